"""Short-horizon direction forecasts: three models, adaptive weights, calibration, walk-forward accuracy.

Everything at a bar uses bars up to it only, so one pass of windows gives the
forecast of every prefix; outcomes come from ``lead``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clamp, normal_cdf
from barloom.operators.signals import score
from barloom.sources.bars import KEY, series
from barloom.sources.scratch import settled

HORIZONS = (1, 5, 20)
MODELS = ("signal", "drift", "regime")
# Prior weights, look-back, decay and softmax temperature.
PRIOR = {"signal": 0.4, "drift": 0.35, "regime": 0.25}
LOOKBACK, HALF_LIFE, TEMPERATURE, LEAST = 80, 100, 0.08, 30
BINS, SMOOTHING = 10, 2


def model_stats(scored: DataFrame) -> DataFrame:
    """Adds volatility, drift, autocorrelation, regime return and signal bias of every bar (last ``LOOKBACK`` returns).

    Steps from or to a price that is not positive have no return: they are left out and
    the look-back reaches that much further back.  ``__j`` counts returns, and frames
    over its range hold exactly the last ones, also at bars without a return.
    """
    w = series()
    before = F.lag("c").over(w)
    ret = F.when((F.col("c") > 0) & (before > 0), F.ln(F.when(F.col("c") > 0, F.col("c")) / F.when(before > 0, before)))
    r = scored.withColumn("i", F.row_number().over(w)).withColumn("ret", ret)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__j", F.count("ret").over(w)).withColumn("__before", F.last("ret", True).over(earlier)).withColumn("__last", F.last("ret", True).over(w))
    by = Window.partitionBy(*KEY).orderBy("__j")
    frame, pairs = by.rangeBetween(-(LOOKBACK - 1), 0), by.rangeBetween(-(LOOKBACK - 2), 0)
    r = r.withColumn("__n", F.count("ret").over(frame)).withColumn("__mean", F.avg("ret").over(frame)).withColumn("__sd", F.coalesce(F.stddev_pop("ret").over(frame), F.lit(0.0)))
    x = F.when(F.col("ret").isNotNull(), F.col("__j").cast("double"))
    r = r.withColumn("__x", x).withColumn("__mx", F.avg("__x").over(frame)).withColumn("__cov", F.covar_pop("ret", "__x").over(frame)).withColumn("__vx", F.var_pop("__x").over(frame))
    slope = F.when(F.col("__vx") > 0, F.try_divide(F.col("__cov"), F.col("__vx"))).otherwise(0.0)
    drift = F.when(F.col("__n") < 3, F.coalesce("__mean", F.lit(0.0))).otherwise(F.col("__mean") + slope * (F.col("__j") + 1 - F.col("__mx")))
    both = F.col("ret").isNotNull() & F.col("__before").isNotNull()
    r = r.withColumn("__a", F.when(both, F.col("ret"))).withColumn("__b", F.when(both, F.col("__before")))
    r = r.withColumn("__cab", F.covar_pop("__a", "__b").over(pairs)).withColumn("__va", F.var_pop("__a").over(pairs)).withColumn("__vb", F.var_pop("__b").over(pairs))
    rho = F.when((F.col("__n") > 2) & (F.col("__va") * F.col("__vb") > 0), clamp(F.try_divide(F.col("__cab"), F.sqrt(F.col("__va") * F.col("__vb"))), -1, 1)).otherwise(0.0)
    r = r.withColumn("volatility", F.greatest(F.col("__sd"), F.abs(F.coalesce("__mean", F.lit(0.0))), F.lit(1e-6))).withColumn("drift_move", drift).withColumn("autocorrelation", rho)
    r = r.withColumn("regime_move", F.coalesce("__last", F.lit(0.0)) * F.col("autocorrelation")).withColumn("bias", clamp(F.col("score") / 8, -1, 1))
    return r.drop(*(c for c in r.columns if c.startswith("__")))


def _move_probability(move: Column, volatility: Column, horizon: int) -> Column:
    return clamp(normal_cdf(move / F.greatest(volatility * horizon**0.5, F.lit(1e-6))), 0.02, 0.98)


def chances(horizon: int) -> dict[str, Column]:
    """p_signal, p_drift and p_regime of one horizon, from the columns of ``model_stats``."""
    k = min(horizon, 5)
    return {
        "p_signal": clamp(0.5 + F.col("bias") * 0.24 / horizon**0.5, 0.05, 0.95), "p_drift": _move_probability(F.col("drift_move") * horizon, F.col("volatility"), horizon),
        "p_regime": _move_probability(F.col("regime_move") * k, F.col("volatility"), k),
    }


def probabilities(stats: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per bar and horizon: p_signal, p_drift, p_regime (chance of a rise) and the outcome where known."""
    w = series()
    items = [F.struct(F.lit(h).alias("horizon"), *(x.alias(n) for n, x in chances(h).items()), (F.lead("c", h).over(w) > F.col("c")).alias("up")) for h in horizons]
    return stats.withColumn("__x", F.array(*items)).select(*KEY, "t", "i", "c", "score", F.explode("__x").alias("x")).select(*KEY, "t", "i", "c", "score", "x.*")


def performance(probability: DataFrame) -> DataFrame:
    """Hits, totals and decayed accuracy per series, horizon and model, over bars with enough history and a known outcome."""
    known = probability.where((F.col("i") > LOOKBACK) & F.col("up").isNotNull())
    rows = known.select(*KEY, "horizon", "i", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), ((F.col(f"p_{m}") >= 0.5) == F.col("up")).cast("int").alias("hit")) for m in MODELS))).alias("x")).select(*KEY, "horizon", "i", "x.*")
    last = Window.partitionBy(*KEY, "horizon", "model")
    decay = F.pow(F.lit(0.5), (F.max("i").over(last) - F.col("i")) / HALF_LIFE)
    out = rows.withColumn("d", decay).groupBy(*KEY, "horizon", "model").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"), (F.sum(F.col("hit") * F.col("d")) / F.sum("d")).alias("ewma_accuracy"))
    return out.withColumn("accuracy", F.col("hits") / F.col("total"))


def weights(perf: DataFrame) -> DataFrame:
    """Softmax weights per series and horizon; the prior where a model has fewer than ``LEAST`` samples."""
    wide = perf.groupBy(*KEY, "horizon").pivot("model", list(MODELS)).agg(F.first("ewma_accuracy").alias("a"), F.first("total").alias("n"))
    logit = {m: F.ln(F.lit(PRIOR[m])) + (F.col(f"{m}_a") - 0.5) / TEMPERATURE for m in MODELS}
    top = F.greatest(*logit.values())
    parts = {m: F.exp(x - top) for m, x in logit.items()}
    total = sum(parts.values(), F.lit(0.0))
    few = F.least(*(F.coalesce(f"{m}_n", F.lit(0)) for m in MODELS)) < LEAST
    return wide.select(*KEY, "horizon", few.alias("fallback"), *(F.when(few, PRIOR[m]).otherwise(parts[m] / total).alias(f"w_{m}") for m in MODELS))


def prior_weighted(probability: DataFrame) -> DataFrame:
    """Adds ``p_up`` under the prior weights: the forecast without any table of statistics."""
    return probability.withColumn("p_up", clamp(sum((F.col(f"p_{m}") * PRIOR[m] for m in MODELS), F.lit(0.0)), 0.02, 0.98))


def weighted(probability: DataFrame, weight: DataFrame) -> DataFrame:
    """Adds ``p_up``, the weighted and clamped probability."""
    joined = probability.join(weight.drop("fallback"), [*KEY, "horizon"], "left")
    mix = sum((F.col(f"p_{m}") * F.coalesce(F.col(f"w_{m}"), F.lit(PRIOR[m])) for m in MODELS), F.lit(0.0))
    return joined.withColumn("p_up", clamp(mix, 0.02, 0.98)).drop(*(f"w_{m}" for m in MODELS))


def _pooled(raw: Column) -> Column:
    """Adjacent violators pooled: (value, weight) pairs to non-decreasing values, one per bin."""

    def push(blocks: Column, x: Column) -> Column:
        new = F.struct(x["value"].alias("value"), x["weight"].alias("weight"), F.lit(1).alias("n"))
        joined = F.array_append(blocks, new)
        # a block under its predecessor merges with it; BINS - 1 merges are the most that one push can cause
        for _ in range(BINS - 1):
            joined = F.transform(F.array(joined), _merge_last)[0]
        return joined

    blocks = F.aggregate(raw, F.array().cast("array<struct<value:double,weight:double,n:int>>"), push)
    return F.flatten(F.transform(blocks, lambda b: F.array_repeat(clamp(b["value"], 0.01, 0.99), b["n"])))


def _merge_last(blocks: Column) -> Column:
    size = F.size(blocks)
    a, b = F.get(blocks, size - 2), F.get(blocks, size - 1)
    total = a["weight"] + b["weight"]
    both = F.struct(((a["value"] * a["weight"] + b["value"] * b["weight"]) / total).alias("value"), total.alias("weight"), (a["n"] + b["n"]).alias("n"))
    return F.when((size > 1) & (a["value"] > b["value"]), F.array_append(F.slice(blocks, 1, F.greatest(size - 2, F.lit(0))), both)).otherwise(blocks)


def calibration_bins(forecast: DataFrame) -> DataFrame:
    """(series, horizon, bin, n, positives, avg_pred, observed): ten bins of the probability, all present."""
    known = forecast.where((F.col("i") > LOOKBACK) & F.col("up").isNotNull()).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("p_up") * BINS)).cast("int"))
    counted = known.groupBy(*KEY, "horizon", "bin").agg(F.count("*").alias("n"), F.count_if("up").alias("positives"), F.avg("p_up").alias("avg"))
    domain = known.select(*KEY, "horizon").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    middle = (F.col("bin") + 0.5) / BINS
    full = domain.join(counted, [*KEY, "horizon", "bin"], "left").fillna(0, ["n", "positives"])
    observed = F.when(F.col("n") > 0, (F.col("positives") + SMOOTHING * 0.5) / (F.col("n") + SMOOTHING)).otherwise(middle)
    return full.select(*KEY, "horizon", "bin", "n", "positives", F.coalesce("avg", middle).alias("avg_pred"), observed.alias("observed"))


def calibration(forecast: DataFrame) -> DataFrame:
    """(series, horizon, points): per bin its mean prediction x and isotonic frequency y, in order of x."""
    row = F.struct("bin", F.col("observed").alias("value"), F.greatest(F.col("n").cast("double"), F.lit(0.001)).alias("weight"), F.col("avg_pred").alias("x"))
    rows = calibration_bins(forecast).groupBy(*KEY, "horizon").agg(F.array_sort(F.collect_list(row)).alias("b"))  # ten entries
    y = _pooled(F.col("b"))
    return rows.withColumn("y", y).select(*KEY, "horizon", F.array_sort(F.zip_with("b", "y", lambda b, v: F.struct(b["x"].alias("x"), v.alias("y")))).alias("points"))


def calibrated(forecast: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``p_calibrated``: linear between the points, constant beyond them; unchanged without a table."""
    joined = forecast.join(table, [*KEY, "horizon"], "left")
    p, pts = F.col("p_up"), F.col("points")
    below, above = F.filter(pts, lambda q: q["x"] <= p), F.filter(pts, lambda q: q["x"] >= p)
    left, right = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = left["y"] + (right["y"] - left["y"]) * (p - left["x"]) / F.greatest(right["x"] - left["x"], F.lit(1e-6))
    value = F.when(pts.isNull(), p).when(left.isNull(), right["y"]).when(right.isNull(), left["y"]).otherwise(clamp(between, 0.01, 0.99))
    return joined.withColumn("p_calibrated", value).drop("points")


def forecasts(bars: DataFrame) -> DataFrame:
    """Weighted and calibrated forecasts of every bar and horizon (in-sample weights and calibration)."""
    mixed = settled(mixed_forecasts(bars))
    return calibrated(mixed, calibration(mixed))


def mixed_forecasts(bars: DataFrame) -> DataFrame:
    """Weighted forecasts of every bar and horizon; the probabilities are computed once for weights and mixing."""
    probability = settled(probabilities(model_stats(score(bars))))
    return weighted(probability, weights(performance(probability)))


def walk_forward(forecast: DataFrame, cutoffs: int = 300, p: str = "p_up") -> DataFrame:
    """Hits and totals per series and horizon over the last ``cutoffs`` bars before the newest whose outcome is known.

    ``forecast`` has every bar of a series.  A horizon of h has at most ``cutoffs`` - h + 1
    outcomes, as the bars behind the last cutoffs are few.
    """
    newest = forecast.groupBy(*KEY).agg(F.max("i").alias("__newest"))
    known = forecast.join(newest, list(KEY)).where((F.col("i") > LOOKBACK) & F.col("up").isNotNull() & (F.col("i") >= F.col("__newest") - cutoffs))
    out = known.groupBy(*KEY, "horizon").agg(F.count_if((F.col(p) >= 0.5) == F.col("up")).alias("hits"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.col("hits") / F.col("total"))


def accuracy_of_weights(perf: DataFrame, weight: DataFrame) -> DataFrame:
    """(series, horizon, accuracy): the models' decayed accuracies (plain ones where none), mixed by their weights."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"w_{m}").alias("w")) for m in MODELS))).alias("x")
    rows = weight.select(*KEY, "horizon", each).select(*KEY, "horizon", "x.*").join(perf, [*KEY, "horizon", "model"])
    used = rows.withColumn("a", F.coalesce("ewma_accuracy", "accuracy")).where("a is not null and w > 0")
    return used.groupBy(*KEY, "horizon").agg(clamp(F.sum(F.col("a") * F.col("w")) / F.sum("w"), 0, 1).alias("accuracy"))


def expected_prices(stats: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Expected price, and bands of 1 and 2 ATR times the root of the horizon around it, not under 0; per bar and horizon.

    The expected move mixes what the signal says of direction, in units of volatility,
    with the drift and the regime.
    """
    least = F.greatest(F.abs("c") * 0.001, F.lit(0.00001))
    range_ = F.when(F.col("atr_latest") > 0, F.col("atr_latest")).otherwise(least)
    items = []
    for h in horizons:
        p_signal = clamp(0.5 + F.col("bias") * 0.24 / h**0.5, 0.05, 0.95)
        move = 0.25 * (p_signal - 0.5) * 2 * F.col("volatility") * h**0.5 + 0.45 * F.col("drift_move") * h + 0.3 * F.col("regime_move") * min(h, 5)
        items.append(F.struct(F.lit(h).alias("horizon"), (F.col("c") * F.exp(move)).alias("expected"), (range_ * h**0.5).alias("width")))
    rows = stats.select(*KEY, "t", F.explode(F.array(*items)).alias("x")).select(*KEY, "t", "x.*")
    band = lambda k: [F.greatest(F.lit(0.0), F.col("expected") - k * F.col("width")), F.col("expected") + k * F.col("width")]
    return rows.select(*KEY, "t", "horizon", "expected", *(c.alias(n) for c, n in zip(band(1) + band(2), ("low", "high", "low2", "high2"), strict=True)))


def reconcile_journal(journal: DataFrame, bars: DataFrame) -> DataFrame:
    """Journal (symbol, tf, t, horizon, p_up) with the outcome of entries whose horizon has passed."""
    w = series()
    items = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead("c", h).over(w).alias("later")) for h in HORIZONS))
    later = bars.withColumn("__x", items).select(*KEY, "t", "c", F.explode("__x").alias("x")).select(*KEY, "t", "c", "x.*")
    joined = journal.join(later, [*KEY, "t", "horizon"], "left")
    return joined.withColumn("outcome", F.col("later") > F.col("c")).withColumn("hit", (F.col("p_up") >= 0.5) == F.col("outcome")).drop("c", "later")


def journal_summary(journal: DataFrame) -> DataFrame:
    return journal.groupBy("horizon").agg(F.count("*").alias("entries"), F.count("hit").alias("resolved"), F.count_if("hit").alias("hits")).withColumn("accuracy", F.try_divide(F.col("hits"), F.col("resolved")))
