"""Signal score of every bar, swings, support and resistance, candle and chart patterns, timeframe alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clamp
from barloom.operators import indicators as ind
from barloom.operators import recurrent as rec
from barloom.operators.conditions import crossed
from barloom.sources.bars import KEY, series

VOTES = ("vote_sma", "vote_rsi", "vote_macd", "vote_band", "vote_cloud", "vote_support", "vote_resistance")


def pivots(bars: DataFrame, strength: int = 2) -> DataFrame:
    """pivot_high, pivot_low: the price where a bar is a strict extreme of ``strength`` bars on both sides, else null."""
    w = series()
    sides = [w.rowsBetween(-strength, -1), w.rowsBetween(1, strength)]
    whole = (F.count("t").over(sides[0]) == strength) & (F.count("t").over(sides[1]) == strength)
    high = whole & (F.col("h") > F.greatest(*(F.max("h").over(s) for s in sides)))
    low = whole & (F.col("l") < F.least(*(F.min("l").over(s) for s in sides)))
    return bars.withColumn("pivot_high", F.when(high, F.col("h"))).withColumn("pivot_low", F.when(low, F.col("l")))


def swing_levels(bars: DataFrame, lookback: int = 120, strength: int = 2) -> DataFrame:
    """support and resistance of every bar, and ``near_pct`` within which they count as near.

    The newest pivot low at or under the close and the newest pivot high at or over
    it, among pivots whose neighbours lie inside the look-back; without any pivot, the
    extreme of the look-back before the bar.
    """
    w = series()
    inside = w.rowsBetween(-(lookback - 1 - strength), -strength)
    found = ind.latest_atr(pivots(bars, strength)).withColumn("__i", F.row_number().over(w))
    found = found.withColumn("__hs", F.collect_list("pivot_high").over(inside)).withColumn("__ls", F.collect_list("pivot_low").over(inside))
    past = w.rowsBetween(-(lookback - 1), -1)
    highs = F.when(F.size("__hs") == 0, F.array(F.max("h").over(past))).otherwise(F.col("__hs"))
    lows = F.when(F.size("__ls") == 0, F.array(F.min("l").over(past))).otherwise(F.col("__ls"))
    found = found.withColumn("__hs", highs).withColumn("__ls", lows)
    found = found.withColumn("support", F.try_element_at(F.filter("__ls", lambda x: x <= F.col("c")), F.lit(-1))).withColumn("resistance", F.try_element_at(F.filter("__hs", lambda x: x >= F.col("c")), F.lit(-1)))
    share = F.when((F.col("atr_latest") > 0) & (F.col("c") != 0), F.abs(F.try_divide(F.col("atr_latest"), F.col("c")))).otherwise(0.002)
    return found.withColumn("near_pct", clamp(share * 0.75, 0.0015, 0.012)).drop("__i", "__hs", "__ls", "pivot_high", "pivot_low", "tr", "atr_latest")


def score(bars: DataFrame, flat_rsi: bool = False) -> DataFrame:
    """Bars with the seven votes, ``score`` (their sum) and ``ratio`` (score over possible votes, at least 4).

    ``flat_rsi`` chooses the index that calls a flat series 50 (the display variant);
    the model variant calls it 100.  ``score_flat`` and ``ratio_flat`` are those of the
    display variant in either case, so one pass serves both.
    """
    name = "rsi" if flat_rsi else "rsi_noflat"
    lines = {"macd": "double", "macd_signal": "double", "macd_hist": "double"}
    base = rec.fused(bars, [(lambda: rec.Rsi(14, True), ["c"], {"rsi": "double"}), (lambda: rec.Rsi(14, False), ["c"], {"rsi_noflat": "double"}), (lambda: rec.Macd(12, 26, 9), ["c"], lines)])
    full = swing_levels(ind.ichimoku(ind.bollinger(ind.sma(ind.sma(base, 20), 50))))
    sign = lambda up, down, weight=1: F.when(F.coalesce(up, F.lit(False)), weight).when(F.coalesce(down, F.lit(False)), -weight).otherwise(0)
    top, bottom = F.when(F.col("span_a").isNotNull() & F.col("span_b").isNotNull(), F.greatest("span_a", "span_b")), F.when(F.col("span_a").isNotNull() & F.col("span_b").isNotNull(), F.least("span_a", "span_b"))
    i = F.row_number().over(series())
    away = lambda x: F.try_divide(F.abs(F.col(x) - F.col("c")), F.abs("c"))
    votes = {
        "vote_sma": sign(crossed("sma20", "sma50", True), crossed("sma20", "sma50", False), 2),
        "vote_rsi": sign(F.col(name) <= 30, F.col(name) >= 70),
        "__vote_flat": sign(F.col("rsi") <= 30, F.col("rsi") >= 70),
        "vote_macd": sign(crossed("macd", "macd_signal", True), crossed("macd", "macd_signal", False)),
        "vote_band": sign(F.col("c") > F.col("bb_upper"), F.col("c") < F.col("bb_lower")),
        "vote_cloud": sign(F.col("c") > top, F.col("c") < bottom),
        "vote_support": F.when((i >= 12) & (away("support") <= F.col("near_pct")), 1).otherwise(0),
        "vote_resistance": F.when((i >= 12) & (away("resistance") <= F.col("near_pct")), -1).otherwise(0),
    }
    for vote, value in votes.items():
        full = full.withColumn(vote, F.when(i > 1, value).otherwise(0))
    total, most = sum((F.col(v) for v in VOTES), F.lit(0)), sum((F.abs(v) for v in VOTES), F.lit(0))
    flat, most_flat = total - F.col("vote_rsi") + F.col("__vote_flat"), most - F.abs("vote_rsi") + F.abs("__vote_flat")
    ratio = lambda x, y: clamp(x / F.greatest(F.lit(4), y), -1, 1)
    full = full.withColumn("score", total).withColumn("ratio", ratio(total, most)).withColumn("score_flat", flat).withColumn("ratio_flat", ratio(flat, most_flat))
    return full.drop("__vote_flat", "rsi_noflat" if flat_rsi else "rsi")


def rating(score: Column) -> Column:
    """Five grades of a score."""
    return F.when(score <= -4, "strong_sell").when(score <= -1, "sell").when(score < 1, "neutral").when(score < 4, "buy").otherwise("strong_buy")


def direction(score: Column) -> Column:
    return F.when(score > 0, "bullish").when(score < 0, "bearish").otherwise("neutral")


def alignment(main: Column, other: Column) -> Column:
    """Whether two scores agree in sign; neutral if either has none."""
    return F.when((main == 0) | (other == 0), "neutral").when(F.signum(main) == F.signum(other), "aligned").otherwise("diverged")


def candle_patterns(bars: DataFrame) -> DataFrame:
    """Rows (symbol, tf, t, pattern, direction, strength) of one-, two- and three-bar shapes."""
    w, tick = series(), 1e-9

    def shape(k: int) -> dict[str, Column]:
        o, h, lo, c = (F.lag(x, k).over(w) if k else F.col(x) for x in "ohlc")
        body, span = F.abs(c - o), F.greatest(h - lo, F.lit(tick))
        return {"o": o, "c": c, "body": body, "span": span, "upper": h - F.greatest(o, c), "lower": F.least(o, c) - lo, "share": body / span, "high": F.greatest(o, c), "low": F.least(o, c), "h": h, "l": lo}

    now, one, two = shape(0), shape(1), shape(2)
    real = now["span"] > tick
    pin = lambda long, other, at: real & (long >= F.greatest(now["body"] * 2.2, now["span"] * 0.52)) & (other <= now["span"] * 0.28) & at
    up_pin = pin(now["lower"], now["upper"], now["c"] >= now["l"] + now["span"] * 0.55)
    down_pin = pin(now["upper"], now["lower"], now["c"] <= now["h"] - now["span"] * 0.55)
    around = (now["high"] >= one["high"]) & (now["low"] <= one["low"]) & (now["body"] > one["body"] * 0.9)
    bull, bear = lambda s: s["c"] > s["o"], lambda s: s["c"] < s["o"]
    star = (two["share"] >= 0.48) & (one["share"] <= 0.32) & (one["body"] < two["body"] * 0.75) & (now["share"] >= 0.42)
    middle = (two["o"] + two["c"]) / 2
    up_engulf, down_engulf = bear(one) & bull(now) & around, bull(one) & bear(now) & around
    up_star, down_star = bear(two) & star & bull(now) & (now["c"] > middle), bull(two) & star & bear(now) & (now["c"] < middle)
    big = lambda cond: F.when(cond, 3).otherwise(2)
    item = lambda name, way, when, strength: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("pattern"), F.lit(way).alias("direction"), F.lit(strength).alias("strength") if isinstance(strength, int) else strength.alias("strength")))
    found = F.array_compact(F.array(
        item("pinbar-bullish", "bullish", up_pin, big(now["lower"] >= now["span"] * 0.68)), item("pinbar-bearish", "bearish", ~F.coalesce(up_pin, F.lit(False)) & down_pin, big(now["upper"] >= now["span"] * 0.68)),
        item("doji", "neutral", real & (now["share"] <= 0.1), 1),
        item("engulfing-bullish", "bullish", up_engulf, big(now["body"] > one["body"] * 1.35)), item("engulfing-bearish", "bearish", down_engulf, big(now["body"] > one["body"] * 1.35)),
        item("morning-star", "bullish", up_star, big(now["c"] >= two["o"])), item("evening-star", "bearish", down_star, big(now["c"] <= two["o"])),
    ))
    return bars.withColumn("__x", found).select(*KEY, "t", F.explode("__x").alias("x")).select(*KEY, "t", "x.*")


def swings(bars: DataFrame, strength: int = 2) -> DataFrame:
    """Rows (symbol, tf, t, i, kind, price): pivots, where runs of one kind keep their most extreme (the first on a tie)."""
    points = pivots(bars, strength).withColumn("i", F.row_number().over(series()))
    both = F.array_compact(F.array(F.when(F.col("pivot_low").isNotNull(), F.struct(F.lit("low").alias("kind"), F.col("pivot_low").alias("price"))), F.when(F.col("pivot_high").isNotNull(), F.struct(F.lit("high").alias("kind"), F.col("pivot_high").alias("price")))))
    rows = points.select(*KEY, "t", "i", F.explode(both).alias("x")).select(*KEY, "t", "i", "x.*")
    order = Window.partitionBy(*KEY).orderBy("i", "price")
    run = rows.withColumn("new", F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    extreme = F.struct(F.when(F.col("kind") == "high", -F.col("price")).otherwise(F.col("price")), "i")
    return run.groupBy(*KEY, "run", "kind").agg(F.min_by(F.struct("t", "i", "price"), extreme).alias("x")).select(*KEY, "run", "kind", "x.*")


def chart_patterns(bars: DataFrame, strength: int = 2) -> DataFrame:
    """Rows (symbol, tf, t, pattern, direction, strength): double tops and bottoms, head and shoulders, over whole series."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("t"))
    newest = ind.latest_atr(bars).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    tolerance = F.greatest(F.coalesce("atr_latest", F.lit(0.0)) * 0.8, F.abs("c") * 0.0012, F.lit(0.00001))
    w = Window.partitionBy(*KEY).orderBy("run")
    s = swings(bars, strength).join(newest.select(*KEY, tolerance.alias("tol")), list(KEY))
    p = [F.col("price"), *(F.lead("price", k).over(w) for k in range(1, 5))]
    end = [F.col("t"), *(F.lead("t", k).over(w) for k in range(1, 5))]
    s = s.select(*KEY, "kind", "tol", *(x.alias(f"p{k}") for k, x in enumerate(p)), *(x.alias(f"t{k}") for k, x in enumerate(end)))
    c = F.col
    sign = F.when(c("kind") == "high", 1.0).otherwise(-1.0)
    near = lambda a, b, k: F.abs(c(a) - c(b)) <= c("tol") * k
    depth = F.least(sign * c("p0"), sign * c("p2")) - sign * c("p1")
    double = near("p0", "p2", 1.0) & (depth >= c("tol") * 1.25)
    over = sign * c("p2") - F.greatest(sign * c("p0"), sign * c("p4"))
    head = (over >= c("tol")) & near("p0", "p4", 1.8) & near("p1", "p3", 2.5)
    top = c("kind") == "high"
    way = F.when(top, "bearish").otherwise("bullish").alias("direction")
    found = F.array_compact(F.array(
        F.when(F.coalesce(double, F.lit(False)), F.struct(c("t2").alias("t"), F.when(top, "double-top").otherwise("double-bottom").alias("pattern"), way, F.when(depth >= c("tol") * 2.5, 3).otherwise(2).alias("strength"))),
        F.when(F.coalesce(head, F.lit(False)), F.struct(c("t4").alias("t"), F.when(top, "head-shoulders").otherwise("inverse-head-shoulders").alias("pattern"), way, F.when(over >= c("tol") * 2, 3).otherwise(2).alias("strength"))),
    ))
    return s.select(*KEY, F.explode(found).alias("x")).select(*KEY, "x.*")


def patterns(bars: DataFrame) -> DataFrame:
    """Candle and chart patterns together."""
    return candle_patterns(bars).unionByName(chart_patterns(bars))


def newest_patterns(bars: DataFrame, lookback: int = 120) -> DataFrame:
    """Patterns that end within the last ``lookback`` bars of every series, chart patterns of these bars alone.

    A pattern that is found again at the same bar counts once, at its greatest strength;
    ``place`` orders a series' patterns from the newest, then from the strongest.
    """
    newest = Window.partitionBy(*KEY).orderBy(F.desc("t"))
    late = bars.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= lookback).drop("__n")
    since = late.groupBy(*KEY).agg(F.min("t").alias("__since"))
    candles = candle_patterns(bars).join(since, list(KEY)).where(F.col("t") >= F.col("__since")).drop("__since")
    found = candles.unionByName(chart_patterns(late)).groupBy(*KEY, "t", "pattern", "direction").agg(F.max("strength").alias("strength"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("t"), F.desc("strength"), "pattern")
    return found.withColumn("place", F.row_number().over(order))


LEVEL = "symbol string, tf string, price double, direction string, touches int, strength double, distance double, last_touch long"


def clustered(points: list[tuple[float, int, int]], close: float, atr: float | None, lookback: int) -> list[tuple]:
    """Clusters (-strength, distance, price, touches, last touch) of swing points (price, age, time), the strongest first."""
    size = abs(close)
    wide = atr if atr is not None else max(size * 0.0015, 1e-5)
    tolerance = max(max(size * 0.0004, 1e-5), min(max(size * 0.02, 5e-5), wide * 0.65))
    half_life, clusters = max(20, lookback // 3), []
    for price, age, t in sorted(points, key=lambda x: (x[0], x[2])):
        weight = 0.5 ** (age / half_life)
        own = clusters[-1] if clusters else None  # prices ascend: a cluster that one has passed is out of reach of all later ones
        if own is None or abs(price - own[0] / own[1]) > tolerance:
            own = [0.0, 0.0, 0, t]
            clusters.append(own)
        own[0] += price * weight
        own[1] += weight
        own[2] += 1
        own[3] = max(own[3], t)
    return sorted((-x[2] * x[1], abs(x[0] / x[1] - close), x[0] / x[1], x[2], x[3]) for x in clusters)


def levels(bars: DataFrame, lookback: int = 240, strength: int = 2, most: int = 8) -> DataFrame:
    """Support and resistance clusters of the newest ``lookback`` bars.

    Swings in order of price join the first cluster whose recency-weighted mean lies
    within the tolerance.  The order-dependent fold runs over at most 2 * lookback
    swings of a series.
    """
    order = Window.partitionBy(*KEY).orderBy(F.desc("t"))
    recent = ind.latest_atr(bars.withColumn("age", F.row_number().over(order) - 1).where(F.col("age") < lookback))
    now = recent.where("age = 0").select(*KEY, F.col("c").alias("close"), F.col("atr_latest").alias("atr"))
    points = pivots(recent, strength).where("pivot_high is not null or pivot_low is not null").join(now, list(KEY))
    low_high = F.array_compact(F.array("pivot_low", "pivot_high"))
    rows = points.select(*KEY, "t", "age", "close", "atr", F.explode(low_high).alias("price"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        symbol, tf, close, atr = (frame[c].iloc[0] for c in ("symbol", "tf", "close", "atr"))
        found = clustered(list(zip(frame["price"], frame["age"], frame["t"])), close, None if atr != atr else atr, lookback)
        out = [(symbol, tf, price, "resistance" if price >= close else "support", touches, -strength, distance, last) for strength, distance, price, touches, last in found]
        return pd.DataFrame(out[: max(1, most)], columns=[c.strip().split(" ")[0] for c in LEVEL.split(",")])

    return rows.groupBy(*KEY).applyInPandas(fold, LEVEL)


def fibonacci(high: Column, low: Column) -> Column:
    """Array of (ratio, price) retracements from high to low."""
    ratios = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
    return F.array(*(F.struct(F.lit(r).alias("ratio"), (high - (high - low) * r).alias("price")) for r in ratios))
