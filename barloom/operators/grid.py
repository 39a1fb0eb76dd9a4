"""Parameter search: grids, hold-out, gates, quarterly stability, reports.

The grid is exploded before the simulation, so every (series, segment, parameter
set) is one independent run; indicators restart on every segment, because the
segment is part of the series key before features are computed.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import backtest, conditions
from barloom.sources.bars import KEY

MOST_COMBINATIONS = 5000
# Hold-out share, gate limits, stability.
HOLD_OUT, LEAST_RATIO, LEAST_TRADES, LEAST_QUARTERS = 0.7, 0.35, 10, 3


def values(low: float, high: float, step: float) -> list[float]:
    """Inclusive range with 0.1 rounding, without repeats; bounds in either order."""
    low, high = min(low, high), max(low, high)
    if step <= 0:
        return [round(low, 1)]
    count = int((high - low) / step + 1e-9)
    return list(dict.fromkeys(backtest.half_up(low + k * step, 1) for k in range(count + 1)))


def combinations(stops: list[float], targets: list[float], trailings: list[float | None], sessions: list[tuple[str, str]] = (("", ""),)) -> list[dict]:
    """The cross product as run rows; more than ``MOST_COMBINATIONS`` are refused before they are built."""
    if len(stops) * len(targets) * len(trailings) * len(sessions) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations")
    return [run(f"{k:05d}", s, t, trailing, *session) for k, (s, t, trailing, session) in enumerate(product(stops, targets, trailings, sessions))]


def run(run_id: str, stop: float, target: float, trailing: float | None = None, start: str = "", end: str = "", **more) -> dict:
    base = {
        "run_id": run_id, "stop_pips": float(stop), "target_pips": float(target), "trailing_pips": None if trailing is None else float(trailing), "close_on_opposite": False, "directions": "long,short",
        "session_start": start, "session_end": end, "session_offset": 0, "mode": "fixedLot", "balance": 1_000_000.0, "fixed_lot": 0.1, "risk_pct": 1.0, "max_lot": 100.0, "spread_pips": 0.5,
    }
    return base | more


def runs(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in backtest.RUN.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], backtest.RUN)


def hold_out(bars: DataFrame, share: float = HOLD_OUT) -> DataFrame:
    """Adds ``segment``: "opt" for the first share of every series (0.05 to 0.95), "val" for the rest."""
    share = min(0.95, max(0.05, share))
    w = Window.partitionBy(*KEY)
    place = F.row_number().over(w.orderBy("t"))
    return bars.withColumn("segment", F.when(place <= F.floor(F.count("*").over(w) * share), "opt").otherwise("val"))


def quarters(bars: DataFrame) -> DataFrame:
    """Adds ``quarter`` 0..3: equal slices of every series' time span, the last inclusive."""
    w = Window.partitionBy(*KEY)
    first, last = F.min("t").over(w), F.max("t").over(w)
    return bars.withColumn("quarter", F.when(last > first, F.least(F.lit(3), F.floor(F.try_divide(4.0 * (F.col("t") - first), last - first)))).otherwise(0).cast("int"))


def by_segment(bars: DataFrame, segment: str) -> DataFrame:
    """Bars whose timeframe key carries the segment, so that nothing looks across segments."""
    return bars.withColumn("tf", F.concat_ws("/", "tf", F.col(segment).cast("string"))).drop(segment)


def search(bars: DataFrame, rules: list[dict], run_rows: DataFrame, pip: float | None = None) -> DataFrame:
    """Metrics of every run and series, ranked within the series by net result, then smaller drawdown."""
    simulated = backtest.simulate(conditions.signals(bars, rules), run_rows, pip, equity=False)
    return ranked(backtest.metrics(simulated))


def ranked(metrics: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("net_yen"), "max_drawdown_yen", "run_id")
    return metrics.withColumn("rank", F.row_number().over(order))


def validation_ratio(opt: Column, val: Column) -> Column:
    """Validation over optimisation result; without an optimisation profit 1 if validation is no worse, else 0."""
    return F.when(opt > 0, val / F.when(opt > 0, opt)).otherwise(F.when(val >= opt, 1.0).otherwise(0.0))


def overfit(opt: Column, val: Column, opt_drawdown: Column, val_drawdown: Column) -> Column:
    """Suspect: the ratio falls short or the drawdown percentage more than doubles; never without an optimisation profit."""
    return F.when(opt <= 0, False).otherwise((validation_ratio(opt, val) < LEAST_RATIO) | (val_drawdown > 2 * opt_drawdown + 5))


def gated(metrics: DataFrame) -> DataFrame:
    """One row per series and run of hold-out metrics, with ratio, reasons (why rejected) and ``eligible``."""
    parts = F.split("tf", "/")
    m = metrics.withColumn("segment", F.get(parts, F.size(parts) - 1)).withColumn("tf", F.get(parts, F.lit(0)))
    values = ("net_yen", "trades", "max_drawdown_pct", "max_drawdown_yen", "profit_factor")
    both = m.groupBy("run_id", *KEY).pivot("segment", ["opt", "val"]).agg(*(F.first(v).alias(v) for v in values))
    for s in ("opt", "val"):
        both = both.fillna(0, [f"{s}_{v}" for v in values])
    o, v = F.col("opt_net_yen"), F.col("val_net_yen")
    both = both.withColumn("ratio", validation_ratio(o, v)).withColumn("overfit", overfit(o, v, F.col("opt_max_drawdown_pct"), F.col("val_max_drawdown_pct")))
    reasons = {"opt_net": o <= 0, "val_net": v <= 0, "val_trades": F.col("val_trades") < LEAST_TRADES, "overfit": F.col("overfit"), "ratio": F.col("ratio") < LEAST_RATIO}
    both = both.withColumn("reasons", F.array_compact(F.array(*(F.when(x, k) for k, x in reasons.items()))))
    return both.withColumn("eligible", F.size("reasons") == 0)


def selected(gates: DataFrame) -> DataFrame:
    """Per series the first eligible run in order of the optimisation result among runs with a profit factor of 1 or more."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("opt_net_yen"), "opt_max_drawdown_yen", "run_id")
    rows = gates.where("opt_profit_factor >= 1").withColumn("opt_rank", F.row_number().over(order)).where("eligible")
    first = Window.partitionBy(*KEY).orderBy("opt_rank")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def rejection_summary(gates: DataFrame) -> DataFrame:
    return gates.select(*KEY, F.explode("reasons").alias("reason")).groupBy(*KEY, "reason").agg(F.count("*").alias("n"))


def stable(quarter_metrics: DataFrame) -> DataFrame:
    """(run_id, symbol, tf, positive_quarters, stable): at least three quarters with a net gain."""
    m = quarter_metrics.withColumn("tf", F.get(F.split("tf", "/"), F.lit(0)))
    return m.groupBy("run_id", *KEY).agg(F.count_if(F.col("net_yen") > 0).alias("positive_quarters")).withColumn("stable", F.col("positive_quarters") >= LEAST_QUARTERS)


def report(gates: DataFrame) -> DataFrame:
    """Counts per symbol: combinations, eligible ones, mean and best ratio."""
    return gates.groupBy("symbol").agg(F.count("*").alias("combinations"), F.count_if("eligible").alias("eligible"), F.avg("ratio").alias("mean_ratio"), F.max("ratio").alias("best_ratio"))
