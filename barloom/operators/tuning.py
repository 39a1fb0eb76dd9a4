"""The tuning job: every candidate (symbol, entry rule, timeframe) with its whole grid, gates, quarters and report.

Signals of all rules of a timeframe are columns of one plan, so the recurrences of all
rules run in one scan; they are exploded into one signal set per rule, and each rule's
grid is stepped over it in chunks of runs.  Optimisation and validation segments are
part of the series key.  Of every candidate only the selected row goes into the quarters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import backtest, conditions, grid
from barloom.operators.supplement import magic_number
from barloom.sources.bars import KEY
from barloom.sources.scratch import settled


@dataclass(frozen=True)
class Profile:
    """An entry rule with its timeframes, whether opposite signals close, and its ranges (lowest, highest, number of values) in pips."""

    condition: dict
    timeframes: tuple[str, str]
    opposite: bool
    stops: tuple[float, float, int]
    targets: tuple[float, float, int]
    trailing: tuple[float | None, ...]

    def grid(self) -> tuple[list[float], list[float]]:
        return tuple(grid.values(a, z, (z - a) / max(1, n - 1)) for a, z, n in (self.stops, self.targets))


# The 18 entry profiles, the sessions, what a reference should span, and the money of a run.
PROFILES = {
    "maCross": Profile({"type": "maCross", "fast_type": "ema", "fast": 20, "slow_type": "ema", "slow": 50}, ("h1", "h4"), True, (20, 80, 6), (30, 150, 6), (None, 20)),
    "rsi": Profile({"type": "rsi", "period": 14, "threshold": 30, "comparison": "below"}, ("m30", "h1"), False, (10, 50, 6), (15, 75, 6), (None,)),
    "bollinger": Profile({"type": "bollinger", "period": 20, "multiplier": 2, "mode": "break", "band": "upper"}, ("m30", "h1"), False, (15, 75, 6), (25, 125, 6), (None, 20)),
    "macdCross": Profile({"type": "macdCross", "fast": 12, "slow": 26, "signal": 9}, ("h1", "h4"), True, (20, 80, 6), (30, 150, 6), (None, 20)),
    "donchianBreak": Profile({"type": "donchianBreak", "period": 20}, ("h1", "h4"), False, (20, 80, 6), (30, 150, 6), (None, 20)),
    "stochastic": Profile({"type": "stochastic", "k": 14, "d": 3, "smooth": 3, "threshold": 20, "comparison": "crossAbove"}, ("m30", "h1"), False, (15, 60, 6), (20, 100, 6), (None, 15)),
    "ichimokuCross": Profile({"type": "ichimokuCross", "conversion": 9, "base": 26, "span": 52, "shift": 26, "cloud": True}, ("h1", "h4"), True, (20, 80, 6), (30, 150, 6), (None, 20)),
    "keltnerBreak": Profile({"type": "keltnerBreak", "ema": 20, "atr": 10, "multiplier": 2}, ("h1", "h4"), False, (15, 75, 6), (25, 125, 6), (None, 20)),
    "cciBreak": Profile({"type": "cciBreak", "period": 14, "level": 100}, ("m30", "h1"), False, (15, 105, 7), (25, 125, 6), (None, 20)),
    "adxTrend": Profile({"type": "adxTrend", "period": 14, "threshold": 25}, ("h1", "h4"), True, (20, 110, 7), (40, 220, 10), (None, 25)),
    "parabolicSar": Profile({"type": "parabolicSar", "step": 0.02, "maximum": 0.2}, ("h1", "h4"), True, (20, 110, 7), (40, 220, 10), (None, 25)),
    "momentum": Profile({"type": "momentum", "period": 14}, ("h1", "h4"), True, (20, 110, 7), (40, 220, 10), (None, 25)),
    "rvi": Profile({"type": "rvi", "period": 10}, ("h1", "h4"), True, (20, 110, 7), (40, 220, 10), (None, 25)),
    "demarker": Profile({"type": "demarker", "period": 14, "threshold": 0.3, "comparison": "crossAbove"}, ("h1", "h4"), True, (20, 110, 7), (40, 220, 10), (None, 25)),
    "ao": Profile({"type": "ao", "fast": 5, "slow": 34}, ("h1", "h4"), True, (20, 170, 11), (40, 340, 16), (None, 25)),
    "envelope": Profile({"type": "envelope", "period": 14, "deviation": 0.1}, ("h1", "h4"), True, (20, 170, 11), (40, 220, 10), (None, 25)),
    "stochCross": Profile({"type": "stochCross", "k": 14, "d": 3, "smooth": 3}, ("m30", "h1"), True, (20, 110, 7), (40, 220, 10), (None, 25)),
    "alligator": Profile({"type": "alligator", "periods": (13, 8, 5), "shifts": (8, 5, 3)}, ("h1", "h4"), True, (20, 110, 7), (40, 220, 10), (None, 25)),
}
SESSIONS = {"none": ("", ""), "Tokyo": ("00:00", "08:00"), "London": ("07:00", "15:00"), "New York": ("12:00", "20:00")}
REFERENCE_DAYS = 737
MONEY = {"mode": "fixedRisk", "balance": 1_000_000.0, "fixed_lot": 0.1, "risk_pct": 1.0, "max_lot": 100.0}

CANDIDATE = ("symbol", "kind", "tf")


def chosen(kinds: list[str] | None = None, timeframes: list[str] | None = None) -> dict[str, Profile]:
    """Profiles of the rules and timeframes asked for; nothing or an empty list asks for all.

    Names are taken in any case; an unknown one is refused with the known ones.
    """

    def known(asked: list[str] | None, names: list[str], what: str) -> set[str]:
        by = {n.lower(): n for n in names}
        for x in asked or ():
            if x.lower() not in by:
                raise ValueError(f"no such {what}: {x}; known are {', '.join(names)}")
        return {by[x.lower()] for x in asked} if asked else set(names)

    frames = list(dict.fromkeys(tf for p in PROFILES.values() for tf in p.timeframes))
    kinds, times = known(kinds, list(PROFILES), "entry rule"), known(timeframes, frames, "timeframe")
    return {k: p for k, p in PROFILES.items() if k in kinds and times & set(p.timeframes)}


def runs_of(profiles: dict[str, Profile], sessions: tuple[str, ...] = ("none",), spread: float = 0.5) -> list[dict]:
    """Run rows of every profile's grid in order: stop, target, trailing stop, session; ``run_key`` is the rule."""
    out = []
    for kind, p in profiles.items():
        stops, targets = p.grid()
        for k, (stop, target, trailing, session) in enumerate(product(stops, targets, p.trailing, sessions)):
            row = grid.run(f"{kind}-{k:05d}", stop, target, trailing, *SESSIONS[session], close_on_opposite=p.opposite, spread_pips=spread, **MONEY)
            out.append(row | {"run_key": kind})
    return out


def run_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in backtest.RUN.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in (*names, "run_key")) for r in rows], backtest.RUN + ", run_key string")


def signal_sets(bars: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """Bars with run_key, long and short, once per rule; all rules' features are computed in one plan."""
    out, sets = conditions.with_recurrences(bars, [p.condition for p in profiles.values()]), []
    for kind, p in profiles.items():
        out, up, down = conditions.compile_condition(out, p.condition)
        sets.append(F.struct(F.lit(kind).alias("run_key"), up.alias("long"), down.alias("short")))
    # window functions are not allowed inside a generator
    return out.select(*bars.columns, F.array(*sets).alias("__sets")).select(*bars.columns, F.inline("__sets"))


def of_timeframe(profiles: dict[str, Profile], tf: str) -> dict[str, Profile]:
    return {k: p for k, p in profiles.items() if tf in p.timeframes}


def combinations(bars: dict[str, DataFrame], profiles: dict[str, Profile], sessions: tuple[str, ...] = ("none",), spread: float = 0.5, pip: float | None = None) -> DataFrame:
    """Hold-out metrics, gates and ranks of every combination of every candidate.

    ``bars`` has the reference bars of each timeframe.  Columns: candidate, run_id and its
    parameters, those of ``grid.gated`` with the profit-factor reason, passed, rank and selected.
    """
    spark = next(iter(bars.values())).sparkSession
    runs = settled(run_table(spark, runs_of(profiles, sessions, spread)))
    parts = []
    for tf, own in bars.items():
        mine = of_timeframe(profiles, tf)
        if mine:
            parts.append(settled(signal_sets(grid.by_segment(grid.hold_out(own), "segment"), mine)))
    simulated = backtest.simulate(reduce(DataFrame.unionByName, parts), runs, pip, equity=False)
    gates = grid.gated(backtest.metrics(settled(simulated)))
    factor = F.when(F.coalesce(F.col("opt_profit_factor"), F.lit(0.0)) < 1, "opt_factor")
    gates = gates.withColumn("reasons", F.array_compact(F.concat("reasons", F.array(factor)))).withColumn("passed", F.size("reasons") == 0).drop("eligible")
    named = gates.join(runs.select("run_id", F.col("run_key").alias("kind"), "stop_pips", "target_pips", "trailing_pips", "session_start", "session_end"), "run_id")
    order = Window.partitionBy(*CANDIDATE).orderBy(F.desc("opt_net_yen"), "opt_max_drawdown_yen", "run_id")
    ranked = named.withColumn("rank", F.row_number().over(order))
    best = Window.partitionBy(*CANDIDATE)
    return ranked.withColumn("selected", F.col("passed") & (F.col("rank") == F.min(F.when(F.col("passed"), F.col("rank"))).over(best)))


def quarters(bars: dict[str, DataFrame], combos: DataFrame, profiles: dict[str, Profile], sessions: tuple[str, ...] = ("none",), spread: float = 0.5, pip: float | None = None) -> DataFrame:
    """(candidate, run_id, quarter, bars, trades, net_yen, profit_factor) of every selected row over the quarters of its reference."""
    spark = next(iter(bars.values())).sparkSession
    key = F.concat_ws("|", "kind", "symbol", "tf")
    runs = run_table(spark, runs_of(profiles, sessions, spread)).drop("run_key").join(combos.where("selected").select(*CANDIDATE, "run_id", key.alias("run_key")), "run_id")
    parts, sizes = [], []
    for tf, own in bars.items():
        mine = of_timeframe(profiles, tf)
        if mine:
            split = grid.by_segment(grid.quarters(own), "quarter")
            parts.append(settled(signal_sets(split, mine)).withColumn("run_key", F.concat_ws("|", "run_key", "symbol", F.lit(tf))))
            sizes.append(split.groupBy(*KEY).agg(F.count("*").alias("bars")))
    runs = settled(runs)
    signals = settled(reduce(DataFrame.unionByName, parts).join(runs.select("run_key").distinct(), "run_key", "left_semi"))
    found = backtest.metrics(backtest.simulate(signals, runs.drop(*CANDIDATE), pip, equity=False)).join(reduce(DataFrame.unionByName, sizes), list(KEY))
    place = F.split("tf", "/")
    named = found.withColumn("quarter", place[1].cast("int")).withColumn("tf", place[0])
    return named.join(runs.select(*CANDIDATE, "run_id"), ["symbol", "tf", "run_id"]).select(*CANDIDATE, "run_id", "quarter", "bars", "trades", "net_yen", "profit_factor")


def demoted(combos: DataFrame, quarter_rows: DataFrame) -> DataFrame:
    """Combinations with the positive quarters of the selected ones; an unstable one is rejected, and no other takes its place."""
    positive = quarter_rows.groupBy(*CANDIDATE, "run_id").agg(F.count_if(F.col("net_yen") > 0).alias("positive_quarters"))
    out = combos.join(positive, [*CANDIDATE, "run_id"], "left").withColumn("positive_quarters", F.when(F.col("selected"), F.coalesce("positive_quarters", F.lit(0))))
    unstable = F.coalesce(F.col("positive_quarters") < grid.LEAST_QUARTERS, F.lit(False))
    out = out.withColumn("reasons", F.array_compact(F.concat("reasons", F.array(F.when(unstable, "quarters")))))
    return out.withColumn("passed", F.col("passed") & ~unstable).withColumn("adopted", F.col("selected") & ~unstable).drop("selected")


def windows(bars: dict[str, DataFrame]) -> DataFrame:
    """(symbol, tf, reference, opt and val bars, span in days, whether it reaches ``REFERENCE_DAYS``)."""
    each = [grid.hold_out(own) for own in bars.values()]
    out = reduce(DataFrame.unionByName, each).groupBy(*KEY).agg(
        F.count("*").alias("reference_bars"), F.count_if(F.col("segment") == "opt").alias("opt_bars"), F.count_if(F.col("segment") == "val").alias("val_bars"), ((F.max("t") - F.min("t")) / 86400).alias("span_days")
    )
    return out.withColumn("short_reference", F.col("span_days") < REFERENCE_DAYS)


def report(combos: DataFrame, window: DataFrame, profiles: dict[str, Profile], rates: DataFrame | None = None) -> DataFrame:
    """One row per candidate: status, counts, the adopted parameters, why nothing was adopted, its data and warnings.

    ``rates`` (symbol, tf, rate_days, fallback) says of symbols that need a foreign rate how many days
    of it there are and whether it comes from another source; its uncovered share is part of a warning.
    """
    spark = combos.sparkSession
    numbers = [(k, tf, i, j) for i, (k, p) in enumerate(PROFILES.items()) for j, tf in enumerate(p.timeframes) if k in profiles]
    candidates = window.join(F.broadcast(spark.createDataFrame(numbers, "kind string, tf string, kind_no int, tf_no int")), "tf")
    symbols = Window.orderBy("symbol")  # a row per symbol
    order = window.select("symbol").distinct().withColumn("symbol_no", F.row_number().over(symbols) - 1)
    candidates = candidates.join(order, "symbol").withColumn("magic", magic_number(F.col("symbol_no"), F.col("kind_no"), F.col("tf_no"))).drop("kind_no", "tf_no", "symbol_no")
    adopted = lambda c: F.max(F.when(F.col("adopted"), F.col(c))).alias(c)
    counts = combos.groupBy(*CANDIDATE).agg(
        F.count("*").alias("combinations"), F.count_if("passed").alias("passed"), *(adopted(c) for c in ("run_id", "stop_pips", "target_pips", "trailing_pips", "rank", "positive_quarters")), F.max("adopted").alias("adopted")
    )
    why = combos.select(*CANDIDATE, F.explode("reasons").alias("reason")).groupBy(*CANDIDATE, "reason").agg(F.count("*").alias("n"))
    listed = why.groupBy(*CANDIDATE).agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "reason", "n")))).alias("reasons"))  # at most seven reasons
    out = candidates.join(counts, list(CANDIDATE), "left").join(listed, list(CANDIDATE), "left").fillna(0, ["combinations", "passed"])
    taken = F.coalesce("adopted", F.lit(False))
    out = out.withColumn("status", F.when(taken, "passed").otherwise("rejected")).withColumn("reasons", F.when(taken, "").when(F.col("combinations") == 0, "nothing_evaluated:1").otherwise(F.coalesce("reasons", F.lit(""))))
    if rates is None:
        out = out.withColumn("fallback", F.lit(False)).withColumn("uncovered", F.lit(None).cast("double"))
    else:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (REFERENCE_DAYS - F.col("rate_days")) / REFERENCE_DAYS))
        out = out.join(rates, list(KEY), "left").withColumn("fallback", F.coalesce("fallback", F.lit(False))).withColumn("uncovered", F.when(F.col("fallback"), share)).drop("rate_days")
    warned = F.concat_ws(",", F.when(F.col("short_reference"), "reference_span_below_target"), F.when(F.col("fallback"), "usd_jpy_rate_source_fallback"))
    return out.withColumn("warnings", warned).drop("adopted", "short_reference", "fallback")


def summary(reports: DataFrame) -> DataFrame:
    """One row over all candidates: how many were adopted, had too short a reference or a rate from another source."""
    short, fallback = F.col("warnings").contains("reference_span"), F.col("warnings").contains("fallback")
    return reports.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("status") == "passed").alias("passed_candidates"), F.count_if(F.col("status") == "rejected").alias("rejected_candidates"), F.count_if(short).alias("short_references"),
        F.coalesce(F.sum("combinations"), F.lit(0)).alias("combinations"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed_combinations"), F.count_if(fallback).alias("fallback_rates"),
        F.sum("uncovered").alias("uncovered_sum"), F.avg("uncovered").alias("uncovered_mean"), F.max("uncovered").alias("uncovered_most"),
    )


def job(bars: dict[str, DataFrame], kinds: list[str] | None = None, timeframes: list[str] | None = None, sessions: tuple[str, ...] = ("none",), walk_forward: bool = True, spread: float = 0.5, pip: float | None = None, rates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(combinations, report) of all candidates over the reference bars of each timeframe."""
    profiles = chosen(kinds, timeframes)
    frames = {tf.lower() for tf in timeframes} if timeframes else set(bars)
    used = {tf: settled(own) for tf, own in bars.items() if tf in frames and of_timeframe(profiles, tf)}
    profiles = {k: p for k, p in profiles.items() if set(p.timeframes) & set(used)}
    combos = settled(combinations(used, profiles, sessions, spread, pip))
    if walk_forward:
        combos = settled(demoted(combos, quarters(used, combos, profiles, sessions, spread, pip)))
    else:
        combos = combos.withColumn("positive_quarters", F.lit(None).cast("long")).withColumn("adopted", F.col("selected")).drop("selected")
    return combos, report(combos, windows(used), profiles, rates)
