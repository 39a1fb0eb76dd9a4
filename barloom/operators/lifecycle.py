"""Generations of registered strategies: their days since registration, snapshots at retirement, ledger keys and lanes.

A generation is a strategy id with the second of its registration, ``registered_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import half_up
from barloom.operators import ledger
from barloom.operators.ledger import DAY
from barloom.operators.supplement import retired_profit_factor
from barloom.sources.bars import KEY

SERIES = list(KEY)
RUN = ["run_id", *SERIES]
#: A gap of more days between registration and the first bar means that the source has lost the beginning.
LOST_DAYS = 7
OBSERVED = "obs-"


def _day(second: Column) -> Column:
    return F.floor(second / DAY)


def registered_days(registered: DataFrame, bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Closed UTC days of every registration (run_id, symbol, tf, registered_at), with bars, trades and results.

    They start on the day of registration; where the first bar is more than
    LOST_DAYS later, on the day after it, as its own day may be cut.  The newest day
    is still forming and left out.  A day without bars is a gap of the source and
    left out too, except Saturdays, when markets are closed.  Bars before the
    registration do not count; trades closed by the end of the data do not either.
    """
    of_bars = [F.count("*").alias("bars"), F.min("t").alias("first_bar"), F.max("t").alias("last_bar")]
    dated = bars.select(*KEY, "t", _day(F.col("t")).alias("day"))
    starts = registered.select(*RUN, "registered_at", _day(F.col("registered_at")).alias("start"))
    # whole days are counted once per series, and only the first one per registration
    whole = dated.groupBy(*KEY, "day").agg(*of_bars).join(starts, SERIES).where("day > start")
    first = dated.join(starts.withColumn("day", F.col("start")), [*KEY, "day"]).where("t >= registered_at").groupBy(*RUN, "start", "day").agg(*of_bars)
    seen = whole.select(*RUN, "start", "day", "bars", "first_bar", "last_bar").unionByName(first)
    span = seen.groupBy(*RUN, "start").agg(F.min("day").alias("a"), F.max("day").alias("z"))
    since = F.when(F.col("a") - F.col("start") > LOST_DAYS, F.col("a") + 1).otherwise(F.col("start"))
    spine = span.withColumn("a", since).where("a < z").select(*RUN, F.explode(F.sequence("a", F.col("z") - 1)).alias("day"))
    done = trades.where("exit_reason <> 'end'").groupBy(*RUN, _day(F.col("exit_time")).alias("day")).agg(F.count("*").alias("trades"), half_up(F.sum("net_pips"), 1).alias("net_pips"), half_up(F.sum("net_yen")).alias("net_yen"))
    out = spine.join(seen.drop("start"), [*RUN, "day"], "left").join(done, [*RUN, "day"], "left").fillna(0, ["bars", "trades", "net_pips", "net_yen"])
    return out.where((F.col("bars") > 0) | ((F.col("day") + 4) % 7 == 6))


def final_snapshots(registered: DataFrame, days: DataFrame, trades: DataFrame) -> DataFrame:
    """What the retirement of every registration records: trades, profit factor, result and confirmed days.

    Trades count where their day is confirmed.  A registration without days has no
    dates and zeros; the factor is null without trades or without losses.
    """
    net = F.col("net_yen")
    mine = trades.where("exit_reason <> 'end'").withColumn("day", _day(F.col("exit_time"))).join(days.select(*RUN, "day"), [*RUN, "day"], "left_semi")
    of_trades = mine.groupBy(*RUN).agg(F.count("*").alias("trades"), F.sum(F.when(net > 0, net).otherwise(0.0)).alias("gain"), F.sum(F.when(net < 0, net).otherwise(0.0)).alias("loss"))
    of_days = days.groupBy(*RUN).agg(half_up(F.sum("net_yen")).alias("net_yen"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    both = registered.select(*RUN, "registered_at").join(of_days, RUN, "left").join(of_trades, RUN, "left").fillna(0, ["trades", "gain", "loss", "net_yen", "days"])
    return both.withColumn("profit_factor", retired_profit_factor(F.col("gain"), F.col("loss"), F.col("trades"))).drop("gain", "loss")


def window_balances(registered: DataFrame, days: DataFrame, bars: DataFrame, balance: float = 1_000_000.0) -> DataFrame:
    """Balance of every registration when the source's bars begin: the start balance and the confirmed days before it."""
    begin = bars.groupBy(*KEY).agg(_day(F.min("t")).alias("begin"))
    before = days.join(begin, SERIES).where("day < begin").groupBy(*RUN).agg(F.sum("net_yen").alias("net"))
    return registered.select(*RUN).join(before, RUN, "left").select(*RUN, half_up(balance + F.coalesce("net", F.lit(0.0))).alias("balance"))


def generation_key(strategy_id: Column, registered_at: Column) -> Column:
    return F.concat(strategy_id, F.lit("@"), registered_at.cast("string"))


def generation_of(key: Column, strategy_id: Column, meta: Column, snapshot: Column) -> Column:
    """Registration second of a ledger entry: from its meta data, else its snapshot, else its key; null if none is a positive whole number."""
    whole = lambda x: F.when((x > 0) & (F.floor(x) == x), x.cast("long"))
    prefix = F.concat(strategy_id, F.lit("@"))
    in_key = F.when(F.startswith(key, prefix), F.substring(key, F.length(prefix) + 1, F.length(key)).try_cast("double"))
    return F.coalesce(whole(F.coalesce(meta, snapshot).try_cast("double")), whole(in_key))


def unledgered(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """Archived definitions (file_name, strategy_id, registered_at) whose generation no ledger entry holds.

    ``misnamed``: the file is not called after its generation.
    """
    name = F.concat(generation_key(F.col("strategy_id"), F.col("registered_at")), F.lit(".json"))
    lost = archives.join(entries.select("strategy_id", "registered_at"), ["strategy_id", "registered_at"], "left_anti")
    return lost.withColumn("misnamed", ~F.col("file_name").eqNullSafe(name))


def unretired_changes(strategies: DataFrame, history: DataFrame, entries: DataFrame) -> DataFrame:
    """Strategies whose history belongs to another generation that no ledger entry retires; must be empty."""
    before = history.select("strategy_id", F.col("registered_at").alias("recorded_at")).distinct()
    changed = strategies.select("strategy_id", "registered_at").join(before, "strategy_id").where("registered_at <> recorded_at")
    return changed.join(entries.select("strategy_id", F.col("registered_at").alias("recorded_at")), ["strategy_id", "recorded_at"], "left_anti")


def observation_problems(observed: DataFrame, adopted: DataFrame) -> DataFrame:
    """Why observed strategies are refused: an id without the observation prefix, one that repeats, or an adopted one."""
    ids = observed.groupBy("strategy_id").agg(F.count("*").alias("n"))
    known = adopted.select("strategy_id", F.lit(True).alias("known")).distinct()
    found = {"prefix": ~F.startswith(F.col("strategy_id"), F.lit(OBSERVED)), "repeated": F.col("n") > 1, "adopted": F.col("known").isNotNull()}
    problems = F.array_compact(F.array(*(F.when(x, k) for k, x in found.items())))
    return ids.join(known, "strategy_id", "left").select("strategy_id", F.explode(problems).alias("problem"))


def lanes(days: DataFrame, trades: DataFrame) -> DataFrame:
    """The strategy report of both lanes; observed strategies are those with the observation prefix."""
    lane = F.when(F.startswith(F.col("run_id"), F.lit(OBSERVED)), "observation").otherwise("adopted")
    return ledger.strategy_report(days, trades).withColumn("lane", lane)
