"""Small operators around the series: reference tables, splits, look-ups, validators, candidate matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import half_up, pip_size
from barloom.operators import conditions
from barloom.operators.asof import nearest
from barloom.sources.bars import KEY, SECONDS, series

# Spreads in pips, days of look-back for reference windows, default rate.
SPREADS = {"USDJPY": 0.9, "EURUSD": 0.7, "GBPJPY": 1.6, "EURJPY": 1.1, "AUDJPY": 1.2, "GBPUSD": 1.0}
REFERENCE_DAYS, REFERENCE_YEARS = 737, 2
DEFAULT_RATE = 150.0
MAGIC_BASE = 1_783_100_000
RANK = {tf: k for k, tf in enumerate(SECONDS)}


def _map(pairs: dict, default) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.lit(default)


def spread_pips(symbol: Column) -> Column:
    """Fixed spread of a pair; 0 where unknown."""
    return F.coalesce(F.try_element_at(_map(SPREADS, 0.0), symbol), F.lit(0.0))


def price_digits(symbol: Column) -> Column:
    return F.when(symbol.endswith("JPY"), 3).otherwise(5)


def to_pips(symbol: Column, distance: Column) -> Column:
    """Absolute distance in pips, to one decimal."""
    return half_up(F.abs(distance) / pip_size(symbol), 1)


def registration_split(bars: DataFrame, registered_at: int) -> DataFrame:
    """``part``: forward from the registration on, reference in the two years before it; older bars are dropped."""
    t = F.col("t")
    part = F.when(t >= registered_at, "forward").when(t >= registered_at - REFERENCE_YEARS * 365 * 86400, "reference")
    return bars.withColumn("part", part).where("part is not null")


def reference_window(bars: DataFrame, registered_at: int, days: int = REFERENCE_DAYS) -> DataFrame:
    return bars.where((F.col("t") >= registered_at - days * 86400) & (F.col("t") < registered_at))


def coverage(bars: DataFrame, registered_at: int) -> DataFrame:
    """Bars and days before registration, and span in days, per series."""
    old = F.col("t") < registered_at
    out = bars.groupBy(*KEY).agg(F.count_if(old).alias("bars_before"), F.max(F.when(old, F.col("t"))).alias("__z"), F.min(F.when(old, F.col("t"))).alias("__a"), ((F.max("t") - F.min("t")) / 86400.0).alias("span_days"))
    return out.withColumn("days_before", F.coalesce((F.col("__z") - F.col("__a")) / 86400.0, F.lit(0.0))).drop("__a", "__z")


def pair_currencies(symbol: Column) -> Column:
    return F.array(F.substring(symbol, 1, 3), F.substring(symbol, 4, 3))


def calendar_for(events: DataFrame, symbol: str) -> DataFrame:
    """Events of the two currencies of a pair with high or medium impact."""
    return events.where(F.array_contains(pair_currencies(F.lit(symbol)), F.col("currency")) & F.col("impact").isin("high", "medium"))


def upcoming_for(events: DataFrame, symbol: str, now: int, seconds: int) -> DataFrame:
    """Events of a pair's currencies in the next ``seconds``, in order of time."""
    mine = F.array_contains(pair_currencies(F.lit(symbol)), F.col("currency"))
    return events.where(mine & (F.col("time") > now) & (F.col("time") <= now + seconds)).orderBy("time")


def calendar_sides(events: DataFrame, now: int) -> DataFrame:
    """``side`` upcoming (nearest first) or past (newest first) and the ``distance`` in seconds, sorted by them."""
    side = F.when(F.col("time") > now, "upcoming").otherwise("past")
    return events.withColumn("side", side).withColumn("distance", F.abs(F.col("time") - now)).orderBy(F.desc("side"), "distance", "currency", "title")


def default_currency(symbol: Column, known: list[str]) -> Column:
    """Base currency if it has reports, else the quote currency, else JPY."""
    base, quote = F.substring(symbol, 1, 3), F.substring(symbol, 4, 3)
    return F.when(base.isin(known), base).when(quote.isin(known), quote).otherwise("JPY")


def cot_change(reports: DataFrame) -> DataFrame:
    """Net position and its change against the report before, per currency."""
    w = Window.partitionBy("currency").orderBy("date")
    return reports.withColumn("net_change", F.col("noncomm_net") - F.lag("noncomm_net").over(w))


def cot_context(net: Column, is_base: Column) -> Column:
    """What a net position says about a pair: long in the base or short in the quote supports it."""
    return F.when(net == 0, "neutral").when((net > 0) == is_base, "supports_pair").otherwise("weighs_on_pair")


def price_change(bars: DataFrame) -> DataFrame:
    """Change and percentage of every close against the one before."""
    before = F.lag("c").over(series())
    return bars.withColumn("change", F.col("c") - before).withColumn("change_pct", F.when(before != 0, F.try_divide(F.col("c") - before, before) * 100))


def pip_values(bars: DataFrame, usdjpy: DataFrame | None) -> DataFrame:
    """pip_value: 1000 per lot for JPY quotes, else ten times the rate of the nearest USDJPY bar (it may lie ahead)."""
    quoted = F.col("symbol").endswith("JPY")
    if usdjpy is None:
        return bars.withColumn("pip_value", F.when(quoted, 1000.0).otherwise(10 * DEFAULT_RATE))
    tagged = bars.withColumn("__one", F.lit(1))
    rates = usdjpy.select(F.lit(1).alias("__one"), F.col("t").alias("rate_t"), F.col("c").alias("rate"))
    # four-day blocks are the join key; every block also gets the last rate before it and the first after it, however far
    tagged, rates = (x.withColumn("__day", F.floor(F.col(c) / 345600)) for x, c in ((tagged, "t"), (rates, "rate_t")))
    ends = rates.groupBy("__one", "__day").agg(F.min(F.struct("rate_t", "rate")).alias("__first"), F.max(F.struct("rate_t", "rate")).alias("__last"))
    blocks = tagged.select("__one", "__day").distinct().join(ends, ["__one", "__day"], "full")
    w = Window.partitionBy("__one").orderBy("__day")  # a row per block of four days
    before, after = F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("__first", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    carried = blocks.select("__one", "__day", F.array_compact(F.array(before, after)).alias("__rates")).select("__one", "__day", F.explode("__rates").alias("__rate"))
    near = nearest(tagged, rates.unionByName(carried.select("__one", "__day", "__rate.rate_t", "__rate.rate")), ["__one", "__day"], "t", "rate_t", "rate")
    rate = F.coalesce(F.when(F.col("rate_nearest") > 0, F.col("rate_nearest")), F.lit(DEFAULT_RATE))
    return near.withColumn("pip_value", F.when(quoted, 1000.0).otherwise(10 * rate)).drop("__one", "__day", "rate_nearest")


def fan(forecasts: DataFrame, seconds: int) -> DataFrame:
    """Points of a fan chart: (time of the horizon, expected, bands) from the newest bar of every series."""
    order = Window.partitionBy(*KEY, "horizon").orderBy(F.desc("t"))
    newest = forecasts.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return newest.withColumn("t", F.col("t") + F.col("horizon") * seconds)


def nearest_levels(levels: DataFrame) -> DataFrame:
    """The nearest level in each direction: least distance, then greatest strength."""
    order = Window.partitionBy(*KEY, "direction").orderBy("distance", F.desc("strength"))
    return levels.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def visible_levels(levels: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy(F.desc("strength"), "distance")
    return levels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def month_spine(bars: DataFrame, most: int = 12) -> DataFrame:
    """The last ``most`` months up to a series' last bar, none before its first."""
    month = lambda x: F.trunc(F.to_date(F.from_unixtime(x)), "month")
    span = bars.groupBy(*KEY).agg(month(F.min("t")).alias("a"), month(F.max("t")).alias("z"))
    start = F.greatest(F.col("a"), F.add_months("z", -(most - 1)))
    return span.select(*KEY, F.explode(F.sequence(start, F.col("z"), F.expr("interval 1 month"))).alias("month")).withColumn("month", F.date_format("month", "yyyy-MM"))


def secondary_timeframe(tf: Column) -> Column:
    """The default comparison timeframe of every timeframe."""
    return F.try_element_at(_map({"m15": "h1", "m30": "h4", "h1": "h4", "h4": "d1", "d1": "h4"}, None), tf)


def relative_timeframe(main: Column, other: Column) -> Column:
    rank = _map(RANK, 0)
    a, b = F.try_element_at(rank, main), F.try_element_at(rank, other)
    return F.when(b > a, "higher").when(b < a, "lower").otherwise("same")


def seven_points(base: float) -> list[float]:
    """Half to two and a half times a value, in seven even steps."""
    return [round(base * (0.5 + k / 3), 1) for k in range(7)]


def magic_number(symbol_no: Column, kind_no: Column, tf_no: Column) -> Column:
    """A number of its own for every candidate: blocks of ten rules, in them symbols, rules and timeframes by decimal places.

    Null for indexes that would collide (1000 symbols or more, 10 timeframes or more) or are negative.
    """
    valid = (symbol_no >= 0) & (symbol_no < 1000) & (kind_no >= 0) & (tf_no >= 0) & (tf_no < 10)
    number = F.lit(MAGIC_BASE) + F.floor(kind_no / 10) * 100_000 + symbol_no * 100 + kind_no % 10 * 10 + tf_no
    return F.when(valid, number.cast("long"))


def candidates(symbols: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(symbol, kind, tf, magic): every symbol of ``symbols`` with every rule and its timeframes, each with a number of its own."""
    order = Window.orderBy("symbol")  # a row per symbol
    rows = symbols.select("symbol").distinct().withColumn("symbol_no", F.row_number().over(order) - 1)
    numbered = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("kind_no"), F.lit(tf).alias("tf"), F.lit(j).alias("tf_no")) for i, (k, tfs) in enumerate(kinds.items()) for j, tf in enumerate(tfs)]
    return rows.select("symbol", "symbol_no", F.inline(F.array(*numbered))).select("symbol", "kind", "tf", magic_number(F.col("symbol_no"), F.col("kind_no"), F.col("tf_no")).alias("magic"))


def strategy_problems(strategies: DataFrame) -> DataFrame:
    """Why a strategy row is refused: one row per strategy and problem; none for sound ones."""
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    time = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
    problems = {
        "id": F.coalesce(F.trim("strategy_id"), F.lit("")) == "",
        "timeframe": ~F.coalesce(F.col("tf").isin(*SECONDS), F.lit(False)),
        "rule": ~F.coalesce(F.col("kind").isin(*conditions.RULES), F.lit(False)),
        "stop": ~positive("stop_pips"),
        "target": ~positive("target_pips"),
        "trailing": F.col("trailing_pips").isNotNull() & ~positive("trailing_pips"),
        "session": (F.col("session_start").isNotNull() & ~F.col("session_start").rlike(time)) | (F.col("session_end").isNotNull() & ~F.col("session_end").rlike(time)),
        "mode": ~F.coalesce(F.col("mode").isin("fixedLot", "compound", "fixedRisk"), F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), k) for k, x in problems.items())))
    each = strategies.select("strategy_id", F.explode(found).alias("problem"))
    repeated = strategies.groupBy("strategy_id").agg(F.count("*").alias("n")).where("n > 1").select("strategy_id", F.lit("repeated").alias("problem"))
    return each.unionByName(repeated)


def newest_iso(values: Column, fallback: Column) -> Column:
    """The latest of an array of ISO times; invalid ones are skipped."""
    return F.coalesce(F.array_max(F.transform(values, lambda x: F.try_to_timestamp(x))), F.to_timestamp(F.from_unixtime(fallback)))


def journal_append(journal: DataFrame, entries: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """Journal with the entries of unknown keys added; the newest ``most`` rows stay (a feature of the journal)."""
    fresh = entries.join(journal.select(*keys), keys, "left_anti")
    return journal.unionByName(fresh).orderBy(F.desc("t"), *keys).limit(most)


def latest_trades(trades: DataFrame, n: int = 50) -> DataFrame:
    order = Window.partitionBy("run_id", *KEY).orderBy(F.desc("exit_time"), F.desc("id"))
    return trades.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def retired_profit_factor(gain: Column, loss: Column, n: Column) -> Column:
    """Null without trades or without losses but with gains; 0 without either."""
    return F.when(n == 0, None).when(loss == 0, F.when(gain > 0, None).otherwise(0.0)).otherwise(gain / F.abs(F.when(loss != 0, loss)))
