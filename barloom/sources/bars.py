"""Bars: building, normalising, validating, resampling and merging candle series.

A bar row is (symbol, tf, t, o, h, l, c, v): ``t`` in unix seconds UTC, unique per
(symbol, tf).  Everything here is declarative; the only shuffles are the grouping
ones on (symbol, bucket) and (symbol, tf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECONDS = {"m15": 900, "m30": 1800, "h1": 3600, "h4": 14400, "d1": 86400}
SCHEMA = "symbol string, tf string, t long, o double, h double, l double, c double, v double"
FILE_SCHEMA = "pair string, tf string, updatedAt string, source string, bars array<struct<t:double,o:double,h:double,l:double,c:double,v:double>>"
KEY = ("symbol", "tf")


def series() -> Window:
    return Window.partitionBy(*KEY).orderBy("t")


def unix_seconds(ts: str) -> Column:
    """Seconds of a timestamp without time zone, taken as UTC."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def bars_of_ticks(ticks: DataFrame, tf: str) -> DataFrame:
    """Bars of ``ticks(symbol, t, seq, price, size)``; first and last by (t, seq).

    The order is one decimal of fixed width: a struct in the aggregation buffer would
    make Spark sort all ticks before it aggregates them.
    """
    step = SECONDS[tf]
    when = F.expr("cast(cast(t as decimal(12,0)) * cast('1e19' as decimal(20,0)) + cast(seq as decimal(19,0)) as decimal(38,0))")
    return (
        ticks.groupBy("symbol", (F.floor(F.col("t") / step) * step).alias("t"))
        .agg(F.min_by("price", when).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", when).alias("c"), F.sum("size").cast("double").alias("v"))
        .select("symbol", F.lit(tf).alias("tf"), F.col("t").cast("long").alias("t"), "o", "h", "l", "c", "v")
    )


def event_bars(spark: SparkSession, sf_dir: str, tf: str = "h1") -> DataFrame:
    """Tape of ``events``: one symbol per event type, price = value, volume = count."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars_of_ticks(events.select(F.col("event_type").alias("symbol"), unix_seconds("ts").alias("t"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1).alias("size")), tf)


def walk_bars(spark: SparkSession, sf_dir: str, tf: str = "m30") -> DataFrame:
    """A tape with trends: half-hourly bars of ``events`` laid end to end, every bar opening at the close before it; coarser ones are made of them.

    Prices are rounded to cents, so their running sum has no order.
    """
    bars = event_bars(spark, sf_dir, "m30")
    step = F.round(F.col("c") - F.col("o"), 2)
    upper, lower = 0.1 * (F.col("h") - F.greatest("o", "c")), 0.1 * (F.least("o", "c") - F.col("l"))
    laid = bars.withColumn("nc", F.round(10_000 + F.sum(step).over(series()), 2)).withColumn("no", F.round(F.col("nc") - step, 2))
    out = laid.select(*KEY, "t", F.col("no").alias("o"), F.round(F.greatest("no", "nc") + upper, 2).alias("h"), F.round(F.least("no", "nc") - lower, 2).alias("l"), F.col("nc").alias("c"), "v")
    return out if tf == "m30" else resample(out, tf)


#: Tape of single orders: bars of a day's session, first bar of the day, first day, price in cents, bars whose drift is averaged.
SESSION, OPENS, FIRST_DAY, CENTS, DRIFT = 4, 28_800, 19_000, 1_000_000, 8


def deal_bars(spark: SparkSession, sf_dir: str, tf: str = "m30") -> DataFrame:
    """A tape of many short days: every order is one half-hourly bar of its priority and status, ``SESSION`` of them a day.

    Closes move by an order's own step and the drift of the last ``DRIFT`` orders, all in
    whole cents, so running sums have no order; coarser bars are made of these.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.floor("o_totalprice").cast("long").alias("x"))
    w = Window.partitionBy("symbol").orderBy("o_orderdate", "o_orderkey")
    rows = orders.select("o_orderkey", "o_orderdate", F.concat(F.substring("p", 1, 1), "s").alias("symbol"), "x", (F.pmod("x", F.lit(201)) - 100).alias("u"))
    rows = rows.withColumn("k", F.row_number().over(w) - 1).withColumn("step", 2 * F.sum("u").over(w.rowsBetween(1 - DRIFT, 0)) + 5 * F.col("u"))
    rows = rows.withColumn("c", CENTS + F.sum("step").over(w)).withColumn("o", F.col("c") - F.col("step"))
    cents = lambda x: x / F.lit(100.0)
    at = (FIRST_DAY + F.floor(F.col("k") / SESSION)) * 86400 + OPENS + F.col("k") % SESSION * 1800
    out = rows.select(
        "symbol", F.lit("m30").alias("tf"), at.cast("long").alias("t"), cents(F.col("o")).alias("o"), cents(F.greatest("o", "c") + 25 + 3 * F.pmod("x", F.lit(7))).alias("h"),
        cents(F.least("o", "c") - 25 - 3 * F.pmod("x", F.lit(5))).alias("l"), cents(F.col("c")).alias("c"), F.lit(1.0).alias("v"),
    )
    return out if tf == "m30" else resample(out, tf)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tape of ``orders``: one symbol per priority, price = total price."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bars_of_ticks(orders.select(F.col("o_orderpriority").alias("symbol"), unix_seconds("o_orderdate").alias("t"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1).alias("size")), "d1")


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """Bars of JSON files (pair, tf, bars[]); unreadable files fail the read."""
    files = spark.read.schema(FILE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return files.select(F.col("pair").alias("symbol"), "tf", F.inline("bars")).withColumn("t", F.col("t").cast("long"))


def write_bar_files(bars: DataFrame, path: str, updated_at: str) -> None:
    """One JSON record per (symbol, tf), partitioned by them so series are written by different tasks."""
    row = F.struct("t", "o", "h", "l", "c", "v")
    files = bars.groupBy(*KEY).agg(F.array_sort(F.collect_list(row)).alias("bars"))
    files.select(F.col("symbol").alias("pair"), F.col("tf"), F.lit(updated_at).alias("updatedAt"), "bars").write.mode("overwrite").json(path)


def normalise(raw: DataFrame) -> DataFrame:
    """Bars of raw feed rows (symbol, tf, timestamp, open, high, low, close, volume).

    Timestamps over 1e10 are milliseconds; rows with a missing or non-finite number, a
    high under the low or a price that is not positive are dropped; a repeated time
    keeps its last row in feed order (``seq``).
    """
    number = {k: F.expr(f"try_cast({n} as double)") for k, n in (("t", "timestamp"), ("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))}
    volume = F.coalesce(F.expr("try_cast(volume as double)"), F.lit(0.0))
    rows = raw.select("symbol", "tf", "seq", *(v.alias(k) for k, v in number.items()), volume.alias("v"))
    rows = rows.withColumn("t", F.floor(F.when(F.col("t") > 1e10, F.col("t") / 1000).otherwise(F.col("t"))).cast("long"))
    usable = F.lit(True)
    for k in "ohlc":
        usable = usable & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) < float("inf"))
    rows = rows.where(usable & F.col("t").isNotNull() & (F.col("h") >= F.col("l")) & (F.col("o") > 0) & (F.col("c") > 0))
    return rows.groupBy("symbol", "tf", "t").agg(*(F.max_by(k, "seq").alias(k) for k in "ohlcv"))


def normalise_chart(payload: DataFrame, now: int) -> DataFrame:
    """Bars of chart payloads (symbol, tf, timestamps[], open[], high[], low[], close[]).

    Parallel arrays are zipped; rows with a null or not finite number, off the grid of
    their timeframe or still forming at ``now`` are dropped; daily times snap to UTC
    midnight; volume is 0; the last row of a time wins.
    """
    step = F.element_at(F.create_map(*(x for k, v in SECONDS.items() for x in (F.lit(k), F.lit(v)))), F.col("tf"))
    zipped = payload.select("symbol", "tf", F.posexplode(F.arrays_zip("timestamps", "open", "high", "low", "close")).alias("seq", "x"))
    rows = zipped.select("symbol", "tf", "seq", F.col("x.timestamps").cast("long").alias("t"), *(F.col(f"x.{n}").cast("double").alias(n[0]) for n in ("open", "high", "low", "close"))).withColumn("step", step)
    rows = rows.withColumn("t", F.when(F.col("tf") == "d1", (F.floor(F.col("t") / 86400 + 0.5) * 86400).cast("long")).otherwise(F.col("t")))
    good = (F.col("t") % F.col("step") == 0) & (F.col("t") + F.col("step") <= now) & (F.col("h") >= F.col("l")) & (F.col("o") > 0) & (F.col("c") > 0)
    for k in "ohlc":
        good = good & F.col(k).isNotNull() & ~F.isnan(k)
    return rows.where(good).groupBy("symbol", "tf", "t").agg(*(F.max_by(k, "seq").alias(k) for k in "ohlc")).withColumn("v", F.lit(0.0))


def violations(bars: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """(symbol, tf, bad_rows, rows, too_few) per series; a clean feed has 0 and false everywhere."""
    bad = F.lit(False)
    for k in "ohlcv":
        bad = bad | F.col(k).isNull() | F.isnan(k) | (F.abs(k) == float("inf"))
    need = F.lit(0)
    for tf, n in (least or {}).items():
        need = F.when(F.col("tf") == tf, n).otherwise(need)
    counted = bars.groupBy(*KEY).agg(F.count_if(bad | (F.col("h") < F.col("l"))).alias("bad_rows"), F.count("*").alias("rows"))
    return counted.withColumn("too_few", F.col("rows") < need)


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of every series."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("t"))
    return bars.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n")


def resample(bars: DataFrame, tf: str, complete_before: int | None = None, parts: int | None = None) -> DataFrame:
    """Coarser bars: first open, highest, lowest, last close, summed volume.

    ``complete_before`` drops buckets that end after that time (a forming day);
    ``parts`` drops the newest bucket of a series unless it holds that many bars.
    """
    step = SECONDS[tf]
    out = bars.groupBy("symbol", (F.floor(F.col("t") / step) * step).cast("long").alias("b")).agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n")
    )
    if complete_before is not None:
        out = out.where(F.col("b") + step <= complete_before)
    if parts is not None:
        newest = F.max("b").over(Window.partitionBy("symbol"))
        out = out.withColumn("__newest", newest).where((F.col("b") < F.col("__newest")) | (F.col("n") >= parts)).drop("__newest")
    return out.select("symbol", F.lit(tf).alias("tf"), F.col("b").alias("t"), "o", "h", "l", "c", "v")


def repair_closes(bars: DataFrame) -> DataFrame:
    """Close of every bar = open of the next; the last bar of a series is dropped."""
    return bars.withColumn("c", F.lead("o").over(series())).where("c is not null")


def merge_append_only(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing bars stay as they are but for the newest, which incoming may replace; only newer ones are added."""
    newest = existing.groupBy(*KEY).agg(F.max("t").alias("last"))
    new = incoming.join(newest, list(KEY), "left").where(F.col("last").isNull() | (F.col("t") >= F.col("last"))).drop("last")
    old = existing.join(new.select(*KEY, "t"), [*KEY, "t"], "left_anti")
    return old.unionByName(new)


def prefer_source(candidates: DataFrame, rank: dict[str, int]) -> DataFrame:
    """Rows of the best available ``source`` of every series: the first in ``rank`` that has any row."""
    order = F.element_at(F.create_map(*(x for k, v in rank.items() for x in (F.lit(k), F.lit(v)))), F.col("source"))
    best = candidates.withColumn("__r", order).where("__r is not null")
    first = best.groupBy(*KEY).agg(F.min("__r").alias("__best"))
    return best.join(first, list(KEY)).where("__r = __best").drop("__r", "__best")


def widest_coverage(bars: DataFrame, before: int) -> DataFrame:
    """(symbol, tf, source, first_t, last_t, n): per series the source with the widest span before a time, then most bars, then name."""
    spans = bars.where(F.col("t") < before).groupBy(*KEY, "source").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.col("last_t") - F.col("first_t")), F.desc("n"), "source")
    return spans.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def source_health(latest: DataFrame, previous: DataFrame) -> DataFrame:
    """(tf, n_series, last_success): newest success per timeframe, carried forward from ``previous(tf, last_success)``; rows without a time are failed series."""
    now = latest.groupBy("tf").agg(F.count("success_at").alias("n_series"), F.max("success_at").alias("now"))
    both = now.join(previous.select("tf", F.col("last_success").alias("then")), "tf", "full_outer")
    return both.select("tf", F.coalesce("n_series", F.lit(0)).alias("n_series"), F.greatest("now", "then").alias("last_success"))


def cot_reports(raw: DataFrame) -> DataFrame:
    """Weekly position reports of text rows; a bad number or date drops the row; the last row of a date wins."""
    numbers = ("oi", "noncomm_long", "noncomm_short", "comm_long", "comm_short")
    rows = raw.select("currency", "seq", F.expr("try_to_timestamp(report_date, 'yyyy-MM-dd')").alias("at"), *(F.expr(f"try_cast({n} as double)").alias(n) for n in numbers))
    rows = rows.dropna(subset=["at", *numbers]).withColumn("date", F.unix_timestamp("at"))
    out = rows.groupBy("currency", "date").agg(*(F.max_by(n, "seq").alias(n) for n in numbers))
    return out.withColumn("noncomm_net", F.col("noncomm_long") - F.col("noncomm_short"))


def newest_reports(reports: DataFrame, n: int = 104) -> DataFrame:
    """The newest ``n`` reports of every currency: two years of weeks."""
    order = Window.partitionBy("currency").orderBy(F.desc("date"))
    return reports.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def from_fallback(source: Column, primary: str) -> Column:
    """Whether a series came from another source than the primary one; unknown sources do not count."""
    return F.coalesce((F.trim(source) != "") & (F.lower(F.trim(source)) != primary), F.lit(False))


def calendar(*feeds: DataFrame) -> DataFrame:
    """Events of several feeds (title, currency, time, impact): trimmed, upper-cased, impact mapped, the last of a key kept."""
    union = feeds[0]
    for feed in feeds[1:]:
        union = union.unionByName(feed)
    impact = F.lower(F.trim("impact"))
    rows = union.select(F.trim("title").alias("title"), F.upper(F.trim("currency")).alias("currency"), "time", F.when(impact.isin("high", "medium", "low"), impact).otherwise("low").alias("impact"), "seq")
    return rows.groupBy("currency", "time", "title").agg(F.max_by("impact", "seq").alias("impact"))
