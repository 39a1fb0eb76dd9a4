"""Queries over prioritised sources with failing series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans import sql
from barloom.plans.series import query, shown
from barloom.sources import bars as src
from barloom.sources import feeds, loaders, scratch
from barloom.streaming import bars as stream
from barloom.streaming import pending


def _read(spark, d) -> DataFrame:
    """Hourly and four-hour bars of all symbols.

    The primary source has no four-hour files, so those are made of hourly ones; its files of
    "error" are cut off, those of "view" have impossible prices.  The second source has all
    but "view", and hourly prices only.
    """
    path = scratch.folder(spark)
    bars = src.event_bars(spark, d)
    high = F.when(F.col("symbol") == "view", F.col("l") - 1).otherwise(F.col("h"))
    feeds.write_feed(bars.where("symbol <> 'error'").withColumn("h", high), path, "primary")
    feeds.write_feed(bars.where("symbol <> 'view'"), path, "fallback")
    cut = bars.where("symbol = 'error'").select(F.lit("primary").alias("source"), "symbol", "tf", F.concat(F.lit('{"t": '), F.col("t").cast("string")).alias("value"))
    broken = scratch.folder(spark)
    cut.repartition(1).write.partitionBy("source", "symbol", "tf").text(broken)
    for name in scratch.listed(spark, f"{broken}/source=primary/symbol=error/tf=h1"):
        scratch.copied(spark, name, f"{path}/source=primary/symbol=error/tf=h1/cut.json")
    symbols = sorted(r.symbol for r in bars.select("symbol").distinct().collect())
    return scratch.settled(feeds.read(spark, path, [(s, tf) for s in symbols for tf in ("h1", "h4")]))


_H4 = """w AS (SELECT symbol, (t // 14400) * 14400 AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c, sum(v) AS v FROM bars GROUP BY 1, 2),
    l AS (SELECT symbol, max(t) + 3600 AS until FROM bars GROUP BY 1), h4 AS (SELECT w.* FROM w JOIN l USING (symbol) WHERE t + 14400 <= until),
    f AS (SELECT *, 'h1' AS tf FROM bars UNION ALL SELECT *, 'h4' FROM h4)"""
query("isolated_feeds", f"WITH {sql.bars()}, {_H4} SELECT symbol, tf, t, {', '.join(sql.r6(x, x) for x in 'ohlcv')} FROM f WHERE symbol <> 'view'")(lambda spark, d: shown(feeds.bars_of(_read(spark, d)), *"ohlcv", keys=("symbol", "tf", "t")))
query(
    "feed_health",
    f"""WITH {sql.bars()}, {_H4}, a AS (SELECT symbol, tf, count(*) AS bars, max(t) AS newest FROM f GROUP BY 1, 2)
    SELECT symbol, tf, CASE symbol WHEN 'view' THEN NULL WHEN 'error' THEN 'fallback' ELSE 'primary' END AS source, CASE WHEN symbol = 'view' THEN 0 ELSE bars END AS bars, CAST(CASE WHEN symbol <> 'view' THEN newest END AS DOUBLE) AS newest,
        CASE symbol WHEN 'view' THEN 'primary: ValueError; fallback: FileNotFoundError' WHEN 'error' THEN 'primary: JSONDecodeError' END AS errors, symbol <> 'view' AS write, symbol = 'error' AS fell_back FROM a""",
)(lambda spark, d: feeds.health(_read(spark, d)).withColumn("newest", F.col("newest").cast("double")))


# -- streams over files ---------------------------------------------------------------------


@query(
    "stream_forecast_outcomes",
    f"""WITH {sql.bars()}, n AS (SELECT max(t) AS newest FROM bars), x AS (SELECT symbol, t, c, lead(t, 5) {sql.S} AS target_t, lead(c, 5) {sql.S} AS later FROM bars)
    SELECT symbol, t, target_t, {sql.r6('later - c', 'change')} FROM x, n WHERE target_t <= newest - 5400""",
)
def _(spark, d):
    """Every hourly bar forecasts its fifth successor; outcomes as a stream with timers, a batch per five days of bars."""
    folders = [scratch.folder(spark) for _ in range(3)]
    bars = src.event_bars(spark, d)
    none = F.lit(None).cast("long")
    both = bars.select("symbol", "tf", "t", none.alias("id"), none.alias("horizon"), "c").unionByName(bars.select("symbol", "tf", "t", F.col("t").alias("id"), F.lit(5).cast("long").alias("horizon"), "c"))
    both = scratch.settled(both.withColumn("part", F.floor(F.col("t") / (5 * 86400))))
    for (part,) in both.select("part").distinct().orderBy("part").collect():  # files are read in the order of their writing
        both.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folders[0])
    if both.isEmpty():
        return shown(pending.of_batch(bars, bars.select("symbol", "tf", "t", F.col("t").alias("id"), F.lit(5).alias("horizon"), "c")), "change", keys=("symbol", "t", "target_t"))
    before = spark.conf.get(pending.PROVIDER, None)
    pending.use_rocks(spark)
    try:
        rows = spark.readStream.schema("symbol string, tf string, t long, id long, horizon long, c double").option("maxFilesPerTrigger", 1).parquet(folders[0])
        out = pending.outcomes(rows, "90 minutes", 3650 * 86400)
        out.writeStream.format("parquet").option("path", folders[1]).option("checkpointLocation", folders[2]).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(pending.PROVIDER) if before is None else spark.conf.set(pending.PROVIDER, before)
    return shown(spark.read.schema(pending.OUTCOMES).parquet(folders[1]), "change", keys=("symbol", "t", "target_t"))


@query(
    "frozen_tail",
    f"""WITH e AS (SELECT event_type AS symbol, event_id AS version, (epoch_us(ts) // 1000000 // 3600) * 3600 AS t, value AS c FROM events) SELECT symbol, t, max(version) AS version, arg_max(c, version) AS c FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    """Every event re-sends its hour with its own value: the newest version of an hour stays, older hours are frozen."""
    path = scratch.folder(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.col("event_type").alias("symbol"), F.lit("h1").alias("tf"), (F.floor(src.unix_seconds("ts") / 3600) * 3600).alias("t"), F.col("event_id").alias("version"), F.col("value").alias("c"))
    rows = scratch.settled(rows.withColumn("day", F.floor(F.col("t") / 86400)))
    write = stream.frozen_tail(path, "version")
    days = [r.day for r in rows.select("day").distinct().orderBy("day").collect()]
    for epoch, k in enumerate(range(0, len(days), 6)):
        write(rows.where(F.col("day").isin(days[k : k + 6])).drop("day"), epoch)
    return stream.read_frozen(spark, path).select("symbol", "t", "version", "c") if days else rows.select("symbol", "t", "version", "c")


# -- stored results -------------------------------------------------------------------------


def _ledger_file(spark, d) -> str:
    """A ledger of all orders: customers as strategies, months as generations, some keyed only, some without a reason, some lines broken."""
    path = scratch.folder(spark)
    o = spark.read.parquet(f"{d}/orders.parquet")
    at = F.floor(src.unix_seconds("o_orderdate") / 2592000) * 2592000
    key = F.concat_ws("@", F.concat(F.lit("c"), F.col("o_custkey").cast("string")), at.cast("string"))
    rows = o.select(
        key.alias("ledger_key"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("strategy_id"), F.when(F.col("o_orderkey") % 4 != 0, at).alias("registered_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("retired_at"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("reason"), F.col("o_orderkey").alias("trades"), F.col("o_totalprice").alias("net_yen"),
    )
    text = F.to_json(F.struct(*rows.columns))
    rows.select(F.when(F.col("trades") % 23 == 0, F.substring(text, 1, 30)).otherwise(text).alias("value")).write.text(path)
    return path


_LEDGER = """le AS (SELECT 'c' || o_custkey AS strategy_id, (epoch_us(o_orderdate) // 1000000) // 2592000 * 2592000 AS registered_at, strftime(o_orderdate, '%Y-%m-%d') AS retired_at, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS reason, o_orderkey AS trades FROM orders)"""
query(
    "retired_generations",
    f"""WITH {_LEDGER}, ok AS (SELECT * FROM le WHERE reason IS NOT NULL AND trades % 23 <> 0) SELECT strategy_id, registered_at, min(retired_at) AS retired_at FROM ok GROUP BY 1, 2""",
)(lambda spark, d: loaders.retired(loaders.load(spark, _ledger_file(spark, d), "retired"), spark).select("strategy_id", "registered_at", "retired_at"))
query("ledger_misfits", f"WITH {_LEDGER} SELECT count(*) FILTER (reason IS NULL OR trades % 23 = 0) AS misfits, count(*) AS records FROM le")(lambda spark, d: loaders.load(spark, _ledger_file(spark, d), "retired").misfits)


@query(
    "observed_strategies",
    """WITH r AS (SELECT 's' || c_custkey AS strategy_id, c_custkey % 7 AS own FROM customer), h AS (SELECT 's' || o_custkey AS strategy_id, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1)
    SELECT r.strategy_id, coalesce(days, own) AS history_days, true AS history_available FROM r LEFT JOIN h USING (strategy_id)""",
)
def _(spark, d):
    """Customers as observed strategies, days with orders as their history."""
    path = scratch.folder(spark)
    c = F.col("c_custkey")
    spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("s"), c.cast("string")).alias("strategy_id"), F.lit(1).alias("registered_at"), F.lit(0).alias("trades"), (c % 7).alias("confirmed_days")).write.json(path)
    days = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("strategy_id"), F.to_date("o_orderdate").alias("day"))
    return loaders.observations(loaders.load(spark, path, "forward"), days).select("strategy_id", "history_days", "history_available")
