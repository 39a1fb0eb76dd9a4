"""Structured Streaming: closed bars of a tick stream, and an insert-only sink of confirmed rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import SECONDS


def closed_bars(ticks: DataFrame, tf: str, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream ``ticks(symbol, ts, seq, price, size)``; a bar comes out once the watermark has passed it."""
    when = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy(F.window("ts", f"{SECONDS[tf]} seconds"), "symbol")
    rows = grouped.agg(F.min_by("price", when).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", when).alias("c"), F.sum("size").cast("double").alias("v"))
    return rows.select("symbol", F.lit(tf).alias("tf"), F.unix_seconds("window.start").alias("t"), "o", "h", "l", "c", "v")


def first_confirmed(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of every key within the watermark; later ones are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def insert_only(path: str, keys: list[str]):
    """A ``foreachBatch`` function: rows of unknown keys are appended to a Parquet table, known keys stay untouched."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _tails(spark: SparkSession, path: str) -> list[int]:
    """Finished batches of a ``frozen_tail`` table, ascending."""
    fs, where = _folder(spark, f"{path}/tail")
    names = [x.getPath() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(x.getName().split("=")[1]) for x in names if fs.exists(_folder(spark, f"{x.toString()}/_SUCCESS")[1]))


def frozen_tail(path: str, version: str, keys: tuple[str, ...] = ("symbol", "tf"), time: str = "t"):
    """A ``foreachBatch`` function for bars that are sent again while they form.

    The newest bar of every series is its tail: a later version of it, or the highest
    ``version`` within a batch, replaces it.  Once a newer bar comes it is frozen, and
    bars older than the tail are ignored, also ones that were missing.  A batch reads
    the tails only, never the frozen bars.  Both go into folders of the batch, so that
    a batch that is tried again overwrites what it wrote.  Read with ``read_frozen``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        before = [e for e in _tails(spark, path) if e < epoch]
        row = F.struct(*batch.columns)
        rows = batch.groupBy(*keys, time).agg(F.max_by(row, version).alias("x")).select("x.*")
        if before:
            tail = spark.read.schema(batch.schema).parquet(f"{path}/tail/epoch={before[-1]}")
            since = tail.select(*keys, F.col(time).alias("__since"))
            rows = rows.join(since, list(keys), "left").where(F.col("__since").isNull() | (F.col(time) >= F.col("__since"))).drop("__since")
            rows = rows.unionByName(tail.join(rows.select(*keys, time), [*keys, time], "left_anti"))
        newest = rows.groupBy(*keys).agg(F.max(time).alias(time))
        rows.join(newest, [*keys, time], "left_anti").select(batch.columns).write.mode("overwrite").parquet(f"{path}/frozen/epoch={epoch}")
        rows.join(newest, [*keys, time], "left_semi").select(batch.columns).write.mode("overwrite").parquet(f"{path}/tail/epoch={epoch}")
        for old in before[:-1]:
            fs, where = _folder(spark, f"{path}/tail/epoch={old}")
            fs.delete(where, True)

    return write


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """Frozen bars and tails as of the last finished batch."""
    last = _tails(spark, path)[-1]
    tail = spark.read.parquet(f"{path}/tail/epoch={last}")
    return spark.read.parquet(f"{path}/frozen").where(F.col("epoch") <= last).drop("epoch").unionByName(tail)


OUTCOMES = "symbol string, tf string, id long, t long, horizon long, target_t long, change double"


def outcomes(rows: DataFrame) -> DataFrame:
    """Outcomes of forecasts as their bars arrive; columns of ``OUTCOMES``.

    ``rows`` is a stream of bars (symbol, tf, t, c), with null in ``id`` and
    ``horizon``, and of forecasts with the time and close of their bar.  A forecast
    is settled by the ``horizon``-th bar after its own; ``change`` is that bar's close
    less its own.  Pending forecasts are the state of a series, so it is bounded by
    them.  Bars of a series come in order over batches, a forecast no later than the bar after its own.
    """

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = json.loads(state.get[0]) if state.exists else []
        found = []
        for r in pd.concat(frames).sort_values(["t", "id"], na_position="last").itertuples(index=False):
            if not pd.isna(r.id):
                pending.append([int(r.id), int(r.t), int(r.horizon), int(r.horizon), float(r.c)])
                continue
            for p in pending:
                p[3] -= p[1] < r.t
            found += [(*key, *p[:3], int(r.t), r.c - p[4]) for p in pending if p[3] == 0]
            pending = [p for p in pending if p[3] > 0]
        state.update((json.dumps(pending),))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    return rows.groupBy("symbol", "tf").applyInPandasWithState(settle, OUTCOMES, "pending string", "append", "NoTimeout")


def event_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the ``events`` table's files as ticks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1).alias("size"))
