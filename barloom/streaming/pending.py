"""Outcomes of forecasts as a stateful stream operator with timers.

``outcomes`` takes one stream of bars and forecasts per series.  Bars may come in any order
within the watermark: they wait in a map by time, and an event-time timer releases them
in order once the watermark has passed them.  A released bar settles forecasts before it;
a forecast is settled by the ``horizon``-th bar after its own.  A series whose newest bar
is ``expire`` behind the watermark is forgotten with all its pending forecasts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "symbol string, tf string, id long, t long, horizon long, target_t long, change double"
_FORECAST = StructType([StructField("id", LongType()), StructField("t", LongType()), StructField("horizon", LongType()), StructField("left", LongType()), StructField("c", DoubleType())])
_NUMBER, _PRICE = StructType([StructField("t", LongType())]), StructType([StructField("c", DoubleType())])


class _Pending(StatefulProcessor):
    def __init__(self, expire: int):
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", _NUMBER, _PRICE)
        self.forecasts = handle.getListState("forecasts", _FORECAST)
        self.newest = handle.getValueState("newest", _NUMBER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        waiting = {k[0] for k in self.bars.keys()} if self.bars.exists() else set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                t = int(r.t)
                if not pd.isna(r.id):
                    self.forecasts.appendValue((int(r.id), t, int(r.horizon), int(r.horizon), float(r.c)))
                elif t not in waiting:  # the first bar of a time counts
                    waiting.add(t)
                    self.bars.updateValue((t,), (float(r.c),))
                    self.handle.registerTimer(t * 1000)
                if newest is None or t > newest:
                    newest = t
        if newest is not None and (not self.newest.exists() or self.newest.get()[0] != newest):
            if self.newest.exists():
                self.handle.deleteTimer((self.newest.get()[0] + self.expire) * 1000)
            self.newest.update((newest,))
            self.handle.registerTimer((newest + self.expire) * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if self.newest.exists() and now >= self.newest.get()[0] + self.expire:
            for state in (self.bars, self.forecasts, self.newest):
                state.clear()
            yield pd.DataFrame()
            return
        due = sorted((k[0], v[0]) for k, v in self.bars.iterator() if k[0] <= now) if self.bars.exists() else []
        if not due:
            yield pd.DataFrame()
            return
        pending, found = [list(x) for x in self.forecasts.get()] if self.forecasts.exists() else [], []
        for t, close in due:
            self.bars.removeKey((t,))
            still = []
            for p in pending:
                p[3] -= p[1] < t
                if p[3] == 0:
                    found.append((*key, p[0], p[1], p[2], t, close - p[4]))
                else:
                    still.append(p)
            pending = still
        self.forecasts.put([tuple(p) for p in pending]) if pending else self.forecasts.clear()
        yield pd.DataFrame(found, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def close(self) -> None:
        pass


def outcomes(rows: DataFrame, late: str = "1 hour", expire: int = 30 * 86400) -> DataFrame:
    """Columns of ``OUTCOMES`` for a stream of bars (symbol, tf, t, c; null id and horizon) and forecasts (with the time and close of their bar).

    Rows more than ``late`` behind the newest are dropped; so the rows are those of a batch
    over all that came in time.  Needs a state store with timers (``use_rocks``).
    """
    timed = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return timed.groupBy("symbol", "tf").transformWithStateInPandas(_Pending(expire), OUTCOMES, "Append", "EventTime")


def use_rocks(spark: SparkSession) -> None:
    """Let new streams of this session keep their state in RocksDB, which operators with timers need."""
    spark.conf.set(PROVIDER, ROCKS)


def of_batch(bars: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The same outcomes from finished tables."""
    from pyspark.sql import Window

    order = Window.partitionBy("symbol", "tf").orderBy("t")
    numbered = bars.select("symbol", "tf", F.col("t").alias("target_t"), F.col("c").alias("later"), F.row_number().over(order).alias("k"))
    both = forecasts.select("symbol", "tf", "t", F.lit(1).alias("kind"), F.struct("id", "horizon", "c").alias("x")).unionByName(
        bars.select("symbol", "tf", "t", F.lit(0).alias("kind"), F.lit(None).cast(forecasts.select(F.struct("id", "horizon", "c").alias("x")).schema["x"].dataType).alias("x"))
    )
    so_far = Window.partitionBy("symbol", "tf").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("n", F.count_if(F.col("kind") == 0).over(so_far)).where("kind = 1").select("symbol", "tf", "t", "x.*", (F.col("n") + F.col("x.horizon")).alias("k"))
    return placed.join(numbered, ["symbol", "tf", "k"]).select("symbol", "tf", "id", "t", "horizon", "target_t", (F.col("later") - F.col("c")).alias("change"))
