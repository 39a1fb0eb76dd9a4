"""Bars of many series from prioritised sources, each series failing for itself.

A Python data source with one partition per (symbol, timeframe): its task tries the sources
in order of priority, ``<path>/source=<source>/symbol=<symbol>/tf=<tf>/*.json`` with one bar a
line, and takes the first that reads and validates.  A coarser timeframe that a source
lacks is made of its hourly bars.  What went wrong becomes part of the rows: a series
without any sound source is one row without a bar, with all its errors; one that fell
back has them on its bars.  No series can fail another one or the job.

Paths are those of ``pyarrow.fs`` (local, HDFS, object stores); a task holds one series.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.sources.bars import SECONDS

SCHEMA = "symbol string, tf string, source string, t long, o double, h double, l double, c double, v double, errors string"
DERIVED = {"h4": "h1", "d1": "h1"}


class _Series(InputPartition):
    def __init__(self, symbol: str, tf: str):
        self.symbol, self.tf = symbol, tf


def _lines(files: fs.FileSystem, folder: str) -> list[dict]:
    found = [x for x in files.get_file_info(fs.FileSelector(folder)) if x.is_file and x.path.endswith(".json")]
    out = []
    for info in sorted(found, key=lambda x: x.path):
        with files.open_input_stream(info.path) as stream:
            out += [json.loads(line) for line in stream.read().decode("utf-8").splitlines() if line.strip()]
    return out


def validated(rows: list[dict], least: int) -> list[tuple]:
    """(t, o, h, l, c, v) in order of time; raises where a value is missing or impossible, a time repeats, or bars are too few."""
    bars = []
    for r in rows:
        t, o, h, l, c, v = (r.get(k) for k in "tohlcv")
        if any(not isinstance(x, (int, float)) or isinstance(x, bool) or x != x for x in (t, o, h, l, c)):
            raise ValueError(f"a value is missing at {t}")
        if not l <= min(o, c) <= max(o, c) <= h:
            raise ValueError(f"prices out of order at {t}")
        bars.append((int(t), float(o), float(h), float(l), float(c), float(v or 0)))
    bars.sort()
    if any(a[0] == b[0] for a, b in zip(bars, bars[1:])):
        raise ValueError("times repeat")
    if len(bars) < least:
        raise ValueError(f"{len(bars)} bars, at least {least} expected")
    return bars


def coarser(bars: list[tuple], tf: str, part: str) -> list[tuple]:
    """Bars of ``tf`` made of those of ``part``; a newest one that is still forming is dropped."""
    step, out = SECONDS[tf], {}
    for t, o, h, l, c, v in bars:
        k = t // step * step
        a = out.get(k)
        out[k] = (k, o, h, l, c, v) if a is None else (k, a[1], max(a[2], h), min(a[3], l), c, a[5] + v)
    made = list(out.values())
    return made[:-1] if made and made[-1][0] + step > bars[-1][0] + SECONDS[part] else made


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sources = options["path"], json.loads(options["sources"])
        self.series, self.least = json.loads(options["series"]), json.loads(options.get("least", "{}"))

    def partitions(self) -> list[_Series]:
        return [_Series(*x) for x in self.series]

    def _tried(self, source: str, symbol: str, tf: str) -> list[tuple]:
        files, base = fs.FileSystem.from_uri(self.path)
        folder = lambda tf: f"{base}/source={source}/symbol={symbol}/tf={tf}"
        least = int(self.least.get(tf, 1))
        if files.get_file_info(folder(tf)).type == fs.FileType.NotFound and tf in DERIVED:
            part = DERIVED[tf]
            return validated([dict(zip("tohlcv", x, strict=True)) for x in coarser(validated(_lines(files, folder(part)), 1), tf, part)], least)
        return validated(_lines(files, folder(tf)), least)

    def read(self, partition: _Series) -> Iterator[tuple]:
        symbol, tf, errors = partition.symbol, partition.tf, []
        for source in self.sources:
            try:
                bars = self._tried(source, symbol, tf)
            except Exception as e:  # whatever is wrong with a source is that series' affair
                errors.append(f"{source}: {type(e).__name__}")
                continue
            told = "; ".join(errors) or None
            for bar in bars:
                yield (symbol, tf, source, *bar, told)
            return
        yield (symbol, tf, *[None] * 7, "; ".join(errors))


class Feeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "barloom_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, series: list[tuple[str, str]], sources: tuple[str, ...] = ("primary", "fallback"), least: dict[str, int] | None = None) -> DataFrame:
    """Rows of ``SCHEMA`` for the given series; ``least`` has the bars expected per timeframe."""
    if not series:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(Feeds)
    options = {"path": path, "series": json.dumps([list(x) for x in series]), "sources": json.dumps(list(sources)), "least": json.dumps(least or {})}
    return spark.read.format("barloom_feeds").options(**options).load()


def bars_of(rows: DataFrame) -> DataFrame:
    return rows.where("t is not null").select("symbol", "tf", "t", "o", "h", "l", "c", "v")


def health(rows: DataFrame) -> DataFrame:
    """One row per series: its source (null: none worked), bars, newest bar, errors, whether to write it, whether it fell back.

    A series without a sound source keeps what was stored before (``write`` is false).
    """
    out = rows.groupBy("symbol", "tf").agg(F.max("source").alias("source"), F.count("t").alias("bars"), F.max("t").alias("newest"), F.max("errors").alias("errors"))
    return out.withColumn("write", F.col("bars") > 0).withColumn("fell_back", F.col("source").isNotNull() & F.col("errors").isNotNull())


def source_counts(health_rows: DataFrame) -> DataFrame:
    """Series and bars per timeframe and source; series without any are counted as "failed"."""
    return health_rows.groupBy("tf", F.coalesce("source", F.lit("failed")).alias("source")).agg(F.count("*").alias("series"), F.sum("bars").alias("bars"))


def write_feed(bars: DataFrame, path: str, source: str) -> None:
    """Bars as the files of one source."""
    bars.withColumn("source", F.lit(source)).repartition("symbol", "tf").write.partitionBy("source", "symbol", "tf").mode("append").json(path)
