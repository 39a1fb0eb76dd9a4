"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
#: A key with more than this part of all rows is joined by broadcast; so few keys can have as many.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, megabytes: int = 16) -> None:
    """Bound what one Arrow batch of long texts holds in a Python worker."""
    spark.conf.set(_ARROW_ROWS, str(rows))
    spark.conf.set(_ARROW_BYTES, f"{megabytes}m")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if everything runs in this one process;
    a cluster, whose machines would not see it, is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    kept = getattr(sc, "_barloom_folder", None)
    if kept is None:
        kept = sc._barloom_folder = "file://" + tempfile.mkdtemp(prefix="barloom-")
    return kept


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Compared with ``checkpoint()`` the files are columnar and compressed.  They
    survive lost executors and are removed when the driver process ends.  The
    shuffle files of the write go with it: nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["cut_path"] = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a finished ``cut`` table."""
    found = next((x for x in _written if x[1] == df.__dict__.get("cut_path")), None)
    if found:
        _written.remove(found)
        _remove(*found)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may already be gone when the interpreter ends
            return


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def hot_join(rows: DataFrame, lookup: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has unique keys and in ``n`` the number of rows of each.

    Keys with more than ``total / HOT`` rows, fewer than HOT of them at any size, are
    broadcast, so their rows stay where they are; the others are shuffled.
    """
    some = lookup.where((F.col("n") > 0) & F.col("n").isNotNull())
    hot, cold = some.where(F.col("n") * HOT > total).drop("n"), some.where(F.col("n") * HOT <= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
