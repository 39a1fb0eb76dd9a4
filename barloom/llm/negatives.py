"""Hard-negative mining: exact windows of inner products through vantage-point trees.

Rows are dealt to shards by hash; one task builds one shard's tree (``vptree``), which
is kept as a table.  Anchors ask every shard twice: first for the best rows of their
own label, then, per distinct score of a positive, for the best rows of other labels
with scores between ``FLOOR`` per cent of it and all of it.  Shards answer with at most
``K`` rows per question, so what is merged has shards x K rows per question and no row
per pair.  Shards hold at most about ``SHARD_ROWS`` rows or ``SHARD_BYTES`` of them, and
anchors come in blocks of at most about ``BLOCK_ROWS`` or ``BLOCK_BYTES``.

Edge cases: rows with a null label, a null vector or a null or non-finite component
take no part; rows that are equal in id, label and vector count once; rows that only
share an id count separately, but not as each other's positives; a null id is no anchor
and comes last among equal scores; vectors of different lengths do not meet; a
component whose 256-fold has no double counts as the largest double, a score beyond
+-(2**63 - 1) as that bound; anchors without positives, and positives without rows in
their window (so all with a negative score), give no rows; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, small_batches
from barloom.llm.vptree import NO_ID, Probe, Tree

K, FLOOR, ANCHORS, SCALE = 5, 80, 100, 256.0
SHARDS, SHARD_ROWS, BLOCK_ROWS = 6, 65_536, 65_536
SHARD_BYTES, BLOCK_BYTES = 128 << 20, 64 << 20
PART = 1 << 22
MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec) of rows that take part; vec: bytes of the floored components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.finfo(np.float64).max
        for batch in batches:
            out = []
            for v in batch.column(2):
                values = v.values if v.is_valid else None
                x = None if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype("<f8")
                with np.errstate(over="ignore"):
                    out.append(None if x is None or not np.isfinite(x).all() else (np.clip(np.floor(SCALE * x), -top, top) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    some = rows.where("label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    packed = some.mapInArrow(run, "vec_id long, label long, vec binary").where("vec is not null")
    return packed.distinct().select("vec_id", "label", (F.length("vec") / 8).cast("int").alias("dim"), "vec")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dim)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    dim, shard = (k.as_py() for k in key)
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    ids = rows.column("vec_id").fill_null(int(NO_ID)).to_numpy()
    data = Tree(_matrix(rows.column("vec"), dim), ids, rows.column("label").to_numpy(), seed=shard).dump()
    parts = [data[a : a + PART] for a in range(0, len(data), PART)]
    return pa.table({"dim": pa.array([dim] * len(parts), pa.int32()), "shard": pa.array([shard] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})


FOUND = "row long, window long, id long, score long"


def _search(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
    """Best rows of one shard per question: of the own label (windows null), or of others per window."""
    out: list[tuple] = []
    if len(asked) and len(shard):
        tree = Tree.load(b"".join(shard.sort_by("part").column("data").to_pylist()))
        vectors = _matrix(asked.column("vec"), tree.x.shape[1])
        rest = (asked.column(n).to_pylist() for n in ("row", "vec_id", "label", "windows"))
        for q, row, own, label, windows in zip(vectors, *rest, strict=True):
            probe = Probe(tree, q, own, label)
            if windows is None:
                out += [(row, None, i, s) for s, i in probe.best(True, K)]
            for high in windows or ():
                low = -(-FLOOR * high // 100)
                if low <= high:
                    out += [(row, high, i, s) for s, i in probe.best(False, K, low, high)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "window", "id", "score"), columns, strict=True)})


def mine(rows: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """Columns of ``MINED`` for the anchors among ``rows(vec_id, label, embedding)`` (default: ids divisible by ``ANCHORS``)."""
    small_batches(rows.sparkSession, rows=4096)
    wanted = F.col("vec_id") % ANCHORS == 0 if is_anchor is None else is_anchor
    base = cut(_packed(rows).withColumn("row", F.monotonically_increasing_id()))
    total, dim = base.agg(F.count("*"), F.max("dim")).first()
    within = lambda rows, size: max(1, min(rows, size // (8 * max(1, dim or 1))))
    shards = max(SHARDS, -(-total // within(SHARD_ROWS, SHARD_BYTES)))
    number = lambda name, n: F.pmod(F.xxhash64("row", F.lit(name)), F.lit(n)).cast("int")
    trees = cut(base.withColumn("shard", number("shard", shards)).groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, part int, data binary"))
    anchors = cut(base.where(wanted))
    blocks = max(1, -(-anchors.count() // within(BLOCK_ROWS, BLOCK_BYTES)))
    keys = ["dim", "shard", "block"]
    copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(questions: DataFrame) -> DataFrame:
        every = questions.withColumn("block", number("block", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        found = every.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_search, FOUND)
        order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)

    plain = anchors.select("row", "vec_id", "label", "dim", "vec")
    positives = cut(ask(plain.withColumn("windows", F.lit(None).cast("array<long>"))).select("row", F.col("id").alias("positive"), "score"))
    windows = positives.groupBy("row").agg(F.collect_set("score").alias("windows"))  # at most K scores
    negatives = ask(plain.join(windows, "row"))
    named = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    pairs = positives.join(negatives.select("row", F.col("window").alias("score"), "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score")), ["row", "score"])
    return pairs.join(anchors.select("row", "vec_id"), "row").select(
        F.col("vec_id").alias("anchor_id"), named("positive").alias("positive_id"), F.col("rank").cast("int"), named("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score"
    )
