"""Embedding near-duplicates: one navigable graph per shard, every shard queried.

Vectors of equal bytes form a class, known by a 128-bit digest and named by the number
of one of its rows.  Double components are scaled by the power of two that brings the
largest to about 1, which changes no cosine, so squares neither overflow nor vanish.  Classes are dealt to shards by hash; one
task builds one shard's graph (``hnsw``), audits its recall on planted neighbours
turned away to the threshold cosine, and widens the beam until the audit passes; where no beam passes, the shard is scanned exactly.
Every class then queries every shard, in blocks: a task holds one graph and one
block of queries.  A query with more than half a beam of links is asked again
with a beam four times as wide, until the links fit.  Candidates near the
threshold are verified with their cosine in double precision.  A task returns a
count per query and the edges of its own union-find forest, never a row per pair;
components unite those forests.

Shards number at least ``SHARDS`` and hold at most about ``SHARD_ROWS`` vectors or
``SHARD_BYTES`` of them, query blocks at most about ``BLOCK_ROWS`` or ``BLOCK_BYTES``,
whichever is less, so memory per task is bounded at any dimension.  A link
is counted at the query that found it.

Edge cases: null vectors, null or non-finite components and zero vectors are
linked with nothing and keep their own id; vectors of different lengths are never
linked; repeated rows are linked like other equal vectors; ids that repeat count
as different vectors; a null id stays null; an empty table gives no rows; labels
and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import cut, hot_join, small_batches
from barloom.llm.components import components
from barloom.llm.hnsw import Graph

COSINE, RECALL = 0.95, 0.995
SHARDS, SHARD_ROWS, BLOCK_ROWS = 6, 65_536, 131_072
#: A vector counts with 12 bytes a component: it is held in double and in single precision.
SHARD_BYTES, BLOCK_BYTES = 128 << 20, 128 << 20
SLACK = 1e-4
PART = 1 << 22


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, row, digest, dim, vec): bytes of usable vectors; null digest, dim and vec for the others."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                if values is None or values.null_count or not len(values):
                    out.append(None)
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(kind)
                top = np.abs(x).max()
                usable = np.isfinite(top) and top > 0
                if usable and not single:
                    x = np.ldexp(x, -np.frexp(top)[1])
                out.append((x + 0.0).tobytes() if usable else None)  # -0 becomes 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "row", "vec"])

    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, "vec_id long, row long, vec binary")
    return given.select("vec_id", "row", F.md5("vec").alias("digest"), (F.length("vec") / int(kind[-1])).cast("int").alias("dim"), "vec")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    n = len(column)
    return np.frombuffer(joined, "<f4" if len(joined) == 4 * dim * n else "<f8").reshape(n, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    dim, shard = (k.as_py() for k in key)
    rows = rows.sort_by("class")
    raw = _matrix(rows.column("vec"), dim)
    graph = Graph(_unit(raw), seed=shard)
    graph.widen(COSINE, RECALL)
    data = graph.dump(raw=raw, ids=rows.column("class").to_numpy(), counts=rows.column("n").to_numpy())
    parts = [data[a : a + PART] for a in range(0, len(data), PART)]
    return pa.table({"dim": pa.array([dim] * len(parts), pa.int32()), "shard": pa.array([shard] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _found(graph: Graph, queries: np.ndarray, beam: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, node) of candidates at the threshold; crowded queries are asked again with wider beams."""
    crowded = []
    step = max(1, min(512, (1 << 25) // max(1, len(graph.x)), (1 << 20) // beam))
    for a in range(0, len(rows), step):
        ids, sims = graph.search(queries[rows[a : a + step]], beam)
        near = sims >= COSINE - SLACK
        full = near.sum(axis=1) > beam / 2
        if beam < len(graph.x):
            crowded.append(rows[a : a + step][full])
            near &= ~full[:, None]
        r, c = np.nonzero(near)
        yield rows[a : a + step][r], ids[r, c]
    again = np.concatenate(crowded) if crowded else rows[:0]
    if len(again):
        yield from _found(graph, queries, min(4 * beam, len(graph.x)), again)


LINKS = "class long, n long, other long"


def _search(key: tuple, queries: pa.Table, shard: pa.Table) -> pa.Table:
    """Rows (class, n): links of a query in this shard; rows (class, null, other): edges of the local forest."""
    empty = pa.table({k: pa.array([], pa.int64()) for k in ("class", "n", "other")})
    if not len(queries) or not len(shard):
        return empty
    graph, extra = Graph.load(b"".join(shard.sort_by("part").column("data").to_pylist()))
    raw, own, counts = extra["raw"], extra["ids"], extra["counts"]
    names = queries.column("class").to_numpy()
    asked = _matrix(queries.column("vec"), raw.shape[1])
    norms, lengths = np.linalg.norm(raw, axis=1), np.linalg.norm(asked, axis=1)
    links, forest = np.zeros(len(names), np.int64), _Forest()
    for r, c in _found(graph, _unit(asked), graph.beam, np.arange(len(names))):
        for a in range(0, len(r), 1 << 16):
            i, j = r[a : a + (1 << 16)], c[a : a + (1 << 16)]
            ok = (names[i] != own[j]) & (np.einsum("rd,rd->r", asked[i], raw[j]) / (lengths[i] * norms[j]) >= COSINE)
            i, j = i[ok], j[ok]
            np.add.at(links, i, counts[j])
            for x, y in zip(names[i].tolist(), own[j].tolist(), strict=True):
                forest.unite(x, y)
    some = np.flatnonzero(links)
    edges = [(x, forest.find(x)) for x in list(forest.up)]
    edges = [(x, y) for x, y in edges if x != y]
    none = [None] * len(edges)
    return pa.table({
        "class": pa.array([*names[some].tolist(), *(x for x, _ in edges)], pa.int64()),
        "n": pa.array([*links[some].tolist(), *none], pa.int64()),
        "other": pa.array([*[None] * len(some), *(y for _, y in edges)], pa.int64()),
    })


def link(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``."""
    small_batches(vectors.sparkSession, rows=4096)
    every = cut(_packed(vectors))
    classes = cut(every.where("vec is not null").groupBy("digest", "dim").agg(F.min("row").alias("class"), F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("low")))
    total, dim = classes.agg(F.count("*"), F.max("dim")).first()
    within = lambda rows, size: max(1, min(rows, size // (12 * (dim or 1))))
    shards, blocks = max(SHARDS, -(-total // within(SHARD_ROWS, SHARD_BYTES))), max(2, -(-total // within(BLOCK_ROWS, BLOCK_BYTES)))
    number = lambda name, n: F.pmod(F.xxhash64("class", F.lit(name)), F.lit(n)).cast("int")
    dealt = classes.withColumn("shard", number("shard", shards))
    graphs = cut(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, part int, data binary"))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    queries = classes.select("dim", "class", "vec", number("block", blocks).alias("block"), every_shard)
    copies = graphs.select("dim", "shard", "part", "data", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["dim", "shard", "block"]
    found = cut(queries.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_search, LINKS))
    links = found.where("n is not null").groupBy("class").agg(F.sum("n").alias("links"))
    roots = components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    own = classes.select("class", "digest", "dim", "low", F.col("n").alias("rows")).join(links, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    own = cut(own.select("digest", "dim", "low", "rows", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")))
    rows = own.agg(F.sum("rows")).first()[0] or 0
    least = own.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(own, least, ["root"], rows).select("digest", "dim", "n_links", "component_id", F.col("rows").alias("n"))
    found = hot_join(every.where("vec is not null").select("vec_id", "digest", "dim"), named, ["digest", "dim"], rows)
    alone = every.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
