"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard.

A document is the set of its distinct five-word shingles.  Shingle hashes are
mapped to a universe of ``UNIVERSE`` places; a first permutation scatters them,
and the k-th signature coordinate is the smallest value of a second permutation
shifted circularly by k, so two permutations give all ``BANDS * ROWS``
coordinates.  A gathered run of the second permutation is one slice of memory,
which makes the signature a gather and a column minimum.

Documents of equal sets form a class, known by a 128-bit digest of the sorted
set and named by the number of one of its rows; classes are what is banded and compared.  In every bucket each class is
verified against the bucket's smallest class, its leader; after the components
of those links are known, every class that is not in its leader's component is
verified against all classes that have the same leader.  That is done by tiles,
whose members are indexed by shingle, and returns links only.  So no candidate
pair of different components goes unverified, and no row is made per pair.  A pair at the threshold is missed by
banding with a probability of about 4 in a million.

Edge cases: null text and text without words have an empty set, are linked with
nothing and keep their own id; repeated rows are one class; rows of one id with
different texts are compared like any others; a null id keeps null; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, hot_join, small_batches
from barloom.llm.components import components
from barloom.llm.hashing import RADIX, mixed, run_hashes, split_words

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 64, 6
UNIVERSE = 1 << 20
SEED = 20240229


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """First permutation; sliding runs of the second, circularly continued."""
    rng, width = np.random.default_rng(SEED), BANDS * ROWS
    first, second = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.int32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *run_hashes(split_words(text), SHINGLE)]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number per band."""
    first, runs = _tables()
    places = first[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    low = np.full(BANDS * ROWS, UNIVERSE, np.int32)
    for a in range(0, len(places), 2048):
        np.minimum(low, runs[places[a : a + 2048]].min(axis=0), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(RADIX)
    for column in low.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ column.astype(np.uint64))
    return keys.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: 100 * intersection >= PERCENT * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


SIGNED = "doc_id long, text_hash long, row long, n_shingles long, high long, low long, bands array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """One row per document: its number, the size and digest of its set, and its buckets (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column(3):
                hashes = shingles(text.as_py())
                sizes.append(len(hashes))
                some = len(hashes) > 0
                digests.append(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8").tolist() if some else [None, None])
                bands.append(signature(hashes) if some else None)
            columns = [*batch.columns[:3], pa.array(sizes, pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "row", "n_shingles", "high", "low", "bands"])

    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    return given.mapInArrow(run, SIGNED)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, linked) of class pairs ``pairs(a, b)``, compared on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            found = []
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                if y not in known:
                    known = {y: shingles(batch.column(3)[k].as_py())}  # rows of one b mostly follow each other
                found.append(linked(shingles(batch.column(2)[k].as_py()), known[y]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.bool_())], ["a", "b", "linked"])

    one = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def _blocks():
    """A ``mapInArrow`` function over sorted rows (cell, tile_t, tile_q, query, class, root, text).

    Targets (query = 0) of a tile come first and are indexed by shingle; every query
    then gets its intersection with all of them from one look-up.  One link per query
    and component of targets is enough, and is what comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, targets, index = None, [], None
        for batch in batches:
            cells, ts, qs, query, classes, roots = (batch.column(k).to_pylist() for k in range(6))
            out = []
            for k, key in enumerate(zip(cells, ts, qs, strict=True)):
                if key != tile:
                    tile, targets, index = key, [], None
                hashes = shingles(batch.column(6)[k].as_py())
                if not query[k]:
                    targets.append((classes[k], roots[k], hashes))
                    continue
                if not targets:
                    continue
                if index is None:
                    flat = np.concatenate([t[2] for t in targets])
                    order = np.argsort(flat, kind="stable")
                    sizes = np.array([len(t[2]) for t in targets])
                    index = flat[order], np.repeat(np.arange(len(targets)), sizes)[order], sizes, np.array([t[1] for t in targets])
                values, owners, sizes, target_roots = index
                low, high = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
                many = high - low
                at = np.repeat(high - np.cumsum(many), many) + np.arange(many.sum())
                both = np.bincount(owners[at], minlength=len(targets))
                hit = np.flatnonzero((100 * both >= PERCENT * (len(hashes) + sizes - both)) & (target_roots != roots[k]))
                for j in dict((int(target_roots[j]), int(j)) for j in hit).values():
                    out.append((classes[k], targets[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _rest(near: DataFrame, roots: DataFrame, texts: DataFrame, block: int = 400) -> DataFrame:
    """Links that the leaders did not settle.

    A cell is all classes that share a leader, so it holds every bucket of that
    leader.  Its classes outside the leader's component are queries against all its
    other classes; both sides are split into tiles of about ``block`` rows.
    """
    to = roots.select(F.col("node"), F.col("root"))
    placed = near.join(to.withColumnRenamed("node", "a").withColumnRenamed("root", "ar"), "a", "left").join(to.withColumnRenamed("node", "b").withColumnRenamed("root", "br"), "b", "left")
    placed = placed.select("a", "b", F.coalesce("ar", "a").alias("root"), (F.coalesce("ar", "a") != F.coalesce("br", "b")).alias("apart"))
    placed = cut(placed)
    sizes = placed.groupBy("b").agg(F.count("*").alias("n"), F.count_if("apart").alias("q")).where("n > 1 and q > 0")
    tiles = sizes.select(F.col("b").alias("cell"), F.ceil(F.col("n") / block).cast("int").alias("nt"), F.ceil(F.col("q") / block).cast("int").alias("nq"))
    both = placed.join(tiles, F.col("b") == F.col("cell"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("a"), F.col(n)).cast("int"))
    targets = both.select("cell", F.lit(0).alias("query"), F.col("a").alias("class"), "root", own("nt").alias("t"), every("nq").alias("q"))
    queries = both.where("apart").select("cell", F.lit(1).alias("query"), F.col("a").alias("class"), "root", every("nt").alias("t"), own("nq").alias("q"))
    rows = targets.unionByName(queries).withColumn("tile_t", F.explode("t")).withColumn("tile_q", F.explode("q")).join(texts, "class")
    dealt = rows.select("cell", "tile_t", "tile_q", "query", "class", "root", "text").repartition("cell", "tile_t", "tile_q").sortWithinPartitions("cell", "tile_t", "tile_q", "query")
    return dealt.mapInArrow(_blocks(), "a long, b long")


def _key(doc_id: str, text_hash: str) -> list:
    """Columns that name a document's id and text, none of them null."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("d"), F.col(doc_id).isNull().alias("none"), F.col(text_hash).alias("h")]


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and first, one row per row of ``docs``.

    ``first`` holds for the rows of the one id and text that stands for the group
    (the smallest id, null being the largest) and is null without words.
    """
    small_batches(docs.sparkSession)
    every = cut(signed(docs))
    some = every.where("n_shingles > 0")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    classes = some.groupBy("high", "low").agg(F.min("row").alias("class"), F.min("n_shingles").alias("n"), one, F.count("*").alias("rows"), F.first("bands").alias("bands"))
    rows = classes.select("class", "n", F.explode("bands").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(F.min("class").alias("leader"), F.max("class").alias("last"), F.min_by("n", "class").alias("leader_n")).where("leader < last").drop("last")
    members = cut(rows.join(leaders, "bucket"))  # only buckets of two classes or more

    def fits(n: str, m: str):
        return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)  # sets of other sizes cannot reach the threshold

    near = members.where("class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b"), fits("n", "leader_n").alias("fits")).distinct()
    near = cut(near)
    wanted = members.select("class").distinct().join(classes.select("class", *_key("one.doc_id", "one.text_hash")), "class")
    content = docs.withColumn("__h", F.xxhash64("text")).select(*_key("doc_id", "__h"), "text").groupBy("d", "none", "h").agg(F.first("text").alias("text"))
    texts = cut(wanted.join(content, ["d", "none", "h"]).select("class", "text"))
    edges = cut(_verified(near.where("fits").select("a", "b"), texts).where("linked").select("a", "b"))
    roots = components(edges)
    more = cut(_rest(near, roots, texts))
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    own = classes.select("class", "high", "low", "one", "rows").join(roots, F.col("class") == F.col("node"), "left")
    own = cut(own.select("high", "low", "one", "rows", F.coalesce("root", "class").alias("root")))
    total = own.agg(F.sum("rows")).first()[0] or 0
    smallest = own.groupBy("root").agg(F.min("one").alias("first"), F.count("*").alias("n"))
    named = hot_join(own, smallest, ["root"], total).select("high", "low", "first", F.col("rows").alias("n"))
    placed = hot_join(some.drop("bands"), named, ["high", "low"], total)
    is_first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("text_hash") == F.col("first.text_hash"))
    found = placed.select("doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id"), is_first.alias("first"))
    empty = every.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("boolean").alias("first"))
    return found.unionByName(empty)


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return grouped(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that remain: one per group, all columns kept.

    Of a group the row of the smallest id stays (a null id is the largest); should
    that very id and text be repeated, one of its rows stays.  Documents without
    words are in no group and stay.
    """
    marked = cut(grouped(docs).where("first is not null").select("doc_id", "text_hash", "first"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.when(~F.col("none"), F.col("d"))) & (F.xxhash64("text") == F.col("h"))
    gone = marked.where("not first").select(*_key("doc_id", "text_hash")).distinct()
    left = docs.join(gone, same, "left_anti")
    repeated = marked.where("first").groupBy(*_key("doc_id", "text_hash")).count().where("count > 1").drop("count")
    if repeated.isEmpty():
        return left
    # the same id and text more than once: of those rows, and only those, one each
    twice = left.join(repeated, same, "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return left.join(repeated, same, "left_anti").unionByName(twice)
