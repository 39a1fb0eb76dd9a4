"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from barloom.llm import negatives, queries, vptree

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    # names that clash with names used inside
    T.StructField("row", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("windows", T.StringType()),
])


def brute(rows):
    """All pairs in Python integers; rows (vec_id, label, vector)."""
    kept = []
    for i, label, v in dict.fromkeys((i, y, None if v is None else tuple(v)) for i, y, v in rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(256 * x) if abs(x) < 2**60 else int(x) * 256 for x in v]))
    hold = lambda s: max(-vptree.MOST, min(vptree.MOST, s))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, v in kept:
        if i is None or i % negatives.ANCHORS:
            continue
        met = [(hold(sum(a * b for a, b in zip(v, w, strict=True))), j, y) for j, y, w in kept if len(w) == len(v)]
        for p, j, _ in sorted((m for m in met if m[2] == label and m[1] != i), key=key)[:5]:
            fits = sorted((m for m in met if m[2] != label and 80 * p <= 100 * m[0] <= 100 * p), key=key)[:5]
            out += [(i, j, r + 1, m[1], p, m[0]) for r, m in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "r", 1, 2.0, "w") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in negatives.mine(df).collect()), key=repr)


def vectors(n, dim, seed, labels=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    x = centres[rnd.integers(0, 12, n)] + 0.3 * rnd.normal(size=(n, dim))
    return [(int(i), int(rnd.integers(0, labels)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim", [2, 16])
def test_against_all_pairs(spark, monkeypatch, dim):
    monkeypatch.setattr(vptree, "LEAF", 16)
    rows = vectors(900, dim, dim)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_trees_leave_out_rows(monkeypatch):
    """The annulus is used: a search reads fewer than half of the leaves, and gives what a scan gives."""
    monkeypatch.setattr(vptree, "LEAF", 16)
    rnd = np.random.default_rng(5)
    x = np.floor(256 * rnd.normal(size=(4000, 3)))
    tree = vptree.Tree.load(vptree.Tree(x, np.arange(4000), rnd.integers(0, 3, 4000)).dump())
    read = 0
    for q in x[:40]:
        probe = vptree.Probe(tree, q, 10**9, 1)
        scores = (tree.x @ q).astype(int)
        high = int(np.quantile(scores, 0.9))
        low = int(0.8 * high)
        want = sorted((-s, i) for s, i, y in zip(scores.tolist(), tree.ids.tolist(), tree.labels.tolist(), strict=True) if y != 1 and low <= s <= high)[:5]
        assert [(-s, i) for s, i in probe.best(False, 5, low, high)] == want
        read += len(probe.kept)
    assert read < 40 * 256 * 0.5


def test_edge_cases(spark):
    assert mined(spark, []) == []
    flat = [1.0, 0.5]
    rows = [
        (0, 1, flat), (0, 1, flat), (1, 1, flat), (2, 1, flat), (3, 2, flat), (4, 2, flat), (None, 1, flat), (None, 2, flat), (100, 3, [-1.0, 0.0]), (101, 3, [1.0, 0.0]),
        (5, None, flat), (6, 2, None), (7, 2, [1.0, None]), (8, 2, [float("inf"), 1.0]), (9, 2, [float("nan"), 1.0]), (200, 1, []), (201, 1, []), (202, 2, []), (300, 1, [1.0]),
        (400, 5, [1e300, 1.0, 1e300]), (401, 5, [1e300, 2.0, -1e300]), (402, 6, [3.0, 5.0, 1e5]), (403, 5, [1e15, 2e15, 3.3]), (404, 6, [1e300, 1.0, 0.0]), (0, 1, [9.0, 9.0]),
    ]
    assert mined(spark, rows) == brute(rows)


def test_hot_copies(spark, monkeypatch):
    """A third of the rows are copies of one vector under two labels."""
    monkeypatch.setattr(vptree, "LEAF", 16)
    rows = vectors(600, 8, 3) + [(1000 + k, k % 2, [0.25] * 8) for k in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, sf_dir).collect()), key=repr) == brute(rows)
