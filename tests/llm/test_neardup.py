import random

import numpy as np
import pytest

from barloom.llm import neardup
from barloom.llm.components import components
from tests.llm.cases import documents, edge_rows, row


def words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc position -> (set size, group) by comparing all pairs."""
    sets = [words(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(r[0], len(s), low[find(k)] if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets))]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(4000, 4300)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies():
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for k in range(220):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
        rows.append(row(1000 + k, " ".join(copy)))
    return rows


def test_equals_brute_force_with_a_large_group(spark, monkeypatch):
    rows = near_copies() + edge_rows() + [row(50, "One two Three"), row(49, "one  TWO\tthree"), row(48, "one two"), row(47, "ÀB c"), row(46, "àb c")]
    want = sorted(map(str, brute(rows)))
    got = neardup.group(documents(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) or r.doc_id is None for r in got)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.group(docs).collect()} == set(brute(rows))


def test_keep_one(spark):
    rows = edge_rows() + [row(4, "alpha beta gamma delta epsilon zeta"), row(None, "lonely words"), row(None, "lonely words")]
    kept = neardup.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    got = kept.collect()
    texts = [r.text for r in got]
    assert len(got) == 10 and texts.count("alpha beta gamma delta epsilon zeta") == 1 and texts.count("same text here twice over") == 1 and texts.count("lonely words") == 1
    assert {r.doc_id for r in got if r.text and r.text.startswith("alpha")} == {4}
    assert {None, "", " \n\t "} <= set(texts)
    assert neardup.keep_one(documents(spark, [])).count() == 0 and neardup.group(documents(spark, [])).count() == 0


def test_many_repeated_rows(spark):
    """Thousands of rows of one id and text, in two near groups, are one class each and no pair per row."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join([*base, "end"])]
    rows = [row(1 + k % 2, texts[k % 2]) for k in range(10_000)] + [row(None, texts[0])] * 50 + [row(9, "")] * 2000
    got = neardup.group(documents(spark, rows)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, True, 5000), (2, 1, False, 5000), (None, 1, True, 50), (9, 9, True, 2000)}
    kept = neardup.keep_one(documents(spark, rows)).groupBy("doc_id").count().collect()
    assert {tuple(r) for r in kept} == {(1, 1), (9, 2000)}


def test_shingles_of_spans(monkeypatch):
    text = " ".join(f"a{k % 50}" for k in range(700))
    whole = neardup.shingles(text)
    monkeypatch.setattr("barloom.llm.hashing.SPAN", 16)
    assert (neardup.shingles(text) == whole).all() and len(whole) == len(words(text))


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_signature_estimates_similarity(share):
    """Coordinates of the circulant signature agree about as often as the sets do."""
    rng = np.random.default_rng(5)
    first, runs = neardup._tables()
    n = 400
    common = rng.integers(0, 2**63, int(n * 2 * share / (1 + share)), dtype=np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)]) for _ in "ab")
    low = [runs[first[(x & np.uint64(neardup.UNIVERSE - 1)).astype(int)]].min(axis=0) for x in (a, b)]
    assert abs((low[0] == low[1]).mean() - share) < 0.1
