"""Spelling variants against all pairs, found without hashes."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from barloom.llm import queries, spelling
from tests.llm.cases import documents, row


def count(docs):
    """(doc_id, text) to words and counts, one run at a time."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    """Exactly one character inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) != len(a) + 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :]


def brute(docs):
    n = count(docs)
    sizes = {}
    for w in n:
        sizes.setdefault(len(w), []).append(w)
    found = {}
    for w in n:
        near = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in sizes.get(size, ()) if v != w and one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        found[w] = (form, len(near))
    out = []
    for w, (form, k) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out.append((w, form, root, n[w], k, None if form is None else n[form]))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def noisy(seed, n_docs=60, vocabulary=12):
    rnd = random.Random(seed)
    bases = ["".join(rnd.choice("abcÀé") for _ in range(rnd.randint(7, 10))) for _ in range(vocabulary)]
    docs = []
    for k in range(n_docs):
        words = []
        for _ in range(120):
            w = bases[min(int(rnd.expovariate(0.9)), vocabulary - 1)]
            while rnd.random() < 0.25:
                at = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:at] + rnd.choice("abcÀé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rnd.choice("abcÀé") + w[at + 1 :]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        docs.append((k, rnd.choice([" ", "-", "1"]).join(words)))
    return docs


def test_keys_are_those_of_the_texts_left():
    """Equal texts have equal keys wherever they come from, different ones different keys."""
    rnd = random.Random(3)
    seen = {}
    for size in range(1, 12):
        words = ["".join(rnd.choice("abÿ") for _ in range(size)) for _ in range(20)]
        key, place, first, of = spelling.deletion_keys(words)
        for k, p, f, r in zip(key.tolist(), place.tolist(), first.tolist(), of.tolist(), strict=True):
            text = words[r] if p < 0 else words[r][:p] + words[r][p + 1 :]
            assert seen.setdefault(text, k) == k
            assert f == (p <= 0 or words[r][p] != words[r][p - 1])
    assert len(set(seen.values())) == len(seen)


def test_noisy_words(spark):
    docs = noisy(1)
    want = brute(docs)
    assert got(spelling.variants(documents(spark, [row(i, t) for i, t in docs]))) == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] is not None and r[1] != r[2] for r in want) and max(r[4] for r in want) > 10


def test_colliding_hashes(spark):
    """With a hash of 5 bits almost everything collides, and texts still decide."""

    def few(words):
        key, *rest = spelling.deletion_keys(words)
        return np.abs(key) % 32, *rest

    docs = noisy(2, n_docs=12, vocabulary=4)
    words = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(sorted(count(docs).items()))], "id long, word string, n long").toPandas()
    rows = []
    for size, part in words.groupby(words.word.str.len()):
        key, place, first, of = few(part.word.tolist())
        rows += [(int(k), int(p), bool(f), int(part.id.iloc[r]), int(part.n.iloc[r]), part.word.iloc[r]) for k, p, f, r in zip(key, place, first, of, strict=True)]
    told = spark.createDataFrame(rows, f"{spelling.KEYS}, word string")
    met = spelling.meeting_rows(told.drop("word")).join(told.select("id", "word").distinct(), "id")
    near = {r["id"]: r["m"] for r in spelling.near_words(met).groupBy("id").sum("n_near").withColumnRenamed("sum(n_near)", "m").collect()}
    want = {w: m for w, _, _, _, m, _ in brute(docs)}
    assert {w: near.get(i, 0) for i, w in zip(words.id, words.word, strict=True)} == want


def test_long_chains(spark):
    """Roots over several forms, each ten times as frequent."""
    text = " ".join(["wordone"] * 2 + ["wordonea"] * 20 + ["wordoneab"] * 200 + ["wordoneabc"] * 2000 + ["wordoneabcd"] * 20000)
    docs = [(k, text) for k in (2, 3)]
    result = got(spelling.variants(documents(spark, [row(i, t) for i, t in docs])))
    assert result == brute(docs)
    assert [r[2] for r in result if r[0] == "wordone"] == ["wordoneabcd"]


def test_edge_cases(spark):
    huge = "z" * 30_000
    docs = [
        (1, None), (2, ""), (3, "short words only"), (None, "Variant variant VARIANT varient"), (4, f"{huge} {huge}z {huge} {huge}z {huge}y {huge}y"), (5, "éÉÀààààà éÉÀààààà ÷×÷×÷×÷×"), (5, "éÉÀààààà éÉÀààààà ÷×÷×÷×÷×"),
        (6, "aaaaaaaa aaaaaaaa aaaaaaab aaaaaaab aaaaaaa aaaaaaa baaaaaaa baaaaaaa"), (7, "variants " * 300), (8, "varient variant's naïveté"),
    ]
    assert got(spelling.variants(documents(spark, [row(i, t) for i, t in docs]))) == brute(docs)
    assert got(spelling.variants(documents(spark, []))) == []


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.QUERIES["op13_spelling_variants"](spark, sf_dir)) == brute(docs)
