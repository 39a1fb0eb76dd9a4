from pyspark.sql import functions as F

from barloom.llm import langid, queries
from tests.llm.cases import documents, row


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert 0.2 < len(held) / len(got) < 0.45
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    docs = documents(spark, [row(1, "the cat and the dog"), row(2, "der Hund und die Katze", "de"), row(3, "the same", None), row(None, None), row(4, ""), row(5, "12 34 !!"), row(6, "the dog"), row(7, "die Katze " * 200_000, None)])
    model = langid.fit(docs)
    assert model.langs == ("de", "en")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model, [F.col("doc_id")]).collect()}
    assert got[None] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "en" and got[7][0] == "de"
    nothing = langid.fit(documents(spark, []))
    assert [r.lang_pred for r in langid.predict(docs, nothing, [F.col("doc_id")]).collect()] == ["und"] * 8


def test_segments_change_nothing(monkeypatch, spark):
    model = langid.fit(documents(spark, [row(1, "the cat and the dog"), row(2, "der Hund und die Katze", "de")]))
    texts = ["the dog and die Katze und the cat " * 40, "x", None]
    whole = model.totals(texts)
    monkeypatch.setattr(langid, "SEGMENT", 7)
    assert abs(model.totals(texts) - whole).max() < 1e-6


def brute(trained, texts):
    """Counts of hashed 1- to 3-grams in dictionaries, one text and one character at a time."""
    import math
    from collections import Counter, defaultdict

    def grams(text):
        text = "  " + (text or "").lower()
        for k in range(2, len(text)):
            a, b, c = (ord(x) for x in (text[k], text[k - 1], text[k - 2]))
            one, two, three = langid._MULTIPLIERS
            for value, salt in zip((a * int(one), a * int(one) + b * int(two), a * int(one) + b * int(two) + c * int(three)), langid._SALTS):
                value %= 1 << 32
                value = (((value ^ (value >> 15)) + int(salt)) * 0x2C1B3C6D) % (1 << 32)
                yield value >> (32 - 14)

    counts, rows = defaultdict(Counter), Counter()
    for text, lang in trained:
        if lang is not None:
            counts[lang].update(grams(text))
            rows[lang] += 1
    langs = sorted(rows)
    out = []
    for text in texts:
        if not langs or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        found = list(grams(text))
        totals = []
        for lang in langs:
            n = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            totals.append(math.log((rows[lang] + 1) / (sum(rows.values()) + len(langs))) + sum(math.log((counts[lang][g] + 0.5) / n) for g in found))
        top = max(totals)
        out.append((langs[totals.index(top)], 1 / sum(math.exp(t - top) for t in totals)))
    return out


def test_whole_query_against_brute_force(spark, sf_dir):
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    want = dict(zip([r.doc_id for r in docs], brute([(r.text, r.lang) for r in docs if not held(r.doc_id)], [r.text for r in docs])))
    got = queries.QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-6 and r.held_out == held(r.doc_id)


def test_ties_and_many_languages(spark, monkeypatch):
    tied = langid.fit(documents(spark, [row(1, "same", "b"), row(2, "same", "a")]))
    assert tied.predict(["same", "other"])[0] == ["a", "a"]
    texts = ["the dog and die Katze and the cat " * 40, "x", None]
    whole = tied.totals(texts)
    monkeypatch.setattr(langid, "CELLS", 10)
    assert abs(tied.totals(texts) - whole).max() < 1e-6
