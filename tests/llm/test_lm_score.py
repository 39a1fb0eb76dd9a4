import math
from collections import Counter

import pytest

from barloom.llm import lm_score as lm
from barloom.llm import queries
from tests.llm.cases import documents, edge_rows, row


def pairs_of(text):
    words = (text or "").encode().lower().split()
    return list(zip(["<", *words], [*words, ">"]))


def brute(target, background, docs, in_target, counted):
    """The formula of the module's docstring with dictionaries of words."""
    vocabulary = {w for t in [*target, *background] for _, w in pairs_of(t)} - {">"}
    tables = [[Counter(f(p) for t in texts for p in pairs_of(t)) for f in (lambda p: p, lambda p: p[0], lambda p: p[1])] for texts in (target, background)]

    def loss(table, pair, own):
        n, h, w = (c[x] - o[x] for c, o, x in zip(table, own, (pair, *pair)))
        p = (w + lm.ALPHA) / (sum(table[2].values()) - sum(own[2].values()) + lm.ALPHA * (len(vocabulary) + 2))
        return -math.log(lm.LAMBDA * n / h + (1 - lm.LAMBDA) * p if h else p)

    out = []
    for k, text in enumerate(docs):
        own = [Counter(f(p) for p in pairs_of(text)) for f in (lambda p: p, lambda p: p[0], lambda p: p[1])]
        nothing = [Counter()] * 3
        both = [[loss(t, p, o) for p in pairs_of(text)] for t, o in zip(tables, (own if k in in_target else nothing, own if counted else nothing))]
        out.append(tuple(sum(x) / len(x) for x in both))
    return out


TEXTS = ["the cat sat on the mat", "The cat ran", "a dog sat on a log", "the dog ran on", "", None, "rare words only", "the the the", "the cat sat on the mat"]


@pytest.mark.parametrize("chunk", [1 << 22, 3])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    docs = documents(spark, [row(k, t) for k, t in enumerate(TEXTS)])
    model = lm.fit(docs.where("doc_id < 2"), docs)
    ids = spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id long")
    others = ["the cat sat", "words of none", "", "the mat on the cat"]
    cases = [(docs, TEXTS, {0, 1}, True, {"counted": True, "in_target": ids}), (documents(spark, [row(k, t) for k, t in enumerate(others)]), others, set(), False, {})]
    for given, texts, own, counted, options in cases:
        got = {r.doc_id: r for r in lm.score(given, model, **options).collect()}
        assert len(got) == len(texts)
        for k, (t, b) in enumerate(brute(TEXTS[:2], TEXTS, texts, own, counted)):
            assert got[k].target_loss == pytest.approx(t) and got[k].background_loss == pytest.approx(b) and got[k].score == pytest.approx(t - b)
            assert got[k].n_tokens == len((texts[k] or "").split()) + 1


def test_distributions_sum_to_one():
    """Both models are distributions over the vocabulary, an unknown word and the end, after every history."""
    texts = ["a b c a b", "b c d", "a b", "c"]
    words = {"a", "b", "c", "d"}
    for h in (*words, "<", "other"):
        for corpus in (texts[:2], texts):
            pair, history, token = (Counter(f(p) for t in corpus for p in pairs_of(t)) for f in (lambda p: p, lambda p: p[0], lambda p: p[1]))
            h2 = h if h == "<" else h.encode()
            total = 0
            for w in (*(x.encode() for x in words), ">", "?"):
                p = (token[w] + lm.ALPHA) / (sum(token.values()) + lm.ALPHA * (len(words) + 2))
                total += lm.LAMBDA * pair[(h2, w)] / history[h2] + (1 - lm.LAMBDA) * p if history[h2] else p
            assert total == pytest.approx(1)


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    texts = [t for _, t in docs]
    want = brute([t for i, t in docs if i in good], texts, texts, {k for k, (i, _) in enumerate(docs) if i in good}, True)
    got = {r.doc_id: r for r in queries.QUERIES["op7_cross_entropy_difference"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, _), (t, b) in zip(docs, want):
        assert got[i].target_loss == pytest.approx(t) and got[i].background_loss == pytest.approx(b) and got[i].score == pytest.approx(t - b)


def test_edges(spark):
    docs = documents(spark, edge_rows())
    got = lm.score(docs, lm.fit(docs.limit(0), docs), counted=True, in_target=docs.limit(0)).collect()
    assert len(got) == len(edge_rows()) and all(math.isfinite(r.score) for r in got)
    got = lm.score(docs, lm.fit(docs, docs), counted=True, in_target=docs.select("doc_id")).collect()
    assert len(got) == len(edge_rows()) and all(abs(r.score) < 1e-9 for r in got if r.doc_id is not None)
    assert lm.score(docs.limit(0), lm.fit(docs, docs)).count() == 0
    nothing = lm.score(docs, lm.fit(docs.limit(0), docs.limit(0))).collect()
    assert all(r.score == 0 for r in nothing)


def test_model_grows_with_the_corpus(spark):
    """One other occurrence is enough in a corpus of any size: no floor that rises with it."""
    texts = ["common words " * 1_000_000, "odd pair", "odd pair", "other text"]
    docs = documents(spark, [row(k, t) for k, t in enumerate(texts)])
    model = lm.fit(docs.where("text = 'odd pair'"), docs)
    got = {r.doc_id: r for r in lm.score(docs, model, counted=True).collect()}
    p = lambda c: (c + lm.ALPHA) / (2_000_007 + lm.ALPHA * 8)
    want = [0.7 / 3 + 0.3 * p(1), 0.7 + 0.3 * p(1), 0.7 + 0.3 * p(3)]
    assert got[1].n_tokens == 3 and got[1].background_loss == pytest.approx(sum(-math.log(x) for x in want) / 3)
