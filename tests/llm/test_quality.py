from itertools import product

import numpy as np

from barloom.llm import quality, queries
from tests.llm.cases import documents, edge_rows, row


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 2, 5]
    emission, pairs = rng.normal(size=12), rng.normal(size=(2, 2))
    good, expected = quality.marginals(emission, pairs, sizes)
    at, total = 0, np.zeros((2, 2))
    for n in sizes:
        weights = {y: np.exp(sum(emission[at + k] * y[k] for k in range(n)) + sum(pairs[y[k], y[k + 1]] for k in range(n - 1))) for y in product((0, 1), repeat=n)}
        z = sum(weights.values())
        for k in range(n):
            assert np.isclose(good[at + k], sum(w for y, w in weights.items() if y[k]) / z)
        for y, w in weights.items():
            for k in range(n - 1):
                total[y[k], y[k + 1]] += w / z
        at += n
    assert np.allclose(expected, total)


def test_features():
    f, sizes = quality.features("Good line here.\n$$$ ***\n\nGood line here.")
    assert f.shape == (4, quality.WIDTH) and sizes.tolist() == [15, 7, 0, 15] and np.isfinite(f).all()
    symbols = 1 + quality.OWN.index("symbols")
    assert f[1, symbols] == 1 and f[0, symbols] == 0
    assert f[0, 2 + len(quality.OWN)] == 1  # the next line's symbols


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.QUERIES["op10_line_crf_quality"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_edges(spark):
    docs = documents(spark, edge_rows())
    labels = spark.createDataFrame([(9, 1, 0, "x"), (7, 0, 0, "x"), (4, None, 0, "x"), (None, 1, 0, "x"), (123, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    untrained = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, untrained).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(documents(spark, [row(1, "a")]).limit(0), labels)[0].any() == False  # noqa: E712


def test_letters_of_other_scripts():
    at = {name: 1 + k for k, name in enumerate(quality.OWN)}
    for text in ("这是一个普通的句子。", "これは普通の文です。", "यह एक साधारण वाक्य है।", "هذه جملة عادية،", "이것은 평범한 문장입니다.", "𐐨𐐩 𠀀𠀁"):
        f, _ = quality.features(text)
        assert f[0, at["symbols"]] == 0 and f[0, at["exclaims"]] == 0, text
    assert quality.features("😀😀 ★★ ＋＋")[0][0, at["symbols"]] == 1
    assert quality.features("٣٤٥ ３４")[0][0, at["digits"]] == 1 and quality.features("好！")[0][0, at["exclaims"]] == 1


def test_training_reads_all_of_a_long_text(monkeypatch):
    f = np.arange(5000.0)[:, None]
    runs = quality.stretches(f)
    assert sum(map(len, runs)) == quality.TRAIN_LINES and runs[0][0] == 0 and runs[-1][-1] == 4999
    assert len(quality.stretches(f[:512])) == 1


def brute_score(text, weights, pairs):
    """The marginals of one text line by line with plain sums of products."""
    f, sizes = quality.features(text)
    unary = [(1.0, float(np.exp(x @ weights))) for x in f]
    step = np.exp(pairs)
    ahead, back = [unary[0]], [(1.0, 1.0)]
    norm = lambda v: tuple(x / sum(v) for x in v)
    for u in unary[1:]:
        last = ahead[-1]
        ahead.append(norm([u[y] * sum(last[z] * step[z, y] for z in (0, 1)) for y in (0, 1)]))
    for u in unary[:0:-1]:
        after = back[0]
        back.insert(0, norm([sum(step[y, z] * u[z] * after[z] for z in (0, 1)) for y in (0, 1)]))
    good = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back)]
    return sum(g * (n + 1e-3) for g, n in zip(good, sizes)) / sum(n + 1e-3 for n in sizes)


def test_whole_query_against_plain_training_and_scoring(spark, sf_dir):
    """The query's scores are those of a model fitted on the driver to the rows it may learn from."""
    import zlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    learned = sorted((i, labels[i], t) for i, t in docs if i in labels and fold(i))
    weights, pairs = quality.train([(s, y) for _, y, t in learned for s in quality.stretches(quality.features(t)[0])])
    got = {r.doc_id: r for r in queries.QUERIES["op10_line_crf_quality"](spark, sf_dir).collect()}
    for i, text in docs:
        assert abs(got[i].score - brute_score(text, weights, pairs)) < 1e-6 and got[i].held_out == (fold(i) == 0)
        assert got[i].predicted == int(got[i].score >= 0.3)


def test_repeated_ids_teach_once_and_always_the_same(spark):
    docs = documents(spark, [row(1, f"text number {k}") for k in range(300)] + [row(2, "$$$ !!!")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    one, two = quality.fit(docs, labels), quality.fit(docs.repartition(7), labels)
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])


def test_training_sample_is_not_copied_into_lists():
    """Features reach the driver as one array of numbers; a full sample of long texts takes no more than that and one copy."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, lines = 400, quality.TRAIN_LINES // quality.STRETCHES
    parts = [rng.random(lines * quality.WIDTH) for _ in range(n * 4)]
    table = pa.table({"f": pa.array(parts, pa.list_(pa.float64())), "quality": pa.array([k // 4 % 2 for k in range(4 * n)], pa.int32()), "doc_id": pa.array([n - k // 4 for k in range(4 * n)], pa.int64())}).combine_chunks()
    tracemalloc.start()
    rows = quality._in_order(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(p.nbytes for p in parts) / 4
    assert [label for _, label in rows[:8]] == [1] * 4 + [0] * 4 and all(np.shares_memory(f, table.column("f").chunk(0).values.to_numpy()) for f, _ in rows[:5])
    assert quality._in_order(table.slice(0, 0).combine_chunks()) == []
