import re
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import decontaminate as d
from tests.llm.cases import documents, edge_rows, row


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def need(size):
    w = min(size, 13)
    return w, w - (3 if w >= 13 else 2 if w >= 10 else 1 if w >= 7 else 0)


def brute(docs, items):
    found = {}
    for i, text in docs:
        doc = tokens(text)
        for item_id, other in items:
            item = tokens(other)
            if not item:
                continue
            w, least = need(len(item))
            for start in range(1 - len(item), len(doc)):
                same = [0 <= start + j < len(doc) and doc[start + j] == x for j, x in enumerate(item)]
                best = max(sum(same[a : a + w]) for a in range(len(item) - w + 1))
                if best >= least and best > 0:
                    old = found.get((i, item_id))
                    if old is None or (best, -start) > (old[1], -old[0]):
                        found[(i, item_id)] = (start, best, len(item))
    return {(*k, *v) for k, v in found.items()}


def spark_items(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, text_hash string")


def rows_of(df):
    return {(r.doc_id, r.item_id, r.start, r.window_matches, r.item_tokens) for r in df.collect()}


def test_masks_find_every_allowed_window():
    assert all(mask != tuple(range(mask[-1] + 1)) for mask in d.MASKS)  # every mask skips a position
    for size in range(min(mask[-1] for mask in d.MASKS) + 1, 14):
        w, least = need(size)
        for bad in combinations(range(w), w - least):
            assert any(all(s + o not in bad for o in mask) for mask in d.MASKS for s in range(w - mask[-1])), (size, bad)


def test_equals_brute_force(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    changed = " ".join("zz" if k in (2, 7, 12) else x for k, x in enumerate(w))
    spoiled = " ".join("zz" if k % 3 == 0 else x for k, x in enumerate(w))
    rows = [row(1, "x y " + item + " z"), row(2, changed.upper() + "!"), row(3, spoiled), row(4, " ".join(w[4:]) + " tail"), row(5, "Head, " + " ".join(w[:12])), row(6, "tiny one"), row(7, "a b c d e f g h i"), row(8, item + " " + item)]
    rows += [(None if r[0] is None else r[0] + 100, *r[1:]) for r in edge_rows()]
    items = [(1, item), (2, "tiny one"), (3, "a b c x e f g h i"), (4, None), (5, ""), (6, "solo"), (1, "solo words")]
    docs = documents(spark, rows)
    got = d.overlaps(docs, spark_items(spark, items))
    assert rows_of(got) == {r for r in brute([(r[0], r[1]) for r in rows], [(i, t) for i, t in items])}
    clean = d.clean(docs, spark_items(spark, items))
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (1, 2, 4, 5, 6, 7, 8))
    assert d.overlaps(documents(spark, []), spark_items(spark, items)).count() == 0
    assert d.overlaps(docs, spark_items(spark, []).limit(0)).count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = ["p q r s t u v w", "q r s t", "x p q r s zz u v w p q r s t u v w", "a b c d", None, "p q r s t u v w"]
    docs = documents(spark, [row(k if k < 5 else None, t) for k, t in enumerate(texts)] + [row(0, texts[0])])
    items = spark_items(spark, [(1, "p q r s t u v w"), (2, "a b c d"), (3, "b")])
    want = rows_of(d.overlaps(docs, items))
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    shuffled = d.overlaps(docs, items)
    assert rows_of(shuffled) == want and {(r[0], r[1]) for r in want} == {(0, 1), (2, 1), (3, 2), (3, 3), (None, 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=40), min_size=1, max_size=4), st.lists(st.text(alphabet="ab ", min_size=1, max_size=30), min_size=1, max_size=3))
def test_random_texts(spark, texts, others):
    rows, items = [row(k, t) for k, t in enumerate(texts)], list(enumerate(others))
    assert rows_of(d.overlaps(documents(spark, rows), spark_items(spark, items))) == brute([(r[0], r[1]) for r in rows], items)
