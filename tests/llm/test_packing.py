import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import packing
from tests.llm.cases import documents, edge_rows, row


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, packed, capacity):
    """Every document comes back whole, pieces lie where they should and nothing overlaps."""
    slow = tokenizer()
    wanted = Counter()
    for r in rows:
        ids = np.array([*slow.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter(tuple(p)[:5] for p in packed) == wanted
    places = defaultdict(list)
    for p in packed:
        places[p.sequence_id].append((p.offset, p.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack(docs).collect()
    n = check([(r.doc_id, r.text) for r in docs.collect()], packed, 2048)
    assert n <= -(-sum(p.length for p in packed) // 2048) + 1


def test_edges(spark):
    rows = edge_rows()
    check(rows, packing.pack(documents(spark), capacity=64).collect(), 64)
    assert packing.pack(documents(spark, [])).collect() == []


def test_special_strings_are_tokens(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", "<|ENDOFTEXT|> <|im_start|>", " <|endoftext|>\n" * 3000]
    assert packing.encoder()(texts[0]).tolist() == [64, 220, 50256, 275]
    rows = [row(k, t) for k, t in enumerate(texts)]
    check(rows, packing.pack(documents(spark, rows)).collect(), 2048)


def test_cut_points():
    assert packing.cut_points(5, 4) == [0, 1]
    assert packing.cut_points(8, 4) == [0, 4]
    assert packing.cut_points(3, 4) == [0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|endoftext>aB1 \n\u0301é漢", max_size=60))
def test_ids_equal_the_unmodified_tokenizer(text):
    for t in (text, text + "<|endoftext|>" + text):
        assert _fast()(t).tolist() == _slow().encode(t, add_special_tokens=False).ids


_fast, _slow = cache(packing.encoder), cache(tokenizer)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_plan_uses_every_piece_once(lengths):
    counts = Counter(lengths)
    used, full = Counter(), 0
    for pattern, times in packing.plan(counts, 32):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 32
        used.update({k: n * times for k, n in pattern.items()})
    assert used == counts


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bound = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(n for _, n in packing.plan(counts)) <= bound + 1
