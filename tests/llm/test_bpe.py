"""Streaming byte-pair encoding against the tokenizers library."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import bpe, queries
from tests.llm.cases import LONG, documents

PARTS = ["a", "b", "e", " ", "  ", "\n", "\t", "\x1c", "'s", "'", "'ll", "1", "23", "é", "ß", "漢字", "😀", "!!", "...", "<|endoftext|>", "<|endo", "<|", "the ", "ing", " ", "՘", " ", "́", "word", "\U000323b0"]
RUNS = ["abcdefghijklmnopqrstuvwxyz", "xa", " ", " \n", "-=", "0123456789", "éàßa", "漢字仮名"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY))


def encoded(text, vocabulary, chunk):
    return np.frombuffer(b"".join(bpe.encode(text, vocabulary, chunk)), "<u4").tolist()


def decoded(text, vocabulary, chunk):
    back = bpe.Decoding(vocabulary)
    return "".join(back.feed(x) for x in bpe.encode(text, vocabulary, chunk)) + back.close()


def test_lookahead_by_hand():
    pairs = [(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"ab", b"cd")]
    # the end of "ab" meets "cd", whose "c" an earlier rule may join to "b" only from the left
    assert bpe.sufficient_lookahead(pairs[:1]) == 2
    assert bpe.sufficient_lookahead(pairs) == 4
    # each rule comes before the one to its left, so what joins "a" to "b" may be settled four letters later
    assert bpe.sufficient_lookahead([(b"d", b"e"), (b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 5


def test_small_texts_in_any_chunks(library, vocabulary):
    rnd = random.Random(1)
    for _ in range(800):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (1, 3, 17, bpe.CHUNK):
            assert encoded(text, vocabulary, chunk) == want
        assert decoded(text, vocabulary, 7) == library.decode(want, skip_special_tokens=False)


def test_long_words_in_windows(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 20)
    monkeypatch.setattr(bpe, "WINDOW", 64)
    rnd = random.Random(2)
    tokens = [t.decode("utf-8", "ignore").strip() for t in vocabulary.bytes.values()]
    for k in range(200):
        n = rnd.choice([50, 500, 3000])
        pool = RUNS[k % len(RUNS)] if k % 3 else tokens
        text = rnd.choice(["", "ab ", " "]) + "".join(rnd.choice(pool) for _ in range(n if k % 3 else n // 5)) + rnd.choice(["", " z", "\n\n q", "<|endoftext|>"])
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (5, 200, bpe.CHUNK):
            assert encoded(text, vocabulary, chunk) == want


def test_memory_is_constant(vocabulary):
    stream = bpe.Encoding(vocabulary)
    for k in range(300):
        for _ in stream.feed("xyzzy" * 200):
            pass
        assert len(stream.rest) <= bpe.LONG + 1000 and (stream.run is None or len(stream.run.held) < 2 * bpe.WINDOW)


def test_invalid_sequences_while_decoding(library, vocabulary):
    ids = [vocabulary.byte_ids[b] for b in b"a\xe6\xbc b\xf0\x9f\x98\x80\xf0\x9f\xffz\xc3"]
    for cut in range(len(ids) + 1):
        back = bpe.Decoding(vocabulary)
        got = back.feed(np.array(ids[:cut], "<u4").tobytes()) + back.feed(np.array(ids[cut:], "<u4").tobytes()) + back.close()
        assert got == library.decode(ids, skip_special_tokens=False)


def digests(doc, text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return doc, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_streaming_bpe"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(digests(r.doc_id, r.text, library) for r in docs)


def test_edge_cases(spark, library):
    docs = documents(spark)
    want = [digests(r.doc_id, r.text, library) for r in docs.collect()]
    got = [tuple(r) for r in bpe.round_trip(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(len(r.text or "") >= len(LONG) for r in docs.collect())
