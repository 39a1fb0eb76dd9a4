"""Spelling variants: words that differ by one character, each pointing at a far commoner form.

**Words.**  Runs of letters are lower-cased (A-Z only) and counted per document and
batch before they are shuffled.

**Deletion keys.**  Two words differ by one character if they agree without it, so every
word of L characters gets the hash of itself (place -1) and of its L texts with one
character left out.  Polynomial prefix and suffix hashes (modulo 2**64) give all of them by array
arithmetic: the hash without character i is the prefix hash before it plus the suffix hash after it
moved one power down.  A key row has 8 bytes of key, place, word number and count, no text.

**Groups.**  Key rows are dealt by the leading bits of the key and sorted by key and place
within a task.  Words that share key and place without a character are all one
replacement apart; a word whose own hash is the key is one deletion away from the others
(from a run of equal characters only the first is taken, so that a pair meets once).  Only the
few rows that meet others go on; they fetch their words, and texts, not hashes,
decide who stays together.  A group sends one row per member with the number of its near words
and the best of them: no row per pair.

**Roots.**  Forms are followed by doubling jumps; every step is at least ``RATIO`` times commoner,
so their number is known from the largest count.

Edge cases: null text has no words; a null ``doc_id`` is an empty string before the colon;
repeated rows count once per row; runs of any length take part; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, drop_cut, small_batches

LEAST, OFTEN, RATIO, ALTERED = 7, 2, 10, 31
BASE, RADIX_BITS, SEED = 0xD1342543DE82EF95, 16, 20250113
#: Characters of words whose hashes are computed at once, and entries of a task's counter.
BLOCK, COUNTED = 1 << 19, 1 << 17
_runs = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
KEYS = "key long, place int, first boolean, id long, n long"


def _altered(doc: str, run: str) -> str:
    """The run, without one character where the checksum says so: a deterministic source of misspellings."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of words with at least ``LEAST`` characters and ``OFTEN`` occurrences."""

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # bytes are lower-cased from A to Z only
                text = (raw.as_py() or b"").lower().decode("utf-8", "replace")
                for word, n in Counter(_runs.findall(text)).items():
                    word = _altered(doc, word)
                    if len(word) >= LEAST:
                        found[word] += n
                if len(found) >= COUNTED:
                    yield rows(found)
                    found.clear()
        yield rows(found)

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("binary"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))])


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, row) of every word of one length: itself (place -1) and without each of its characters."""
    size = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size)
    values = (points.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(31)
    terms = values * _powers(size - 1)
    prefix = np.zeros((len(words), size + 1), np.uint64)
    np.cumsum(terms, axis=1, out=prefix[:, 1:])
    suffix = prefix[:, -1:] - prefix
    down = np.uint64(pow(BASE, -1, 1 << 64))
    keys = np.column_stack([prefix[:, -1], prefix[:, :-1] + suffix[:, 1:] * down])
    places = np.tile(np.arange(-1, size, dtype=np.int32), len(words))
    first = np.ones((len(words), size + 1), bool)
    first[:, 2:] = points[:, 1:] != points[:, :-1]
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ (keys >> np.uint64(32))).ravel().view(np.int64), places, first.ravel(), np.repeat(np.arange(len(words)), size + 1)


def key_rows(words: DataFrame) -> DataFrame:
    """Columns of ``KEYS`` for ``words(id, word, n)``."""
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            sizes = np.array([len(t) for t in texts], np.int64)
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                step = max(1, BLOCK // int(size))
                for a in range(0, len(some), step):
                    part = some[a : a + step]
                    key, place, first, row = deletion_keys(texts[part].tolist())
                    columns = (key, place, first, ids[part][row], n[part][row])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "place", "first", "id", "n"])

    return words.select("id", "word", "n").mapInArrow(run, KEYS)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in sorted columns, and the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    for k, c in enumerate(columns):
        new[1:] = (c[1:] != c[:-1]) if k == 0 else new[1:] | (c[1:] != c[:-1])
    return np.append(np.flatnonzero(new), n)


def _meeting(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows, sorted by key and place, meet another: by a replacement, or by a deletion around a word itself."""
    n = len(rows["key"])
    pairs = np.diff(_edges(rows["key"], rows["place"]))
    met = np.repeat(pairs > 1, pairs)
    starts = _edges(rows["key"])
    sizes = np.diff(starts)
    own = rows["place"] == -1
    removed = rows["first"] & ~own
    has_own = np.repeat(np.add.reduceat(own, starts[:-1]) > 0, sizes)
    has_removed = np.repeat(np.add.reduceat(removed, starts[:-1]) > 0, sizes)
    return (met | (removed & has_own) | (own & has_removed)) if n else np.zeros(0, bool)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by key, cut between keys: rows of a batch's last key wait for the next one."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, now]) if held is not None else now
        if not len(table):
            continue
        key = table.column("key").to_numpy()
        at = int(np.searchsorted(key, key[-1]))
        held = table.slice(at)
        if at:
            yield table.slice(0, at)
    if held is not None:
        yield held


def meeting_rows(keys: DataFrame) -> DataFrame:
    """Rows of ``KEYS`` that share a key with another row in one of the two ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "place", "first")}
            yield from table.filter(pa.array(_meeting(rows))).combine_chunks().to_batches()

    return _sorted(keys).mapInArrow(run, KEYS)


def _sorted(keys: DataFrame) -> DataFrame:
    return keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key", "place")


NEAR = "id long, n_near long, best_n long, best string"


def near_words(told: DataFrame) -> DataFrame:
    """Columns of ``NEAR`` for ``told`` (``KEYS`` and word): a row per group and member, with its near words there and the best of them."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        replaced: dict[tuple, list[tuple]] = {}
        around: dict[str, list[tuple]] = {}
        own: dict[str, tuple] = {}
        for place, first, i, n, word in rows:
            me = (-n, word, i)
            if place < 0:
                own[word] = me
                continue
            left = word[:place] + word[place + 1 :]  # equal hashes do not suffice
            replaced.setdefault((left, place), []).append(me)
            if first:
                around.setdefault(left, []).append(me)
        for members in replaced.values():
            if len(members) > 1:
                top, second = sorted(members)[:2]
                for me in members:
                    other = second if me is top else top
                    yield me[2], len(members) - 1, -other[0], other[1]
        for left, members in around.items():
            if left in own:
                centre, top = own[left], min(members)
                yield centre[2], len(members), -top[0], top[1]
                for me in members:
                    yield me[2], 1, -centre[0], centre[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            columns = [table.column(c).to_pylist() for c in ("place", "first", "id", "n", "word")]
            rows, edges = list(zip(*columns, strict=True)), _edges(table.column("key").to_numpy()).tolist()
            out = [x for a, b in zip(edges, edges[1:]) for x in group(rows[a:b])]
            values = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["id", "n_near", "best_n", "best"])

    return _sorted(told).mapInArrow(run, NEAR)


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession, rows=4096)
    words = cut(count_words(docs).withColumn("id", F.monotonically_increasing_id()))
    met = cut(meeting_rows(key_rows(words)))
    told = met.join(words.select("id", "word"), "id")
    best = near_words(told).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("x"))
    much = -F.col("x.less") >= RATIO * F.col("n")
    whole = words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("x.best")).alias("form"), F.when(much, -F.col("x.less")).alias("form_n")
    )
    forms = cut(whole)
    drop_cut(met)
    drop_cut(words)
    return followed(forms)


def followed(forms: DataFrame) -> DataFrame:
    """Adds ``root``: the last word on the way from form to form."""
    most = forms.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most) / math.log(RATIO)))  # no way is longer
    jump = cut(forms.where("form is not null").select("word", F.col("form").alias("to")))
    for _ in range(math.ceil(math.log2(steps))):
        on, before = jump.select(F.col("word").alias("to"), F.col("to").alias("beyond")), jump
        jump = cut(jump.join(on, "to", "left").select("word", F.coalesce("beyond", "to").alias("to")))
        drop_cut(before)
    return forms.join(jump, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
