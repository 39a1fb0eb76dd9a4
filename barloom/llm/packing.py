"""Best-fit packing with exact-complement hashing.

Documents are tokenised, an end token 0 is added, and documents longer than a
sequence are cut into full pieces, the remainder coming first.  Pieces of one
length are interchangeable, so the packing plan needs only the histogram of
lengths, at most ``capacity`` numbers however large the corpus is.  The plan
takes the longest available piece, looks up single, pair and triple sums that
fill its gap exactly and are available, and otherwise adds the longest piece
that fits (best fit) and looks again.  A plan entry says "repeat this pattern m
times", so its size follows the number of distinct lengths, not of pieces.

Pieces are then ranked within their length without sorting rows: every task
counts its own pieces, a prefix sum over (task, length) counts gives each task
its first rank, and rank -> (sequence, offset) is arithmetic on the plan.

Edge cases: null text is an empty text (one piece holding only the end token);
repeated rows are packed once per row; a null ``doc_id`` is kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, small_batches

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def encoder(vocabulary: str = VOCABULARY):
    """text -> uint32 ids; the same vocabulary and ids as ``<vocabulary>.json``.

    The rank file of the vocabulary is read by the faster library; a text that it
    refuses goes through the other one.  A string of an added token (``<|endoftext|>``)
    is that token, as the JSON file has it.
    """
    import base64
    import json

    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens: the remainder first, then full pieces."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece with its checksum and its rank among equal lengths of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([END], "<u4"))
                starts = cut_points(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, int(seen[b - a])))
                    seen[b - a] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class _Supply:
    """How many pieces of each length are left, with sums of two and of three lengths indexed."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs: np.ndarray | None = None
        self.triples: np.ndarray | None = None

    def pair_sums(self) -> np.ndarray:
        """pairs[s] > 0: two available lengths have the sum s."""
        if self.pairs is None:
            there = np.fft.rfft((self.left > 0).astype(float), 4 * len(self.left))
            self.pairs, self.triples = (np.rint(np.fft.irfft(there**k)) for k in (2, 3))
        return self.pairs

    def triple_sums(self) -> np.ndarray:
        """triples[s] > 0: three available lengths have the sum s."""
        self.pair_sums()
        return self.triples

    def take(self, pattern: Counter) -> int:
        """Use ``pattern`` as often as supplies last; how often that is."""
        times = min(int(self.left[k]) // n for k, n in pattern.items())
        for k, n in pattern.items():
            self.left[k] -= n * times
            if self.left[k] == 0:
                self.pairs = None
        return times

    def enough(self, pattern: Counter) -> bool:
        return all(self.left[k] >= n for k, n in pattern.items())


def _pair(supply: _Supply, used: Counter, gap: int, most: int) -> tuple[int, ...]:
    low = max(1, gap - most)
    firsts = np.arange(min(most, gap - 1), (gap - 1) // 2, -1)
    firsts = firsts[firsts >= low]
    for a in firsts[(supply.left[firsts] > 0) & (supply.left[gap - firsts] > 0)]:
        if supply.enough(used + Counter([int(a), gap - int(a)])):
            return int(a), gap - int(a)
    return ()


def _exact(supply: _Supply, used: Counter, gap: int, most: int) -> tuple[int, ...]:
    """One, two or three available lengths with the sum ``gap``, or nothing."""
    if gap <= most and supply.enough(used + Counter([gap])):
        return (gap,)
    sums = supply.pair_sums()
    if sums[gap] > 0 and (found := _pair(supply, used, gap, most)):
        return found
    if supply.triple_sums()[gap] == 0:
        return ()
    thirds = np.arange(min(most, gap - 2), 0, -1)
    for a in thirds[(supply.left[thirds] > 0) & (sums[gap - thirds] > 0)]:
        more = used + Counter([int(a)])
        if 3 * a < gap:
            break
        if supply.enough(more) and (found := _pair(supply, more, gap - int(a), min(int(a), most))):
            return int(a), *found
    return ()


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(pattern of lengths, how often), longest pieces first."""
    supply, out = _Supply(counts, capacity), []
    for longest in range(capacity, 0, -1):
        while supply.left[longest]:
            used, gap = Counter([longest]), capacity - longest
            while gap:
                if found := _exact(supply, used, gap, longest):
                    used.update(found)
                    break
                fits = np.nonzero(supply.left[1 : min(gap, longest) + 1])[0][::-1] + 1
                best = next((int(k) for k in fits if supply.left[k] > used[int(k)]), 0)
                if not best:
                    break
                used[best] += 1
                gap -= best
            out.append((used, supply.take(used)))
    return out


def slots(patterns: list[tuple[Counter, int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, times, offset) sorted by length and rank."""
    rank, first, rows = Counter(), 0, []
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, rank[length], first, times, offset))
            rank[length] += n * times
            offset += n * length
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns of ``PACKED``: one row per piece with its sequence and its place there."""
    small_batches(docs.sparkSession)
    pieces = cut(tokenised_pieces(docs, capacity, vocabulary))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    lookup = slots(plan(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    ranked = pieces.join(first, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("first_rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (lookup[:, 0] << 44) + lookup[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            row = lookup[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            copy, turn = np.divmod(rank - row[:, 1], row[:, 3])
            columns = [*batch.columns[:5], pa.array(row[:, 2] + turn), pa.array(row[:, 4] + copy * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
