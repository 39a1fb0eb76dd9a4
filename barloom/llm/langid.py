"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are all 1-, 2- and 3-grams of the lower-cased text, hashed into
``BUCKETS`` columns.  Training counts every n-gram of every training row, per
task in numpy and summed in Spark; the model is a (languages x BUCKETS) matrix
of log probabilities, whose size depends on neither corpus nor text lengths, and
which is broadcast (a column of more than ``MOST_LANGUAGES`` languages is refused).  Scoring adds the matrix rows of a text's n-grams, for a
batch of texts at once, at most about ``CELLS`` of its numbers at a time.

Long texts are handled in segments of ``SEGMENT`` characters that overlap by the
two characters an n-gram looks back, so whole texts are used in bounded memory.

Edge cases: null text or text without a letter gives ``und`` with score 0; rows
with a null language teach nothing; without any training row every document is
``und``; ties between languages go to the alphabetically first; a null id is
kept; repeated rows count each time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches

BUCKETS = 1 << 14
SEGMENT = 1 << 20
MOST_LANGUAGES = 1000
#: Log probabilities gathered at once, characters x languages.
CELLS = 1 << 23
UNKNOWN = "und"
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_SALTS = (np.uint32(0x9E3779B9), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _segments(texts: list[str | None], most: int | None = None) -> Iterator[tuple[list[int], list[str], list[str]]]:
    """Groups of (row, two characters before, segment), each group of about ``most`` characters."""
    most = most or SEGMENT
    rows, before, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for a in range(0, len(text), most):
            rows.append(row)
            before.append("  " if a == 0 else text[a - 2 : a])
            parts.append(text[a : a + most])
            size += len(parts[-1])
            if size >= most:
                yield rows, before, parts
                rows, before, parts, size = [], [], [], 0
    if rows:
        yield rows, before, parts


def _hashed(before: list[str], parts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the segments in the joined text, and per n a bucket for every position."""
    joined = "".join(x for pair in zip(before, parts, strict=True) for x in pair)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    one = codes * _MULTIPLIERS[0]
    two, three = one.copy(), one.copy()
    two[1:] += codes[:-1] * _MULTIPLIERS[1]
    three[1:] += codes[:-1] * _MULTIPLIERS[1]
    three[2:] += codes[:-2] * _MULTIPLIERS[2]
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    buckets = []
    for values, salt in zip((one, two, three), _SALTS, strict=True):
        values ^= values >> np.uint32(15)
        values += salt
        values *= np.uint32(0x2C1B3C6D)
        buckets.append((values >> shift).astype(np.int64))
    lengths = np.array([2 + len(p) for p in parts])
    return np.concatenate([[0], np.cumsum(lengths)]), buckets


@dataclass(frozen=True)
class Model:
    """Languages in order, and log probabilities of shape (BUCKETS, languages) plus log priors."""

    langs: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Log joint probability of each text and language."""
        out = np.tile(self.log_prior, (len(texts), 1))
        most = max(1, min(SEGMENT, CELLS // max(1, len(self.langs))))
        for rows, before, parts in _segments(texts, most):
            starts, buckets = _hashed(before, parts)
            at = np.empty(2 * len(parts), np.int64)
            at[0::2], at[1::2] = starts[:-1], starts[:-1] + 2
            for values in buckets:
                each = np.add.reduceat(self.log_prob[values], at, axis=0)[1::2]
                np.add.at(out, rows, each)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        totals = self.totals(texts)
        best = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        known = [any(map(str.isalpha, t or "")) for t in texts]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(share, known, strict=True)]


def fit(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Learn from all rows of ``docs`` with a language."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in langs:
                seen.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += 1
            for rows, before, parts in _segments(batch.column(0).to_pylist()):
                starts, buckets = _hashed(before, parts)
                for k, row in enumerate(rows):
                    for values in buckets:
                        seen[langs[row]][:BUCKETS] += np.bincount(values[starts[k] + 2 : starts[k + 1]], minlength=BUCKETS)
        for lang, counts in seen.items():
            where = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(counts[where])], ["lang", "bucket", "n"])

    if docs.select("lang").distinct().limit(MOST_LANGUAGES + 2).count() > MOST_LANGUAGES + 1:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is that column a language?")
    rows = docs.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x (BUCKETS + 1) rows at most
    langs = tuple(sorted(set(found.column("lang").to_pylist())))
    counts = np.zeros((len(langs), BUCKETS + 1))
    place = {lang: k for k, lang in enumerate(langs)}
    counts[[place[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams = counts[:, :BUCKETS] + smoothing
    docs_seen = counts[:, BUCKETS] + 1
    return Model(langs, np.ascontiguousarray(np.log(grams / grams.sum(axis=1, keepdims=True)).T) if langs else np.zeros((BUCKETS, 0)), np.log(docs_seen / docs_seen.sum()))


def predict(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    given = docs.select(F.col("text").alias("__text"), *keep)
    return given.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[1:]) + ", lang_pred string, score double")
