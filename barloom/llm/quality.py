"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Emissions are linear in features of the
line and of its two neighbours; a 2 x 2 transition table couples adjacent labels.
Labels exist per document only, so in training every line carries its document's
label.  The document score is the mean marginal probability of "good" from the
forward-backward pass, weighted by line length.

Training uses a bounded sample: at most ``TRAIN_ROWS`` labelled rows (those of
smallest id hash; of rows of one id, the text of smallest hash).  Their texts are read
whole; of one with more than ``TRAIN_LINES`` lines, features of ``STRETCHES`` runs of
lines, spread over all of it, are kept.  Scoring reads whole texts.  Forward and backward steps run over all documents of a batch at once.

Edge cases: null and empty texts are one empty line and get its score; without
training rows every score is 0.5; repeated rows are scored once each; a null id
is kept; extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import sha1
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches

TRAIN_ROWS = 4000
TRAIN_LINES, STRETCHES = 512, 16
THRESHOLD = 0.3
NEIGHBOUR = ("symbols", "upper", "repeats", "same_words")
OWN = ("length", "symbols", "punctuation", "exclaims", "upper", "digits", "repeats", "same_words", "word_length", "ends", "seen")
STRETCHED, STRETCH = ("symbols", "exclaims", "upper", "digits", "repeats"), 6
WIDTH = 1 + len(OWN) + 2 * len(NEIGHBOUR)

#: Scripts other than Latin begin at _LATIN; from _MARKS on the table holds marks and symbols.
_LATIN, _MARKS = 0x300, 0x2000
_ORDINARY = ".,;:'\"()-?’¿¡"


def _classes() -> np.ndarray:
    """Per code point: 0 other letter, 1 upper case, 2 digit, 3 ordinary mark, 4 exclamation, 5 symbol, 6 space."""
    out = np.zeros(0x3000, np.int8)
    for code in range(len(out)):
        c = chr(code)
        out[code] = 1 if c.isupper() else 2 if c.isdigit() else 6 if c.isspace() else 0 if c.isalpha() else 4 if c == "!" else 3 if c in _ORDINARY else 5
    return out


_TABLE = _classes()


def _kind(c: str) -> int:
    """The class of a character of any script."""
    group = unicodedata.category(c)
    if group[0] in "LM":
        return int(group == "Lu")
    return {"N": 2, "Z": 6, "P": 4 if c == "！" else 3}.get(group[0], 5)


def kinds_of(codes: np.ndarray) -> np.ndarray:
    """Class of every code point; those beyond the Latin table are looked up once each."""
    kinds = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
    far = (codes >= _LATIN) & ((codes < _MARKS) | (codes >= len(_TABLE)))
    if far.any():
        seen, at = np.unique(codes[far], return_inverse=True)
        kinds[far] = np.array([_kind(chr(c)) for c in seen], np.int8)[at]
    return kinds


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH) features and the length of each line in code points."""
    lines = (text or "").split("\n")
    joined = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = kinds_of(joined)
    ends = np.cumsum([len(x) + 1 for x in lines])
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts - 1
    counts = {k: np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(6)}
    letters, shown = counts[0] + counts[1], sum(counts.values())
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words])
    seen = Counter(lines)
    part = lambda a, b: a / np.maximum(b, 1)
    own = {
        "length": np.log1p(sizes) / 5,
        "symbols": part(counts[5], shown),
        "punctuation": part(counts[3], shown),
        "exclaims": part(counts[4], shown),
        "upper": part(counts[1], letters),
        "digits": part(counts[2], shown),
        "repeats": part(np.array([sum(map(eq, w, w[1:])) for w in words]), n_words),
        "same_words": 1 - part(np.array([len(set(w)) for w in words]), n_words) * (n_words > 0),
        "word_length": part(shown, n_words) / 10,
        "ends": np.array([x[-1:] in (".", "?", "!", ":") for x in lines], float),
        "seen": np.array([seen[x] > 1 for x in lines], float),
    }
    out = np.zeros((len(lines), WIDTH))
    out[:, 0] = 1
    for name in STRETCHED:  # small shares already tell, larger ones tell no more
        own[name] = np.minimum(1, STRETCH * own[name])
    for k, name in enumerate(OWN):
        out[:, 1 + k] = own[name]
    for k, name in enumerate(NEIGHBOUR):
        out[1:, 1 + len(OWN) + 2 * k] = own[name][:-1]
        out[:-1, 2 + len(OWN) + 2 * k] = own[name][1:]
    return out, sizes


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(emission: np.ndarray, pairs: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" per line, and expected adjacent label pairs (2 x 2), for documents laid end to end.

    ``emission`` scores "good" against "bad" (whose score is 0); ``pairs`` is the transition table.
    """
    order = np.argsort([-n for n in sizes], kind="stable")
    lengths = np.asarray(sizes)[order]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    unary = np.stack([np.zeros_like(emission), emission], axis=1)
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    longest = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest + 1)]  # documents with more than t lines
    forward[first] = unary[first]
    for t in range(1, longest):
        at = first[: active[t]] + t
        last = forward[at - 1]
        forward[at, 0] = unary[at, 0] + _log_add(last[:, 0] + pairs[0, 0], last[:, 1] + pairs[1, 0])
        forward[at, 1] = unary[at, 1] + _log_add(last[:, 0] + pairs[0, 1], last[:, 1] + pairs[1, 1])
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        after = unary[at + 1] + backward[at + 1]
        for y in (0, 1):
            backward[at, y] = _log_add(after[:, 0] + pairs[y, 0], after[:, 1] + pairs[y, 1])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    inner = np.ones(len(emission), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    joint = forward[to - 1][:, :, None] + pairs[None] + (unary[to] + backward[to])[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True)) if len(to) else joint
    expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(to) else np.zeros((2, 2))
    return good, expected


def train(rows: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition table that maximise the conditional likelihood (Adam, full batch)."""
    if not rows:
        return np.zeros(WIDTH), np.zeros((2, 2))
    x, sizes = np.concatenate([f for f, _ in rows]), [len(f) for f, _ in rows]
    y = np.concatenate([np.full(len(f), label) for f, label in rows]).astype(float)
    seen = np.zeros((2, 2))
    for f, label in rows:
        seen[label, label] += len(f) - 1
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, rounds + 1):
        good, expected = marginals(x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2), sizes)
        gradient = np.concatenate([x.T @ (y - good), (seen - expected).ravel()]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def stretches(f: np.ndarray) -> list[np.ndarray]:
    """The lines of a text, or runs of its lines spread evenly over it."""
    if len(f) <= TRAIN_LINES:
        return [f]
    size = TRAIN_LINES // STRETCHES
    return [f[a : a + size] for a in np.linspace(0, len(f) - size, STRETCHES).astype(int)]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Train on ``labels(doc_id, quality)``; of at most TRAIN_ROWS rows, TRAIN_LINES lines each reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, s.ravel()) for k, t in enumerate(batch.column(0).to_pylist()) for s in stretches(features(t)[0])]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f for _, f in found], pa.list_(pa.float64())), batch.column(1).take(at), batch.column(2).take(at)], ["f", "quality", "doc_id"])

    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("l"), F.col("quality").cast("int").alias("quality"))
    sample = known.distinct().orderBy(F.xxhash64("l"), "l", "quality").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l")).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "quality").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    taken = rows.select("text", "quality", "doc_id").mapInArrow(run, "f array<double>, quality int, doc_id long").toArrow().combine_chunks()
    return train(_in_order(taken))


def _in_order(taken: pa.Table) -> list[tuple[np.ndarray, int]]:
    """(features, label) in order of id and label; the features are views of the table's one array."""
    if not len(taken):
        return []
    lists = taken.column("f").chunk(0)
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    parts = [flat[a:b].reshape(-1, WIDTH) for a, b in zip(ends, ends[1:])]
    keys = list(zip(taken.column("doc_id").to_pylist(), taken.column("quality").to_pylist(), strict=True))
    # digests put the parts of one text in a fixed order
    several = {k for k, n in Counter(keys).items() if n > 1}
    order = sorted(range(len(parts)), key=lambda k: (keys[k], sha1(parts[k]).digest() if keys[k] in several else b""))
    return [(parts[k], keys[k][1]) for k in order]


def scores(texts: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[float]:
    """Length-weighted mean marginal of "good" per text."""
    if not texts:
        return []
    weights, pairs = model
    found = [features(t) for t in texts]
    sizes = [len(f) for f, _ in found]
    good, _ = marginals(np.concatenate([f for f, _ in found]) @ weights, pairs, sizes)
    length = np.concatenate([n for _, n in found]) + 1e-3
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mean = np.add.reduceat(good * length, at) / np.add.reduceat(length, at)
    return [min(1.0, max(0.0, float(s))) for s in mean]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    return _scored(docs.select(F.col("doc_id").cast("long"), "text"), model, "doc_id long, score double, predicted int", lambda batch, s: [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())])


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    at = docs.columns.index("text")

    def cut_down(batch: pa.RecordBatch, s: list[float]) -> list[pa.Array]:
        return batch.filter(pa.array([x >= THRESHOLD for x in s], pa.bool_())).columns

    return _scored(docs, model, docs.schema, cut_down, at)


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], schema, columns, at: int = 1) -> DataFrame:
    small_batches(docs.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")] if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(columns(batch, scores(batch.column(at).to_pylist(), model)), names)

    return docs.mapInArrow(run, schema)
