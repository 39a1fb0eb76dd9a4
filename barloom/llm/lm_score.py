"""Cross-entropy difference of two matched bigram models.

The target and the background model share one vocabulary (every word of both
corpora), one set of bigrams (every bigram of both) and one formula:

    p(w | h) = LAMBDA * c(h, w) / c(h) + (1 - LAMBDA) * p(w)      where c(h) > 0
    p(w | h) = p(w)                                               elsewhere
    p(w)     = (c(w) + ALPHA) / (N + ALPHA * V)

with counts of the model's own corpus, so both are distributions over the V
predicted tokens: the words, an unknown word and the end.  Tokens are lower-cased
words between white space; a text starts after a start mark and ends with an end
token.  A document that a corpus holds is scored by that corpus without it: its
own counts are taken off c(h, w), c(h), c(w) and N.  So no document is scored by
what it taught, and words that occur once teach nothing about their document.  A
document's score is the mean over its tokens of the target loss minus the
background loss, in nats: lower is closer to the target.

Every word and every bigram of both corpora is counted; there is no floor and no
share, so the model grows with the corpus.  Texts are dealt into chunks of CHUNK
bytes.  A chunk counts its words and bigrams in numpy and sends each once, as a
64-bit key; Spark sums a key over all chunks and returns the sums to the chunk,
which scores its texts.  Keys travel in blocks: those of a chunk that share their
first bits, sorted, so that the sums return in their order, without the keys.  A
key has one row per chunk however often it occurs, a chunk's answers are no more
than its own tokens, and nothing of the model is collected or broadcast; the
driver receives totals only.  Words are 64-bit hashes, a bigram's key is a mix of
two.  A word is followed by a token wherever it stands, so c(h) is the word's own
count, and that of the start mark is the end's.

``score_corpus`` scores a corpus by itself in one such exchange; ``fit`` keeps the
sums of two corpora as a table, with which ``score`` scores any documents.

Edge cases: null and blank texts hold only the end token and are scored by it; an
empty target or background leaves uniform probabilities; repeated rows count each
time, and each is scored without itself only; null ids are kept; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, drop_cut, small_batches
from barloom.llm.hashing import run_hashes, split_words

LAMBDA, ALPHA = 0.7, 0.5
#: Bytes of text that are counted and scored together, and keys of one batch sent to Spark.
CHUNK, BATCH = 1 << 22, 1 << 18
#: Fewest and most first bits of a key that name its block.
LEAST_BITS, MOST_BITS = 10, 16
#: Stand for the start of a text and its end; the end follows every text once.
START, END = 1, 2
KINDS = ("target", "background")
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def hashed(text: str | None) -> np.ndarray:
    """One 64-bit number per word of a text."""
    found = list(run_hashes(split_words(text), 1))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit number per bigram: h xor w turned by one bit."""
    turned = w.view(np.uint64)
    return h ^ ((turned << np.uint64(1)) | (turned >> np.uint64(63))).view(np.int64)


@dataclass(frozen=True)
class Tokens:
    """All tokens of some texts, one after the other."""

    token: np.ndarray
    pair: np.ndarray
    owner: np.ndarray  # position of the token's text
    first: np.ndarray  # position of each text's first token
    size: np.ndarray  # tokens of each text


def tokens_of(texts: list[str | None]) -> Tokens:
    found = [np.append(hashed(t), END) for t in texts]
    size = np.array([len(f) for f in found])
    token, first = np.concatenate(found), np.cumsum(size) - size
    history = np.roll(token, 1)
    history[first] = START
    return Tokens(token, pair_keys(history, token), np.repeat(np.arange(len(texts)), size), first, size)


def _chunks(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text, taught), numbered within chunks of at most CHUNK bytes of text, or of one text; written."""
    limit = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, at, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            places = []
            for n in pc.binary_length(batch.column(1)).to_pylist():
                if at and size + (n or 0) > limit:
                    chunk, at, size = chunk + 1, 0, 0
                places.append((chunk, at))
                at, size = at + 1, size + (n or 0)
            chunks = np.array(places, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*map(pa.array, chunks.T.copy()), *batch.columns], ["chunk", "at", *batch.schema.names])

    return cut(rows.mapInArrow(run, "chunk long, at long, doc_id long, text string, taught boolean"), "zstd")


def _layout(*tables: DataFrame) -> tuple[int, int]:
    """First bits of a key that name its block, four blocks or more per chunk, and partitions of about a chunk's keys."""
    chunks = sum(t.agg(F.countDistinct("chunk")).first()[0] for t in tables)
    return min(max(LEAST_BITS, (4 * chunks).bit_length()), MOST_BITS), min(max(chunks, 1), 1 << MOST_BITS)


@dataclass(frozen=True)
class Keys:
    """The distinct words, then bigrams, of some tokens, and the order that sorts all keys."""

    keys: np.ndarray
    n_words: int
    at: tuple[np.ndarray, np.ndarray]  # place in ``keys`` of each token and bigram
    order: np.ndarray


def _keys_of(tokens: Tokens) -> Keys:
    (words, of_word), (pairs, of_pair) = (np.unique(x, return_inverse=True) for x in (tokens.token, tokens.pair))
    keys = np.concatenate([words, pairs])
    return Keys(keys, len(words), (of_word, of_pair + len(words)), np.argsort(keys, kind="stable"))


BLOCKS = "bucket int, chunk long, start long, low array<int>, mid array<smallint>, top array<tinyint>, token array<boolean>, target array<int>, background array<int>"


def _blocks(chunks: DataFrame, bits: int) -> DataFrame:
    """Every word and bigram of a chunk once, in blocks of keys with the same first bits; see ``BLOCKS``.

    A chunk that is read in parts sends each from its first row, ``start``.  Counts
    are those in taught rows and in all.
    """

    def out(chunk: int, start: int, texts: list, taught: list) -> Iterator[pa.RecordBatch]:
        found = tokens_of(texts)
        keys, held = _keys_of(found), np.array(taught)[found.owner]
        counts = [sum(np.bincount(at[w], minlength=len(keys.keys)) for at in keys.at)[keys.order].astype(np.int32) for w in (held, slice(None))]
        of_key = keys.keys[keys.order]
        bucket = of_key >> (64 - bits)
        rest = of_key & ((1 << (64 - bits)) - 1)
        values = [rest.astype(np.int32), (rest >> 32).astype(np.int16), (rest >> 48).astype(np.int8), keys.order < keys.n_words, *counts]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(first[1:], len(bucket))
        batch = first // BATCH
        for k in np.unique(batch):
            mine = batch == k
            a, z = first[mine][0], ends[mine][-1]
            offsets = pa.array(np.append(first[mine], z) - a, pa.int32())
            n = int(mine.sum())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[a:z])) for v in values]
            heads = [pa.array(bucket[first[mine]].astype(np.int32)), pa.array(np.full(n, chunk)), pa.array(np.full(n, start))]
            yield pa.RecordBatch.from_arrays([*heads, *lists], [f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, texts, taught = None, 0, [], []
        for batch in batches:
            for chunk, at, text, flag in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now or at != start + len(texts):
                    if texts:
                        yield from out(now, start, texts, taught)
                    now, start, texts, taught = chunk, at, [], []
                texts.append(text)
                taught.append(flag)
        if texts:
            yield from out(now, start, texts, taught)

    return chunks.select("chunk", "at", "text", "taught").mapInArrow(run, BLOCKS)


def _keys(blocks: DataFrame) -> DataFrame:
    """(bucket, chunk, start, place, key, token, target, background): one row per key of a block."""
    rows = blocks.select("bucket", "chunk", "start", F.posexplode(F.arrays_zip("low", "mid", "top", "token", *KINDS)).alias("place", "x"))
    wide = lambda name, mask: F.col(f"x.{name}").cast("long").bitwiseAND(F.lit(mask))
    key = wide("low", 0xFFFFFFFF) + F.shiftleft(wide("mid", 0xFFFF), 32) + F.shiftleft(wide("top", 0xFF), 48)
    return rows.select("bucket", "chunk", "start", "place", key.alias("key"), "x.token", *(F.col(f"x.{k}").cast("long").alias(k) for k in KINDS))


def _answers(keys: DataFrame, *more: Column) -> DataFrame:
    """The sums of a block's keys in the order in which it sent them."""
    many = F.sort_array(F.collect_list(F.struct("place", *KINDS)))
    found = keys.groupBy("bucket", "chunk", "start").agg(many.alias("x"), *more)
    return found.select("chunk", "start", "bucket", *(F.col(f"x.{k}").alias(k) for k in KINDS), *found.columns[4:])


@dataclass(frozen=True)
class Model:
    """``grams`` (bucket, key, target, background), in the shared folder: every word and bigram of both corpora."""

    grams: DataFrame
    bits: int  # of a bucket
    size: int  # predicted tokens
    tokens: dict[str, int]

    def drop(self) -> None:
        """Remove the model's files."""
        drop_cut(self.grams)


def fit(target: DataFrame, background: DataFrame) -> Model:
    """Count both corpora; the target's rows need not be of the background."""
    spark = background.sparkSession
    small_batches(spark)
    sides = [_chunks(d.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("taught"))) for d in (target, background)]
    (bits, _), none = _layout(*sides), F.lit(0).cast("long")
    counted = [_keys(_blocks(c, bits)).withColumn(k, none) for c, k in zip(sides, reversed(KINDS))]
    grams = cut(counted[0].unionByName(counted[1]).groupBy("bucket", "key", "token").agg(*(F.sum(k).alias(k) for k in KINDS)))
    for c in sides:
        drop_cut(c)
    found = grams.where("token").agg(F.count("*").alias("words"), *(F.sum(k).alias(k) for k in KINDS)).first()
    return Model(grams, bits, max(found["words"] - 1, 0) + 2, {k: found[k] or 0 for k in KINDS})


def _scorer(size: int, total: dict[str, int], counted: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores the rows of a chunk with the sums that were returned to it; ``counted``: the background holds the rows."""

    def of_text(owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each token's key occurs in its own text."""
        _, place, counts = np.unique(owner * (at.max() + 1) + at, return_inverse=True, return_counts=True)
        return counts[place]

    def part(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = tokens_of(rows.column("text").to_pylist())
        keys, taught = _keys_of(texts), np.array(rows.column("taught").to_pylist())[texts.owner]
        (word, pair), answers = keys.at, answers.sort_by("bucket")
        own_w, own_pair = of_text(texts.owner, word), of_text(texts.owner, pair)
        end = word[texts.first + texts.size - 1]

        def history(of_token: np.ndarray, of_end: np.ndarray) -> np.ndarray:
            turned = np.roll(of_token, 1)
            turned[texts.first] = of_end
            return turned

        own_h = history(own_w, np.ones(len(end), own_w.dtype))
        losses = []
        for kind in KINDS:
            sums = np.empty(len(keys.keys), np.int64)
            sums[keys.order] = pc.list_flatten(answers.column(kind)).to_numpy()
            less = (taught if kind == "target" else np.full(len(taught), counted)).astype(np.int64)
            # a row that the corpus does not hold after all may have more than the corpus
            own = ((sums[word], own_w), (history(sums[word], sums[end]), own_h), (sums[pair], own_pair), (total[kind], texts.size[texts.owner]))
            w, h, n, all_ = (np.maximum(x - less * y, 0) for x, y in own)
            p = (w + ALPHA) / (all_ + ALPHA * size)
            p = np.where(h > 0, LAMBDA * n / np.maximum(h, 1) + (1 - LAMBDA) * p, p)
            losses.append(np.bincount(texts.owner, -np.log(p)) / texts.size)
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": texts.size, "target_loss": losses[0], "background_loss": losses[1], "score": losses[0] - losses[1]})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        starts = np.unique(right.column("start").to_numpy())
        parts = np.searchsorted(starts, left.column("at").to_numpy(), "right") - 1
        return pa.concat_tables(part(left.filter(pa.array(parts == k)), right.filter(pc.equal(right.column("start"), int(x)))) for k, x in enumerate(starts))

    return run


def _taught(docs: DataFrame, in_target: DataFrame | None) -> DataFrame:
    """(doc_id, text, taught); ``taught`` where the id is one of ``in_target`` (doc_id)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if in_target is None:
        return rows.select("*", F.lit(False).alias("taught"))
    ids = in_target.select(F.col("doc_id").cast("long").alias("l")).where("l is not null").distinct()
    return rows.join(ids.hint("merge"), F.col("doc_id") == F.col("l"), "left").select("doc_id", "text", F.col("l").isNotNull().alias("taught"))


def _scored(chunks: DataFrame, answers: DataFrame, scorer: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scorer, SCORED)


def score_corpus(docs: DataFrame, in_target: DataFrame) -> DataFrame:
    """Columns of ``SCORED``: the background is ``docs``, the target its rows with ids of ``in_target`` (doc_id).

    Every row is scored by either corpus without itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chunks = _chunks(_taught(docs, in_target))
    key = Window.partitionBy("key", "bucket")
    own = [F.col(k).alias(f"own_{k}") for k in KINDS]
    # blocks are shuffled whole; sums by key and answers by block both stay within a bucket
    bits, partitions = _layout(chunks)
    keys = _keys(_blocks(chunks, bits).repartition(partitions, "bucket"))
    summed = keys.select("bucket", "chunk", "start", "place", "token", *own, *(F.sum(k).over(key).alias(k) for k in KINDS), F.count("*").over(key).alias("n"))
    # a word of n chunks counts as one word
    totals = [F.sum(F.when(F.col("token"), c)).alias(n) for n, c in (("words", 1 / F.col("n")), *((f"own_{k}", F.col(f"own_{k}")) for k in KINDS))]
    answers = cut(_answers(summed, *totals))
    found = answers.agg(*(F.sum(c).alias(c) for c in ("words", "own_target", "own_background"))).first()
    size, tokens = max(round(found["words"] or 0) - 1, 0) + 2, {k: found[f"own_{k}"] or 0 for k in KINDS}
    return _scored(chunks, answers.select("chunk", "start", "bucket", *KINDS), _scorer(size, tokens, True))


def score(docs: DataFrame, model: Model, counted: bool = False, in_target: DataFrame | None = None) -> DataFrame:
    """Columns of ``SCORED``; losses are means over the document's tokens.

    ``counted``: the model's background holds the rows of ``docs``, so every row is
    scored without itself.  ``in_target`` (doc_id): the ids of rows that the target
    holds too; of them the target loss is that of the target without them.
    """
    small_batches(docs.sparkSession)
    chunks = _chunks(_taught(docs, in_target))
    keys = _keys(_blocks(chunks, model.bits)).select("bucket", "chunk", "start", "place", "key", "token")
    met = keys.join(model.grams, ["bucket", "key", "token"], "left").fillna(0, list(KINDS))
    return _scored(chunks, _answers(met), _scorer(model.size, model.tokens, counted))
