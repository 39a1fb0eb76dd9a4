"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only.

Tokens are maximal runs of letters and digits of the lower-cased text.  Two fixed
masks pick four of five or six neighbouring tokens; the hash of the picked tokens
ignores the others, so a substitution at an ignored position keeps the hit.  Test
and training hashes are joined, and every hit names a diagonal: where the item
would start in the document.  Along it, tokens are compared one by one: the pair
counts as an overlap if some window of ``WINDOW`` item tokens has at most
``SUBSTITUTIONS`` mismatches.  The two masks hit every such window (checked for
all positions of three mismatches in a test), so seeding loses no overlap.

Items shorter than the window must match in one piece with fewer mismatches
(``allowed``); items of fewer tokens than a mask are matched whole.

Benchmark hashes and tokens are broadcast only up to ``BROADCAST_BYTES`` each.
Beyond that the same joins are shuffled: the seed join carries a document's key, a
position and a hash, and only documents with hits are read again along their
diagonals; skewed keys are split by Spark.

Edge cases: null texts and texts without tokens overlap with nothing; repeated
items of one id are compared each and the best kept; repeated documents give one
row per id and text; a null id is kept; empty tables give no rows; extra columns
are ignored by ``overlaps`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
WINDOW, SUBSTITUTIONS = 13, 3
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def allowed(size: Column) -> Column:
    """Mismatches allowed in a window of ``size`` tokens; the masks find every window within it."""
    return F.when(size >= 13, SUBSTITUTIONS).when(size >= 10, 2).when(size >= 7, 1).otherwise(0)


def _token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def _seeds(array: str, at: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """Array of one hash per mask for the window that starts at ``at``; null where it ends too late."""
    picked = [F.when(at + mask[-1] < F.size(array), F.xxhash64(F.lit(k), *(F.get(array, at + o) for o in mask))) for k, mask in enumerate(masks)]
    return F.array(*picked)


def _fits(df: DataFrame, size: Column) -> bool:
    """Whether the rows, of ``size`` bytes each, may be broadcast."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, window_matches, item_tokens) per overlapping document and item.

    ``start`` is the document token where the item would begin (negative if cut off
    in front); ``window_matches`` is the best window's number of equal tokens.  The
    column ``text_hash`` tells documents of one id apart.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _token_hashes(F.col("text")).alias("item")).where("size(item) > 0")
    shortest = min(mask[-1] for mask in MASKS) + 1
    short = [r[0] for r in items.where(F.size("item") < shortest).select(F.size("item")).distinct().collect()]  # fewer values than a mask has tokens
    masks = (*MASKS, *(tuple(range(n)) for n in sorted(short)))
    items = items.withColumn("item_key", F.xxhash64("item_id", "item"))
    placed = items.select("item_id", "item_key", F.size("item").alias("size"), "item", F.posexplode("item").alias("at", "first"))
    hashes = placed.select("item_key", "size", "at", F.posexplode(_seeds("item", F.col("at"), masks)).alias("mask", "seed")).where("seed is not null")
    own = F.array(*(F.lit(0 if k < len(MASKS) else mask[-1] + 1) for k, mask in enumerate(masks)))
    hashes = hashes.where((F.get(own, F.col("mask")) == 0) | (F.get(own, F.col("mask")) == F.col("size"))).select("seed", "item_key", "size", "at").distinct()
    small = _fits(hashes, F.lit(64))
    known = items.select("item_key", "item_id", "item").dropDuplicates(["item_key"])
    known = F.broadcast(known) if _fits(known, 64 + 8 * F.size("item")) else known

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _token_hashes(F.col("text")).alias("doc"))
    cut_off = F.greatest(-F.col("start"), F.lit(0))
    aligned = F.slice("doc", F.greatest("start", F.lit(0)) + 1, F.col("size") - cut_off)
    line = ["doc_id", "text_hash", "item_key", "start", "size"]
    placed = read.select("doc_id", "text_hash", "doc", F.posexplode("doc").alias("i", "first"))
    windows = placed.select("doc_id", "text_hash", "doc", "i", F.explode(_seeds("doc", F.col("i"), masks)).alias("seed")).where("seed is not null")
    if small:
        hits = windows.join(F.broadcast(hashes), "seed").withColumn("start", F.col("i") - F.col("at"))
        lines = hits.select(*line, aligned.alias("aligned")).groupBy(line).agg(F.first("aligned").alias("aligned"))
    else:
        hits = windows.select("doc_id", "text_hash", "i", "seed").join(hashes, "seed").select("doc_id", "text_hash", "item_key", (F.col("i") - F.col("at")).alias("start"), "size").distinct()
        whole = read.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "doc").dropDuplicates(["d", "h"])
        lines = hits.join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select(*line, aligned.alias("aligned"))

    compared = lines.join(known, "item_key").withColumn("cut_off", F.greatest(-F.col("start"), F.lit(0)))
    equal = F.transform("item", lambda x, k: F.when(F.get("aligned", k - F.col("cut_off")).eqNullSafe(x) & (k >= F.col("cut_off")), 1).otherwise(0))
    size = F.least(F.size("item"), F.lit(WINDOW))
    compared = compared.withColumn("equal", equal).withColumn("window", size)
    sums = F.transform(F.sequence(F.lit(1), F.size("item") - F.col("window") + 1), lambda a: F.aggregate(F.slice("equal", a, F.col("window")), F.lit(0), lambda x, y: x + y))
    found = compared.withColumn("window_matches", F.array_max(sums)).where(F.col("window_matches") >= F.col("window") - allowed(F.col("window")))
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("window_matches", (-F.col("start")).alias("back"), F.size("item").alias("item_tokens"))).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.window_matches").cast("long").alias("window_matches"), F.col("best.item_tokens").cast("long").alias("item_tokens"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with all their columns."""
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h"))
    return docs.join(bad, same, "left_anti")
