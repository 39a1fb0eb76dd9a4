"""Chat formatting from reply trees, with DataFrame operations only.

Messages form trees: every message names the message it answers.  Iterative
self-joins enumerate the root-to-leaf paths: each round joins the ancestor table
with itself, so the known distance to an ancestor doubles and a tree of depth d
takes log2(d) rounds.  Branches are ranked by score, and every chosen path is
written as one conversation.

Template of a turn:  ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
Inside roles and texts a backslash precedes every backslash and every ``|`` that
follows ``<`` (and a newline in a role), so the control strings cannot occur
there and removing one backslash before any character restores the original.
The loss mask covers the texts of assistant turns, as spans into the output.

Edge cases: null role and null text are empty texts; a message whose parent is
missing from its tree is a root; turns of one number follow each other by role
and text (``chain``); a cycle of messages has no leaf and gives no conversation,
nor does a path that comes from a cycle (the other paths of its tree are written);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, drop_cut

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escaped(text: Column, newline: bool = False) -> Column:
    """Backslash before every backslash, every ``|`` after ``<`` and, for roles, every newline."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\\|(?<=<)\|" + (r"|\n" if newline else ""), r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escaped(role, newline=True), F.lit("\n"), escaped(text), F.lit(END + "\n"))


def chain(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of linear conversations: every turn answers the one before it.

    Rows of one turn follow each other by role and text.  ``score`` is 0.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(F.col(conversation).cast("long").alias("tree"), F.col(turn).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = named.withColumn("message", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, message, depth) for every message on every root-to-leaf path; depth of a root is 0.

    ``messages`` has tree, message and parent.  ``jump`` holds for every message its
    ancestor at a distance that doubles each round; ``found`` holds what is known of
    every leaf's path and doubles with it.
    """
    keys = cut(messages.select("tree", "message", "parent"))
    known = keys.select(F.col("tree").alias("t"), F.col("message").alias("m"))
    jump = cut(keys.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("m"))).select("tree", "message", F.col("m").alias("up"), F.lit(1).cast("long").alias("far")).distinct())
    parents = jump.select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
    leaves = keys.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("u")), "left_anti")
    found = cut(leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("back")))
    largest, far = keys.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1
    while not jump.isEmpty():
        if far > largest:  # so far above lies no ancestor unless on a cycle
            endless = jump.select(F.col("tree").alias("t"), F.col("message").alias("m")).distinct()
            found = found.join(endless, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("m")), "left_anti")
            break
        # every message found so far is followed by the ancestor `far` steps above it, where there is one
        step = jump.select(F.col("tree").alias("t"), F.col("message").alias("m"), "up", "far")
        above = found.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m"))).select("tree", "leaf", F.col("up").alias("message"), (F.col("back") + F.col("far")).alias("back"))
        then = cut(found.unionByName(above))
        after = jump.select(F.col("tree").alias("t"), F.col("message").alias("m"), F.col("up").alias("up2"))
        twice = cut(jump.join(after, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("m"))).select("tree", "message", F.col("up2").alias("up"), (F.col("far") * 2).alias("far")))
        drop_cut(found)
        drop_cut(jump)
        found, jump, far = then, twice, 2 * far
    depth = Window.partitionBy("tree", "leaf")
    return found.withColumn("depth", F.max("back").over(depth) - F.col("back")).drop("back")


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """One conversation per chosen path.

    ``messages``: tree, message, parent (null: root), role, text, score.  Paths of a
    tree are ranked by the sum of their scores, then leaf; ``best`` keeps that many
    per tree (None: all).  Result: tree, leaf, path_score, path_rank, n_turns,
    formatted, turns (start of each turn, and the span of its text under the loss
    mask or null), in code points, ends exclusive.
    """
    line = turn_text(F.col("role"), F.col("text"))
    text_start = F.lit(len(START) + 1) + F.length(escaped(F.col("role"), newline=True))
    parts = messages.select(F.col("tree").alias("t"), F.col("message").alias("m"), "score", line.alias("line"), (F.col("role") == TRAINED_ROLE).alias("trained"), text_start.alias("text_start"), F.length(escaped(F.col("text"))).alias("text_length"))
    on_path = paths(messages).join(parts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("message") == F.col("m")))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = on_path.withColumn("start", F.coalesce(F.sum(F.length("line").cast("long")).over(before), F.lit(0)))
    span = F.when(F.col("trained"), F.struct((F.col("start") + F.col("text_start")).alias("start"), (F.col("start") + F.col("text_start") + F.col("text_length")).alias("end")))
    turn = F.struct("depth", "start", span.alias("loss"), "line")
    joined = placed.groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"), F.count("*").alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("t"))
    rank = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    done = joined.select(
        "tree", "leaf", "path_score", F.row_number().over(rank).alias("path_rank"), "n_turns",
        F.concat_ws("", F.col("t.line")).alias("formatted"), F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["loss"].alias("loss"))).alias("turns"),
    )
    return done if best is None else done.where(F.col("path_rank") <= best)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds: ``roles``, ``texts`` and ``losses`` (null where not under the mask)."""
    pieces = F.filter(F.split("formatted", r"(?=<\|im_start\|>)"), lambda x: x != "")
    head = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)<\|im_end\|>\n$"
    return formatted.withColumn("pieces", pieces).select(
        "*",
        F.transform("pieces", lambda x: unescaped(F.regexp_extract(x, head, 1))).alias("roles"),
        F.transform("pieces", lambda x: unescaped(F.regexp_extract(x, head, 2))).alias("texts"),
        F.zip_with("pieces", "turns", lambda x, t: F.when(t["loss"].isNotNull(), unescaped(F.substring(x, (t["loss"]["start"] - t["start"] + 1).cast("int"), (t["loss"]["end"] - t["loss"]["start"]).cast("int"))))).alias("losses"),
    )
