"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, drop_cut


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set that does not depend on row order."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)`` that is not its component's smallest.

    Every round points each node's larger neighbours, then its smaller ones, at
    the smallest node in reach; the table shrinks to one star per component in a
    logarithmic number of rounds.  Hubs are aggregated by partial minima and joined
    by splittable joins.  Loops, repeated and null edges are ignored.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        then, before = cut(small.distinct()), now
        new = _mark(then)
        drop_cut(before)
        now = then
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
