"""Series cut into blocks of time, so that one long series uses many tasks.

A block is ``floor(t / seconds)``; rows are shuffled and sorted by series and block.  What
a block needs of the earlier ones is small and travels as a table with a row per block:

* linear recurrences (``exponential``, ``smoothed``, ``rsi``, ``macd``, ``alligator``): a block of m values maps
  the state before it to keep^m * state + rest, so states at block edges come from
  composing these maps, and blocks are then scanned side by side;
* frames of rows (``windowed``): the last rows before a block are copied to it;
* as-of joins (``backward``, ``nearest``): the last right row before a block is copied to it.

Only tables of blocks are handled per series.  Results equal those of the whole-series
operators, recurrences up to the order of their sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import asof
from barloom.operators import recurrent as rec
from barloom.sources.bars import KEY
from barloom.sources.scratch import settled

BLOCK = "__block"


@dataclass(frozen=True)
class Line:
    """out_k = keep * out_(k-1) + (1 - keep) * x_k over the values of ``column``, seeded with the mean of the first ``n``; nulls are skipped."""

    out: str
    column: str
    n: int
    keep: float


def exponential(out: str, column: str, n: int) -> Line:
    return Line(out, column, n, 1 - 2 / (n + 1))


def smoothed(out: str, column: str, n: int) -> Line:
    return Line(out, column, n, (n - 1) / n)


class _Resumed:
    """Lines of one block from the counts, states and seeds before it."""

    def __init__(self, lines: list[Line]):
        self.lines, self.counts, self.now = lines, None, None

    def step(self, *values) -> tuple:
        k = len(self.lines)
        xs, seeds = values[:k], values[3 * k :]
        if self.counts is None:
            self.counts, self.now = list(values[k : 2 * k]), list(values[2 * k : 3 * k])
        out = []
        for j, (line, x) in enumerate(zip(self.lines, xs, strict=True)):
            if x is None:
                out.append(None)
                continue
            self.counts[j] += 1
            if self.counts[j] == line.n:
                self.now[j] = seeds[j]
            elif self.counts[j] > line.n:
                self.now[j] = line.keep * self.now[j] + (1 - line.keep) * x
            out.append(self.now[j] if self.counts[j] >= line.n else None)
        return tuple(out)


class _Carried:
    """States before each block: maps of the blocks composed in order."""

    def __init__(self, lines: list[Line]):
        self.lines, self.now = lines, [None] * len(lines)

    def step(self, *values) -> tuple:
        k = len(self.lines)
        before, counts, rests, seeds = (values[a * k : (a + 1) * k] for a in range(4))
        found = tuple(self.now)
        for j, line in enumerate(self.lines):
            after = before[j] + counts[j]
            if after < line.n:
                continue
            start = seeds[j] if before[j] < line.n else self.now[j]
            steps = after - max(before[j], line.n)
            self.now[j] = start * line.keep**steps + (rests[j] or 0.0)
        return found


def _in_blocks(df: DataFrame, seconds: int, at: str = "t") -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(at) / seconds).cast("long"))


def linear(df: DataFrame, lines: list[Line], seconds: int) -> DataFrame:
    """Adds the lines' outputs to bars of many series."""
    rows = _in_blocks(df, seconds)
    names = lambda what: [f"__{what}{j}" for j in range(len(lines))]
    before, count, rest, seed, state = (names(x) for x in ("before", "count", "rest", "seed", "state"))
    counts = rows.groupBy(*KEY, BLOCK).agg(*(F.count(x.column).alias(n) for x, n in zip(lines, count, strict=True)))
    earlier = Window.partitionBy(*KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    edges = settled(counts.withColumns({b: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for b, c in zip(before, count, strict=True)}))
    so_far = Window.partitionBy(*KEY, BLOCK).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(edges, [*KEY, BLOCK])
    for j, x in enumerate(lines):
        placed = placed.withColumn(f"__k{j}", F.when(F.col(x.column).isNotNull(), F.col(before[j]) + F.count(x.column).over(so_far)))
    early = lambda j, x: F.col(f"__k{j}") <= x.n
    late = lambda j, x: F.when(F.col(f"__k{j}") > x.n, (1 - x.keep) * F.col(x.column) * F.pow(F.lit(x.keep), F.col(before[j]) + F.col(count[j]) - F.col(f"__k{j}")))
    sums = placed.groupBy(*KEY, BLOCK).agg(
        *(F.sum(late(j, x)).alias(rest[j]) for j, x in enumerate(lines)), *(F.sum(F.when(early(j, x), F.col(x.column))).alias(f"__sum{j}") for j, x in enumerate(lines))
    )
    whole = Window.partitionBy(*KEY)
    maps = edges.join(sums, [*KEY, BLOCK]).withColumns({s: F.sum(f"__sum{j}").over(whole) / x.n for j, (s, x) in enumerate(zip(seed, lines, strict=True))})
    maps = maps.select(*KEY, F.col(BLOCK).alias("t"), *before, *count, *rest, *seed)
    states = rec.scan(maps, lambda: _Carried(lines), [*before, *count, *rest, *seed], dict.fromkeys(state, "double"))
    given = settled(states.select(*KEY, F.col("t").alias(BLOCK), *before, *state, *seed))
    ready = rows.join(given, [*KEY, BLOCK])
    out = rec.scan(ready, lambda: _Resumed(lines), [*(x.column for x in lines), *before, *state, *seed], {x.out: "double" for x in lines}, (*KEY, BLOCK))
    return out.select(*df.columns, *(x.out for x in lines))


def previous(df: DataFrame, column: str, out: str, seconds: int) -> DataFrame:
    """Adds the value of the row before, across block borders."""
    rows = _in_blocks(df, seconds)
    last = rows.groupBy(*KEY, BLOCK).agg(F.max_by(column, "t").alias("__last"))
    edges = last.withColumn("__last", F.lag("__last").over(Window.partitionBy(*KEY).orderBy(BLOCK)))
    inside = Window.partitionBy(*KEY, BLOCK).orderBy("t")
    first = F.row_number().over(inside) == 1
    return rows.join(edges, [*KEY, BLOCK]).withColumn(out, F.when(first, F.col("__last")).otherwise(F.lag(column).over(inside))).select(*df.columns, out)


def _split(bars: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Series whose ``columns`` are never null, and the others: a gap starts smoothed means anew, which a linear map cannot."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    holed = bars.groupBy(*KEY).agg(F.max(gap).alias("gap")).where("gap").select(*KEY)
    return bars.join(holed, list(KEY), "left_anti"), bars.join(holed, list(KEY), "left_semi")


def ema(bars: DataFrame, n: int, column: str = "c", out: str | None = None, seconds: int = 30 * 86400) -> DataFrame:
    return linear(bars, [exponential(out or f"ema{n}", column, n)], seconds)


def rsi(bars: DataFrame, n: int = 14, flat: bool = True, seconds: int = 30 * 86400) -> DataFrame:
    name = "rsi" if flat else "rsi_noflat"
    sound, holed = _split(bars, ["c"])
    moved = previous(sound, "c", "__then", seconds).withColumn("__up", F.greatest(F.col("c") - F.col("__then"), F.lit(0.0))).withColumn("__down", F.greatest(F.col("__then") - F.col("c"), F.lit(0.0)))
    moved = moved.withColumns({x: F.when(F.col("__then").isNotNull(), F.col(x)) for x in ("__up", "__down")})
    both = linear(moved, [smoothed("__gain", "__up", n), smoothed("__loss", "__down", n)], seconds)
    gain, loss = F.col("__gain"), F.col("__loss")
    value = F.when(loss == 0, F.when((gain == 0) & F.lit(flat), 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + gain / F.when(loss != 0, loss)))
    return both.withColumn(name, value).select(*bars.columns, name).unionByName(rec.rsi(holed, n, flat))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, seconds: int = 30 * 86400) -> DataFrame:
    if fast >= slow:
        raise ValueError("fast must be below slow")
    lines = linear(bars, [exponential("__fast", "c", fast), exponential("__slow", "c", slow)], seconds)
    lines = linear(lines.withColumn("macd", F.col("__fast") - F.col("__slow")), [exponential("macd_signal", "macd", signal)], seconds)
    return lines.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).select(*bars.columns, "macd", "macd_signal", "macd_hist")


def alligator(bars: DataFrame, periods: tuple[int, int, int] = (13, 8, 5), shifts: tuple[int, int, int] = (8, 5, 3), seconds: int = 30 * 86400) -> DataFrame:
    names = ("jaw", "teeth", "lips")
    sound, holed = _split(bars, ["h", "l"])
    lines = linear(sound.withColumn("__mid", (F.col("h") + F.col("l")) / 2), [smoothed(f"__{x}", "__mid", n) for x, n in zip(names, periods, strict=True)], seconds)
    late = lambda df: df.withColumns({x: F.lag(f"__{x}", s).over(Window.partitionBy(*KEY).orderBy("t")) for x, s in zip(names, shifts, strict=True)})
    shifted = windowed(lines, late, max(shifts), seconds)
    return shifted.select(*bars.columns, *names).unionByName(rec.alligator(holed, periods, shifts))


def windowed(bars: DataFrame, add: Callable[[DataFrame], DataFrame], back: int, seconds: int) -> DataFrame:
    """``add`` over blocks; it may look ``back`` rows back within a series (symbol, tf) and must not number rows.

    The last ``back`` rows before a block, from as many earlier blocks as that takes, are copied to it.
    """
    rows = _in_blocks(bars, seconds)
    order = Window.partitionBy(*KEY).orderBy(BLOCK)
    sizes = rows.groupBy(*KEY, BLOCK).agg(F.count("*").alias("__n"))
    ends = sizes.withColumn("__end", F.sum("__n").over(order))
    # blocks that follow this one with fewer than ``back`` rows between: at most ``back`` of them
    following = F.collect_list(F.struct(F.col(BLOCK).alias("block"), (F.col("__end") - F.col("__n")).alias("rows_before"))).over(order.rowsBetween(1, max(1, back)))
    near = ends.withColumn("__to", F.filter(following, lambda x: x["rows_before"] - F.col("__end") < back)).where(F.size("__to") > 0)
    last = Window.partitionBy(*KEY, BLOCK).orderBy(F.desc("t"))
    tails = rows.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= back).join(near.select(*KEY, BLOCK, "__end", "__to"), [*KEY, BLOCK])
    copies = tails.withColumn("__x", F.explode(F.filter("__to", lambda x: x["rows_before"] - F.col("__end") + F.col("__r") <= back)))
    copies = copies.withColumn(BLOCK, F.col("__x.block")).select(*rows.columns, F.lit(True).alias("__copy"))
    own = rows.withColumn("__copy", F.lit(False)).unionByName(copies)
    named = own.withColumn("__tf", F.col("tf")).withColumn("tf", F.concat_ws("#", "tf", F.col(BLOCK).cast("string"))).drop(BLOCK)
    return add(named).where(~F.col("__copy")).withColumn("tf", F.col("__tf")).drop("__copy", "__tf")


def backward(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, columns: list[str], seconds: int, suffix: str = "_asof") -> DataFrame:
    """``asof.backward`` by blocks: every left row with the last right row of its key whose ``right_at`` <= ``at``."""
    l, r = _in_blocks(left, seconds, at), _in_blocks(right.select(*by, right_at, *columns), seconds, right_at)
    newest = r.groupBy(*by, BLOCK).agg(F.max_by(F.struct(*columns), right_at).alias("__row"), F.max(right_at).alias("__time"))
    # a right row of block b can serve all later blocks: an as-of join of the (few) blocks themselves
    asked = l.select(*by, BLOCK).distinct().withColumn("__ask", F.col(BLOCK) - 1)
    carried = asof.backward(asked, newest.withColumnRenamed(BLOCK, "__from"), by, "__ask", "__from", ["__row", "__time"], "")
    carried = carried.where("__time is not null").select(*by, BLOCK, F.col("__time").alias(right_at), *(F.col("__row")[c].alias(c) for c in columns))
    return asof.backward(l, r.unionByName(carried), [*by, BLOCK], at, right_at, columns, suffix).drop(BLOCK)


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, column: str, seconds: int) -> DataFrame:
    """``asof.nearest`` by blocks: the nearest right row in time, the earlier on a tie."""
    back = backward(left, right, by, at, right_at, [column], seconds, "_before")
    turned = right.withColumn("__neg", -F.col(right_at))
    both = backward(back.withColumn("__neg_at", -F.col(at)), turned, by, "__neg_at", "__neg", [column, right_at], seconds, "_after").drop("__neg_at", "__neg_after")
    return asof.nearer(both, at, right_at, column)
