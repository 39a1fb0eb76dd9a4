"""As-of and interval joins on unix seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, columns: list[str], suffix: str = "_asof") -> DataFrame:
    """Every left row with the last right row of its key whose ``right_at`` <= ``at`` (nulls where none).

    Both sides are tagged into one sorted window: one shuffle on the key, no range
    join, and no row per pair.
    """
    packed = F.struct(F.col(right_at).alias("__at"), *columns)
    tagged = left.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(packed.alias("x")).schema[0].dataType).alias("__right"))
    others = right.select(*by, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(tagged.schema["__left"].dataType).alias("__left"), packed.alias("__right"))
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = tagged.unionByName(others).withColumn("__right", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__left.*", *(F.col(f"__right.{c}").alias(c + suffix) for c in columns), F.col("__right.__at").alias(right_at + suffix))


def markers(events: DataFrame, bars: DataFrame, by: list[str], time: str, seconds: int) -> DataFrame:
    """Events with ``bar_t``, the last bar at or before them; null outside a series' first bar to the end of its last one."""
    spans = bars.groupBy(*by).agg((F.max("t") + seconds).alias("__until"))
    at = backward(events, bars.select(*by, F.col("t").alias("bar_t")), by, time, "bar_t", [], "").join(spans, by, "left")
    return at.withColumn("bar_t", F.when(F.col(time) < F.col("__until"), F.col("bar_t"))).drop("__until")


def nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, column: str) -> DataFrame:
    """Every left row with the nearest right row in time, the earlier on a tie; it may lie in the future."""
    back = backward(left, right, by, at, right_at, [column], "_before")
    turned = right.withColumn("__neg", -F.col(right_at))
    both = backward(back.withColumn("__neg_at", -F.col(at)), turned, by, "__neg_at", "__neg", [column, right_at], "_after").drop("__neg_at", "__neg_after")
    return nearer(both, at, right_at, column)


def nearer(both: DataFrame, at: str, right_at: str, column: str) -> DataFrame:
    """Of a row's neighbours before and after it the nearer one, the earlier on a tie."""
    before, after = F.col(at) - F.col(f"{right_at}_before"), F.col(f"{right_at}_after") - F.col(at)
    use_before = before.isNotNull() & (after.isNull() | (before <= after))
    out = both.withColumn(f"{column}_nearest", F.when(use_before, F.col(f"{column}_before")).otherwise(F.col(f"{column}_after")))
    return out.drop(f"{column}_before", f"{right_at}_before", f"{column}_after", f"{right_at}_after")


def within_next(points: DataFrame, now: int, seconds: int, time: str = "time") -> DataFrame:
    """Events with now < time <= now + seconds."""
    return points.where((F.col(time) > now) & (F.col(time) <= now + seconds))


def within_span(bars: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Bars inside their key's [first_t, last_t]."""
    named = spans.select(*by, "first_t", "last_t")
    return bars.join(named, by).where(F.col("t").between(F.col("first_t"), F.col("last_t"))).drop("first_t", "last_t")
