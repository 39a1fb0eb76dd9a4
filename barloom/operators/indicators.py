"""Indicators that are frames over a series: native window expressions.

Every function takes bars and adds columns.  A value is null until its whole
look-back exists (``ready``), which is part of each indicator's meaning.  Windows
share one partitioning (symbol, tf), so a chain of indicators costs one shuffle
and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.bars import KEY, series

W = series


def last(n: int, gap: int = 0):
    """Frame of the ``n`` bars that end ``gap`` bars before the current one."""
    return series().rowsBetween(-(n - 1) - gap, -gap)


def ready(x: Column, n: int, value: Column, gap: int = 0) -> Column:
    """``value`` where the last ``n`` values of ``x`` all exist."""
    return F.when(F.count(x).over(last(n, gap)) == n, value)


def mean(x: str, n: int) -> Column:
    return ready(F.col(x), n, F.avg(x).over(last(n)))


def ordered_sum(x: str, n: int) -> Column:
    """Oldest-to-newest sum of the last ``n``: bit-equal for equal windows, so ties stay ties."""
    window = F.collect_list(x).over(last(n))
    return ready(F.col(x), n, F.aggregate(window, F.lit(0.0), lambda a, b: a + b))


def sma(bars: DataFrame, n: int, column: str = "c", out: str | None = None) -> DataFrame:
    return bars.withColumn(out or f"sma{n}", mean(column, n))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower: mean and k population deviations."""
    dev = ready(F.col("c"), n, F.stddev_pop("c").over(last(n)))
    return bars.withColumn("bb_mid", mean("c", n)).withColumn("__d", dev).withColumn("bb_upper", F.col("bb_mid") + k * F.col("__d")).withColumn("bb_lower", F.col("bb_mid") - k * F.col("__d")).drop("__d")


def true_range(bars: DataFrame) -> DataFrame:
    """tr: null on the first bar of a series."""
    before = F.lag("c").over(W())
    return bars.withColumn("tr", F.when(before.isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr: simple mean of the true range."""
    return true_range(bars).withColumn("atr", mean("tr", n))


def latest_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr_latest: mean of the true ranges that exist among the last ``n`` bars."""
    return true_range(bars).withColumn("atr_latest", F.avg("tr").over(last(n)))


def envelope(bars: DataFrame, n: int, deviation: float) -> DataFrame:
    """env_upper, env_lower around a mean, one bar later than the mean could be known."""
    if not 2 <= n <= 1000 or deviation <= 0:
        raise ValueError("period in 2..1000 and a positive deviation are needed")
    middle = F.when(F.row_number().over(W()) > n, mean("c", n))
    return bars.withColumn("__m", middle).withColumn("env_upper", F.col("__m") * (1 + deviation / 100)).withColumn("env_lower", F.col("__m") * (1 - deviation / 100)).drop("__m")


def demarker(bars: DataFrame, n: int = 14) -> DataFrame:
    up, down = F.col("h") - F.lag("h").over(W()), F.lag("l").over(W()) - F.col("l")
    raw = bars.withColumn("__u", F.greatest(up, F.when(up.isNotNull(), 0.0))).withColumn("__d", F.greatest(down, F.when(down.isNotNull(), 0.0)))
    sums = raw.withColumn("__u", mean("__u", n)).withColumn("__d", mean("__d", n))
    return sums.withColumn("demarker", F.when(F.col("__u") + F.col("__d") > 0, F.col("__u") / (F.col("__u") + F.col("__d")))).drop("__u", "__d")


def momentum(bars: DataFrame, n: int = 14) -> DataFrame:
    before = F.lag("c", n).over(W())
    return bars.withColumn("momentum", F.when((before > 0) & (F.col("c") > 0), F.col("c") / F.when(before > 0, before) * 100))


def ao(bars: DataFrame, fast: int = 5, slow: int = 34) -> DataFrame:
    """ao: difference of two means of the median price, from fresh sums."""
    if fast >= slow:
        raise ValueError("fast must be below slow")
    mid = bars.withColumn("__m", (F.col("h") + F.col("l")) / 2)
    return mid.withColumn("ao", ordered_sum("__m", fast) / fast - ordered_sum("__m", slow) / slow).drop("__m")


def rvi(bars: DataFrame, n: int = 10) -> DataFrame:
    """rvi and its signal: symmetrically weighted (1, 2, 2, 1) body over range."""

    def weighted(x: str) -> Column:
        lags = [F.lag(x, k).over(W()) for k in (1, 2, 3)]
        return (F.col(x) + 2 * lags[0] + 2 * lags[1] + lags[2]) / 6

    raw = bars.withColumn("__b", F.col("c") - F.col("o")).withColumn("__r", F.col("h") - F.col("l"))
    raw = raw.withColumn("__n", weighted("__b")).withColumn("__d", weighted("__r"))
    sums = raw.withColumn("__sn", ordered_sum("__n", n)).withColumn("__sd", ordered_sum("__d", n))
    line = sums.withColumn("rvi", F.when(F.col("__sd") != 0, F.col("__sn") / F.when(F.col("__sd") != 0, F.col("__sd"))))
    return line.withColumn("rvi_signal", weighted("rvi")).drop("__b", "__r", "__n", "__d", "__sn", "__sd")


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """cci: distance from the mean in units of 0.015 mean absolute deviations about that same mean."""
    raw = bars.withColumn("__p", (F.col("h") + F.col("l") + F.col("c")) / 3).withColumn("__w", F.collect_list("__p").over(last(n)))
    raw = raw.withColumn("__m", ready(F.col("__p"), n, F.aggregate("__w", F.lit(0.0), lambda a, b: a + b) / n))
    raw = raw.withColumn("__d", F.aggregate("__w", F.lit(0.0), lambda a, b: a + F.abs(b - F.col("__m"))) / n)
    value = F.when(F.col("__d") == 0, 0.0).otherwise((F.col("__p") - F.col("__m")) / (0.015 * F.when(F.col("__d") != 0, F.col("__d"))))
    return raw.withColumn("cci", F.when(F.col("__m").isNotNull(), value)).drop("__p", "__w", "__m", "__d")


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    """don_upper, don_lower: extremes of the n bars before the current one."""
    return bars.withColumn("don_upper", ready(F.col("h"), n, F.max("h").over(last(n, 1)), 1)).withColumn("don_lower", ready(F.col("l"), n, F.min("l").over(last(n, 1)), 1))


def raw_k(bars: DataFrame, n: int) -> DataFrame:
    """__k: place of the close in the range of the last n bars, 50 where that is flat."""
    high, low = ready(F.col("h"), n, F.max("h").over(last(n))), ready(F.col("l"), n, F.min("l").over(last(n)))
    ranged = bars.withColumn("__hi", high).withColumn("__lo", low)
    width = F.col("__hi") - F.col("__lo")
    place = F.when(width == 0, 50.0).otherwise((F.col("c") - F.col("__lo")) / F.when(width != 0, width) * 100)
    return ranged.withColumn("__k", F.when(F.col("__hi").isNotNull(), place)).drop("__hi", "__lo")


def stochastic(bars: DataFrame, k: int = 14, d: int = 3, smooth: int = 3) -> DataFrame:
    """stoch_k, stoch_d: smoothed place of the close, and its mean."""
    return raw_k(bars, k).withColumn("stoch_k", mean("__k", smooth)).withColumn("stoch_d", mean("stoch_k", d)).drop("__k")


def stochastic_fresh(bars: DataFrame, k: int = 14, d: int = 3, smooth: int = 3) -> DataFrame:
    """stochf_k, stochf_d: as ``stochastic`` with fresh ordered sums, so equal windows tie exactly."""
    return raw_k(bars, k).withColumn("stochf_k", ordered_sum("__k", smooth) / smooth).withColumn("stochf_d", ordered_sum("stochf_k", d) / d).drop("__k")


def ichimoku(bars: DataFrame, conversion: int = 9, base: int = 26, span: int = 52, shift: int = 26) -> DataFrame:
    """tenkan, kijun, and the cloud (span_a, span_b) that was projected to this bar ``shift`` bars ago."""

    def middle(n: int) -> Column:
        return ready(F.col("h"), n, (F.max("h").over(last(n)) + F.min("l").over(last(n))) / 2)

    lines = bars.withColumn("tenkan", middle(conversion)).withColumn("kijun", middle(base)).withColumn("__b", middle(span))
    lines = lines.withColumn("__a", (F.col("tenkan") + F.col("kijun")) / 2)
    return lines.withColumn("span_a", F.lag("__a", shift).over(W())).withColumn("span_b", F.lag("__b", shift).over(W())).drop("__a", "__b")


def ichimoku_future(bars: DataFrame, seconds: int, shift: int = 26) -> DataFrame:
    """Cloud rows beyond the last bar: the spans of the last ``shift`` bars at times ``shift`` steps later."""
    lines = ichimoku(bars, shift=0).withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("t"))))
    newest = F.max("t").over(Window.partitionBy(*KEY))
    ahead = lines.withColumn("t", newest + seconds * (shift - F.col("__n") + 1)).where(F.col("__n") <= shift)
    return ahead.select(*KEY, "t", "span_a", "span_b")
