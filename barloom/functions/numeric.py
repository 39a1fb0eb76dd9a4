"""Numeric column helpers with the rounding and guards the analytics rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity: floor(x * 10^d + 0.5) / 10^d."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def rounded(x: Column, digits: int = 6) -> Column:
    """For output: rounded, and never minus zero."""
    return F.round(x, digits) + 0.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def finite(x: Column) -> Column:
    """Null for NaN and infinities, which otherwise compare as largest or equal."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7."""
    # Fixed values of formula 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / (2**0.5)))


def pip_size(symbol: Column) -> Column:
    """Smallest quoted step: 0.01 for symbols quoted in JPY, else 0.0001."""
    return F.when(symbol.endswith("JPY"), 0.01).otherwise(0.0001)
