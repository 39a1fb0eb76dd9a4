"""Queries of the time-blocked operators; each has the SQL of its whole-series counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import blocks
from barloom.operators import indicators as ind
from barloom.plans.series import ORACLES, query, shown
from barloom.sources import bars as src

SPAN = 3 * 86400  # short blocks, so that a month of bars has ten


def _bars(spark, d, tf="h1"):
    return src.event_bars(spark, d, tf)


query("ema20_blocks", ORACLES["ema20"])(lambda spark, d: shown(blocks.ema(_bars(spark, d), 20, seconds=SPAN), "ema20"))
query("rsi14_blocks", ORACLES["rsi14"])(lambda spark, d: shown(blocks.rsi(_bars(spark, d), seconds=SPAN), "rsi"))
query("macd_blocks", ORACLES["macd"])(lambda spark, d: shown(blocks.macd(_bars(spark, d), seconds=SPAN), "macd", "macd_signal", "macd_hist"))
query("alligator_blocks", ORACLES["alligator"])(lambda spark, d: shown(blocks.alligator(_bars(spark, d), seconds=SPAN), "jaw", "teeth", "lips"))
query("bollinger_blocks", ORACLES["bollinger"])(lambda spark, d: shown(blocks.windowed(_bars(spark, d), ind.bollinger, 19, SPAN), "bb_mid", "bb_upper", "bb_lower"))
query("stochastic_blocks", ORACLES["stochastic"])(lambda spark, d: shown(blocks.windowed(_bars(spark, d), ind.stochastic, 13 + 2 + 2, 86400), "stoch_k", "stoch_d"))


@query("asof_backward_blocks", ORACLES["asof_backward_h4_on_h1"])
def _(spark, d):
    wide = _bars(spark, d, "h4").select("symbol", (F.col("t") + 14400).alias("closed"), "c")
    return shown(blocks.backward(_bars(spark, d).select("symbol", "t", "c"), wide, ["symbol"], "t", "closed", ["c"], 5 * 3600), "c", "c_asof")


@query("asof_nearest_blocks", ORACLES["asof_nearest"])
def _(spark, d):
    days = _bars(spark, d, "d1").select("symbol", F.col("t").alias("day"), "c")
    return shown(blocks.nearest(_bars(spark, d).select("symbol", "t"), days, ["symbol"], "t", "day", "c", SPAN), "c_nearest")
