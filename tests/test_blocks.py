"""Time-blocked operators give the rows of the whole-series ones, whatever the blocks."""

import random

import pytest

from barloom.operators import asof, blocks
from barloom.operators import indicators as ind
from barloom.operators import recurrent as rec
from barloom.sources import bars as src


def tape(spark, gaps=False, n=90):
    rnd, rows = random.Random(4), []
    for symbol in ("A", "B"):
        close, t = 50.0, 1_000_000 if symbol == "A" else 1_003_600
        for k in range(n if symbol == "A" else 9):
            close += rnd.choice([-1.5, 0.0, 0.0, 1.0, 2.0])
            t += 3600 * rnd.choice([1, 1, 1, 2, 60])
            c = None if gaps and k % 23 == 5 else close
            rows.append((symbol, "h1", t, close - 0.5, None if gaps and symbol == "A" and k == 60 else close + 1.0, close - 1.25, c, 1.0))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, src.SCHEMA).cache()


def rows(df, *names):
    return [tuple(None if x is None else round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select("symbol", "t", *names).orderBy("symbol", "t").collect()]


@pytest.mark.parametrize("gaps", [True, False])
def test_recurrences(spark, gaps):
    bars, seconds = tape(spark, gaps), 7 * 3600
    assert rows(blocks.ema(bars, 12, seconds=seconds), "ema12") == rows(rec.ema(bars, 12), "ema12")
    assert rows(blocks.rsi(bars, 5, seconds=seconds), "rsi") == rows(rec.rsi(bars, 5), "rsi")
    assert rows(blocks.macd(bars, 3, 7, 4, seconds=seconds), "macd", "macd_signal", "macd_hist") == rows(rec.macd(bars, 3, 7, 4), "macd", "macd_signal", "macd_hist")
    assert rows(blocks.alligator(bars, seconds=seconds), "jaw", "teeth", "lips") == rows(rec.alligator(bars), "jaw", "teeth", "lips")


def test_frames(spark):
    bars, seconds = tape(spark), 3600
    assert rows(blocks.windowed(bars, ind.bollinger, 19, seconds), "bb_upper") == rows(ind.bollinger(bars), "bb_upper")
    assert rows(blocks.windowed(bars, ind.donchian, 20, seconds), "don_upper", "don_lower") == rows(ind.donchian(bars), "don_upper", "don_lower")
    assert rows(blocks.windowed(bars, ind.momentum, 14, seconds), "momentum") == rows(ind.momentum(bars), "momentum")


@pytest.mark.parametrize("seconds", [1, 10_000])
def test_as_of(spark, seconds):
    rnd = random.Random(seconds)
    left = spark.createDataFrame([("A" if k % 3 else "B", rnd.randrange(-200, 200), k) for k in range(120)], "symbol string, t long, k long")
    right = spark.createDataFrame([("A", rnd.randrange(-150, 150) * 2 + 1, float(k)) for k in range(12)] + [("C", 0, 1.0)], "symbol string, at long, x double").dropDuplicates(["symbol", "at"])
    shown = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert shown(blocks.backward(left, right, ["symbol"], "t", "at", ["x"], seconds)) == shown(asof.backward(left, right, ["symbol"], "t", "at", ["x"]))
    assert shown(blocks.nearest(left, right, ["symbol"], "t", "at", "x", seconds)) == shown(asof.nearest(left, right, ["symbol"], "t", "at", "x"))


def test_empty(spark):
    none = tape(spark).limit(0)
    assert blocks.macd(none).count() == blocks.rsi(none).count() == blocks.windowed(none, ind.bollinger, 19, 3600).count() == 0


def test_one_series_uses_many_tasks(spark):
    """A block is the unit of work: rows of one series are dealt by block, not by series alone."""
    plan = blocks.ema(tape(spark), 12, seconds=3600)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol#" in plan and blocks.BLOCK in plan[plan.index("MapInArrow") :]
