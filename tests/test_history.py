"""Chunked work that is cancelled and goes on; labels; histories; markers."""

import time

import pytest
from pyspark.sql import functions as F

from barloom.operators import asof, conditions, history
from barloom.operators.progress import Chunked
from barloom.operators.tuning import PROFILES


def test_cancelled_work_keeps_finished_chunks(spark, tmp_path):
    def work(k):
        if k < 2:
            return spark.range(k + 1).withColumn("chunk", F.lit(k))

        def slow(batches):
            for b in batches:
                time.sleep(30)
                yield b

        return spark.range(0, 64, 1, 4).mapInArrow(slow, "id long").withColumn("chunk", F.lit(k))

    root = f"file://{tmp_path}"
    job = Chunked(spark, root, 3, work).start()
    until = time.time() + 90
    while time.time() < until and not (job.progress().done == 2 and job.progress().running_tasks):
        time.sleep(0.1)
    seen = job.progress()
    assert (seen.done, seen.chunks, seen.cancelled) == (2, 3, False) and seen.running_tasks > 0
    began = time.time()
    job.cancel()
    job.wait()
    assert time.time() - began < 20 and job.progress().cancelled
    assert sorted((r.chunk, r.id) for r in job.results().collect()) == [(0, 0), (1, 0), (1, 1)]
    again = Chunked(spark, root, 3, lambda k: spark.range(5).withColumn("chunk", F.lit(k))).start()  # goes on behind what is finished
    again.wait()
    assert again.progress().done == 3 and again.results().count() == 8
    broken = Chunked(spark, f"{root}/b", 1, lambda k: spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))).start()
    with pytest.raises(Exception, match="no"):
        broken.wait()
    assert broken.results() is None


def test_labels():
    got = {k: conditions.label(p.condition) for k, p in PROFILES.items()}
    assert got["maCross"] == "EMA20 x EMA50" and got["ichimokuCross"] == "一目9/26/52 クロス(雲フィルタ)" and got["alligator"] == "Alligator 13/8/5 (8/5/3) クロス"
    assert got["bollinger"] == "BB20/2 upper break" and got["stochCross"] == "Stoch14/3/3 %K/%D クロス" and got["keltnerBreak"] == "Keltner20/10 x2 ブレイク"
    assert conditions.label({"type": "ichimokuCross"}) == "一目9/26/52 クロス" and conditions.label({"type": "rsi"}) == "RSI14 below 30"


HISTORY = "strategy_id string, date string, net_pips double, net_yen double, bars int, initial_balance double, spread_pips double, fingerprint string, trades array<struct<exit_time:long,exit_reason:string,net_pips:double,net_yen:double>>"


def test_problems(spark):
    sound = ("2024-01-05", 1.5, 20.0, 3, 1e6, 0.5, "a" * 64, [(1704412800, "stop_loss", 1.0, 10.0), (1704499199, "take_profit", 0.5, 10.0)])
    change = lambda **x: tuple(x.get(n, v) for n, v in zip(("date", "pips", "yen", "bars", "balance", "spread", "mark", "trades"), sound, strict=True))
    cases = {
        "sound": sound, "no mark": change(mark=None), "no trades": change(pips=0.0, yen=0.0, trades=[]), "date": change(date="2024-1-5"), "no day": change(date="2024-02-30"), "yen": change(yen=21.0), "nan": change(pips=float("nan")), "late": change(trades=[(1704499200, "stop_loss", 1.5, 20.0)]),
        "end": change(trades=[(1704412800, "end", 1.5, 20.0)]), "balance": change(balance=0.0), "spread": change(spread=-1.0), "mark": change(mark="A" * 64), "bars": change(bars=-1), "null": change(trades=None), "empty": change(trades=[(None, "stop_loss", 1.5, 20.0)]),
    }
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], HISTORY)
    got = {}
    for r in history.problems(df).collect():
        got.setdefault(r.strategy_id, set()).add(r.problem)
    assert "sound" not in got and "no mark" not in got and "no trades" not in got
    assert got["date"] >= {"date"} and got["no day"] >= {"date"} and got["yen"] == {"sum"} and got["late"] == {"trade_day"} and got["end"] == {"trade_day"}
    assert got["nan"] >= {"values"} and got["balance"] == {"balance"} and got["spread"] == {"spread"} and got["mark"] == {"fingerprint"} and got["bars"] == {"bars"} and "values" in got["null"] and got["empty"] == {"values"}


def test_markers_outside_the_bars_are_null(spark):
    bars = spark.createDataFrame([("A", 100), ("A", 200)], "symbol string, t long")
    events = spark.createDataFrame([(1, "A", 99), (2, "A", 100), (3, "A", 250), (4, "A", 299), (5, "A", 300), (6, "B", 150)], "id int, symbol string, time long")
    assert {r.id: r.bar_t for r in asof.markers(events, bars, ["symbol"], "time", 100).collect()} == {1: None, 2: 100, 3: 200, 4: 200, 5: None, 6: None}
