"""A broken source costs its own series only."""

import json

from pyspark.sql import functions as F

from barloom.sources import bars as src
from barloom.sources import feeds


def put(tmp_path, source, symbol, tf, text):
    folder = tmp_path / f"source={source}" / f"symbol={symbol}" / f"tf={tf}"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(text)


def lines(n, step=3600, start=0, **change):
    return "\n".join(json.dumps({"t": start + k * step, "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "v": 1.0} | change) for k in range(n))


def test_isolation(spark, tmp_path):
    put(tmp_path, "primary", "A", "h1", lines(9))
    put(tmp_path, "primary", "B", "h1", lines(3) + "\n{")
    put(tmp_path, "fallback", "B", "h1", lines(6))
    put(tmp_path, "primary", "C", "h1", lines(3, h=1.2))
    put(tmp_path, "primary", "D", "h1", lines(2) + "\n" + lines(1))
    put(tmp_path, "fallback", "D", "h1", lines(3))
    put(tmp_path, "primary", "E", "h1", lines(4, c=None))
    put(tmp_path, "primary", "F", "h4", "")
    wanted = [(s, tf) for s in "ABCDEF" for tf in ("h1", "h4")]
    rows = feeds.read(spark, str(tmp_path), wanted, least={"h1": 3, "h4": 1}).cache()
    assert rows.rdd.getNumPartitions() == len(wanted)
    health = {(r.symbol, r.tf): (r.source, r.bars, r.errors, r.write, r.fell_back) for r in feeds.health(rows).collect()}
    assert health["A", "h1"] == ("primary", 9, None, True, False) and health["A", "h4"] == ("primary", 2, None, True, False)
    assert health["B", "h1"] == ("fallback", 6, "primary: JSONDecodeError", True, True) and health["B", "h4"][:2] == ("fallback", 1)
    assert health["C", "h1"] == (None, 0, "primary: ValueError; fallback: FileNotFoundError", False, False)
    assert health["D", "h1"] == ("fallback", 3, "primary: ValueError", True, True) and health["D", "h4"][:2] == (None, 0)
    assert health["E", "h1"][:2] == health["F", "h1"][:2] == health["F", "h4"][:2] == (None, 0)
    counts = {(r.tf, r.source): (r.series, r.bars) for r in feeds.source_counts(feeds.health(rows)).collect()}
    assert counts["h1", "failed"] == (3, 0) and counts["h1", "fallback"] == (2, 9)
    assert feeds.read(spark, str(tmp_path), []).count() == 0


def test_as_the_plan_computes_it(spark, sf_dir, tmp_path):
    """Files written and read give the bars, and derived four-hour bars equal ``resample`` without the forming one."""
    own = src.event_bars(spark, sf_dir)
    feeds.write_feed(own, str(tmp_path), "primary")
    symbols = [r.symbol for r in own.select("symbol").distinct().collect()]
    rows = feeds.bars_of(feeds.read(spark, str(tmp_path), [(s, tf) for s in symbols for tf in ("h1", "h4")]))
    shown = lambda df: sorted((r.symbol, r.t, round(r.o, 6), round(r.c, 6), round(r.v, 6)) for r in df.collect())
    assert shown(rows.where("tf = 'h1'")) == shown(own)
    until = own.groupBy("symbol").agg((F.max("t") + 3600).alias("until"))
    assert shown(rows.where("tf = 'h4'")) == shown(src.resample(own, "h4").join(until, "symbol").where("t + 14400 <= until"))
