"""Absent, broken and repeated records of stored results."""

import json

import pytest

from barloom.sources import loaders


def put(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_absent_and_broken(spark, tmp_path):
    assert loaders.load(spark, str(tmp_path / "none.json"), "adaptive") is None
    assert loaders.retired(None, spark).count() == 0 and loaders.observations(None, None) is None
    with pytest.raises(FileNotFoundError):
        loaders.forward(None, spark)
    found = loaders.load(spark, put(tmp_path / "a.json", {"symbol": "A", "tf": "h1", "horizon": 5, "accuracy": 0.5}, "{", {"symbol": "B"}, {"symbol": "C", "tf": "h1", "horizon": "x"}), "adaptive")
    assert [r.symbol for r in found.rows.collect()] == ["A"] and tuple(found.misfits.first()) == (3, 4)


def test_one_row_per_generation(spark, tmp_path):
    row = {"strategy_id": "a", "retired_at": "2024-01-01", "reason": "weak", "trades": 1}
    path = put(tmp_path / "l.json", row | {"ledger_key": "a@5"}, row | {"ledger_key": "a@5x", "registered_at": 5, "trades": 2}, row | {"ledger_key": "a", "trades": 3}, row | {"ledger_key": "a@9", "reason": None}, row | {"ledger_key": "a@7", "registered_at": 8})
    got = sorted(((r.registered_at, r.trades) for r in loaders.retired(loaders.load(spark, path, "retired"), spark).collect()), key=repr)
    assert got == [(5, 1), (8, 1), (None, 3)]
    path = put(tmp_path / "f.json", {"strategy_id": "a", "registered_at": 1, "trades": 9}, {"strategy_id": "a", "registered_at": 2, "trades": 1}, {"strategy_id": "b", "registered_at": 1, "trades": 0, "confirmed_days": 4})
    loaded = loaders.load(spark, path, "forward")
    assert sorted((r.strategy_id, r.registered_at) for r in loaders.forward(loaded, spark).collect()) == [("a", 2), ("b", 1)]
    history = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "strategy_id string, day long")
    assert sorted((r.strategy_id, r.history_days, r.history_available) for r in loaders.observations(loaded, history).collect()) == [("a", 2, True), ("a", 2, True), ("b", 4, True)]
    assert {(r.history_days, r.history_available) for r in loaders.observations(loaded, None).collect()} == {(0, False), (4, False)}
