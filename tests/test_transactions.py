"""Versions of reports, locks and retirements survive a writer that dies at any step."""

import json
import threading

import pytest

from barloom.operators.retirement import Retirement
from barloom.sources.files import Files, Lock
from barloom.sources.store import Store


class Killed(BaseException):
    """Not an Exception: nothing of the writer runs afterwards."""


def killed_at(name):
    def step(done):
        if done == name:
            raise Killed(name)

    return step


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def numbers(df):
    return sorted(r.id for r in df.collect())


def test_tables_change_together(spark, root):
    store = Store(spark, root)
    assert store.read("a") is None and store.versions() == []
    assert store.publish({"a": spark.range(1), "b": spark.range(2)}) == 1
    with pytest.raises(Killed):
        store.publish({"a": spark.range(5), "b": spark.range(6)}, killed_at("a"))
    assert numbers(store.read("a")) == [0] and numbers(store.read("b")) == [0, 1]
    assert store.publish({"b": spark.range(3)}) == 2
    assert numbers(store.read("a")) == [0] and numbers(store.read("b")) == [0, 1, 2]
    assert numbers(store.read("b", 1)) == [0, 1] and store.read("c") is None
    assert store.publish({"b": spark.range(4), "a": spark.range(4)}) == 3
    assert store.vacuum(keep=1) == 3 and store.versions() == [3]
    assert numbers(store.read("a")) == numbers(store.read("b")) == [0, 1, 2, 3]


def test_racing_writers_both_stay(spark, root):
    store = Store(spark, root)
    threads = [threading.Thread(target=lambda n=n: Store(spark, root).publish({f"t{n}": spark.range(n)})) for n in range(1, 4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert store.versions() == [1, 2, 3] and [len(numbers(store.read(f"t{n}"))) for n in range(1, 4)] == [1, 2, 3]


def test_locks(spark, root):
    files = Files(spark, root)
    with Lock(files, "lock", patience=0.1):
        with pytest.raises(TimeoutError), Lock(files, "lock", patience=0.1):
            pass
        with Lock(files, "lock", patience=5, stale=0.0):  # an expired lock is taken over
            assert files.exists("lock")
    assert not files.exists("lock")


SNAPSHOT = "run_id string, registered_at long, trades long, profit_factor double, net_yen double, first_day long, last_day long, days long"


@pytest.fixture
def strategies(spark, root):
    files = Files(spark, root)
    for lane, name, at in (("adopted", "alpha", 100), ("adopted", "beta", 200), ("observed", "obs-one", 300)):
        files.create(f"{lane}/{name}.json", json.dumps({"id": name, "registered_at": at}))
    rows = [("alpha", 100, 21, 0.759, -47822.0, 10, 52, 43), ("beta", 200, 0, None, 0.0, None, None, 0), ("obs-one", 300, 1, None, 5.0, 1, 1, 1)]
    return files, spark.createDataFrame(rows, SNAPSHOT)


def state(files, lane="adopted"):
    return {f: files.names(f"{lane}/{f}" if f else lane) for f in ("", "retired", "ledger")}


def test_a_retirement(spark, root, strategies):
    files, snapshots = strategies
    work = Retirement(spark, root)
    entry = work.retire("alpha", " too weak ", "2026-01-02T03:04:05", snapshots)
    assert entry["reason"] == "too weak" and entry["snapshot"]["trades"] == 21 and not entry["already"]
    assert work.retire("alpha", "again", "2026-01-03", snapshots)["reason"] == "too weak"
    assert state(files) == {"": ["beta.json", "ledger", "retired"], "retired": ["alpha@100.json"], "ledger": ["alpha@100.json"]}
    work.retire("obs-one", "late", "2026-01-02", snapshots, "observed")
    assert [tuple(r) for r in work.ledger().collect()] == [("alpha", 100, "too weak", "2026-01-02T03:04:05", 21, 0.759, -47822.0, 10, 52, 43)]
    assert work.ledger("observed").count() == 1
    # a later generation of the same id
    files.create("adopted/alpha.json", json.dumps({"id": "alpha", "registered_at": 400}))
    with pytest.raises(ValueError, match="0 snapshots"):
        work.retire("alpha", "no results", "2026-01-02", snapshots)
    with pytest.raises(FileNotFoundError):
        work.retire("gamma", "x", "2026-01-02", snapshots)
    for bad in (("a/b", "x", "2026-01-02", "adopted"), ("beta", " ", "2026-01-02", "adopted"), ("beta", "x", "soon", "adopted"), ("beta", "x", "2026-01-02", "third")):
        with pytest.raises(ValueError):
            work.retire(bad[0], bad[1], bad[2], snapshots, bad[3])


@pytest.mark.parametrize("step", ["recorded", "moved", "entered", "cleared"])
def test_killed_after_every_step(spark, root, strategies, step):
    files, snapshots = strategies
    with pytest.raises(Killed):
        Retirement(spark, root, killed_at(step)).retire("alpha", "weak", "2026-01-02", snapshots)
    if files.exists("retiring.lock"):  # a process that really dies leaves its lock, which expires
        files.remove("retiring.lock")
    Retirement(spark, root).recover()
    assert state(files) == {"": ["beta.json", "ledger", "retired"], "retired": ["alpha@100.json"], "ledger": ["alpha@100.json"]}
    assert not files.exists("retiring.json")
    assert Retirement(spark, root).retire("alpha", "again", "2026-01-03", snapshots)["already"]


def test_an_error_moves_the_definition_back(spark, root, strategies, monkeypatch):
    files, snapshots = strategies
    work = Retirement(spark, root)
    create = Files.create
    monkeypatch.setattr(Files, "create", lambda self, name, text: (_ for _ in ()).throw(OSError("disk full")) if "/ledger/" in name else create(self, name, text))
    before = state(files)
    with pytest.raises(OSError, match="disk full"):
        work.retire("alpha", "weak", "2026-01-02", snapshots)
    assert state(files)[""] == ["alpha.json", "beta.json", "retired"] and state(files)["retired"] == [] and before[""] == ["alpha.json", "beta.json"]
    assert not files.exists("retiring.json") and not files.exists("retiring.lock")
