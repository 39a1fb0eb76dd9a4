"""Vectorised runs against one run at a time; the tuning job's gates, quarters and report."""

import random

import pyarrow as pa
import pytest

from barloom.operators import backtest, conditions, grid, tuning
from barloom.operators.fleet import Fleet
from barloom.sources import bars as src
from tests.one_run import Simulation

SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[k]) for n, k in (x.strip().split(" ") for x in backtest.TRADE.split(","))])


def bars(n, seed):
    rnd = random.Random(seed)
    close, out = 100.0, []
    for k in range(n):
        o = close
        close = round(o + rnd.gauss(0, 0.6), 2)
        h, l = round(max(o, close) + rnd.random() * 0.5, 2), round(min(o, close) - rnd.random() * 0.5, 2)
        out.append({"t": k * 1800, "o": o, "h": h, "l": l, "c": close, "long": rnd.random() < 0.06, "short": rnd.random() < 0.06, "last": k == n - 1, "pip_value": 900.0 + k % 7})
    return out


def runs(seed):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)
    return [
        grid.run(f"r{k}", pick(20, 50, 120), pick(20, 60, 200), pick(None, 30, 0.0), *pick(("", ""), ("09:00", "17:00"), ("22:00", "06:00"), ("xx", "10:00"), ("08:00", "08:00")), close_on_opposite=pick(True, False),
                 directions=pick("long,short", "short,long", "long", "short"), mode=pick("fixedLot", "compound", "fixedRisk"), session_offset=pick(0, 540), balance=pick(1_000_000.0, 20_000.0, -1.0), spread_pips=pick(0.5, 3.0))
        for k in range(60)
    ]


def minutes(text):
    ok = len(text) == 5 and text[2] == ":" and (text[:2] + text[3:]).isdigit()
    return int(text[:2]) * 60 + int(text[3:]) if ok else None


def open_at(run, t):
    a, b = minutes(run["session_start"]), minutes(run["session_end"])
    now = (t // 60 + run["session_offset"]) % 1440
    return True if a is None or b is None or a == b else a <= now < b if a < b else now >= a or now < b


def one_by_one(rows, run):
    state = Simulation(run, 0.01)
    return [x for bar in rows for x in state.bar(bar | {"open_session": open_at(run, bar["t"])})]


def stepped(rows, given, marks):
    fleet = Fleet(given, "S", "m30", 0.01, marks)
    for bar in rows:
        fleet.bar(*(bar[x] for x in ("t", "o", "h", "l", "c", "long", "short", "last", "pip_value")))
    return [r for batch in fleet.rows(SCHEMA) for r in batch.to_pylist()]


def test_vectors_equal_single_runs():
    rows, given = bars(700, 1), runs(2)
    got = stepped(rows, given, True)
    short = stepped(rows, given, False)
    traded = 0
    for run in given:
        want = one_by_one(rows, run)
        for kind in ("trade", "equity"):
            mine = [{k: v for k, v in r.items() if v is not None and k not in ("run_id", "symbol", "tf")} for r in got if r["run_id"] == run["run_id"] and r["kind"] == kind]
            assert mine == [x for x in want if x["kind"] == kind]
        assert [r for r in short if r["run_id"] == run["run_id"] and r["kind"] == "trade"] == [r for r in got if r["run_id"] == run["run_id"] and r["kind"] == "trade"]
        (worst,) = [r for r in short if r["run_id"] == run["run_id"] and r["kind"] == "worst"]
        for name in ("drawdown_pips", "drawdown_yen", "drawdown_pct"):
            assert worst[name] == max(x[name] for x in want if x["kind"] == "equity")
        traded += sum(x["kind"] == "trade" for x in want)
    assert traded > 1000


def test_runs_of_a_key_meet_only_its_signals(spark, sf_dir, monkeypatch):
    """Chunks of two runs and several series give what one chunk gives."""
    given = [grid.run(f"{k}", 10 + k, 30, None) | {"run_key": key} for k, key in enumerate("aabbbab")]
    table = tuning.run_table(spark, given)
    own = src.event_bars(spark, sf_dir)
    kept = ["symbol", "tf", "t", "o", "h", "l", "c", "long", "short"]
    sets = conditions.signals(own, [{"type": "donchianBreak"}]).selectExpr(*kept, "'a' AS run_key").unionByName(conditions.signals(own, [{"type": "maCross", "fast": 3, "slow": 8}]).selectExpr(*kept, "'b' AS run_key"))
    whole = sorted(map(tuple, backtest.simulate(sets, table, 1.0).collect()), key=repr)
    monkeypatch.setattr(backtest, "CHUNK", 2)
    assert sorted(map(tuple, backtest.simulate(sets, table, 1.0).collect()), key=repr) == whole
    assert len({r[0] for r in whole}) == 7


STRATEGY = [{"type": "macdCross"}, {"type": "rsi", "comparison": "crossBelow", "threshold": 45}, {"type": "adxTrend", "threshold": 5}, {"type": "maCross", "fast_type": "ema", "fast": 5, "slow": 9}, {"type": "alligator"}, {"type": "parabolicSar"}, {"type": "keltnerBreak"}]


def test_one_scan_for_a_strategy(spark, sf_dir):
    own = src.event_bars(spark, sf_dir)
    plan = conditions.signals(own, STRATEGY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    fused = conditions.with_recurrences(own, STRATEGY)
    for rule in STRATEGY:
        apart, a, b = conditions.compile_condition(own, rule)
        together, c, d = conditions.compile_condition(fused, rule)
        shown = lambda df, x, y: sorted(map(tuple, df.select("symbol", "t", x.alias("x"), y.alias("y")).collect()))
        assert shown(apart, a, b) == shown(together, c, d)


def test_profiles():
    rows = tuning.runs_of(tuning.PROFILES)
    per_symbol = sum(len(p.timeframes) * sum(r["run_key"] == k for r in rows) for k, p in tuning.PROFILES.items())
    assert sum(len(p.timeframes) for p in tuning.PROFILES.values()) * 6 == 216 and per_symbol * 6 == 26_112
    assert len(tuning.runs_of(tuning.chosen(["rsi"]), tuple(tuning.SESSIONS))) == 4 * 36
    assert list(tuning.chosen(["RSI", "maCross"], [])) == ["maCross", "rsi"] and "rsi" not in tuning.chosen(timeframes=["H4"])
    with pytest.raises(ValueError, match="known are m30, h1, h4|known are h1, h4, m30"):
        tuning.chosen(timeframes=["d1"])


def test_unstable_rows_are_demoted_and_not_replaced(spark):
    combos = spark.createDataFrame([("S", "ao", "h1", "ao-0", True, [], 1, True), ("S", "ao", "h1", "ao-1", True, [], 2, False), ("S", "rvi", "h1", "rvi-0", True, [], 1, True), ("S", "rsi", "h1", "rsi-0", False, ["opt_net"], 1, False)], "symbol string, kind string, tf string, run_id string, passed boolean, reasons array<string>, rank int, selected boolean")
    quarter = spark.createDataFrame([("S", k, "h1", f"{k}-0", q, 1.0 if q < n else -1.0) for k, n in (("ao", 2), ("rvi", 3)) for q in range(4)], "symbol string, kind string, tf string, run_id string, quarter int, net_yen double")
    got = {r.run_id: (r.passed, r.adopted, r.reasons, r.positive_quarters) for r in tuning.demoted(combos, quarter).collect()}
    assert got == {"ao-0": (False, False, ["quarters"], 2), "ao-1": (True, False, [], None), "rvi-0": (True, True, [], 3), "rsi-0": (False, False, ["opt_net"], None)}


def test_warnings_of_a_report(spark):
    window = spark.createDataFrame([("EURUSD", "h4", 10, 7, 3, 700.0, True), ("USDJPY", "h4", 10, 7, 3, 740.0, False)], "symbol string, tf string, reference_bars long, opt_bars long, val_bars long, span_days double, short_reference boolean")
    combos = spark.createDataFrame([], "symbol string, kind string, tf string, run_id string, stop_pips double, target_pips double, trailing_pips double, rank int, positive_quarters long, passed boolean, adopted boolean, reasons array<string>")
    rates = spark.createDataFrame([("EURUSD", "h4", 368.5, True)], "symbol string, tf string, rate_days double, fallback boolean")
    reports = tuning.report(combos, window, tuning.chosen(["ao"]), rates)
    got = {r.symbol: (r.status, r.reasons, r.warnings, r.uncovered, r.magic) for r in reports.collect()}
    assert got == {"EURUSD": ("rejected", "nothing_evaluated:1", "reference_span_below_target,usd_jpy_rate_source_fallback", 0.5, 1783200041), "USDJPY": ("rejected", "nothing_evaluated:1", "", None, 1783200141)}
    (total,) = tuning.summary(reports).collect()
    assert (total.candidates, total.rejected_candidates, total.short_references, total.fallback_rates, total.uncovered_sum, total.uncovered_most) == (2, 2, 1, 1, 0.5, 0.5)


def test_job_against_single_runs(spark):
    """Hold-out sums of some combinations of a small job, one run at a time."""
    rows = [("S", "h1", k * 3600, b["o"], b["h"], b["l"], b["c"], 1.0) for k, b in enumerate(bars(420, 7))]
    own = spark.createDataFrame(rows, src.SCHEMA)
    combos, reports = tuning.job({"h1": own}, kinds=["donchianBreak", "rsi"], pip=0.01)
    got = {(r.kind, r.run_id): r for r in combos.collect()}
    assert len(got) == 72 + 36 and {r.kind for r in reports.collect()} == {"donchianBreak", "rsi"}
    cut = int(420 * 0.7)
    for kind in ("donchianBreak", "rsi"):
        for name, part in (("opt", rows[:cut]), ("val", rows[cut:])):
            signalled = conditions.signals(spark.createDataFrame(part, src.SCHEMA), [tuning.PROFILES[kind].condition]).orderBy("t").collect()
            listed = [r.asDict() | {"pip_value": 1000.0, "last": k == len(signalled) - 1} for k, r in enumerate(signalled)]
            for run in tuning.runs_of(tuning.chosen([kind]))[::17]:
                want = one_by_one(listed, run)
                assert got[kind, run["run_id"]][f"{name}_net_yen"] == sum(x.get("net_yen", 0.0) for x in want if x["kind"] == "trade")
                assert got[kind, run["run_id"]][f"{name}_trades"] == sum(x["kind"] == "trade" for x in want)
