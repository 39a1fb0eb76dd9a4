"""Operators against plain loops and worked cases."""

import math
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import numeric
from barloom.operators import asof, backtest, conditions, forecast, grid, ledger, recurrent, scanner, signals
from barloom.operators import forecast as fc
from barloom.sources import bars as src


def tape(spark, closes, symbol="AAA", step=3600, spread=0.5):
    rows = [(symbol, "h1", k * step, float(c), c + spread, c - spread, float(c), 1.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, src.SCHEMA)


def walk(n, seed=1, start=100.0):
    rng, x, out = random.Random(seed), start, []
    for _ in range(n):
        x = max(5.0, x + rng.gauss(0, 1))
        out.append(round(x, 3))
    return out


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rounding_and_normal_cdf(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.05,)], "x double")
    assert [r[0] for r in df.select(numeric.half_up(F.col("x"))).collect()] == [-2.0, 3.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(-1.5,), (0.0,), (0.7,)], "x double").select(numeric.normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / 2**0.5)) for x in (-1.5, 0.0, 0.7)], abs=2e-7)


def test_rsi_known_values(spark):
    closes = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00, 46.03, 46.41, 46.22, 45.64, 46.21]
    got = column(recurrent.rsi(tape(spark, closes)), "rsi")
    assert got[:14] == [None] * 14
    assert got[14:] == pytest.approx([70.46, 66.25, 66.48, 69.35, 66.29, 57.92, 62.88], abs=0.01)
    flat = tape(spark, [7.0] * 20)
    assert column(recurrent.rsi(flat), "rsi")[-1] == 50 and column(recurrent.rsi(flat, flat=False), "rsi_noflat")[-1] == 100


def test_sar_exposure(spark):
    """Two early reversals, a long flat stretch: values appear 100 bars after the first reversal."""
    highs = [10, 11, 12, 13, *[13] * 98, 30, 32, 34, 35]
    lows = [8, 9, 10, 8, *[10] * 98, 15, 16, 17, 18]
    rows = [("A", "h1", k * 60, float(low), float(h), float(low), float(h), 1.0) for k, (h, low) in enumerate(zip(highs, lows))]
    got = column(recurrent.parabolic_sar(spark.createDataFrame(rows, src.SCHEMA)), "sar")
    first = next(k for k, x in enumerate(got) if x is not None)
    assert first in (101, 102) and all(x is not None for x in got[first:])


def test_scan_keeps_state_between_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        a = tape(spark, walk(60)).unionByName(tape(spark, walk(40, 2), "BBB"))
        got = {(r.symbol, r.t): r.ema5 for r in recurrent.ema(a, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for symbol, closes in (("AAA", walk(60)), ("BBB", walk(40, 2))):
        now = sum(closes[:5]) / 5
        for k in range(5, len(closes)):
            now = closes[k] / 3 + now * 2 / 3
            assert got[(symbol, k * 3600)] == pytest.approx(now)


def test_asof_equals_loops(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(100)) for _ in range(60)]
    right = [(s, t, float(k)) for k, (s, t) in enumerate({(rng.choice("abc"), rng.randrange(100)) for _ in range(40)})]
    a, b = spark.createDataFrame(left, "s string, t long"), spark.createDataFrame(right, "s string, at long, v double")
    want = sorted(str((s, t, next((v for _, at, v in sorted((x for x in right if x[0] == s and x[1] <= t), key=lambda x: -x[1])), None))) for s, t in left)
    assert sorted(str((r.s, r.t, r.v_asof)) for r in asof.backward(a, b, ["s"], "t", "at", ["v"]).collect()) == want
    near = sorted(str((s, t, min(((abs(at - t), at, v) for z, at, v in right if z == s), default=(0, 0, None))[2])) for s, t in left)
    assert sorted(str((r.s, r.t, r.v_nearest)) for r in asof.nearest(a, b, ["s"], "t", "at", "v").collect()) == near


@pytest.mark.parametrize("start,end,offset", [("22:00", "06:30", 540), ("08:00", "17:00", 0), ("09:00", "09:00", 0), ("25:00", "06:00", 0)])
def test_session(spark, start, end, offset):
    def inside(t):
        a, b = conditions.minutes_of(start), conditions.minutes_of(end)
        if a is None or b is None or a == b:
            return True
        m = (t // 60 + offset) % 1440
        return a <= m < b if a < b else m >= a or m < b

    df = spark.range(0, 200_000, 1777)
    got = df.select("id", conditions.in_session(F.col("id"), start, end, offset).alias("x")).collect()
    assert all(r.x == inside(r.id) for r in got)


def test_conditions_refuse_unknown_and_never_fire_outside_their_domain(spark):
    bars = tape(spark, walk(80))
    with pytest.raises(ValueError):
        conditions.signals(bars, [{"type": "nothing"}])
    with pytest.raises(ValueError):
        conditions.signals(bars, [{"type": "rsi", "levels": 3}])
    for bad in ({"type": "envelope", "deviation": 0}, {"type": "macdCross", "fast": 26, "slow": 12}, {"type": "adxTrend", "threshold": 100}, {"type": "alligator", "periods": (5, 8, 13)}, {"type": "cciBreak", "level": -1}):
        assert conditions.signals(bars, [bad]).where("long or short").count() == 0
    assert conditions.signals(bars, []).where("long or short").count() == 0
    both = conditions.signals(bars, [{"type": "donchianBreak", "period": 5}, {"type": "momentum", "period": 3}])
    single = conditions.signals(conditions.signals(bars, [{"type": "donchianBreak", "period": 5}], "l1", "s1"), [{"type": "momentum", "period": 3}], "l2", "s2")
    assert column(both, "long") == [r.l1 and r.l2 for r in single.orderBy("t").collect()]


def simulate_plainly(bars, run, pip):
    """A second, independent simulation: list of (direction, entry, exit, reason, net pips)."""
    trades, pos, pending, close, spread = [], None, None, False, run["spread_pips"]

    def leave(bar, price, reason):
        nonlocal pos
        move = (price - pos["p"]) * pos["s"] / pip
        trades.append((pos["d"], pos["t"], bar["t"], round(price, 9), reason, math.floor((move - spread) * 10 + 0.5) / 10))
        pos = None

    for k, bar in enumerate(bars):
        if k == 0:
            continue
        if pos and close:
            leave(bar, bar["o"], "opposite_signal")
            close = False
        if pending and not pos:
            s = 1 if pending == "long" else -1
            pos = {"d": pending, "s": s, "p": bar["o"], "t": bar["t"], "stop": bar["o"] - s * run["stop_pips"] * pip, "goal": bar["o"] + s * run["target_pips"] * pip, "why": "stop_loss"}
        pending = None
        if pos:
            s = pos["s"]
            worst, best = (bar["l"], bar["h"]) if s > 0 else (bar["h"], bar["l"])
            if (worst - pos["stop"]) * s <= 0:
                leave(bar, min(pos["stop"], bar["o"]) if s > 0 else max(pos["stop"], bar["o"]), pos["why"])
            elif (best - pos["goal"]) * s >= 0:
                leave(bar, pos["goal"], "take_profit")
            elif run["trailing_pips"]:
                new = best - s * run["trailing_pips"] * pip
                if (new - pos["stop"]) * s > 0:
                    pos["stop"], pos["why"] = new, "trailing_stop"
        if k < len(bars) - 1:
            if pos:
                close = run["close_on_opposite"] and bar["short" if pos["s"] > 0 else "long"]
            else:
                pending = next((d for d in ("long", "short") if bar[d]), None)
    if pos:
        leave(bars[-1], bars[-1]["c"], "end")
    return trades


@pytest.mark.parametrize("trailing,opposite", [(None, False), (2.0, False), (2.5, True)])
def test_backtest_equals_a_second_simulation(spark, trailing, opposite):
    rng = random.Random(5)
    rows = []
    for k, c in enumerate(walk(400, 9)):
        o = c + rng.gauss(0, 0.7)
        rows.append(("AAA", "h1", k * 3600, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, 1.0, rng.random() < 0.1, rng.random() < 0.1))
    signals_df = spark.createDataFrame(rows, src.SCHEMA + ", long boolean, short boolean")
    run = grid.run("r", 3, 6, trailing, close_on_opposite=opposite)
    out = backtest.simulate(signals_df, grid.runs(spark, [run]), pip=1.0).cache()
    got = [(r.direction, r.entry_time, r.exit_time, round(r.exit_price, 9), r.exit_reason, r.net_pips) for r in backtest.trades_of(out).orderBy("id").collect()]
    names = ("symbol", "tf", "t", "o", "h", "l", "c", "v", "long", "short")
    want = simulate_plainly([dict(zip(names, r)) for r in rows], run, 1.0)
    assert got == want and len(got) > 20
    marks = backtest.equity_of(out).orderBy("t").collect()
    assert len(marks) == 400 and marks[-1].equity_pips == pytest.approx(sum(x[5] for x in want), abs=0.051)
    m = backtest.metrics(out).collect()[0]
    assert (m.trades, m.wins) == (len(want), sum(r.net_yen > 0 for r in backtest.trades_of(out).collect()))


def test_take_profit_case(spark):
    """Set-up, entry at the next open, target 20 pips away: net 19.5 after half a pip of spread."""
    rows = [("EURUSD", "h1", k * 3600, 1.1, 1.1001, 1.0999, 1.1, 1.0, k == 1, False) for k in range(3)] + [("EURUSD", "h1", 10800, 1.1, 1.1030, 1.0999, 1.1025, 1.0, False, False), ("EURUSD", "h1", 14400, 1.1025, 1.1026, 1.1024, 1.1025, 1.0, False, False)]
    out = backtest.simulate(spark.createDataFrame(rows, src.SCHEMA + ", long boolean, short boolean"), grid.runs(spark, [grid.run("r", 10, 20)]))
    (trade,) = backtest.trades_of(out).collect()
    assert (trade.exit_reason, trade.net_pips, trade.lot) == ("take_profit", 19.5, 0.1)


def test_grid_values_and_cap():
    assert grid.values(10, 20, 5) == [10, 15, 20] and grid.values(20, 10, 5) == [10, 15, 20] and grid.values(1, 1.2, 0.1) == [1.0, 1.1, 1.2]
    with pytest.raises(ValueError):
        grid.combinations(list(range(100)), list(range(100)), [None])


def test_overfit_rules(spark):
    cases = [(100, 50, 5, 5, 0.5, False), (100, 20, 5, 5, 0.2, True), (100, 90, 5, 20, 0.9, True), (-10, -5, 1, 50, 1.0, False), (0, -1, 1, 1, 0.0, False)]
    df = spark.createDataFrame([tuple(map(float, c[:4])) for c in cases], "o double, v double, od double, vd double")
    got = df.select(grid.validation_ratio(F.col("o"), F.col("v")).alias("r"), grid.overfit(F.col("o"), F.col("v"), F.col("od"), F.col("vd")).alias("x")).collect()
    assert [(r.r, r.x) for r in got] == [c[4:] for c in cases]


def pooled(values, weights):
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [min(0.99, max(0.01, b[0])) for b in blocks for _ in range(b[2])]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(1, 50)), min_size=10, max_size=10))
def test_isotonic_pooling(spark, pairs):
    values, weights = [a / 100 for a, _ in pairs], [float(b) for _, b in pairs]
    df = spark.createDataFrame([([(v, w) for v, w in zip(values, weights)],)], "b array<struct<value:double,weight:double>>")
    assert df.select(forecast._pooled(F.col("b"))).first()[0] == pytest.approx(pooled(values, weights))


def test_calibration_interpolates(spark):
    table = spark.createDataFrame([("A", "h1", 1, [(0.2, 0.3), (0.6, 0.5)])], "symbol string, tf string, horizon int, points array<struct<x:double,y:double>>")
    df = spark.createDataFrame([("A", "h1", 1, p) for p in (0.1, 0.2, 0.4, 0.6, 0.9)] + [("B", "h1", 1, 0.7)], "symbol string, tf string, horizon int, p_up double")
    got = [r.p_calibrated for r in forecast.calibrated(df, table).orderBy("symbol", "p_up").collect()]
    assert got == pytest.approx([0.3, 0.3, 0.4, 0.5, 0.5, 0.7])


def test_levels_cluster_swings(spark):
    closes = [100 + 5 * math.sin(k / 3) for k in range(200)]
    got = signals.levels(tape(spark, closes)).orderBy(F.desc("strength")).collect()
    assert 1 <= len(got) <= 8 and {r.direction for r in got} == {"support", "resistance"}
    assert got[0].touches > 3 and all(a.strength >= b.strength for a, b in zip(got, got[1:]))


def test_outcomes_equal_loops(spark):
    rng = random.Random(8)
    bars, x = [], 100.0
    for k in range(120):
        x += rng.gauss(0, 1)
        bars.append(("A", "h1", k * 3600, x, x + rng.random(), x - rng.random(), x + rng.gauss(0, 0.3), 1.0))
    bars = [(s, f, t, o, max(o, h, c), min(o, low, c), c, v) for s, f, t, o, h, low, c, v in bars]
    recs = []
    for k in range(0, 115, 3):
        side, kind, entry = rng.choice(["buy", "sell"]), rng.choice(["market", "pullback"]), bars[k][6]
        sign = 1 if side == "buy" else -1
        recs.append(("A", "h1", "swing", k * 3600, k * 3600 + 12 * 3600, side, 60.0, "medium", kind, entry - sign * 0.5, entry - sign * 0.5 - 0.3, entry - sign * 0.5 + 0.3, entry - sign * 2.0, entry + sign * 2.5))
    df = spark.createDataFrame(recs, "symbol string, tf string, style string, t long, deadline long, direction string, total double, tier string, entry_type string, entry double, zone_low double, zone_high double, stop double, target double")
    span, spread = 12 * 3600, 0.1
    want = {}
    for _, _, _, t, _, side, _, _, kind, entry, lo, hi, stop, target in recs:
        s, later, fill, end = (1 if side == "buy" else -1), [b for b in bars if t < b[2] <= t + span], None, None
        for b in later:
            if fill is None:
                if kind == "market" or (b[5] <= hi and b[4] >= lo):
                    fill = (b[2], (b[3] if kind == "market" else max(b[5], min(b[4], entry))) + s * spread)
                else:
                    continue
            if (b[5] <= stop) if s > 0 else (b[4] >= stop):
                end = ("stop", stop)
                break
            if (kind == "market" or b[2] > fill[0]) and ((b[4] >= target) if s > 0 else (b[5] <= target)):
                end = ("target", target)
                break
        if end is None and bars[-1][2] < t + span or not later:
            continue
        name, price = ("unfilled", None) if fill is None else end or ("deadline", later[-1][6])
        risk = None if fill is None else s * (fill[1] - stop)
        want[t] = (name, None if fill is None else 0.0 if risk <= 0 else round(s * (price - fill[1]) / risk, 6))
    rows = scanner.outcomes(df, spark.createDataFrame(bars, src.SCHEMA), spread).collect()
    assert {r.t: (r.exit_reason, r.r) for r in rows} == want and len({x[0] for x in want.values()}) >= 3
    names = {"unfilled": "unfilled", "stop": "loss", "target": "win"}
    assert all(r.outcome == (names.get(r.exit_reason) or ("loss" if r.r < 0 else "win" if r.r > 0 else "draw")) for r in rows)


def test_expectation_and_downgrade(spark):
    rows = [(75.0, 0.6, 0.53, True), (75.0, 0.6, 0.51, True), (75.0, None, None, True), (60.0, None, None, False), (50.0, 0.55, None, True), (50.0, None, 0.9, True), (90.0, 0.5, None, False)]
    df = spark.createDataFrame(rows, "total double, p double, a double, aligned boolean")
    got = [r[0] for r in df.select(scanner.expectation(F.col("total"), F.col("p"), F.col("a"), F.col("aligned"))).collect()]
    assert got == ["high", "medium", "medium", "low", "medium", "low", "low"]
    poor = spark.createDataFrame([("high", 10, 0.44), ("medium", 10, 0.44), ("low", 10, 0.0), ("high", 9, 0.0), ("high", 10, 0.45), ("high", None, None)], "tier string, n int, e double")
    assert [r[0] for r in poor.select(scanner.downgraded(F.col("tier"), F.col("n"), F.col("e"))).collect()] == ["medium", "low", "low", "high", "high", "high"]


def test_monthly_simulation_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"2023-{m:02d}-{d:02d}", rng.choice(["high", "medium", "low"]), round(rng.gauss(0.1, 1), 6)) for m in (1, 2, 4, 7, 12) for d in range(1, 20, 4)]
    data = [("win" if r > 0 else "loss", "deadline", tier, r, 1 + int(datetime.fromisoformat(day + "T12:00:00+00:00").timestamp())) for day, tier, r in rows]
    df = spark.createDataFrame(data, "outcome string, exit_reason string, tier string, r double, exit_t long")
    for mode, tiers, months in (("medium", ("high", "medium"), 12), ("high", ("high",), 6)):
        got = {r.month: r for r in scanner.monthly(df, mode, months).collect()}
        names, balance = [f"2023-{m:02d}" for m in range(13 - months, 13)], 1_000_000.0
        assert sorted(got) == names
        for name in names:
            start = balance
            for day, tier, r in rows:
                if day.startswith(name) and tier in tiers:
                    balance += balance * 0.01 * r
            assert abs(got[name].pnl - (balance - start)) <= 1 and abs(got[name].end_balance - balance) <= 1
    (one,) = scanner.monthly_summary(scanner.monthly(df)).collect()
    assert one.first_month == "2023-01" and one.active_months == 5 and one.best_pnl >= one.worst_pnl


def test_returns_reach_beyond_gaps(spark):
    """A price that is not positive has no return; the look-back holds the last returns there are."""
    closes = [100 + 7 * math.sin(k) + k % 5 for k in range(130)]
    for k in (40, 41, 90, 129):
        closes[k] = 0.0 if k % 2 else -1.0
    bars = tape(spark, closes).withColumn("score", F.lit(2))
    got = {r.t: r for r in fc.model_stats(bars).collect()}
    times = sorted(got)
    for n in (2, 5, 60, 100, 129, 130):
        returns = [math.log(b / a) for a, b in zip(closes[: n - 1], closes[1:n]) if a > 0 and b > 0][-80:]
        mean, m = sum(returns) / len(returns), len(returns)
        sd = math.sqrt(sum((x - mean) ** 2 for x in returns) / m)
        mx = (m - 1) / 2
        var = sum((k - mx) ** 2 for k in range(m))
        slope = sum((k - mx) * (x - mean) for k, x in enumerate(returns)) / var if var else 0
        r = got[times[n - 1]]
        assert abs(r.volatility - max(sd, abs(mean), 1e-6)) < 1e-9
        assert abs(r.drift_move - (mean if m < 3 else mean + slope * (m - mx))) < 1e-9


def test_append_only_and_sources(spark):
    old, new = tape(spark, [1, 2, 3]), tape(spark, [9, 9, 30, 4])
    assert column(src.merge_append_only(old, new), "c") == [1, 2, 30, 4]
    assert column(src.merge_append_only(old.limit(0), new), "c") == [9, 9, 30, 4]
    both = old.withColumn("source", F.lit("b")).unionByName(new.withColumn("source", F.lit("a")))
    assert {r.source for r in src.prefer_source(both, {"a": 1, "b": 2}).collect()} == {"a"}


def test_bar_files_round_trip(spark, tmp_path):
    bars = tape(spark, [1, 2, 3]).unionByName(tape(spark, [5, 6], "B"))
    src.write_bar_files(bars, str(tmp_path / "out"), "now")
    files = spark.read.json(str(tmp_path / "out"))
    assert {r.pair for r in files.collect()} == {"AAA", "B"}
    back = src.read_bar_files(spark, str(tmp_path / "out" / "*.json")) if files.count() == 1 else spark.read.schema(src.FILE_SCHEMA).json(str(tmp_path / "out")).select(F.col("pair").alias("symbol"), "tf", F.inline("bars"))
    assert sorted((r.symbol, r.t, r.c) for r in back.collect()) == sorted((r.symbol, r.t, r.c) for r in bars.collect())


def test_chart_payload(spark):
    rows = [("X", "h1", [0, 3600, 3601, 7200, 10800, 3600], [1.0, 1.0, 1.0, None, 1.0, 2.0], [2.0] * 6, [0.5] * 6, [1.0, 1.0, 1.0, 1.0, 1.0, 1.5])]
    payload = spark.createDataFrame(rows, "symbol string, tf string, timestamps array<long>, open array<double>, high array<double>, low array<double>, close array<double>")
    got = src.normalise_chart(payload, now=10800).orderBy("t").collect()
    assert [(r.t, r.o, r.c, r.v) for r in got] == [(0, 1.0, 1.0, 0.0), (3600, 2.0, 1.5, 0.0)]


def test_feeds(spark):
    cot = spark.createDataFrame([("USD", 1, "2024-01-02", "10", "5", "3", "1", "2"), ("USD", 2, "2024-01-02", "11", "6", "3", "1", "2"), ("USD", 3, "bad", "1", "1", "1", "1", "1"), ("USD", 4, "2024-01-09", "x", "1", "1", "1", "1")], "currency string, seq int, report_date string, oi string, noncomm_long string, noncomm_short string, comm_long string, comm_short string")
    (r,) = src.cot_reports(cot).collect()
    assert (r.oi, r.noncomm_net) == (11.0, 3.0)
    one = spark.createDataFrame([(" CPI ", "usd", 5, "High", 1)], "title string, currency string, time long, impact string, seq int")
    two = spark.createDataFrame([("CPI", "USD", 5, "odd", 2), ("GDP", "eur", 9, "medium", 3)], "title string, currency string, time long, impact string, seq int")
    assert sorted(tuple(r) for r in src.calendar(one, two).collect()) == [("EUR", 9, "GDP", "medium"), ("USD", 5, "CPI", "low")]
    health = src.source_health(spark.createDataFrame([("h1", 50), ("h1", 60)], "tf string, success_at long"), spark.createDataFrame([("h1", 70), ("d1", 10)], "tf string, last_success long"))
    assert sorted(tuple(r) for r in health.collect()) == [("d1", 0, 10), ("h1", 2, 70)]


def test_lifecycle(spark):
    df = spark.createDataFrame([(25, 10, 0.8, -5.0), (12, 50, 0.95, -5.0), (12, 10, 0.95, -5.0), (5, 90, 0.1, -5.0), (30, 90, 1.2, 5.0)], "n int, d int, pf double, net double")
    got = [r[0] for r in df.select(ledger.retirement(F.col("n"), F.col("d"), F.col("pf"), F.col("net"))).collect()]
    assert got == ["retire_factor", "retire_loss", "probation", "active", "active"]
    sources = spark.createDataFrame([(1000, True), (1000, False), (None, True)], "last_success long, primary_ok boolean")
    assert [r.verdict for r in ledger.health(sources, 2000).collect()] == ["ok", "warn", "fail"]
    entries = spark.createDataFrame([("a", 1, 5), ("a", 2, 1), ("b", 1, 1)], "strategy_id string, registered_at long, retired_at long")
    assert sorted(tuple(r) for r in ledger.latest_entry(entries).collect()) == [("a", 2, 1), ("b", 1, 1)]
