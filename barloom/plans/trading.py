"""Queries over simulations, parameter search, recommendations, the ledger, quality gates and streams."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import conditions, grid, ledger, rolling, scanner
from barloom.operators import forecast as fc
from barloom.operators import signals as sg
from barloom.plans import analysis as an
from barloom.plans import sql
from barloom.plans import sql_trades as st
from barloom.plans.series import RSI14, query, shown
from barloom.sources import bars as src
from barloom.sources import scratch
from barloom.streaming import bars as stream

PIP = 1.0  # the tapes move in whole units
RULES = {
    "ma": [{"type": "maCross", "fast": 5, "slow": 20}],
    "donchian": [{"type": "donchianBreak", "period": 20}],
    "rsi": [{"type": "rsi", "comparison": "crossBelow"}, {"type": "bollinger"}],
}


RUNS = [grid.run("base", 15, 30), grid.run("trail", 15, 60, 10, close_on_opposite=True), grid.run("risk", 15, 30, mode="fixedRisk"), grid.run("night", 15, 30, None, "22:00", "06:00", mode="compound")]


def _simulated(spark, d, rules: str = "donchian", equity: bool = True) -> DataFrame:
    return bt.simulate(conditions.signals(src.event_bars(spark, d), RULES[rules]), grid.runs(spark, RUNS), PIP, equity)


_SIM = f"WITH RECURSIVE {sql.bars()}, {st.donchian('bars')}, {st.runs(RUNS)}, {st.simulated('sg')}"
_COMBINED = f"""WITH RECURSIVE {sql.bars()}, {sql.numbered()}, {RSI14}, y AS (SELECT *, {sql.frame('avg', 'c', 20)} AS mid, {sql.frame('stddev_pop', 'c', 20)} AS sd FROM x),
    sg AS (SELECT symbol, t, o, h, l, c, coalesce({sql.lag('rsi')} > 30 AND rsi <= 30 AND l <= mid - 2 * sd, false) AS long, coalesce({sql.lag('rsi')} < 70 AND rsi >= 70 AND h >= mid + 2 * sd, false) AS short FROM y), {st.runs(RUNS)}, {st.simulated('sg')}"""


@query("backtest_trades", f"{_SIM} SELECT * FROM trades")
def _(spark, d):
    return bt.trades_of(_simulated(spark, d)).drop("tf")


@query("backtest_equity", f"{_SIM} SELECT run_id, symbol, t, {', '.join(sql.r6(a, b) for a, b in (('eq_pips', 'equity_pips'), ('dd_pips', 'drawdown_pips'), ('eq_yen', 'equity_yen'), ('dd_yen', 'drawdown_yen'), ('dd_pct', 'drawdown_pct')))} FROM sim")
def _(spark, d):
    return shown(bt.equity_of(_simulated(spark, d)), "equity_pips", "drawdown_pips", "equity_yen", "drawdown_yen", "drawdown_pct", keys=("run_id", "symbol", "t"))


@query("backtest_metrics", f"{_SIM}, {st.METRICS} SELECT * FROM m")
def _(spark, d):
    return bt.metrics(_simulated(spark, d)).drop("tf")


@query("backtest_combined_rules", f"{_COMBINED}, {st.METRICS} SELECT * FROM m")
def _(spark, d):
    return bt.metrics(_simulated(spark, d, "rsi")).drop("tf")


# -- a table of results that SQL has too: orders as trades ---------------------------------

TRADES = """tr AS (SELECT o_orderstatus AS run_id, o_orderpriority AS symbol, o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS exit_time, floor(o_totalprice - 150000) AS net_yen, floor(o_totalprice / 1000 - 150) AS net_pips FROM orders)"""


def order_trades(spark, d) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(
        F.col("o_orderstatus").alias("run_id"), F.col("o_orderpriority").alias("symbol"), F.lit("d1").alias("tf"), F.lit("trade").alias("kind"), F.col("o_orderkey").alias("id"), src.unix_seconds("o_orderdate").alias("exit_time"),
        F.floor(F.col("o_totalprice") - 150000).cast("double").alias("net_yen"), F.floor(F.col("o_totalprice") / 1000 - 150).cast("double").alias("net_pips"), F.lit("stop_loss").alias("exit_reason"),
        *(F.lit(None).cast("double").alias(c) for c in ("drawdown_yen", "drawdown_pips", "drawdown_pct")),
    )


@query(
    "trade_metrics",
    f"""WITH {TRADES}, s AS (SELECT *, sign(net_yen) AS s, CASE WHEN sign(net_yen) = lag(sign(net_yen)) OVER (PARTITION BY run_id, symbol ORDER BY id) THEN 0 ELSE 1 END AS new FROM tr), i AS (SELECT *, sum(new) OVER (PARTITION BY run_id, symbol ORDER BY id) AS island FROM s),
    n AS (SELECT run_id, symbol, island, s, count(*) AS n FROM i GROUP BY ALL), k AS (SELECT run_id, symbol, coalesce(max(n) FILTER (s = 1), 0) AS max_wins, coalesce(max(n) FILTER (s = -1), 0) AS max_losses FROM n GROUP BY ALL),
    m AS (SELECT run_id, symbol, count(*) AS trades, count(*) FILTER (net_yen > 0) AS wins, count(*) FILTER (net_yen < 0) AS losses, sum(net_yen) AS net_yen, coalesce(sum(net_yen) FILTER (net_yen > 0), 0) AS gp, coalesce(sum(net_yen) FILTER (net_yen < 0), 0) AS gl FROM tr GROUP BY ALL)
    SELECT run_id, symbol, trades, wins, losses, net_yen, round(100.0 * wins / trades, 6) AS win_rate, round(CASE WHEN gl = 0 THEN NULL ELSE gp / abs(gl) END, 6) AS profit_factor,
        floor(CASE WHEN wins > 0 THEN gp / wins ELSE 0 END + 0.5) AS average_win_yen, CAST(max_wins AS BIGINT) AS max_wins, CAST(max_losses AS BIGINT) AS max_losses FROM m JOIN k USING (run_id, symbol)""",
)
def _(spark, d):
    m = bt.metrics(order_trades(spark, d))
    factor = F.when(F.col("profit_factor") < float("inf"), F.round("profit_factor", 6))
    return m.select("run_id", "symbol", "trades", "wins", "losses", "net_yen", F.round("win_rate", 6).alias("win_rate"), factor.alias("profit_factor"), F.col("average_win_yen").cast("double").alias("average_win_yen"), "max_wins", "max_losses")


# -- search ---------------------------------------------------------------------------------


GRID = grid.combinations(grid.values(10, 20, 5), grid.values(20, 40, 10), [None, 8.0])
#: The tapes jump by tens of units, so only wide stops of long positions survive: some runs pass the gates, most do not.
WIDE_GRID = [r | {"directions": "long" if r["stop_pips"] > 100 else "long,short"} for r in grid.combinations([20.0, 300.0, 500.0], [20.0, 40.0], [None, 8.0])]
_SEARCH = f"WITH RECURSIVE {sql.bars()}, {st.donchian('bars')}, {st.runs(GRID)}, {st.simulated('sg')}, {st.METRICS}"
#: Table gd: results of both segments of the tables m, with the reasons to reject them.
GATES = """sm AS (SELECT * REPLACE (split_part(symbol, '/', 1) AS symbol), split_part(symbol, '/', 2) AS segment FROM m), op AS (SELECT * FROM sm WHERE segment = 'opt'), va AS (SELECT * FROM sm WHERE segment = 'val'),
    ga AS (SELECT run_id, symbol, coalesce(op.net_yen, 0.0) AS opt_net_yen, coalesce(va.net_yen, 0.0) AS val_net_yen, coalesce(op.profit_factor, 0) AS opt_profit_factor, coalesce(op.max_drawdown_yen, 0) AS opt_max_drawdown_yen, coalesce(va.trades, 0) AS val_trades, coalesce(op.max_drawdown_pct, 0) AS od, coalesce(va.max_drawdown_pct, 0) AS vd FROM op FULL JOIN va USING (run_id, symbol)),
    gb AS (SELECT *, CASE WHEN opt_net_yen > 0 THEN val_net_yen / opt_net_yen WHEN val_net_yen >= opt_net_yen THEN 1.0 ELSE 0.0 END AS ratio FROM ga),
    gc AS (SELECT *, CASE WHEN opt_net_yen <= 0 THEN false ELSE ratio < 0.35 OR vd > 2 * od + 5 END AS overfit FROM gb),
    gd AS (SELECT *, list_filter([CASE WHEN opt_net_yen <= 0 THEN 'opt_net' END, CASE WHEN val_net_yen <= 0 THEN 'val_net' END, CASE WHEN val_trades < 10 THEN 'val_trades' END, CASE WHEN overfit THEN 'overfit' END, CASE WHEN ratio < 0.35 THEN 'ratio' END], lambda x: x IS NOT NULL) AS reasons FROM gc)"""
# segments are part of the series key, so nothing looks across them
_SEGMENTS = f"""WITH RECURSIVE {sql.bars()}, hs AS (SELECT * REPLACE (symbol || '/' || CASE WHEN row_number() {sql.S} <= floor(count(*) OVER (PARTITION BY symbol) * CAST(0.7 AS DOUBLE)) THEN 'opt' ELSE 'val' END AS symbol) FROM bars), {st.crosses('hs')}, {st.runs(WIDE_GRID)}, {st.simulated('sg')}, {st.METRICS},
    {GATES}, gates AS (SELECT *, len(reasons) = 0 AS eligible FROM gd)"""
_QUARTERS = f"""WITH RECURSIVE {sql.bars()}, sp AS (SELECT *, min(t) OVER (PARTITION BY symbol) AS a, max(t) OVER (PARTITION BY symbol) AS z FROM bars), hs AS (SELECT symbol || '/' || CAST(CASE WHEN z > a THEN least(3, floor(4.0 * (t - a) / (z - a))) ELSE 0 END AS INT) AS symbol, t, o, h, l, c FROM sp), {st.crosses('hs')}, {st.runs(WIDE_GRID)}, {st.simulated('sg')}, {st.METRICS}"""


def _grid(spark) -> DataFrame:
    return grid.runs(spark, GRID)


@query("grid_search", f"{_SEARCH} SELECT run_id, symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY net_yen DESC, max_drawdown_yen, run_id) AS INT) AS rank, trades, net_yen, max_drawdown_yen FROM m")
def _(spark, d):
    return grid.search(src.event_bars(spark, d), RULES["donchian"], _grid(spark), PIP).select("run_id", "symbol", "rank", "trades", "net_yen", "max_drawdown_yen")


def _gates(spark, d) -> DataFrame:
    bars = grid.by_segment(grid.hold_out(src.event_bars(spark, d)), "segment")
    return grid.gated(bt.metrics(bt.simulate(conditions.signals(bars, RULES["ma"]), grid.runs(spark, WIDE_GRID), PIP, equity=False)))


query("holdout_gates", f"{_SEGMENTS} SELECT run_id, symbol, opt_net_yen, val_net_yen, round(ratio, 6) AS ratio, overfit, array_to_string(reasons, ',') AS reasons, eligible FROM gates")(lambda spark, d: _gates(spark, d).select("run_id", "symbol", "opt_net_yen", "val_net_yen", F.round("ratio", 6).alias("ratio"), "overfit", F.concat_ws(",", "reasons").alias("reasons"), "eligible"))
query("selected_parameters", f"{_SEGMENTS}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY opt_net_yen DESC, opt_max_drawdown_yen, run_id) AS opt_rank FROM gates WHERE opt_profit_factor >= 1) SELECT run_id, symbol, CAST(opt_rank AS INT) AS opt_rank, opt_net_yen, val_net_yen FROM rk WHERE eligible QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY opt_rank) = 1")(lambda spark, d: grid.selected(_gates(spark, d)).select("run_id", "symbol", "opt_rank", "opt_net_yen", "val_net_yen"))
query("rejection_summary", f"{_SEGMENTS}, u AS (SELECT symbol, unnest(reasons) AS reason FROM gates) SELECT symbol, reason, count(*) AS n FROM u GROUP BY ALL")(lambda spark, d: grid.rejection_summary(_gates(spark, d)).drop("tf"))
query("tuning_report", f"{_SEGMENTS} SELECT symbol, count(*) AS combinations, count(*) FILTER (eligible) AS eligible, {sql.r6('avg(ratio)', 'mean_ratio')}, {sql.r6('max(ratio)', 'best_ratio')} FROM gates GROUP BY 1")(lambda spark, d: shown(grid.report(_gates(spark, d)), "mean_ratio", "best_ratio", keys=("symbol", "combinations", "eligible")))


@query("quarterly_stability", f"{_QUARTERS} SELECT run_id, split_part(symbol, '/', 1) AS symbol, count(*) FILTER (net_yen > 0) AS positive_quarters, count(*) FILTER (net_yen > 0) >= 3 AS stable FROM m GROUP BY 1, 2")
def _(spark, d):
    bars = grid.by_segment(grid.quarters(src.event_bars(spark, d)), "quarter")
    return grid.stable(bt.metrics(bt.simulate(conditions.signals(bars, RULES["ma"]), grid.runs(spark, WIDE_GRID), PIP, equity=False))).drop("tf")


query("holdout_split", f"WITH {sql.bars()}, x AS (SELECT symbol, t, CASE WHEN row_number() {sql.S} <= floor(count(*) OVER (PARTITION BY symbol) * CAST(0.7 AS DOUBLE)) THEN 'opt' ELSE 'val' END AS segment FROM bars) SELECT symbol, segment, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM x GROUP BY 1, 2")(
    lambda spark, d: grid.hold_out(src.event_bars(spark, d)).groupBy("symbol", "segment").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
)
query(
    "quarter_segments",
    f"WITH {sql.bars()}, x AS (SELECT symbol, t, min(t) OVER (PARTITION BY symbol) AS a, max(t) OVER (PARTITION BY symbol) AS z FROM bars) SELECT symbol, CAST(CASE WHEN z > a THEN least(3, floor(4.0 * (t - a) / (z - a))) ELSE 0 END AS INT) AS quarter, count(*) AS n FROM x GROUP BY 1, 2",
)(lambda spark, d: grid.quarters(src.event_bars(spark, d)).groupBy("symbol", "quarter").agg(F.count("*").alias("n")))

# -- recommendations --------------------------------------------------------------------------


def _retrained(horizon: int, decisions: str = "d1") -> str:
    """Table cal: weights, mixed and calibrated probability and accuracy of every decision (symbol, i), each fitted on the outcomes known by then."""
    mix = lambda p: f"greatest(0.02, least(0.98, {p}p_signal * w_signal + {p}p_drift * w_drift + {p}p_regime * w_regime))"
    few = "n < 30"
    return f"""sm AS (SELECT d.symbol, d.i AS di, p.i AS j, p_signal, p_drift, p_regime, up, pow(0.5, (d.i - {horizon} - p.i) / 100.0) AS d FROM {decisions} d JOIN pb p ON p.symbol = d.symbol AND p.horizon = {horizon} AND p.i > 80 AND p.i + {horizon} <= d.i),
    ac AS (SELECT symbol, di, count(*) AS n, {', '.join(f"sum(CASE WHEN (p_{m} >= 0.5) = up THEN d ELSE 0 END) / sum(d) AS a_{m}" for m in fc.MODELS)} FROM sm GROUP BY 1, 2),
    ad AS (SELECT d.symbol, d.i AS di, coalesce(n, 0) AS n, {', '.join(f'a_{m}, ln({p}) + (a_{m} - 0.5) / 0.08 AS l_{m}' for m, p in fc.PRIOR.items())} FROM {decisions} d LEFT JOIN ac ON ac.symbol = d.symbol AND ac.di = d.i),
    ae AS (SELECT *, {', '.join(f'exp(l_{m} - greatest(l_signal, l_drift, l_regime)) AS e_{m}' for m in fc.MODELS)} FROM ad),
    aw AS (SELECT symbol, di, n, a_signal, a_drift, a_regime, {', '.join(f"CASE WHEN {few} THEN {p} ELSE e_{m} / (e_signal + e_drift + e_regime) END AS w_{m}" for m, p in fc.PRIOR.items())} FROM ae),
    kb AS (SELECT symbol, di, {mix('')} AS p_up, up FROM sm JOIN aw USING (symbol, di)),
    ct AS (SELECT symbol, di, CAST(least(9, floor(p_up * 10)) AS INT) AS bin, count(*) AS n, count(*) FILTER (up) AS positives, avg(p_up) AS a FROM kb GROUP BY 1, 2, 3),
    dm AS (SELECT symbol, di, CAST(unnest(range(10)) AS INT) AS bin FROM aw),
    cu AS (SELECT symbol, di, bin, coalesce(a, (bin + 0.5) / 10) AS x, CASE WHEN n > 0 THEN (positives + 1) / (n + 2.0) ELSE (bin + 0.5) / 10 END AS v, greatest(CAST(coalesce(n, 0) AS DOUBLE), 0.001) AS w FROM dm LEFT JOIN ct USING (symbol, di, bin)),
    mn AS (SELECT l.symbol, l.di, l.bin AS i, r.bin AS j, sum(m.v * m.w) / sum(m.w) AS y FROM cu l JOIN cu r ON r.symbol = l.symbol AND r.di = l.di AND r.bin >= l.bin JOIN cu m ON m.symbol = l.symbol AND m.di = l.di AND m.bin BETWEEN l.bin AND r.bin GROUP BY ALL),
    lw AS (SELECT c.symbol, c.di, c.bin, mn.i, min(mn.y) AS y FROM cu c JOIN mn ON mn.symbol = c.symbol AND mn.di = c.di AND mn.i <= c.bin AND mn.j >= c.bin GROUP BY ALL),
    iso AS (SELECT lw.symbol, lw.di, lw.bin, any_value(cu.x) AS x, greatest(0.01, least(0.99, max(lw.y))) AS y FROM lw JOIN cu USING (symbol, di, bin) GROUP BY ALL),
    pt AS (SELECT symbol, di, list({{'x': x, 'y': y}} ORDER BY x, y) AS pts FROM iso GROUP BY 1, 2),
    cm AS (SELECT aw.*, p.t, {mix('p.')} AS p_up FROM aw JOIN pb p ON p.symbol = aw.symbol AND p.i = aw.di AND p.horizon = {horizon}),
    ca AS (SELECT cm.*, list_filter(pts, lambda q: q.x <= p_up)[-1] AS lo, list_filter(pts, lambda q: q.x >= p_up)[1] AS hi FROM cm JOIN pt USING (symbol, di)),
    cal AS (SELECT *, CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL THEN lo.y ELSE greatest(0.01, least(0.99, lo.y + (hi.y - lo.y) * (p_up - lo.x) / greatest(hi.x - lo.x, 1e-6))) END AS p_calibrated,
        CASE WHEN n > 0 THEN greatest(0, least(1, (a_signal * w_signal + a_drift * w_drift + a_regime * w_regime) / (w_signal + w_drift + w_regime))) END AS accuracy FROM ca)"""


def _style_sql(style: str) -> str:
    """Table r_<style>: the recommendations of a style; the fragments of single operators, over slices of bars."""
    s = scanner.STYLES[style]
    seconds, wide = src.SECONDS[s.main], src.SECONDS[s.wide]
    tape = lambda text, seconds: sql.swapped(text, sql.bars(), sql.deal(seconds))
    sliced = lambda text, source: sql.swapped(text, sql.bars(), f"bars AS (SELECT symbol, t, o, h, l, c FROM {source})")
    env = f"WITH RECURSIVE {sql.deal(wide)}, {sql.numbered()}, {an.votes(an.NOFLAT)} SELECT symbol, i, t + {wide} AS closed, score FROM z"
    piece = lambda n: f"SELECT d.symbol || '/' || d.t AS symbol, b.t, b.o, b.h, b.l, b.c FROM d1 d JOIN b ON b.symbol = d.symbol AND b.i BETWEEN d.i - {n - 1} AND d.i"
    swings = f"WITH bars AS (SELECT * FROM s160), {an.PIVOTS.format('bars')} SELECT symbol, t, pivot_high, pivot_low FROM piv WHERE pivot_high IS NOT NULL OR pivot_low IS NOT NULL"
    levels = sliced(an._LV, "s240") + " SELECT symbol, price FROM levels WHERE place <= 12"
    full = tape(f"{an.HEAD}{an.votes(an.NOFLAT)}, {an.STATS}, {an.PROB}", seconds)
    return f"""r_{style} AS ({full}, env AS ({env}),
    d0 AS (SELECT symbol, t, i, c, score, greatest(-1, least(1, score / CAST(greatest(4, most) AS DOUBLE))) AS ratio, s20, atr_latest AS atr FROM z QUALIFY row_number() OVER (PARTITION BY symbol, t // 86400 ORDER BY t DESC) = 1),
    d1 AS (SELECT d0.*, sign(d0.score) AS sg, CASE WHEN e.score = 0 THEN 'neutral' WHEN sign(e.score) = sign(d0.score) THEN 'aligned' ELSE 'diverged' END AS status FROM d0 ASOF JOIN env e ON e.symbol = d0.symbol AND d0.t >= e.closed WHERE d0.i >= 50 AND e.i >= 2 AND d0.score <> 0 AND atr > 0),
    {_retrained(s.horizon)},
    d2 AS (SELECT *, symbol || '/' || t AS id, CASE WHEN abs(score) >= 3 AND status <> 'diverged' AND abs(c - s20) <= 1.1 * atr THEN 'market' ELSE 'pullback' END AS entry_type FROM d1),
    d3 AS (SELECT *, CASE WHEN entry_type = 'market' THEN c WHEN sg > 0 THEN least(c, coalesce(s20, c)) ELSE greatest(c, coalesce(s20, c)) END AS entry FROM d2),
    s120 AS ({piece(120)}), s160 AS ({piece(160)}), s240 AS ({piece(240)}),
    ch AS ({sliced(an.ORACLES['chart_patterns'], 's120')}), cp AS ({tape(an.ORACLES['candle_patterns'], seconds)}), fs AS ({swings}), le AS ({levels}),
    pa AS (SELECT d.id, b.i, ch.direction, ch.strength FROM d1 JOIN d3 d USING (symbol, t) JOIN ch ON ch.symbol = d.id JOIN b ON b.symbol = d.symbol AND b.t = ch.t WHERE b.i >= d.i - 5
        UNION ALL SELECT d.id, b.i, cp.direction, cp.strength FROM d3 d JOIN b ON b.symbol = d.symbol AND b.i BETWEEN d.i - 5 AND d.i JOIN cp ON cp.symbol = b.symbol AND cp.t = b.t WHERE cp.direction <> 'neutral'),
    pb2 AS (SELECT id, direction, arg_max(strength, i * 10 + strength) AS strength FROM pa GROUP BY 1, 2), pc AS (SELECT id, max(strength) FILTER (direction = 'bullish') AS bull, max(strength) FILTER (direction = 'bearish') AS bear FROM pb2 GROUP BY 1),
    lv2 AS (SELECT d.id, max(price) FILTER (price < entry) AS below, min(price) FILTER (price > entry) AS above FROM d3 d JOIN le ON le.symbol = d.id GROUP BY 1),
    fb AS (SELECT d.id, arg_max(pivot_low, fs.t) FILTER (pivot_low < entry) AS below, arg_max(pivot_high, fs.t) FILTER (pivot_high > entry) AS above FROM d3 d JOIN fs ON fs.symbol = d.id GROUP BY 1),
    d4 AS (SELECT d.*, coalesce(lv2.below, fb.below) AS below, coalesce(lv2.above, fb.above) AS above, CASE WHEN sg > 0 THEN bull ELSE bear END AS own, CASE WHEN sg > 0 THEN bear ELSE bull END AS contrary, CASE WHEN sg > 0 THEN cal.p_calibrated ELSE 1 - cal.p_calibrated END AS p, cal.accuracy
        FROM d3 d LEFT JOIN pc ON pc.id = d.id LEFT JOIN lv2 ON lv2.id = d.id LEFT JOIN fb ON fb.id = d.id LEFT JOIN cal ON cal.symbol = d.symbol AND cal.di = d.i),
    d5 AS (SELECT *, round(greatest(0, least(100, 56.0 * abs(ratio) + CASE status WHEN 'aligned' THEN 22.0 WHEN 'neutral' THEN 6.0 ELSE -18.0 END + CASE WHEN own IS NOT NULL THEN 5.0 * own WHEN contrary IS NOT NULL THEN -8.0 ELSE 0 END
        + coalesce(16.0 * greatest(-1, least(1, 2 * (p - 0.5))), 0))), 1) AS total FROM d4),
    d6 AS (SELECT *, coalesce(total >= 58, false) AS a1, coalesce(p >= 0.54, false) AS a2, status = 'aligned' AS a3, coalesce(accuracy >= 0.51, false) AS a4, CASE WHEN sg > 0 THEN below ELSE above END AS guard, CASE WHEN sg > 0 THEN above ELSE below END AS goal FROM d5 WHERE total >= 48),
    d7 AS (SELECT *, CASE WHEN total >= 70 AND coalesce(p >= 0.57, false) AND coalesce(accuracy >= 0.52, false) AND a3 THEN 'high' WHEN CAST(a1 AS INT) + CAST(a2 AS INT) + CAST(a3 AS INT) + CAST(a4 AS INT) >= 2 AND (a1 OR a2) THEN 'medium' ELSE 'low' END AS tier,
        greatest(1.5 * atr, coalesce(greatest(sg * (entry - guard), 0) + 0.3 * atr, 0)) AS risk, least(coalesce(greatest(sg * (goal - entry), 0), 3 * atr), 3 * atr) AS gain, greatest(0.25 * atr, 0.00008 * abs(c), 0.00001) AS half, CAST(make_timestamp(CAST(t * 1000000 AS BIGINT)) AS DATE) AS dd FROM d6),
    d8 AS (SELECT *, CASE WHEN isodow(dd) > 5 THEN isodow(dd) - 5 ELSE 0 END AS back, least(isodow(dd), 5) - 1 AS wd FROM d7)
    SELECT symbol, '{style}' AS style, t, CASE WHEN sg > 0 THEN 'buy' ELSE 'sell' END AS direction, total, tier, status, entry_type, entry, CASE WHEN entry_type = 'pullback' THEN entry - half END AS zone_low, CASE WHEN entry_type = 'pullback' THEN entry + half END AS zone_high,
        entry - sg * risk AS stop, entry + sg * gain AS target, round(gain / risk, 2) AS reward, CAST(t + ({s.weekdays} + 2 * ((wd + {s.weekdays}) // 5) - back) * 86400 AS BIGINT) AS deadline FROM d8 WHERE gain > 0 AND gain / risk >= 1.2)"""


_REC = f"WITH RECURSIVE {_style_sql('daytrade')}, {_style_sql('swing')}, recs AS (SELECT * FROM r_daytrade UNION ALL SELECT * FROM r_swing)"
_LATER = f"""{', '.join(sql.deal(src.SECONDS[x.main], f'b_{k}') for k, x in scanner.STYLES.items())}, later AS (SELECT *, 'daytrade' AS style FROM b_daytrade UNION ALL SELECT *, 'swing' FROM b_swing), newest AS (SELECT symbol, style, max(t) AS newest FROM later GROUP BY 1, 2),
    pr0 AS (SELECT r.*, n.newest, b.t AS bt, b.o, b.h, b.l, b.c, CASE WHEN direction = 'buy' THEN 1.0 ELSE -1.0 END AS sg FROM recs r JOIN newest n USING (symbol, style) JOIN later b ON b.symbol = r.symbol AND b.style = r.style AND b.t > r.t AND b.t <= r.deadline),
    pr1 AS (SELECT *, min(CASE WHEN entry_type = 'market' OR (l <= zone_high AND h >= zone_low) THEN bt END) OVER (PARTITION BY symbol, style, t) AS fill_t FROM pr0),
    pr2 AS (SELECT *, max(CASE WHEN bt = fill_t THEN CASE WHEN entry_type = 'market' THEN o ELSE greatest(l, least(h, entry)) END + sg * 0.5 END) OVER (PARTITION BY symbol, style, t) AS price FROM pr1),
    oc0 AS (SELECT symbol, style, t, direction, tier, stop, target, deadline, newest, sg, any_value(fill_t) AS fill_t, any_value(price) AS price, min(bt) FILTER (bt >= fill_t AND CASE WHEN sg > 0 THEN l <= stop ELSE h >= stop END) AS stop_t,
        min(bt) FILTER (bt >= fill_t AND (entry_type = 'market' OR bt > fill_t) AND CASE WHEN sg > 0 THEN h >= target ELSE l <= target END) AS target_t, max(bt) AS last_t, arg_max(c, bt) AS last_c FROM pr2 GROUP BY symbol, style, t, direction, tier, stop, target, deadline, newest, sg),
    oc1 AS (SELECT *, CASE WHEN fill_t IS NULL THEN 'unfilled' WHEN stop_t IS NOT NULL AND (target_t IS NULL OR stop_t <= target_t) THEN 'stop' WHEN target_t IS NOT NULL THEN 'target' ELSE 'deadline' END AS exit_reason FROM oc0),
    oc2 AS (SELECT *, CASE exit_reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE last_c END AS leave, sg * (price - stop) AS risk, CASE exit_reason WHEN 'stop' THEN stop_t WHEN 'target' THEN target_t WHEN 'deadline' THEN last_t END AS exit_t FROM oc1 WHERE exit_reason IN ('stop', 'target') OR newest >= deadline),
    oc3 AS (SELECT *, CASE WHEN exit_reason <> 'unfilled' THEN coalesce(round(CASE WHEN risk > 0 THEN sg * (leave - price) / risk END, 6), 0) END AS r FROM oc2),
    outcomes AS (SELECT *, CASE exit_reason WHEN 'unfilled' THEN 'unfilled' WHEN 'stop' THEN 'loss' WHEN 'target' THEN 'win' ELSE CASE WHEN risk <= 0 OR r < 0 THEN 'loss' WHEN r > 0 THEN 'win' ELSE 'draw' END END AS outcome FROM oc3)"""
_CELLS = """cx AS (SELECT *, 'symbol_style' AS cell, symbol || '/' || style AS name FROM outcomes WHERE exit_reason <> 'unfilled' UNION ALL SELECT *, 'style_tier', style || '/' || tier FROM outcomes WHERE exit_reason <> 'unfilled'),
    cd AS (SELECT *, pow(0.5, (row_number() OVER (PARTITION BY cell, name ORDER BY fill_t DESC, exit_t DESC, symbol DESC, t DESC) - 1) / 30.0) AS d FROM cx),
    ce AS (SELECT cell, name, count(*) AS n, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'draw') AS draws, avg(r) AS mean_r, sum(d) AS decayed_n, sum(CASE WHEN outcome = 'win' THEN d ELSE 0 END) / sum(d) AS ewa_win_rate, sum(r * d) / sum(d) AS ewa_mean_r FROM cd GROUP BY 1, 2),
    cf AS (SELECT cell, name FROM ce UNION SELECT 'symbol_style', symbol || '/' || s FROM (SELECT DISTINCT symbol FROM later), (SELECT unnest(['daytrade', 'swing']) AS s) UNION SELECT 'style_tier', s || '/' || t FROM (SELECT unnest(['daytrade', 'swing']) AS s), (SELECT unnest(['high', 'medium', 'low']) AS t)),
    stats AS (SELECT cf.cell, cf.name, coalesce(n, 0) AS n, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(draws, 0) AS draws, mean_r, decayed_n, ewa_win_rate, ewa_mean_r, CASE WHEN n > 0 THEN wins / CAST(n AS DOUBLE) END AS win_rate FROM cf LEFT JOIN ce ON ce.cell = cf.cell AND ce.name = cf.name)"""
_MONTHS = """mo AS (SELECT *, date_trunc('month', make_timestamp(CAST(exit_t * 1000000 AS BIGINT))) AS m FROM outcomes WHERE exit_reason <> 'unfilled'), ms AS (SELECT date_trunc('month', make_timestamp(CAST(min(t) * 1000000 AS BIGINT))) AS a, date_trunc('month', make_timestamp(CAST(max(t) * 1000000 AS BIGINT))) AS z FROM later),
    mp AS (SELECT unnest(generate_series(CAST(greatest(a, z - INTERVAL 11 MONTH) AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM ms WHERE z IS NOT NULL),
    mg AS (SELECT m, count(*) AS trades, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'draw') AS draws, sum(ln(greatest(1 + 0.01 * r, 1e-9))) AS growth FROM mo WHERE tier IN ('high', 'medium') GROUP BY 1),
    mb AS (SELECT mp.m, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(draws, 0) AS draws, 1000000 * exp(sum(coalesce(growth, 0)) OVER (ORDER BY mp.m)) AS e FROM mp LEFT JOIN mg ON mg.m = mp.m),
    months AS (SELECT strftime(m, '%Y-%m') AS month, trades, wins, losses, draws, CAST(floor(e - coalesce(lag(e) OVER (ORDER BY m), 1000000) + 0.5) AS BIGINT) AS pnl, CAST(floor(e + 0.5) AS BIGINT) AS end_balance FROM mb)"""


def _scored(spark, d) -> DataFrame:
    """Bars of all timeframes over the tape of single orders, scored once for both styles."""
    frames = sorted({tf for s in scanner.STYLES.values() for tf in (s.main, s.wide)})
    return scratch.settled(scanner.scores(reduce(DataFrame.unionByName, (src.deal_bars(spark, d, tf) for tf in frames))))


def _recommended(scored: DataFrame) -> DataFrame:
    """Both styles; the last bar of every UTC day decides, statistics are fitted anew each time."""
    found = []
    for name, s in scanner.STYLES.items():
        main, wide = (scored.where(F.col("tf") == tf) for tf in (s.main, s.wide))
        found.append(scanner.scan(main, wide, name, decisions=scanner.last_bars_of_days(main.select("symbol", "tf", "t")), retrain=True, scored=scored))
    return reduce(DataFrame.unionByName, found)


_RS = ("w_signal", "w_drift", "w_regime", "p_up", "p_calibrated", "accuracy")


@query(
    "rolling_adaptive_stats",
    f"""{sql.swapped(f"{an.HEAD}{an.votes(an.NOFLAT)}, {an.STATS}, {an.PROB}", sql.bars(), sql.deal())}, dd AS (SELECT symbol, t, i FROM b QUALIFY row_number() OVER (PARTITION BY symbol, t // 86400 ORDER BY t DESC) = 1),
    {_retrained(5, "dd")} SELECT symbol, t, n AS samples, {", ".join(sql.r6(x, x) for x in _RS)} FROM cal""",
)
def _(spark, d):
    """Weights, calibrated forecast and accuracy at the last bar of every day, each from what was known then."""
    bars = src.deal_bars(spark, d)
    found = rolling.retrained(bars, 5, scanner.last_bars_of_days(bars))
    return shown(found.withColumn("samples", F.col("samples").cast("long")), *_RS, keys=("symbol", "t", "samples"))


_RC = ", ".join(sql.r6(x, x) for x in ("total", "entry", "zone_low", "zone_high", "stop", "target", "reward"))
query("recommendations", f"{_REC} SELECT symbol, style, t, direction, tier, status, entry_type, deadline, {_RC} FROM recs")(
    lambda spark, d: shown(_recommended(_scored(spark, d)), "total", "entry", "zone_low", "zone_high", "stop", "target", "reward", keys=("symbol", "style", "t", "direction", "tier", "status", "entry_type", "deadline"))
)
query("best_recommendations", f"{_REC} SELECT t, CAST(row_number() OVER (PARTITION BY t ORDER BY total DESC, symbol, style) AS INT) AS rank, symbol, direction, {sql.r6('total', 'total')} FROM recs QUALIFY rank <= 3")(
    lambda spark, d: shown(scanner.best(_recommended(_scored(spark, d))), "total", keys=("t", "rank", "symbol", "direction"))
)


def _outcomes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Outcomes, written once for the aggregates that read them several times, and the bars that decide and settle: those of every style's main timeframe."""
    scored = _scored(spark, d)
    traded = scored.where(F.col("tf").isin(*(s.main for s in scanner.STYLES.values()))).select("symbol", "tf", "t", *"ohlc")
    return scratch.settled(scanner.outcomes(_recommended(scored), traded, 0.5)), traded


def _months(found: DataFrame, traded: DataFrame) -> DataFrame:
    return scanner.monthly(found, bars=traded)


query("recommendation_outcomes", f"{_REC}, {_LATER} SELECT symbol, style, t, direction, tier, outcome, exit_reason, CAST(fill_t AS DOUBLE) AS fill_t, CAST(exit_t AS DOUBLE) AS exit_t, {sql.r6('price', 'price')}, {sql.r6('r', 'r')} FROM outcomes")(
    lambda spark, d: shown(_outcomes(spark, d)[0].withColumns({x: F.col(x).cast("double") for x in ("fill_t", "exit_t")}), "price", "r", keys=("symbol", "style", "t", "direction", "tier", "outcome", "exit_reason", "fill_t", "exit_t"))
)
_SC = ("mean_r", "decayed_n", "ewa_win_rate", "ewa_mean_r", "win_rate")
query("scanner_statistics", f"{_REC}, {_LATER}, {_CELLS} SELECT cell, name, n, wins, losses, draws, {', '.join(sql.r6(x, x) for x in _SC)} FROM stats")(
    lambda spark, d: shown(scanner.statistics(*_outcomes(spark, d)), *_SC, keys=("cell", "name", "n", "wins", "losses", "draws"))
)
query("scanner_monthly", f"{_REC}, {_LATER}, {_MONTHS} SELECT * FROM months")(lambda spark, d: _months(*_outcomes(spark, d)))
query(
    "scanner_monthly_summary",
    f"""{_REC}, {_LATER}, {_MONTHS} SELECT min(month) AS first_month, max(month) AS last_month, count(*) FILTER (trades > 0) AS active_months, CASE WHEN count(*) FILTER (trades > 0) > 0 THEN round(count(*) FILTER (trades > 0 AND pnl > 0) / CAST(count(*) FILTER (trades > 0) AS DOUBLE), 4) END AS plus_share,
    max(pnl) FILTER (trades > 0) AS best_pnl, min(pnl) FILTER (trades > 0) AS worst_pnl, CAST(CASE WHEN count(*) FILTER (trades > 0) > 0 THEN floor(sum(pnl) / count(*) FILTER (trades > 0) + 0.5) ELSE 0 END AS BIGINT) AS mean_pnl, CAST(sum(pnl) AS BIGINT) AS total_pnl FROM months""",
)(lambda spark, d: scanner.monthly_summary(_months(*_outcomes(spark, d))))
query("last_bars_of_days", f"WITH {sql.bars()}, x AS (SELECT symbol, t, c FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, t // 86400 ORDER BY t DESC) = 1) SELECT symbol, t, {sql.r6('c', 'c')} FROM x QUALIFY (row_number() {sql.S} - 1) % 3 = 0")(
    lambda spark, d: shown(scanner.last_bars_of_days(src.event_bars(spark, d), 3), "c")
)
query(
    "business_days",
    """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), y AS (SELECT day, (isodow(day) - 1) AS w FROM x), z AS (SELECT day, CAST(CASE WHEN w > 4 THEN day - CAST(w - 4 AS INT) ELSE day END AS DATE) AS f, least(w, 4) AS w FROM y)
    SELECT CAST(day AS VARCHAR) AS day, CAST(CAST(f + CAST(5 + 2 * ((w + 5) // 5) AS INT) AS DATE) AS VARCHAR) AS later FROM z""",
)(lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct().select(F.col("day").cast("string").alias("day"), scanner.add_business_days(F.col("day"), 5).cast("string").alias("later")))

# -- ledger ----------------------------------------------------------------------------------------

DAYS = f"""{TRADES}, {sql.ORDER_BARS}, dy AS (SELECT DISTINCT symbol, t // 86400 AS day FROM bars), sp AS (SELECT symbol, day FROM dy QUALIFY day < max(day) OVER (PARTITION BY symbol)), ids AS (SELECT DISTINCT run_id, symbol FROM tr),
    dn AS (SELECT run_id, symbol, exit_time // 86400 AS day, count(*) AS trades, sum(net_pips) AS net_pips, sum(net_yen) AS net_yen FROM tr GROUP BY 1, 2, 3),
    days AS (SELECT ids.run_id, ids.symbol, sp.day, coalesce(trades, 0) AS trades, coalesce(net_pips, 0) AS net_pips, coalesce(net_yen, 0) AS net_yen FROM ids JOIN sp USING (symbol) LEFT JOIN dn ON dn.run_id = ids.run_id AND dn.symbol = ids.symbol AND dn.day = sp.day)"""


def _days(spark, d) -> DataFrame:
    return ledger.confirmed_days(order_trades(spark, d), src.order_bars(spark, d))


query("ledger_days", f"WITH {DAYS} SELECT * FROM days")(lambda spark, d: _days(spark, d).drop("tf"))
_RUN = "OVER (PARTITION BY run_id, symbol ORDER BY day)"
query("ledger_equity", f"WITH {DAYS}, e AS (SELECT *, 1000000 + sum(net_yen) {_RUN} AS balance FROM days) SELECT run_id, symbol, day, balance, greatest(1000000, max(balance) {_RUN}) - balance AS drawdown_yen FROM e")(
    lambda spark, d: ledger.equity(_days(spark, d)).select("run_id", "symbol", "day", "balance", "drawdown_yen")
)
query(
    "ledger_monthly",
    f"""WITH {DAYS}, m AS (SELECT *, strftime(make_timestamp(CAST(day * 86400000000 AS BIGINT)), '%Y-%m') AS month FROM days), g AS (SELECT month, run_id, sum(net_yen) AS net_yen, sum(net_pips) AS net_pips, CAST(sum(trades) AS BIGINT) AS trades, count(DISTINCT day) AS days FROM m GROUP BY GROUPING SETS ((month), (month, run_id)))
    SELECT *, month < (SELECT max(month) FROM m) AS complete FROM g""",
)(lambda spark, d: ledger.monthly(_days(spark, d)))
query(
    "ledger_report",
    f"""WITH {DAYS}, t AS (SELECT run_id, symbol, count(*) AS trades, sum(CASE WHEN net_yen > 0 THEN net_yen ELSE 0 END) AS gain, sum(CASE WHEN net_yen < 0 THEN net_yen ELSE 0 END) AS loss FROM tr GROUP BY 1, 2), s AS (SELECT run_id, symbol, count(*) AS days, sum(net_yen) AS net_yen FROM days GROUP BY 1, 2),
    b AS (SELECT s.*, coalesce(trades, 0) AS trades, CASE WHEN coalesce(loss, 0) = 0 THEN CASE WHEN coalesce(gain, 0) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE gain / abs(loss) END AS pf FROM s LEFT JOIN t USING (run_id, symbol))
    SELECT run_id, symbol, days, trades, net_yen, CASE WHEN trades >= 20 AND pf < 0.9 THEN 'retire_factor' WHEN days >= 45 AND trades >= 10 AND net_yen < 0 THEN 'retire_loss' WHEN trades >= 10 AND pf < 1 THEN 'probation' ELSE 'active' END AS lifecycle,
        CASE WHEN trades < 10 THEN 'collecting' WHEN pf >= 1.1 THEN 'good' WHEN pf < 0.9 THEN 'poor' ELSE 'watch' END AS status FROM b""",
)(lambda spark, d: ledger.strategy_report(_days(spark, d), order_trades(spark, d)).select("run_id", "symbol", "days", "trades", "net_yen", "lifecycle", "status"))


@query(
    "ledger_merge",
    f"""WITH {DAYS}, mid AS (SELECT CAST(floor((min(day) + max(day)) / 2.0) AS BIGINT) AS m FROM days), old AS (SELECT d.*, CASE WHEN run_id = 'F' THEN 'v1' ELSE 'v2' END AS mark FROM days d, mid WHERE day <= m), new AS (SELECT d.* REPLACE (net_yen + 1 AS net_yen), 'v2' AS mark FROM days d),
    kept AS (SELECT * FROM old WHERE mark = 'v2'), added AS (SELECT new.* FROM new ANTI JOIN kept USING (run_id, symbol, day)) SELECT run_id, symbol, day, net_yen, mark FROM kept UNION ALL SELECT run_id, symbol, day, net_yen, mark FROM added""",
)
def _(spark, d):
    days = _days(spark, d)
    middle = days.agg(F.floor((F.min("day") + F.max("day")) / 2.0).alias("m"))
    old = days.crossJoin(F.broadcast(middle)).where("day <= m").drop("m").withColumn("mark", F.when(F.col("run_id") == "F", "v1").otherwise("v2"))
    new = days.withColumn("net_yen", F.col("net_yen") + 1).withColumn("mark", F.lit("v2"))
    return ledger.merged(old, new, ["run_id", "symbol"], "day", "mark").select("run_id", "symbol", "day", "net_yen", "mark")


@query("ledger_integrity", f"WITH {DAYS} SELECT run_id, symbol, day, net_yen + CASE WHEN day % 7 = 0 THEN 3 ELSE 0 END AS net_yen, net_yen AS traded FROM days WHERE day % 7 = 0")
def _(spark, d):
    """A ledger in which every seventh day was tampered with."""
    wrong = _days(spark, d).withColumn("net_yen", F.col("net_yen") + F.when(F.col("day") % 7 == 0, 3.0).otherwise(0.0))
    return ledger.integrity(wrong, order_trades(spark, d)).select("run_id", "symbol", "day", "net_yen", F.coalesce("traded", F.lit(0.0)).alias("traded"))


_JSON = """'{"directions":"' || dirs || '","mode":"' || mode || '","rules":[{"period":20,"type":"donchianBreak"}],"stop_pips":' || sp || ',"target_pips":' || tp || ',"trailing_pips":' || CASE WHEN trail > 0 THEN CAST(trail AS VARCHAR) ELSE 'null' END || '}'"""


@query("strategy_fingerprints", f"WITH {st.runs(GRID)} SELECT run_id, sha256({_JSON}) AS fingerprint FROM rn")
def _(spark, d):
    rules = json.dumps(ledger.canonical([{"type": "donchianBreak", "period": 20}]), separators=(",", ":"))
    rows = _grid(spark).withColumn("rules", F.lit(rules))
    return rows.select("run_id", ledger.fingerprint(rows, ["stop_pips", "target_pips", "trailing_pips", "directions", "mode"]).alias("fingerprint"))


# -- quality gates ---------------------------------------------------------------------------------


@query(
    "data_freshness",
    f"""WITH {sql.bars()}, n AS (SELECT max(t) + 7200 AS now FROM bars), l AS (SELECT symbol, max(t) AS latest FROM bars GROUP BY 1), x AS (SELECT symbol, latest, (now - latest) / 3600.0 AS age_hours, (max(latest) OVER () - latest) / 3600.0 AS lag_hours FROM l, n)
    SELECT symbol, latest, {sql.r6('age_hours', 'age_hours')}, {sql.r6('lag_hours', 'lag_hours')}, CASE WHEN age_hours > 96 THEN 'fail' WHEN lag_hours >= 3 THEN 'warn' ELSE 'ok' END AS verdict FROM x""",
)
def _(spark, d):
    bars = src.event_bars(spark, d)
    now = bars.agg(F.max("t")).first()[0] or 0
    return shown(ledger.freshness(bars, now + 7200), "age_hours", "lag_hours", keys=("symbol", "latest", "verdict"))


@query(
    "source_coverage",
    "WITH b AS (SELECT event_type AS symbol, CASE WHEN user_id % 3 = 0 THEN 'primary' ELSE 'fallback' END AS source, epoch_us(ts) // 1000000 AS t FROM events), s AS (SELECT symbol, source, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM b GROUP BY 1, 2) SELECT symbol, source, first_t, last_t, n FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY last_t - first_t DESC, n DESC, source) = 1",
)
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.col("event_type").alias("symbol"), F.lit("tick").alias("tf"), F.when(F.col("user_id") % 3 == 0, "primary").otherwise("fallback").alias("source"), src.unix_seconds("ts").alias("t"))
    return src.widest_coverage(rows, 1 << 40).drop("tf")


# -- streams -----------------------------------------------------------------------------------------


@query(
    "stream_closed_bars",
    f"WITH {sql.bars()}, m AS (SELECT max(epoch_us(ts)) // 1000 AS newest FROM events) SELECT symbol, t, {', '.join(sql.r6(x, x) for x in 'ohlcv')} FROM bars, m WHERE (t + 3600) * 1000 <= newest - 600000",
)
def _(spark, d):
    """Closed hourly bars of the tick stream, written by an append sink and read back."""
    out, state = scratch.folder(spark), scratch.folder(spark)
    bars = stream.closed_bars(stream.event_ticks(spark, f"{d}/events.parque[t]"), "h1")
    bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.parquet(out), *"ohlcv")
