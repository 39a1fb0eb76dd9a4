"""Queries over the tuning job; the SQL covers the four-hour candidates, whose grid it can step through."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import tuning
from barloom.plans import series as se
from barloom.plans import sql
from barloom.plans import sql_trades as st
from barloom.plans import trading as tr
from barloom.plans.series import query, shown
from barloom.sources import bars as src

_EMAS = f"{sql.ema('ef', 20)}, {sql.ema('es', 50)}, x AS (SELECT b.*, ef.y AS f, es.y AS s FROM b LEFT JOIN ef USING (symbol, i) LEFT JOIN es USING (symbol, i))"
_ENV = f"m AS (SELECT *, CASE WHEN row_number() {sql.S} > 14 THEN {sql.frame('avg', 'c', 14)} END AS mid FROM bars), x AS (SELECT *, mid * (1 + 0.1 / 100) AS env_upper, mid * (1 - 0.1 / 100) AS env_lower FROM m)"
_CLOUD = "CASE WHEN span_a IS NOT NULL AND span_b IS NOT NULL THEN {}(span_a, span_b) END"
#: Per rule of the four-hour profiles: tables up to x, and when its bars are long and short.
SIGNALS = {
    "maCross": (_EMAS, sql.up("f", "s"), sql.down("f", "s")),
    "macdCross": (se.MACD, sql.up("macd", "macd_signal"), sql.down("macd", "macd_signal")),
    "donchianBreak": (se.DON, "c > don_upper", "c < don_lower"),
    "ichimokuCross": (se.ICH, f"{sql.up('tenkan', 'kijun')} AND c > {_CLOUD.format('greatest')}", f"{sql.down('tenkan', 'kijun')} AND c < {_CLOUD.format('least')}"),
    "keltnerBreak": (se.KELT, "atr > 0 AND c >= kelt_upper", "atr > 0 AND c <= kelt_lower"),
    "adxTrend": (se.ADX, f"adx >= 25 AND {sql.up('plus_di', 'minus_di')}", f"adx >= 25 AND {sql.down('plus_di', 'minus_di')}"),
    "parabolicSar": (sql.sar(), f"sar_long AND NOT {sql.lag('sar_long')}", f"NOT sar_long AND {sql.lag('sar_long')}"),
    "momentum": (se.MOM, sql.up("momentum", "100"), sql.down("momentum", "100")),
    "rvi": (se.RVI, sql.up("rvi", "rvi_signal"), sql.down("rvi", "rvi_signal")),
    "demarker": (se.DEM, f"{sql.lag('demarker')} < 0.3 AND demarker >= 0.3", f"{sql.lag('demarker')} > 0.7 AND demarker <= 0.7"),
    "ao": (se.AO, sql.up("ao", "0"), sql.down("ao", "0")),
    "envelope": (_ENV, sql.up("c", "env_upper"), sql.down("c", "env_lower")),
    "alligator": (se.ALLI, f"{sql.up('lips', 'teeth')} AND teeth > jaw", f"{sql.down('lips', 'teeth')} AND teeth < jaw"),
}
_PROFILES = tuning.chosen(timeframes=["h4"])
_RUNS = tuning.runs_of(_PROFILES)


def _sets(source: str) -> str:
    """Table sg: the signals of every rule over the series of ``source``, whose names the rule precedes."""
    later = f"{sql.lag('t')} IS NOT NULL"
    one = lambda kind, ctes, up, down: f"g_{kind} AS (WITH RECURSIVE bars AS (SELECT * FROM {source}), {sql.numbered()}, {ctes} SELECT '{kind}|' || symbol AS symbol, t, o, h, l, c, {later} AND coalesce({up}, false) AS long, {later} AND coalesce({down}, false) AS short FROM x)"
    return ", ".join(one(k, *SIGNALS[k]) for k in _PROFILES) + f", sg AS ({' UNION ALL '.join(f'SELECT * FROM g_{k}' for k in _PROFILES)})"


_START = "FROM rn, sig WHERE i = 1"
_BY_RULE = "FROM rn JOIN sig ON i = 1 AND split_part(run_id, '-', 1) = split_part(symbol, '|', 1)"
_BY_ROW = "FROM rn JOIN sel ON sel.run_id = rn.run_id JOIN sig ON i = 1 AND split_part(sig.symbol, '/', 1) = sel.symbol"
_COMBOS = f"""WITH RECURSIVE {sql.bars(14400)}, hs AS (SELECT * REPLACE (symbol || '/' || CASE WHEN row_number() {sql.S} <= floor(count(*) OVER (PARTITION BY symbol) * CAST(0.7 AS DOUBLE)) THEN 'opt' ELSE 'val' END AS symbol) FROM bars),
    {_sets('hs')}, {st.runs(_RUNS)}, {sql.swapped(st.simulated('sg'), _START, _BY_RULE)}, {st.METRICS}, {tr.GATES},
    ge AS (SELECT *, CASE WHEN opt_profit_factor < 1 THEN list_append(reasons, 'opt_factor') ELSE reasons END AS why, row_number() OVER (PARTITION BY symbol ORDER BY opt_net_yen DESC, opt_max_drawdown_yen, run_id) AS rank FROM gd),
    sel AS (SELECT symbol, run_id FROM ge WHERE len(why) = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rank) = 1),
    sp AS (SELECT *, min(t) OVER (PARTITION BY symbol) AS a, max(t) OVER (PARTITION BY symbol) AS z FROM bars), qb AS (SELECT symbol || '/' || CAST(CASE WHEN z > a THEN least(3, floor(4.0 * (t - a) / (z - a))) ELSE 0 END AS INT) AS symbol, t, o, h, l, c FROM sp),
    qr AS (WITH RECURSIVE {_sets('qb')}, {sql.swapped(sql.swapped(st.simulated('sg'), _START, _BY_ROW), 'SELECT run_id, symbol, i, t, 0 AS pos', 'SELECT rn.run_id, sig.symbol, i, t, 0 AS pos')}, {st.METRICS} SELECT split_part(symbol, '/', 1) AS symbol, run_id, count(*) FILTER (net_yen > 0) AS positive FROM m GROUP BY 1, 2),
    co AS (SELECT ge.*, sel.run_id IS NOT NULL AS selected, CASE WHEN sel.run_id IS NOT NULL THEN coalesce(positive, 0) END AS positive_quarters FROM ge LEFT JOIN sel ON sel.symbol = ge.symbol AND sel.run_id = ge.run_id LEFT JOIN qr ON qr.symbol = ge.symbol AND qr.run_id = ge.run_id),
    combos AS (SELECT * EXCLUDE (symbol, why), split_part(symbol, '|', 2) AS symbol, split_part(symbol, '|', 1) AS kind, CASE WHEN positive_quarters < 3 THEN list_append(why, 'quarters') ELSE why END AS why, selected AND positive_quarters >= 3 AS adopted FROM co)"""
_NUMBER = {k: n for n, k in enumerate(tuning.PROFILES)}
_REPORT = f"""{_COMBOS}, wn AS (SELECT symbol, count(*) AS reference_bars, floor(count(*) * CAST(0.7 AS DOUBLE)) AS opt_bars, (max(t) - min(t)) / 86400.0 AS span_days, row_number() OVER (ORDER BY symbol) - 1 AS no FROM bars GROUP BY symbol),
    kn AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {_NUMBER[k]})" for k in _PROFILES)}) v(kind, kind_no)),
    cn AS (SELECT symbol, kind, count(*) AS combinations, count(*) FILTER (len(why) = 0) AS passed, max(run_id) FILTER (adopted) AS run_id, max(rank) FILTER (adopted) AS rank, max(positive_quarters) FILTER (adopted) AS positive_quarters, bool_or(adopted) AS adopted FROM combos GROUP BY 1, 2),
    ws AS (SELECT symbol, kind, reason, count(*) AS n FROM (SELECT symbol, kind, unnest(why) AS reason FROM combos) GROUP BY 1, 2, 3), wl AS (SELECT symbol, kind, string_agg(reason || ':' || n, ',' ORDER BY reason || ':' || n) AS reasons FROM ws GROUP BY 1, 2),
    report AS (SELECT wn.symbol, kn.kind, 'h4' AS tf, CASE WHEN cn.adopted THEN 'passed' ELSE 'rejected' END AS status, coalesce(combinations, 0) AS combinations, coalesce(passed, 0) AS passed, cn.run_id, sp AS stop_pips, tp AS target_pips, nullif(trail, 0) AS trailing_pips, CAST(rank AS DOUBLE) AS rank, CAST(positive_quarters AS DOUBLE) AS positive_quarters,
        CASE WHEN cn.adopted THEN '' WHEN combinations IS NULL THEN 'nothing_evaluated:1' ELSE coalesce(reasons, '') END AS reasons, reference_bars, CAST(opt_bars AS BIGINT) AS opt_bars, CAST(reference_bars - opt_bars AS BIGINT) AS val_bars, span_days, CASE WHEN span_days < 737 THEN 'reference_span_below_target' ELSE '' END AS warnings,
        CAST(1783100000 + (kind_no // 10) * 100000 + no * 100 + (kind_no % 10) * 10 + 1 AS BIGINT) AS magic
        FROM wn CROSS JOIN kn LEFT JOIN cn ON cn.symbol = wn.symbol AND cn.kind = kn.kind LEFT JOIN wl ON wl.symbol = wn.symbol AND wl.kind = kn.kind LEFT JOIN rn ON rn.run_id = cn.run_id)"""


def _reported(spark, d, timeframes):
    return tuning.job({tf: src.event_bars(spark, d, tf) for tf in timeframes}, timeframes=timeframes, pip=tr.PIP)


def _listed(reports):
    whole = reports.withColumns({c: F.col(c).cast("double") for c in ("rank", "positive_quarters")}).withColumn("span_days", F.round("span_days", 6))
    return whole.select("symbol", "kind", "tf", "status", "combinations", "passed", "run_id", "stop_pips", "target_pips", "trailing_pips", "rank", "positive_quarters", "reasons", "reference_bars", "opt_bars", "val_bars", "span_days", "warnings", "magic")


query("tuning_candidates_h4", f"{_REPORT} SELECT * REPLACE (round(span_days, 6) AS span_days) FROM report")(lambda spark, d: _listed(_reported(spark, d, ["h4"])[1]))


@query(
    "tuning_combinations_h4",
    f"""{_COMBOS} SELECT symbol, kind, run_id, CAST(rank AS INT) AS rank, len(why) = 0 AS passed, adopted, array_to_string(why, ',') AS reasons, opt_net_yen, val_net_yen, val_trades, {sql.r6('ratio', 'ratio')} FROM combos""",
)
def _(spark, d):
    combos = _reported(spark, d, ["h4"])[0].withColumn("reasons", F.concat_ws(",", "reasons"))
    return shown(combos, "ratio", keys=("symbol", "kind", "run_id", "rank", "passed", "adopted", "reasons", "opt_net_yen", "val_net_yen", "val_trades"))


query(
    "tuning_summary_h4",
    f"""{_REPORT} SELECT count(*) AS candidates, count(*) FILTER (status = 'passed') AS passed_candidates, count(*) FILTER (status = 'rejected') AS rejected_candidates, count(*) FILTER (warnings <> '') AS short_references, CAST(sum(combinations) AS BIGINT) AS combinations, CAST(sum(passed) AS BIGINT) AS passed_combinations FROM report""",
)(lambda spark, d: tuning.summary(_reported(spark, d, ["h4"])[1]).drop("fallback_rates", "uncovered_sum", "uncovered_mean", "uncovered_most"))
query("tuning_job", None)(lambda spark, d: _listed(_reported(spark, d, ["m30", "h1", "h4"])[1]))
