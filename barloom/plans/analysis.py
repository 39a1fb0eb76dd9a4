"""Queries over signals, patterns, levels and forecasts; each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import forecast as fc
from barloom.operators import indicators as ind
from barloom.operators import signals as sg
from barloom.plans import sql
from barloom.plans.series import MACD, ORACLES, RSI14, query, shown
from barloom.sources import bars as src

L = sql.lag
S = sql.S


def _side(f: str, x: str, a: str) -> str:
    return f"{f}({x}) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {a})"


BACK, AHEAD = "2 PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND 2 FOLLOWING"
_WHOLE = f"{_side('count', 't', BACK)} = 2 AND {_side('count', 't', AHEAD)} = 2"
PIVOTS = f"""piv AS (SELECT *, CASE WHEN {_WHOLE} AND h > greatest({_side('max', 'h', BACK)}, {_side('max', 'h', AHEAD)}) THEN h END AS pivot_high,
    CASE WHEN {_WHOLE} AND l < least({_side('min', 'l', BACK)}, {_side('min', 'l', AHEAD)}) THEN l END AS pivot_low FROM {{0}})"""
TR = f"CASE WHEN {L('c')} IS NOT NULL THEN greatest(h - l, abs(h - {L('c')}), abs(l - {L('c')})) END AS tr"
_IN = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 117 PRECEDING AND 2 PRECEDING)"
_PAST = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 119 PRECEDING AND 1 PRECEDING)"
SWING = f"""{PIVOTS}, sw1 AS (SELECT *, {TR}, list(pivot_high) FILTER (pivot_high IS NOT NULL) {_IN} AS hs, list(pivot_low) FILTER (pivot_low IS NOT NULL) {_IN} AS ls, max(h) {_PAST} AS ph, min(l) {_PAST} AS pl FROM piv),
    sw2 AS (SELECT *, avg(tr) {sql.over(14)} AS atr_latest, CASE WHEN hs IS NULL OR len(hs) = 0 THEN [ph] ELSE hs END AS hs2, CASE WHEN ls IS NULL OR len(ls) = 0 THEN [pl] ELSE ls END AS ls2 FROM sw1),
    sw AS (SELECT *, list_filter(ls2, lambda z: z <= c)[-1] AS support, list_filter(hs2, lambda z: z >= c)[-1] AS resistance,
        greatest(0.0015, least(0.012, (CASE WHEN atr_latest > 0 AND c <> 0 THEN abs(atr_latest / c) ELSE 0.002 END) * 0.75)) AS near_pct FROM sw2)"""


def events(spark, d, tf="h1"):
    return src.event_bars(spark, d, tf)


query("fractal_swings", f"WITH {sql.bars()}, {PIVOTS.format('bars')} SELECT symbol, t, {sql.r6('pivot_high', 'pivot_high')}, {sql.r6('pivot_low', 'pivot_low')} FROM piv")(lambda spark, d: shown(sg.pivots(events(spark, d)), "pivot_high", "pivot_low"))
query("swing_support_resistance", f"WITH {sql.bars()}, {SWING.format('bars')} SELECT symbol, t, {', '.join(sql.r6(x, x) for x in ('support', 'resistance', 'near_pct'))} FROM sw")(lambda spark, d: shown(sg.swing_levels(events(spark, d)), "support", "resistance", "near_pct"))


def _mid(n: int) -> str:
    return f"CASE WHEN count(h) {sql.over(n)} = {n} THEN (max(h) {sql.over(n)} + min(l) {sql.over(n)}) / 2 END"


def votes(rsi: str) -> str:
    """Table z with the votes and the score; rsi: the recursive fragment whose x has a column named rsi."""
    return f"""{rsi.replace('x AS (', 'xr AS (')}, {MACD.replace('x AS (', 'xm AS (')},
    f1 AS (SELECT b.*, xr.rsi, xm.macd, xm.macd_signal FROM b JOIN xr USING (symbol, i) JOIN xm USING (symbol, i)),
    f2 AS (SELECT *, {sql.frame('avg', 'c', 20)} AS s20, {sql.frame('avg', 'c', 50)} AS s50, {sql.frame('avg', 'c', 20)} AS bm, {sql.frame('stddev_pop', 'c', 20)} AS bd, {_mid(9)} AS tk, {_mid(26)} AS kj, {_mid(52)} AS sb FROM f1),
    f3 AS (SELECT *, lag((tk + kj) / 2, 26) {S} AS span_a, lag(sb, 26) {S} AS span_b FROM f2), {SWING.format('f3')},
    f4 AS (SELECT *, CASE WHEN {sql.up('s20', 's50')} THEN 2 WHEN {sql.down('s20', 's50')} THEN -2 ELSE 0 END AS vote_sma, CASE WHEN rsi <= 30 THEN 1 WHEN rsi >= 70 THEN -1 ELSE 0 END AS vote_rsi,
        CASE WHEN {sql.up('macd', 'macd_signal')} THEN 1 WHEN {sql.down('macd', 'macd_signal')} THEN -1 ELSE 0 END AS vote_macd, CASE WHEN c > bm + 2 * bd THEN 1 WHEN c < bm - 2 * bd THEN -1 ELSE 0 END AS vote_band,
        CASE WHEN span_a IS NULL OR span_b IS NULL THEN 0 WHEN c > greatest(span_a, span_b) THEN 1 WHEN c < least(span_a, span_b) THEN -1 ELSE 0 END AS vote_cloud,
        CASE WHEN i >= 12 AND c <> 0 AND abs(support - c) / nullif(abs(c), 0) <= near_pct THEN 1 ELSE 0 END AS vote_support, CASE WHEN i >= 12 AND c <> 0 AND abs(resistance - c) / nullif(abs(c), 0) <= near_pct THEN -1 ELSE 0 END AS vote_resistance FROM sw),
    z AS (SELECT *, CASE WHEN i > 1 THEN vote_sma + vote_rsi + vote_macd + vote_band + vote_cloud + vote_support + vote_resistance ELSE 0 END AS score,
        abs(vote_sma) + abs(vote_rsi) + abs(vote_macd) + abs(vote_band) + abs(vote_cloud) + abs(vote_support) + abs(vote_resistance) AS most FROM f4)"""


NOFLAT = RSI14.replace("WHEN g = 0 AND s = 0 THEN 50 ", "")
HEAD = f"WITH RECURSIVE {sql.bars()}, {sql.numbered()}, "
GRADE = "CASE WHEN score <= -4 THEN 'strong_sell' WHEN score <= -1 THEN 'sell' WHEN score < 1 THEN 'neutral' WHEN score < 4 THEN 'buy' ELSE 'strong_buy' END"


@query("signal_score", f"{HEAD}{votes(NOFLAT)} SELECT symbol, t, CAST(score AS BIGINT) AS score, {sql.r6('greatest(-1, least(1, score / CAST(greatest(4, most) AS DOUBLE)))', 'ratio')}, {GRADE} AS rating FROM z")
def _(spark, d):
    scored = sg.score(events(spark, d))
    return shown(scored, "ratio", keys=("symbol", "t", "score")).withColumn("score", F.col("score").cast("long")).withColumn("rating", sg.rating(F.col("score")))


@query("analyze_last_bar", f"{HEAD}{votes(RSI14)} SELECT symbol, t, CAST(score AS BIGINT) AS score, CASE WHEN score > 0 THEN 'bullish' WHEN score < 0 THEN 'bearish' ELSE 'neutral' END AS direction FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1")
def _(spark, d):
    last = src.tail(sg.score(events(spark, d), flat_rsi=True), 1)
    return last.select("symbol", "t", F.col("score").cast("long").alias("score"), sg.direction(F.col("score")).alias("direction"))


_WIDE = f"WITH RECURSIVE {sql.bars(14400)}, {sql.numbered()}, {votes(NOFLAT)}"
_LAST = "SELECT symbol, CAST(score AS BIGINT) AS score FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1"


@query("mtf_alignment", f"""SELECT symbol, m.score AS main_score, o.score AS other_score, CASE WHEN m.score = 0 OR o.score = 0 THEN 'neutral' WHEN sign(m.score) = sign(o.score) THEN 'aligned' ELSE 'diverged' END AS status
    FROM ({HEAD}{votes(NOFLAT)} {_LAST}) m JOIN ({_WIDE} {_LAST}) o USING (symbol)""")
def _(spark, d):
    """Newest score of hourly bars against that of four-hour bars."""
    main, other = (src.tail(sg.score(events(spark, d, tf)), 1) for tf in ("h1", "h4"))
    both = main.select("symbol", F.col("score").cast("long").alias("main_score")).join(other.select("symbol", F.col("score").cast("long").alias("other_score")), "symbol")
    return both.withColumn("status", sg.alignment(F.col("main_score"), F.col("other_score")))


def _shapes() -> str:
    part = lambda k, n: f"{L('o', k) if k else 'o'} AS o{n}, {L('h', k) if k else 'h'} AS h{n}, {L('l', k) if k else 'l'} AS l{n}, {L('c', k) if k else 'c'} AS c{n}"
    derived = ", ".join(f"abs(c{n} - o{n}) AS body{n}, greatest(h{n} - l{n}, 1e-9) AS span{n}, greatest(o{n}, c{n}) AS hi{n}, least(o{n}, c{n}) AS lo{n}" for n in range(3))
    return f"p AS (SELECT symbol, t, {part(0, 0)}, {part(1, 1)}, {part(2, 2)} FROM bars), q AS (SELECT *, {derived}, h0 - greatest(o0, c0) AS up0, least(o0, c0) - l0 AS dn0 FROM p)"


_UPPIN = "(span0 > 1e-9 AND dn0 >= greatest(body0 * 2.2, span0 * 0.52) AND up0 <= span0 * 0.28 AND c0 >= l0 + span0 * 0.55)"
_DNPIN = "(span0 > 1e-9 AND up0 >= greatest(body0 * 2.2, span0 * 0.52) AND dn0 <= span0 * 0.28 AND c0 <= h0 - span0 * 0.55)"
_ROUND = "hi0 >= hi1 AND lo0 <= lo1 AND body0 > body1 * 0.9"
_STAR = "body2 / span2 >= 0.48 AND body1 / span1 <= 0.32 AND body1 < body2 * 0.75 AND body0 / span0 >= 0.42"
query(
    "candle_patterns",
    f"""WITH {sql.bars()}, {_shapes()}
    SELECT symbol, t, 'pinbar-bullish' AS pattern, 'bullish' AS direction, CASE WHEN dn0 >= span0 * 0.68 THEN 3 ELSE 2 END AS strength FROM q WHERE {_UPPIN}
    UNION ALL SELECT symbol, t, 'pinbar-bearish', 'bearish', CASE WHEN up0 >= span0 * 0.68 THEN 3 ELSE 2 END FROM q WHERE {_DNPIN} AND NOT {_UPPIN}
    UNION ALL SELECT symbol, t, 'doji', 'neutral', 1 FROM q WHERE span0 > 1e-9 AND body0 / span0 <= 0.1
    UNION ALL SELECT symbol, t, 'engulfing-bullish', 'bullish', CASE WHEN body0 > body1 * 1.35 THEN 3 ELSE 2 END FROM q WHERE c1 < o1 AND c0 > o0 AND {_ROUND}
    UNION ALL SELECT symbol, t, 'engulfing-bearish', 'bearish', CASE WHEN body0 > body1 * 1.35 THEN 3 ELSE 2 END FROM q WHERE c1 > o1 AND c0 < o0 AND {_ROUND}
    UNION ALL SELECT symbol, t, 'morning-star', 'bullish', CASE WHEN c0 >= o2 THEN 3 ELSE 2 END FROM q WHERE c2 < o2 AND {_STAR} AND c0 > o0 AND c0 > (o2 + c2) / 2
    UNION ALL SELECT symbol, t, 'evening-star', 'bearish', CASE WHEN c0 <= o2 THEN 3 ELSE 2 END FROM q WHERE c2 > o2 AND {_STAR} AND c0 < o0 AND c0 < (o2 + c2) / 2""",
)(lambda spark, d: sg.candle_patterns(events(spark, d)).drop("tf"))

SWINGS = f"""{PIVOTS.format('nb')}, pts AS (SELECT symbol, t, i, 'low' AS kind, pivot_low AS price FROM piv WHERE pivot_low IS NOT NULL UNION ALL SELECT symbol, t, i, 'high', pivot_high FROM piv WHERE pivot_high IS NOT NULL),
    ch AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY symbol ORDER BY i, price) THEN 0 ELSE 1 END AS new FROM pts), rn AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY i, price) AS run FROM ch),
    sg AS (SELECT symbol, CAST(run AS BIGINT) AS run, kind, first(t ORDER BY CASE WHEN kind = 'high' THEN -price ELSE price END, i) AS t, first(price ORDER BY CASE WHEN kind = 'high' THEN -price ELSE price END, i) AS price FROM rn GROUP BY 1, 2, 3)"""
NB = f"nb AS (SELECT *, row_number() {S} AS i FROM bars)"
query("normalized_swings", f"WITH {sql.bars()}, {NB}, {SWINGS} SELECT symbol, run, kind, t, {sql.r6('price', 'price')} FROM sg")(lambda spark, d: shown(sg.swings(events(spark, d)).withColumn("run", F.col("run").cast("long")), "price", keys=("symbol", "run", "kind", "t")))

_O = "OVER (PARTITION BY sg.symbol ORDER BY run)"
query(
    "chart_patterns",
    f"""WITH {sql.bars()}, {NB}, {SWINGS}, tr AS (SELECT *, {TR} FROM bars), nw AS (SELECT symbol, c, avg(tr) {sql.over(14)} AS atr FROM tr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1),
    y AS (SELECT sg.symbol, kind, CASE WHEN kind = 'high' THEN 1 ELSE -1 END AS s, greatest(coalesce(atr, 0) * 0.8, abs(c) * 0.0012, 0.00001) AS tol, price AS p0, lead(price, 1) {_O} AS p1, lead(price, 2) {_O} AS p2, lead(price, 3) {_O} AS p3, lead(price, 4) {_O} AS p4,
        lead(t, 2) {_O} AS t2, lead(t, 4) {_O} AS t4 FROM sg JOIN nw ON sg.symbol = nw.symbol),
    z AS (SELECT *, least(s * p0, s * p2) - s * p1 AS depth, s * p2 - greatest(s * p0, s * p4) AS over FROM y WHERE p2 IS NOT NULL)
    SELECT symbol, t2 AS t, CASE WHEN kind = 'high' THEN 'double-top' ELSE 'double-bottom' END AS pattern, CASE WHEN kind = 'high' THEN 'bearish' ELSE 'bullish' END AS direction, CASE WHEN depth >= tol * 2.5 THEN 3 ELSE 2 END AS strength FROM z WHERE abs(p0 - p2) <= tol AND depth >= tol * 1.25
    UNION ALL SELECT symbol, t4, CASE WHEN kind = 'high' THEN 'head-shoulders' ELSE 'inverse-head-shoulders' END, CASE WHEN kind = 'high' THEN 'bearish' ELSE 'bullish' END, CASE WHEN over >= tol * 2 THEN 3 ELSE 2 END
        FROM z WHERE p4 IS NOT NULL AND over >= tol AND abs(p0 - p4) <= tol * 1.8 AND abs(p1 - p3) <= tol * 2.5""",
)(lambda spark, d: sg.chart_patterns(events(spark, d)).drop("tf"))

LEVELS = f"""rc AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) - 1 AS age FROM {{source}} QUALIFY age < 240), {PIVOTS.format('rc')}, rt AS (SELECT *, {TR} FROM rc),
    lat AS (SELECT symbol, c AS close, avg(tr) {sql.over(14)} AS atr FROM rt QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1),
    lp AS (SELECT symbol, t, age, unnest([pivot_low, pivot_high]) AS price FROM piv), lq AS (SELECT lp.*, close, greatest(greatest(abs(close) * 0.0004, 1e-5), least(greatest(abs(close) * 0.02, 5e-5), coalesce(atr, greatest(abs(close) * 0.0015, 1e-5)) * 0.65)) AS tol,
        pow(0.5, age / 80.0) AS wt, row_number() OVER (PARTITION BY symbol ORDER BY price, t) AS k FROM lp JOIN lat USING (symbol) WHERE price IS NOT NULL),
    cl AS (SELECT symbol, k, [{{{{'s': price * wt, 'w': wt, 'n': 1, 'last': t}}}}] AS g FROM lq WHERE k = 1
        UNION ALL SELECT symbol, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(g, {{{{'s': price * wt, 'w': wt, 'n': 1, 'last': t}}}}) ELSE list_transform(g, lambda x, j: CASE WHEN j = hit THEN {{{{'s': x.s + price * wt, 'w': x.w + wt, 'n': x.n + 1, 'last': greatest(x.last, t)}}}} ELSE x END) END
        FROM (SELECT q.*, cl.g, list_position(list_transform(cl.g, lambda x: abs(q.price - x.s / x.w) <= q.tol), true) AS hit FROM cl JOIN lq q ON q.symbol = cl.symbol AND q.k = cl.k + 1)),
    lu AS (SELECT symbol, unnest(g) AS x FROM cl QUALIFY k = max(k) OVER (PARTITION BY symbol)), lv AS (SELECT symbol, x.s / x.w AS price, x.n AS touches, x.n * x.w AS strength, abs(x.s / x.w - close) AS distance, x.last AS last_touch, close FROM lu JOIN lat USING (symbol)),
    levels AS (SELECT *, CASE WHEN price >= close THEN 'resistance' ELSE 'support' END AS direction, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, distance) AS place FROM lv)"""
_LV = f"WITH RECURSIVE {sql.bars()}, {LEVELS.format(source='bars')}"
query("support_resistance_levels", f"{_LV} SELECT symbol, direction, CAST(touches AS INT) AS touches, last_touch, {', '.join(sql.r6(x, x) for x in ('price', 'strength', 'distance'))} FROM levels WHERE place <= 8")(lambda spark, d: shown(sg.levels(events(spark, d)), "price", "strength", "distance", keys=("symbol", "direction", "touches", "last_touch")))
query(
    "fibonacci_levels",
    f"WITH {sql.bars()}, x AS (SELECT symbol, max(h) AS h, min(l) AS l FROM bars GROUP BY 1) SELECT symbol, ratio, round(h - (h - l) * ratio, 9) AS price FROM x, (SELECT unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]::DOUBLE[]) AS ratio)",
)(lambda spark, d: events(spark, d).groupBy("symbol").agg(F.max("h").alias("h"), F.min("l").alias("l")).select("symbol", F.explode(sg.fibonacci(F.col("h"), F.col("l"))).alias("x")).select("symbol", "x.ratio", F.round("x.price", 9).alias("price")))


# -- forecasts -------------------------------------------------------------------------

_F80, _F79 = sql.over(80), sql.over(79)
STATS = f"""m1 AS (SELECT *, CASE WHEN c > 0 AND {L('c')} > 0 THEN ln(CASE WHEN c > 0 THEN c END / CASE WHEN {L('c')} > 0 THEN {L('c')} END) END AS r FROM z), m2 AS (SELECT *, {L('r')} AS q, CASE WHEN r IS NOT NULL THEN CAST(i AS DOUBLE) END AS x FROM m1),
    m3 AS (SELECT *, CASE WHEN r IS NOT NULL AND q IS NOT NULL THEN r END AS ra, CASE WHEN r IS NOT NULL AND q IS NOT NULL THEN q END AS qa FROM m2),
    m4 AS (SELECT *, count(r) {_F80} AS n, avg(r) {_F80} AS mu, coalesce(stddev_pop(r) {_F80}, 0) AS sd, avg(x) {_F80} AS mx, covar_pop(r, x) {_F80} AS cv, var_pop(x) {_F80} AS vx, covar_pop(ra, qa) {_F79} AS cab, var_pop(ra) {_F79} AS va, var_pop(qa) {_F79} AS vb FROM m3),
    m5 AS (SELECT *, greatest(sd, abs(coalesce(mu, 0)), 1e-6) AS volatility, CASE WHEN n < 3 THEN coalesce(mu, 0) ELSE mu + (CASE WHEN vx > 0 THEN cv / vx ELSE 0 END) * (i + 1 - mx) END AS drift_move,
        CASE WHEN n > 2 AND va * vb > 0 THEN greatest(-1, least(1, cab / sqrt(va * vb))) ELSE 0 END AS autocorrelation FROM m4),
    st AS (SELECT *, coalesce(r, 0) * autocorrelation AS regime_move, greatest(-1, least(1, score / 8.0)) AS bias FROM m5)"""


def _stats(spark, d):
    return fc.model_stats(sg.score(events(spark, d)))


query("model_stats", f"{HEAD}{votes(NOFLAT)}, {STATS} SELECT symbol, t, {', '.join(sql.r6(x, x) for x in ('volatility', 'drift_move', 'autocorrelation', 'regime_move', 'bias'))} FROM st")(
    lambda spark, d: shown(_stats(spark, d), "volatility", "drift_move", "autocorrelation", "regime_move", "bias")
)


def _cdf(x: str) -> str:
    a = f"abs(({x}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {a}))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(0.5 * (1 + sign({x}) * (1 - {poly} * exp(-{a} * {a}))))"


PROB = f"""hz AS (SELECT unnest([1, 5, 20]) AS horizon), e1 AS (SELECT symbol, t, i, c, bias, volatility, drift_move, regime_move, lead(c, 1) {S} AS c1, lead(c, 5) {S} AS c5, lead(c, 20) {S} AS c20 FROM st),
    e2 AS (SELECT *, CASE horizon WHEN 1 THEN c1 WHEN 5 THEN c5 ELSE c20 END AS later, least(horizon, 5) AS k FROM e1, hz),
    e3 AS (SELECT *, later > c AS up, drift_move * horizon / greatest(volatility * sqrt(horizon), 1e-6) AS zd, regime_move * k / greatest(volatility * sqrt(k), 1e-6) AS zr FROM e2),
    pb AS (SELECT symbol, t, i, c, horizon, up, greatest(0.05, least(0.95, 0.5 + bias * 0.24 / sqrt(horizon))) AS p_signal, greatest(0.02, least(0.98, {_cdf('zd')})) AS p_drift, greatest(0.02, least(0.98, {_cdf('zr')})) AS p_regime FROM e3)"""
PERF = """kn AS (SELECT * FROM pb WHERE i > 80 AND up IS NOT NULL), hits AS (SELECT symbol, horizon, i, 'signal' AS model, CAST((p_signal >= 0.5) = up AS INT) AS hit FROM kn UNION ALL SELECT symbol, horizon, i, 'drift', CAST((p_drift >= 0.5) = up AS INT) FROM kn
        UNION ALL SELECT symbol, horizon, i, 'regime', CAST((p_regime >= 0.5) = up AS INT) FROM kn),
    dk AS (SELECT *, pow(0.5, (max(i) OVER (PARTITION BY symbol, horizon, model) - i) / 100.0) AS d FROM hits),
    pf AS (SELECT symbol, horizon, model, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS total, sum(hit * d) / sum(d) AS ewma_accuracy FROM dk GROUP BY ALL)"""
_LOGIT = "ln({p}) + (max(CASE WHEN model = '{m}' THEN ewma_accuracy END) - 0.5) / 0.08 AS l_{m}"
WEIGHT = f"""lg AS (SELECT symbol, horizon, min(total) AS n, count(*) AS k, {', '.join(_LOGIT.format(m=m, p=p) for m, p in fc.PRIOR.items())} FROM pf GROUP BY 1, 2),
    ex AS (SELECT *, exp(l_signal - greatest(l_signal, l_drift, l_regime)) AS e_signal, exp(l_drift - greatest(l_signal, l_drift, l_regime)) AS e_drift, exp(l_regime - greatest(l_signal, l_drift, l_regime)) AS e_regime FROM lg),
    wt AS (SELECT symbol, horizon, n < 30 OR k < 3 AS fallback, {', '.join(f"CASE WHEN n < 30 OR k < 3 THEN {p} ELSE e_{m} / (e_signal + e_drift + e_regime) END AS w_{m}" for m, p in fc.PRIOR.items())} FROM ex)"""
MIX = "mx AS (SELECT pb.*, greatest(0.02, least(0.98, p_signal * coalesce(w_signal, 0.4) + p_drift * coalesce(w_drift, 0.35) + p_regime * coalesce(w_regime, 0.25))) AS p_up FROM pb LEFT JOIN wt USING (symbol, horizon))"
FULL = f"{HEAD}{votes(NOFLAT)}, {STATS}, {PROB}, {PERF}, {WEIGHT}, {MIX}"

query("model_probabilities", f"{HEAD}{votes(NOFLAT)}, {STATS}, {PROB} SELECT symbol, t, horizon, {', '.join(sql.r6(x, x) for x in ('p_signal', 'p_drift', 'p_regime'))}, up FROM pb")(
    lambda spark, d: shown(fc.probabilities(_stats(spark, d)), "p_signal", "p_drift", "p_regime", keys=("symbol", "t", "horizon", "up"))
)
query("model_performance", f"{HEAD}{votes(NOFLAT)}, {STATS}, {PROB}, {PERF} SELECT symbol, horizon, model, hits, total, {sql.r6('ewma_accuracy', 'ewma_accuracy')} FROM pf")(
    lambda spark, d: shown(fc.performance(fc.probabilities(_stats(spark, d))), "ewma_accuracy", keys=("symbol", "horizon", "model", "hits", "total"))
)
query("adaptive_weights", f"{HEAD}{votes(NOFLAT)}, {STATS}, {PROB}, {PERF}, {WEIGHT} SELECT symbol, horizon, fallback, {', '.join(sql.r6(f'w_{m}', f'w_{m}') for m in fc.MODELS)} FROM wt")(
    lambda spark, d: shown(fc.weights(fc.performance(fc.probabilities(_stats(spark, d)))), *(f"w_{m}" for m in fc.MODELS), keys=("symbol", "horizon", "fallback"))
)


def _mixed(spark, d):
    return fc.mixed_forecasts(events(spark, d))


query("weighted_forecast", f"{FULL} SELECT symbol, t, horizon, {sql.r6('p_up', 'p_up')} FROM mx")(lambda spark, d: shown(_mixed(spark, d), "p_up", keys=("symbol", "t", "horizon")))
query(
    "calibration_bins",
    f"""{FULL}, kb AS (SELECT symbol, horizon, CAST(least(9, floor(p_up * 10)) AS INT) AS bin, p_up, up FROM mx WHERE i > 80 AND up IS NOT NULL), ct AS (SELECT symbol, horizon, bin, count(*) AS n, count(*) FILTER (up) AS positives, avg(p_up) AS a FROM kb GROUP BY 1, 2, 3),
    dm AS (SELECT DISTINCT symbol, horizon, bin.bin FROM kb k, (SELECT CAST(unnest(range(10)) AS INT) AS bin) bin)
    SELECT symbol, horizon, bin, coalesce(n, 0) AS n, coalesce(positives, 0) AS positives, {sql.r6('coalesce(a, (bin + 0.5) / 10)', 'avg_pred')}, {sql.r6('CASE WHEN n > 0 THEN (positives + 1) / (n + 2.0) ELSE (bin + 0.5) / 10 END', 'observed')} FROM dm LEFT JOIN ct USING (symbol, horizon, bin)""",
)(lambda spark, d: shown(fc.calibration_bins(_mixed(spark, d)), "avg_pred", "observed", keys=("symbol", "horizon", "bin", "n", "positives")))
# the isotonic fit of ten bins is the largest of the smallest weighted means of bins i to j around a bin
CURVE = """cu AS (SELECT symbol, horizon, bin, coalesce(a, (bin + 0.5) / 10) AS x, CASE WHEN n > 0 THEN (positives + 1) / (n + 2.0) ELSE (bin + 0.5) / 10 END AS v, greatest(CAST(coalesce(n, 0) AS DOUBLE), 0.001) AS w FROM dm LEFT JOIN ct USING (symbol, horizon, bin)),
    mn AS (SELECT l.symbol, l.horizon, l.bin AS i, r.bin AS j, sum(m.v * m.w) / sum(m.w) AS y FROM cu l JOIN cu r ON r.symbol = l.symbol AND r.horizon = l.horizon AND r.bin >= l.bin JOIN cu m ON m.symbol = l.symbol AND m.horizon = l.horizon AND m.bin BETWEEN l.bin AND r.bin GROUP BY ALL),
    lw AS (SELECT c.symbol, c.horizon, c.bin, mn.i, min(mn.y) AS y FROM cu c JOIN mn ON mn.symbol = c.symbol AND mn.horizon = c.horizon AND mn.i <= c.bin AND mn.j >= c.bin GROUP BY ALL),
    iso AS (SELECT lw.symbol, lw.horizon, lw.bin, any_value(cu.x) AS x, greatest(0.01, least(0.99, max(lw.y))) AS y FROM lw JOIN cu USING (symbol, horizon, bin) GROUP BY ALL)"""
_BINNED = """kb AS (SELECT symbol, horizon, CAST(least(9, floor(p_up * 10)) AS INT) AS bin, p_up, up FROM mx WHERE i > 80 AND up IS NOT NULL), ct AS (SELECT symbol, horizon, bin, count(*) AS n, count(*) FILTER (up) AS positives, avg(p_up) AS a FROM kb GROUP BY 1, 2, 3),
    dm AS (SELECT DISTINCT symbol, horizon, bin.bin FROM kb k, (SELECT CAST(unnest(range(10)) AS INT) AS bin) bin)"""
CALIBRATED = f"""{_BINNED}, {CURVE}, pt AS (SELECT symbol, horizon, list({{'x': x, 'y': y}} ORDER BY x, y) AS pts FROM iso GROUP BY 1, 2),
    ca AS (SELECT mx.*, pts, list_filter(pts, lambda q: q.x <= p_up)[-1] AS lo, list_filter(pts, lambda q: q.x >= p_up)[1] AS hi FROM mx LEFT JOIN pt USING (symbol, horizon)),
    cal AS (SELECT *, CASE WHEN pts IS NULL THEN p_up WHEN lo IS NULL THEN hi.y WHEN hi IS NULL THEN lo.y ELSE greatest(0.01, least(0.99, lo.y + (hi.y - lo.y) * (p_up - lo.x) / greatest(hi.x - lo.x, 1e-6))) END AS p_calibrated FROM ca)"""
query("calibration_curve", f"{FULL}, {_BINNED}, {CURVE} SELECT symbol, horizon, CAST(row_number() OVER (PARTITION BY symbol, horizon ORDER BY x, y) - 1 AS INT) AS pos, round(x, 6) AS x, round(y, 6) AS y FROM iso")(lambda spark, d: fc.calibration(_mixed(spark, d)).select("symbol", "horizon", F.posexplode("points").alias("pos", "p")).select("symbol", "horizon", "pos", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")))
query("calibrated_forecast", f"{FULL}, {CALIBRATED} SELECT symbol, t, horizon, {sql.r6('p_up', 'p_up')}, {sql.r6('p_calibrated', 'p_calibrated')} FROM cal")(lambda spark, d: shown(fc.forecasts(events(spark, d)), "p_up", "p_calibrated", keys=("symbol", "t", "horizon")))
_CUT = "WHERE i > 80 AND up IS NOT NULL AND i >= newest - 300"
_PRIOR = "greatest(0.02, least(0.98, " + " + ".join(f"p_{m} * {p}" for m, p in fc.PRIOR.items()) + "))"


def _walked(source: str, p: str) -> str:
    return f"wf AS (SELECT *, {p} AS pw, max(i) OVER (PARTITION BY symbol) AS newest FROM {source}) SELECT symbol, horizon, count(*) FILTER ((pw >= 0.5) = up) AS hits, count(*) AS total, {sql.r6('count(*) FILTER ((pw >= 0.5) = up) / CAST(count(*) AS DOUBLE)', 'accuracy')} FROM wf {_CUT} GROUP BY 1, 2"


query("walk_forward_accuracy", f"{HEAD}{votes(NOFLAT)}, {STATS}, {PROB}, {_walked('pb', _PRIOR)}")(lambda spark, d: shown(fc.walk_forward(fc.prior_weighted(fc.probabilities(_stats(spark, d)))), "accuracy", keys=("symbol", "horizon", "hits", "total")))
query("walk_forward_with_table", f"{FULL}, {CALIBRATED}, {_walked('cal', 'p_calibrated')}")(lambda spark, d: shown(fc.walk_forward(fc.forecasts(events(spark, d)), p="p_calibrated"), "accuracy", keys=("symbol", "horizon", "hits", "total")))
ACCURACY = "wl AS (SELECT symbol, horizon, 'signal' AS model, w_signal AS w FROM wt UNION ALL SELECT symbol, horizon, 'drift', w_drift FROM wt UNION ALL SELECT symbol, horizon, 'regime', w_regime FROM wt), wa AS (SELECT symbol, horizon, greatest(0, least(1, sum(ewma_accuracy * w) / sum(w))) AS accuracy FROM wl JOIN pf USING (symbol, horizon, model) WHERE w > 0 GROUP BY 1, 2)"
query("weighted_accuracy", f"{HEAD}{votes(NOFLAT)}, {STATS}, {PROB}, {PERF}, {WEIGHT}, {ACCURACY} SELECT symbol, horizon, {sql.r6('accuracy', 'accuracy')} FROM wa")(lambda spark, d: _weighted_accuracy(spark, d))


def _weighted_accuracy(spark, d):
    perf = fc.performance(fc.probabilities(_stats(spark, d)))
    return shown(fc.accuracy_of_weights(perf, fc.weights(perf)), "accuracy", keys=("symbol", "horizon"))


EXPECTED = f"""xp AS (SELECT symbol, t, horizon, c * exp(0.25 * (greatest(0.05, least(0.95, 0.5 + bias * 0.24 / sqrt(horizon))) - 0.5) * 2 * volatility * sqrt(horizon) + 0.45 * drift_move * horizon + 0.3 * regime_move * least(horizon, 5)) AS expected,
        CASE WHEN atr_latest > 0 THEN atr_latest ELSE greatest(abs(c) * 0.001, 0.00001) END * sqrt(horizon) AS wd FROM st, (SELECT unnest([1, 5, 20]) AS horizon) hz),
    xb AS (SELECT *, greatest(0, expected - wd) AS low, expected + wd AS high, greatest(0, expected - 2 * wd) AS low2, expected + 2 * wd AS high2 FROM xp)"""
_X = ", ".join(sql.r6(x, x) for x in ("expected", "low", "high", "low2", "high2"))


@query("expected_prices", f"{HEAD}{votes(NOFLAT)}, {STATS}, {EXPECTED} SELECT symbol, t, horizon, {_X} FROM xb")
def _(spark, d):
    stats = fc.model_stats(ind.latest_atr(sg.score(events(spark, d))))
    return shown(fc.expected_prices(stats), "expected", "low", "high", "low2", "high2", keys=("symbol", "t", "horizon"))


@query("journal_summary", f"{FULL} SELECT horizon, count(*) AS entries, count(up) AS resolved, count(*) FILTER ((round(p_up, 6) >= 0.5) = up) AS hits, {sql.r6('count(*) FILTER ((round(p_up, 6) >= 0.5) = up) / CAST(nullif(count(up), 0) AS DOUBLE)', 'accuracy')} FROM mx GROUP BY 1")
def _(spark, d):
    bars = events(spark, d)
    journal = _mixed(spark, d).select("symbol", "tf", "t", "horizon", F.round("p_up", 6).alias("p_up"))
    return shown(fc.journal_summary(fc.reconcile_journal(journal, bars)), "accuracy", keys=("horizon", "entries", "resolved", "hits"))
