"""Queries over bars of ``events`` and ``orders``: sources, indicators, entry conditions; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import rounded
from barloom.operators import asof, conditions
from barloom.operators import indicators as ind
from barloom.operators import recurrent as rec
from barloom.plans import sql
from barloom.sources import bars as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def shown(df: DataFrame, *values: str, keys: tuple[str, ...] = ("symbol", "t"), digits: int = 6) -> DataFrame:
    return df.select(*keys, *(rounded(F.col(v), digits).alias(v) for v in values))


# -- bars -----------------------------------------------------------------------

PRICES = ", ".join(sql.r6(x, x) for x in "ohlcv")

for _tf in src.SECONDS:
    query(f"bars_{_tf}", f"WITH {sql.bars(src.SECONDS[_tf])} SELECT symbol, t, {PRICES} FROM bars")(lambda spark, d, tf=_tf: shown(src.event_bars(spark, d, tf), *"ohlcv"))

query("bars_orders_d1", f"WITH {sql.ORDER_BARS} SELECT symbol, t, {PRICES} FROM bars")(lambda spark, d: shown(src.order_bars(spark, d), *"ohlcv"))


def _resampled(step: int) -> str:
    return f"(SELECT symbol, (t // {step}) * {step} AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c, sum(v) AS v, count(*) AS n FROM bars GROUP BY 1, (t // {step}) * {step})"


@query("resample_h1_to_h4", f"WITH {sql.bars()} SELECT symbol, t, {PRICES} FROM {_resampled(14400)}")
def _(spark, d):
    return shown(src.resample(src.event_bars(spark, d), "h4"), *"ohlcv")


@query("resample_h4_complete_tail", f"WITH {sql.bars()}, x AS {_resampled(14400)} SELECT symbol, t, {PRICES} FROM x QUALIFY t < max(t) OVER (PARTITION BY symbol) OR n >= 4")
def _(spark, d):
    return shown(src.resample(src.event_bars(spark, d), "h4", parts=4), *"ohlcv")


@query("resample_h1_to_d1_closed", f"WITH {sql.bars()}, x AS {_resampled(86400)} SELECT symbol, t, {PRICES} FROM x WHERE t + 86400 <= 1706000000")
def _(spark, d):
    return shown(src.resample(src.event_bars(spark, d), "d1", complete_before=1706000000), *"ohlcv")


@query("repair_daily_close", f"WITH {sql.bars(86400)} SELECT symbol, t, {sql.r6('o', 'o')}, {sql.r6('n', 'c')} FROM (SELECT *, lead(o) {sql.S} AS n FROM bars) WHERE n IS NOT NULL")
def _(spark, d):
    return shown(src.repair_closes(src.event_bars(spark, d, "d1")), "o", "c")


@query("tail_bars", f"WITH {sql.bars()} SELECT symbol, t, {sql.r6('c', 'c')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) <= 100")
def _(spark, d):
    return shown(src.tail(src.event_bars(spark, d), 100), "c")


@query(
    "append_only_merge",
    f"""WITH {sql.bars()}, cut AS (SELECT min(t) + 400000 AS upto FROM bars), old AS (SELECT bars.* FROM bars, cut WHERE t <= upto), newest AS (SELECT symbol, max(t) AS last FROM old GROUP BY 1),
    new AS (SELECT b.* REPLACE (b.c + 1 AS c) FROM bars b LEFT JOIN newest n ON b.symbol = n.symbol WHERE n.last IS NULL OR b.t >= n.last)
    SELECT symbol, t, {sql.r6('c', 'c')} FROM (SELECT symbol, t, c FROM new UNION ALL SELECT symbol, t, c FROM old ANTI JOIN new USING (symbol, t))""",
)
def _(spark, d):
    every = src.event_bars(spark, d)
    at = every.agg((F.min("t") + 400000).alias("at"))
    old = every.crossJoin(F.broadcast(at)).where("t <= at").drop("at")
    return shown(src.merge_append_only(old, every.withColumn("c", F.col("c") + 1)), "c")


@query("validate_bars", f"WITH {sql.bars()} SELECT symbol, CAST(count(*) FILTER (h < l) AS BIGINT) AS bad_rows, count(*) AS rows, count(*) < 300 AS too_few FROM bars GROUP BY 1")
def _(spark, d):
    return src.violations(src.event_bars(spark, d), {"h1": 300}).drop("tf")


@query(
    "normalise_feed",
    """WITH raw AS (SELECT o_orderpriority AS symbol, o_orderkey AS seq, epoch_us(o_orderdate) // 1000000 AS t, o_totalprice AS c, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o,
        o_totalprice + 1 AS h, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 2 ELSE o_totalprice - 1 END AS l FROM orders),
    good AS (SELECT * FROM raw WHERE o IS NOT NULL AND h >= l AND o > 0 AND c > 0)
    SELECT symbol, t, round(last(o ORDER BY seq), 6) AS o, round(last(c ORDER BY seq), 6) AS c FROM good GROUP BY 1, 2""",
)
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    price = F.col("o_totalprice")
    seconds = src.unix_seconds("o_orderdate")
    raw = orders.select(
        F.col("o_orderpriority").alias("symbol"), F.lit("d1").alias("tf"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, seconds * 1000).otherwise(seconds).cast("string").alias("timestamp"),
        F.when(F.col("o_orderkey") % 7 != 0, price).cast("string").alias("open"), (price + 1).cast("string").alias("high"), F.when(F.col("o_orderkey") % 11 == 0, price + 2).otherwise(price - 1).cast("string").alias("low"),
        price.cast("string").alias("close"), F.lit("x").alias("volume"),
    )
    return shown(src.normalise(raw), "o", "c")


# -- native indicators -------------------------------------------------------------

_SMA = "WITH {b} SELECT symbol, t, {v} FROM bars"


def _native(name: str, add: Callable[[DataFrame], DataFrame], outputs: list[str], ctes: str, daily: bool = False, digits: int = 6) -> None:
    """``ctes`` ends with a table x that has the outputs."""
    base = sql.ORDER_BARS if daily else sql.bars()
    text = f"WITH {base}, {ctes} SELECT symbol, t, {', '.join(sql.r6(o, o, digits) for o in outputs)} FROM x"
    query(name, text)(lambda spark, d: shown(add(src.order_bars(spark, d) if daily else src.event_bars(spark, d)), *outputs, digits=digits))


TR = f"tr AS (SELECT *, CASE WHEN {sql.lag('c')} IS NOT NULL THEN greatest(h - l, abs(h - {sql.lag('c')}), abs(l - {sql.lag('c')})) END AS tr FROM bars)"
SMA = {n: f"x AS (SELECT *, {sql.frame('avg', 'c', n)} AS sma{n} FROM bars)" for n in (20, 50)}
BOLL = f"m AS (SELECT *, {sql.frame('avg', 'c', 20)} AS bb_mid, {sql.frame('stddev_pop', 'c', 20)} AS dev FROM bars), x AS (SELECT *, bb_mid + 2 * dev AS bb_upper, bb_mid - 2 * dev AS bb_lower FROM m)"
ATR = f"{TR}, x AS (SELECT *, {sql.frame('avg', 'tr', 14)} AS atr FROM tr)"
ENV = f"m AS (SELECT *, CASE WHEN row_number() {sql.S} > 20 THEN {sql.frame('avg', 'c', 20)} END AS mid FROM bars), x AS (SELECT *, mid * 1.0053 AS env_upper, mid * 0.9947 AS env_lower FROM m)"
DEM = f"""d AS (SELECT *, greatest(h - {sql.lag('h')}, CASE WHEN {sql.lag('h')} IS NOT NULL THEN 0 END) AS u, greatest({sql.lag('l')} - l, CASE WHEN {sql.lag('l')} IS NOT NULL THEN 0 END) AS w FROM bars),
    s AS (SELECT *, {sql.frame('avg', 'u', 14)} AS su, {sql.frame('avg', 'w', 14)} AS sw FROM d), x AS (SELECT *, CASE WHEN su + sw > 0 THEN su / (su + sw) END AS demarker FROM s)"""
DEM = DEM.replace("greatest(h - ", "CASE WHEN " + sql.lag("h") + " IS NULL THEN NULL ELSE greatest(h - ").replace(f", CASE WHEN {sql.lag('h')} IS NOT NULL THEN 0 END) AS u", ", 0) END AS u").replace("greatest(" + sql.lag("l"), "CASE WHEN " + sql.lag("l") + " IS NULL THEN NULL ELSE greatest(" + sql.lag("l")).replace(f", CASE WHEN {sql.lag('l')} IS NOT NULL THEN 0 END) AS w", ", 0) END AS w")
MOM = f"p AS (SELECT *, lag(c, 14) {sql.S} AS q FROM bars), x AS (SELECT *, CASE WHEN q > 0 AND c > 0 THEN c / q * 100 END AS momentum FROM p)"
AO = f"m AS (SELECT *, (h + l) / 2 AS m FROM bars), x AS (SELECT *, {sql.frame('avg', 'm', 5)} - {sql.frame('avg', 'm', 34)} AS ao FROM m)"
_SW = "({0} + 2 * lag({0}, 1) {1} + 2 * lag({0}, 2) {1} + lag({0}, 3) {1}) / 6"
RVI = f"""d AS (SELECT *, c - o AS bo, h - l AS ra FROM bars), n AS (SELECT *, {_SW.format('bo', sql.S)} AS nu, {_SW.format('ra', sql.S)} AS de FROM d),
    s AS (SELECT *, {sql.frame('sum', 'nu', 10)} AS sn, {sql.frame('sum', 'de', 10)} AS sd FROM n), r AS (SELECT *, CASE WHEN sd <> 0 THEN sn / sd END AS rvi FROM s), x AS (SELECT *, {_SW.format('rvi', sql.S)} AS rvi_signal FROM r)"""
CCI = f"""p AS (SELECT *, (h + l + c) / 3 AS p FROM bars), w AS (SELECT *, {sql.frame('avg', 'p', 20)} AS m, list(p) {sql.over(20)} AS w FROM p),
    e AS (SELECT *, list_sum(list_transform(w, lambda z: abs(z - m))) / 20 AS e FROM w), x AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN e = 0 THEN 0 ELSE (p - m) / (0.015 * e) END AS cci FROM e)"""
DON = f"x AS (SELECT *, {sql.frame('max', 'h', 20, 1)} AS don_upper, {sql.frame('min', 'l', 20, 1)} AS don_lower FROM bars)"
_K = f"g AS (SELECT *, {sql.frame('max', 'h', 14)} AS hi, {sql.frame('min', 'l', 14)} AS lo FROM bars), k AS (SELECT *, CASE WHEN hi IS NULL THEN NULL WHEN hi = lo THEN 50 ELSE (c - lo) / (hi - lo) * 100 END AS k FROM g)"
STO = f"{_K}, y AS (SELECT *, {sql.frame('avg', 'k', 3)} AS stoch_k FROM k), x AS (SELECT *, {sql.frame('avg', 'stoch_k', 3)} AS stoch_d FROM y)"
STF = STO.replace("stoch_", "stochf_")


def _mid(n: int) -> str:
    return f"CASE WHEN count(h) {sql.over(n)} = {n} THEN (max(h) {sql.over(n)} + min(l) {sql.over(n)}) / 2 END"


ICH = f"y AS (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS sb FROM bars), x AS (SELECT *, lag((tenkan + kijun) / 2, 26) {sql.S} AS span_a, lag(sb, 26) {sql.S} AS span_b FROM y)"

_native("sma20", lambda b: ind.sma(b, 20), ["sma20"], SMA[20])
_native("sma50_orders", lambda b: ind.sma(b, 50), ["sma50"], SMA[50], daily=True)
_native("bollinger", ind.bollinger, ["bb_mid", "bb_upper", "bb_lower"], BOLL)
_native("atr", ind.atr, ["tr", "atr"], ATR)
_native("atr_latest", ind.latest_atr, ["atr_latest"], f"{TR}, x AS (SELECT *, avg(tr) {sql.over(14)} AS atr_latest FROM tr)")
_native("envelope", lambda b: ind.envelope(b, 20, 0.53), ["env_upper", "env_lower"], ENV, digits=9)  # the values have eight decimals: six could tie
_native("demarker", ind.demarker, ["demarker"], DEM)
_native("momentum", ind.momentum, ["momentum"], MOM)
_native("ao", ind.ao, ["ao"], AO)
_native("rvi", ind.rvi, ["rvi", "rvi_signal"], RVI)
_native("cci", ind.cci, ["cci"], CCI)
_native("donchian", ind.donchian, ["don_upper", "don_lower"], DON)
_native("stochastic", ind.stochastic, ["stoch_k", "stoch_d"], STO)
_native("stochastic_fresh", ind.stochastic_fresh, ["stochf_k", "stochf_d"], STF)
_native("ichimoku", ind.ichimoku, ["tenkan", "kijun", "span_a", "span_b"], ICH)
_native("ichimoku_orders", ind.ichimoku, ["tenkan", "kijun", "span_a", "span_b"], ICH, daily=True)

query(
    "ichimoku_future",
    f"""WITH {sql.bars()}, y AS (SELECT *, {_mid(9)} AS tenkan, {_mid(26)} AS kijun, {_mid(52)} AS span_b, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n, max(t) OVER (PARTITION BY symbol) AS newest FROM bars)
    SELECT symbol, newest + 3600 * (27 - n) AS t, round((tenkan + kijun) / 2, 6) + 0.0 AS span_a, round(span_b, 6) + 0.0 AS span_b FROM y WHERE n <= 26""",
)(lambda spark, d: shown(ind.ichimoku_future(src.event_bars(spark, d), 3600), "span_a", "span_b"))

# -- recurrences --------------------------------------------------------------------


def _recursive(name: str, add: Callable[[DataFrame], DataFrame], outputs: list[str], ctes: str) -> None:
    text = f"WITH RECURSIVE {sql.bars()}, {sql.numbered()}, {ctes} SELECT symbol, t, {', '.join(sql.r6(o, o) for o in outputs)} FROM x"
    query(name, text)(lambda spark, d: shown(add(src.event_bars(spark, d)), *outputs))


EMA20 = f"{sql.ema('e', 20)}, x AS (SELECT b.*, e.y AS ema20 FROM b LEFT JOIN e USING (symbol, i))"
RSI14 = f"{sql.rsi('r', 14)}, x AS (SELECT b.*, {sql.RSI_VALUE} AS rsi FROM b LEFT JOIN r USING (symbol, i))".replace("CASE WHEN g = 0", "CASE WHEN g IS NULL THEN NULL WHEN g = 0")
MACD = f"""{sql.ema('ef', 12)}, {sql.ema('es', 26)}, ml AS (SELECT b.*, ef.y - es.y AS macd FROM b LEFT JOIN ef USING (symbol, i) LEFT JOIN es USING (symbol, i)), {sql.ema('eg', 9, 'macd', 'ml')},
    x AS (SELECT ml.*, eg.y AS macd_signal, macd - eg.y AS macd_hist FROM ml LEFT JOIN eg USING (symbol, i))"""
ADX = f"""{sql.adx('a', 14)}, x AS (SELECT b.*, CASE WHEN b.i > 14 THEN a.p END AS plus_di, CASE WHEN b.i > 14 THEN a.m END AS minus_di, CASE WHEN b.i > 28 THEN a.y END AS adx FROM b LEFT JOIN a USING (symbol, i))"""
ALLI = f"""bm AS (SELECT *, (h + l) / 2 AS m FROM b), {sql.smma('sj', 13, 'm', 'bm')}, {sql.smma('st', 8, 'm', 'bm')}, {sql.smma('sl', 5, 'm', 'bm')},
    x AS (SELECT b.*, sj.y AS jaw, st.y AS teeth, sl.y AS lips FROM b LEFT JOIN sj ON sj.symbol = b.symbol AND sj.i = b.i - 8 LEFT JOIN st ON st.symbol = b.symbol AND st.i = b.i - 5 LEFT JOIN sl ON sl.symbol = b.symbol AND sl.i = b.i - 3)"""
KELT = f"""{sql.ema('e', 20)}, tr AS (SELECT *, CASE WHEN {sql.lag('c')} IS NOT NULL THEN greatest(h - l, abs(h - {sql.lag('c')}), abs(l - {sql.lag('c')})) END AS tr FROM b), ar AS (SELECT *, {sql.frame('avg', 'tr', 10)} AS atr FROM tr),
    x AS (SELECT ar.*, e.y + 2 * atr AS kelt_upper, e.y - 2 * atr AS kelt_lower FROM ar LEFT JOIN e USING (symbol, i))"""

_recursive("ema20", lambda b: rec.ema(b, 20), ["ema20"], EMA20)
_recursive("rsi14", rec.rsi, ["rsi"], RSI14)
_recursive("rsi_noflat", lambda b: rec.rsi(b, flat=False), ["rsi_noflat"], RSI14.replace("WHEN g = 0 AND s = 0 THEN 50 ", "").replace("CASE WHEN g IS NULL THEN NULL WHEN s = 0", "CASE WHEN g IS NULL THEN NULL WHEN s = 0").replace("AS rsi ", "AS rsi_noflat "))
_recursive("macd", rec.macd, ["macd", "macd_signal", "macd_hist"], MACD)
_recursive("adx", rec.adx, ["plus_di", "minus_di", "adx"], ADX)
_recursive("alligator", rec.alligator, ["jaw", "teeth", "lips"], ALLI)
_recursive("keltner", rec.keltner, ["kelt_upper", "kelt_lower"], KELT)
_SAR = f"WITH RECURSIVE {sql.bars()}, {sql.numbered()}, {sql.sar()}"
query("parabolic_sar", f"{_SAR} SELECT symbol, t, {sql.r6('sar', 'sar')}, {sql.r6('CAST(sar_long AS INT)', 'sar_long')} FROM x")(lambda spark, d: shown(rec.parabolic_sar(src.event_bars(spark, d)).withColumn("sar_long", F.col("sar_long").cast("int")), "sar", "sar_long"))

# -- entry conditions ------------------------------------------------------------------


def _condition(kind: str, ctes: str, long: str, short: str, recursive: bool = False, **parameters) -> None:
    head = f"WITH RECURSIVE {sql.bars()}, {sql.numbered()}, {ctes}" if recursive else f"WITH {sql.bars()}, {ctes}"
    later = f"{sql.lag('t')} IS NOT NULL"
    text = f"{head} SELECT symbol, t, {later} AND coalesce({long}, false) AS long, {later} AND coalesce({short}, false) AS short FROM x"
    query(f"cond_{kind}", text)(lambda spark, d: conditions.signals(src.event_bars(spark, d), [{"type": kind} | parameters]).select("symbol", "t", "long", "short"))


_condition("maCross", f"x AS (SELECT *, {sql.frame('avg', 'c', 20)} AS f, {sql.frame('avg', 'c', 50)} AS s FROM bars)", sql.up("f", "s"), sql.down("f", "s"))
_condition("rsi", RSI14, f"{sql.lag('rsi')} > 30 AND rsi <= 30", f"{sql.lag('rsi')} < 70 AND rsi >= 70", True, comparison="crossBelow")
_condition("demarker", DEM, "demarker <= 0.3", "demarker >= 0.7")
_condition("bollinger", BOLL, "l <= bb_lower", "h >= bb_upper")
_condition("envelope", ENV, sql.up("c", "env_upper"), sql.down("c", "env_lower"), deviation=0.53)
_condition("macdCross", MACD, sql.up("macd", "macd_signal"), sql.down("macd", "macd_signal"), True)
_condition("ichimokuCross", ICH, f"{sql.up('tenkan', 'kijun')} AND c > CASE WHEN span_a IS NOT NULL AND span_b IS NOT NULL THEN greatest(span_a, span_b) END", f"{sql.down('tenkan', 'kijun')} AND c < CASE WHEN span_a IS NOT NULL AND span_b IS NOT NULL THEN least(span_a, span_b) END", cloud=True)
_condition("donchianBreak", DON, "c > don_upper", "c < don_lower")
_condition("keltnerBreak", KELT, "atr > 0 AND c >= kelt_upper", "atr > 0 AND c <= kelt_lower", True)
_condition("cciBreak", CCI, "cci >= 100", "cci <= -100")
_condition("adxTrend", ADX, f"adx >= 20 AND {sql.up('plus_di', 'minus_di')}", f"adx >= 20 AND {sql.down('plus_di', 'minus_di')}", True)
_condition("momentum", MOM, sql.up("momentum", "100"), sql.down("momentum", "100"))
_condition("ao", AO, sql.up("ao", "0"), sql.down("ao", "0"))
_condition("rvi", RVI, sql.up("rvi", "rvi_signal"), sql.down("rvi", "rvi_signal"))
_condition("stochastic", STO, "stoch_k <= 20", "stoch_k >= 80")
_condition("stochCross", STF, sql.up("stochf_k", "stochf_d"), sql.down("stochf_k", "stochf_d"))
_condition("alligator", ALLI, f"{sql.up('lips', 'teeth')} AND teeth > jaw", f"{sql.down('lips', 'teeth')} AND teeth < jaw", True)
query("cond_parabolicSar", f"{_SAR} SELECT symbol, t, coalesce(sar_long AND NOT {sql.lag('sar_long')}, false) AS long, coalesce(NOT sar_long AND {sql.lag('sar_long')}, false) AS short FROM x")(lambda spark, d: conditions.signals(src.event_bars(spark, d), [{"type": "parabolicSar"}]).select("symbol", "t", "long", "short"))


@query(
    "cross_counts",
    f"WITH {sql.bars()}, x AS (SELECT *, {sql.frame('avg', 'c', 20)} AS f, {sql.frame('avg', 'c', 50)} AS s FROM bars), y AS (SELECT symbol, {sql.up('f', 's')} AS up, {sql.down('f', 's')} AS dn FROM x) SELECT symbol, count(*) FILTER (up) AS golden, count(*) FILTER (dn) AS dead, count(*) AS bars FROM y GROUP BY 1",
)
def cross_counts(spark, d):
    """Golden and dead crosses of two means per symbol."""
    crossed = conditions.signals(src.event_bars(spark, d), [{"type": "maCross"}])
    return crossed.groupBy("symbol").agg(F.count_if("long").alias("golden"), F.count_if("short").alias("dead"), F.count("*").alias("bars"))


@query(
    "session_filter",
    f"WITH {sql.bars()} SELECT symbol, count(*) FILTER ((t // 60 + 540) % 1440 >= 1320 OR (t // 60 + 540) % 1440 < 390) AS inside, count(*) FILTER ((t // 60) % 1440 >= 480 AND (t // 60) % 1440 < 1020) AS day FROM bars GROUP BY 1",
)
def _(spark, d):
    t = F.col("t")
    return src.event_bars(spark, d).groupBy("symbol").agg(F.count_if(conditions.in_session(t, "22:00", "06:30", 540)).alias("inside"), F.count_if(conditions.in_session(t, "08:00", "17:00")).alias("day"))


# -- joins ----------------------------------------------------------------------------------


@query(
    "asof_backward_h4_on_h1",
    f"WITH {sql.bars()}, {sql.bars(14400, 'wide')}, w AS (SELECT symbol, t + 14400 AS closed, c FROM wide) SELECT b.symbol, b.t, {sql.r6('b.c', 'c')}, {sql.r6('w.c', 'c_asof')} FROM bars b ASOF LEFT JOIN w ON b.symbol = w.symbol AND b.t >= w.closed",
)
def _(spark, d):
    wide = src.event_bars(spark, d, "h4").select("symbol", (F.col("t") + 14400).alias("closed"), "c")
    return shown(asof.backward(src.event_bars(spark, d).select("symbol", "t", "c"), wide, ["symbol"], "t", "closed", ["c"]), "c", "c_asof")


@query(
    "asof_nearest",
    f"""WITH {sql.bars()}, {sql.bars(86400, 'day')}, e AS (SELECT symbol, t, c FROM bars), f AS (SELECT e.*, d.t AS bt, d.c AS bc FROM e ASOF LEFT JOIN day d ON e.symbol = d.symbol AND e.t >= d.t),
    g AS (SELECT f.*, d.t AS nt, d.c AS ac FROM f ASOF LEFT JOIN day d ON f.symbol = d.symbol AND f.t <= d.t)
    SELECT symbol, t, {sql.r6('CASE WHEN bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t) THEN bc ELSE ac END', 'c_nearest')} FROM g""",
)
def _(spark, d):
    left = src.event_bars(spark, d).select("symbol", "t")
    days = src.event_bars(spark, d, "d1").select("symbol", F.col("t").alias("day"), "c")
    return shown(asof.nearest(left, days, ["symbol"], "t", "day", "c"), "c_nearest")


@query(
    "interval_events",
    """WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS time FROM events), n AS (SELECT min(time) + 86400 AS now FROM e) SELECT event_id, time FROM e, n WHERE time > now AND time <= now + 172800""",
)
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", src.unix_seconds("ts").alias("time"))
    now = events.agg(F.min("time")).first()[0]
    return asof.within_next(events, (now or 0) + 86400, 172800)


@query(
    "span_semi_join",
    f"""WITH {sql.bars()}, {sql.bars(86400, 'day')}, s AS (SELECT symbol, min(t) + 864000 AS first_t, max(t) - 864000 AS last_t FROM day GROUP BY 1) SELECT b.symbol, b.t, {sql.r6('c', 'c')} FROM bars b JOIN s ON b.symbol = s.symbol AND b.t BETWEEN first_t AND last_t""",
)
def _(spark, d):
    spans = src.event_bars(spark, d, "d1").groupBy("symbol").agg((F.min("t") + 864000).alias("first_t"), (F.max("t") - 864000).alias("last_t"))
    return shown(asof.within_span(src.event_bars(spark, d), spans, ["symbol"]), "c")
