"""Queries over the supplementary operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import asof, conditions, history
from barloom.operators import backtest as bt
from barloom.operators import forecast as fc
from barloom.operators import indicators as ind
from barloom.operators import ledger
from barloom.operators import signals as sg
from barloom.operators import supplement as sp
from barloom.operators.tuning import PROFILES
from barloom.plans import sql
from barloom.plans.analysis import _LV, EXPECTED, HEAD, NOFLAT, STATS, votes
from barloom.plans.series import ORACLES, query, shown
from barloom.plans.trading import _SIM, TRADES, _simulated, order_trades
from barloom.sources import bars as src
from barloom.sources import scratch

REGISTERED = 1705276800


@query("registration_split", f"WITH {sql.bars()}, x AS (SELECT symbol, CASE WHEN t >= {REGISTERED} THEN 'forward' WHEN t >= {REGISTERED} - 63072000 THEN 'reference' END AS part FROM bars) SELECT symbol, part, count(*) AS n FROM x WHERE part IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return sp.registration_split(src.event_bars(spark, d), REGISTERED).groupBy("symbol", "part").agg(F.count("*").alias("n"))


@query("reference_window", f"WITH {sql.bars()} SELECT symbol, t, {sql.r6('c', 'c')} FROM bars WHERE t >= {REGISTERED} - 63676800 AND t < {REGISTERED}")
def _(spark, d):
    return shown(sp.reference_window(src.event_bars(spark, d), REGISTERED), "c")


@query("coverage_before_registration", f"WITH {sql.bars()} SELECT symbol, count(*) FILTER (t < {REGISTERED}) AS bars_before, {sql.r6(f'coalesce((max(t) FILTER (t < {REGISTERED}) - min(t) FILTER (t < {REGISTERED})) / 86400.0, 0)', 'days_before')}, {sql.r6('(max(t) - min(t)) / 86400.0', 'span_days')} FROM bars GROUP BY 1")
def _(spark, d):
    return shown(sp.coverage(src.event_bars(spark, d), REGISTERED), "days_before", "span_days", keys=("symbol", "bars_before"))


@query("price_change", f"WITH {sql.bars(86400)} SELECT symbol, t, {sql.r6('c - ' + sql.lag('c'), 'change')}, {sql.r6('(c - ' + sql.lag('c') + ') / nullif(' + sql.lag('c') + ', 0) * 100', 'change_pct')} FROM bars")
def _(spark, d):
    return shown(sp.price_change(src.event_bars(spark, d, "d1")), "change", "change_pct")


@query("month_spine", f"WITH {sql.ORDER_BARS}, s AS (SELECT symbol, date_trunc('month', make_timestamp(CAST(min(t) * 1000000 AS BIGINT))) AS a, date_trunc('month', make_timestamp(CAST(max(t) * 1000000 AS BIGINT))) AS z FROM bars GROUP BY 1) SELECT symbol, strftime(unnest(generate_series(CAST(greatest(a, z - INTERVAL 11 MONTH) AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM s")
def _(spark, d):
    return sp.month_spine(src.order_bars(spark, d)).drop("tf")


@query("latest_trades", f"WITH {TRADES}, x AS (SELECT run_id, symbol, id, row_number() OVER (PARTITION BY run_id, symbol ORDER BY exit_time DESC, id DESC) AS place FROM tr) SELECT * FROM x WHERE place <= 50")
def _(spark, d):
    return sp.latest_trades(order_trades(spark, d)).select("run_id", "symbol", "id", F.col("place").cast("long").alias("place"))


_LIST = lambda values: "(SELECT unnest(range(" + str(len(values)) + ")) AS no, unnest([" + ", ".join(f"'{v}'" for v in values) + "]) AS x)"


_KINDS = [(k, i, tf, j) for i, (k, p) in enumerate(PROFILES.items()) for j, tf in enumerate(p.timeframes)]
_KIND_ROWS = ", ".join(f"('{k}', {i}, '{tf}', {j}, '{conditions.label(PROFILES[k].condition)}')" for k, i, tf, j in _KINDS)


@query(
    "candidate_matrix",
    f"""WITH s AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS no FROM (SELECT DISTINCT event_type AS symbol FROM events)) SELECT symbol, kind, tf, 1783100000 + kind_no // 10 * 100000 + no * 100 + kind_no % 10 * 10 + tf_no AS magic, label
    FROM s, (VALUES {_KIND_ROWS}) v(kind, kind_no, tf, tf_no, label)""",
)
def _(spark, d):
    """Every traded symbol of the tape with every entry profile, its label and number."""
    symbols = _events(spark, d).select(F.col("event_type").alias("symbol"))
    found = sp.candidates(symbols, {k: p.timeframes for k, p in PROFILES.items()})
    labels = F.create_map(*(F.lit(x) for k, p in PROFILES.items() for x in (k, conditions.label(p.condition))))
    return found.withColumn("label", labels[F.col("kind")])


@query(
    "calendar_sides",
    """WITH e AS (SELECT event_id, event_type AS currency, epoch_us(ts) // 1000000 AS time FROM events), x AS (SELECT *, CASE WHEN time > 1705276800 THEN 'upcoming' ELSE 'past' END AS side FROM e)
    SELECT event_id, side, abs(time - 1705276800) AS distance FROM x""",
)
def _(spark, d):
    """The events as a calendar."""
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select("event_id", F.col("event_type").alias("currency"), src.unix_seconds("ts").alias("time"), F.col("event_id").cast("string").alias("title"))
    return sp.calendar_sides(rows, REGISTERED).select("event_id", "side", "distance")


@query(
    "weekly_net_change",
    "WITH w AS (SELECT event_type AS currency, (epoch_us(ts) // 1000000) // 604800 * 604800 AS date, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE -value END) AS net FROM events GROUP BY 1, 2) SELECT currency, date, round(net, 4) + 0.0 AS noncomm_net, round(net - lag(net) OVER (PARTITION BY currency ORDER BY date), 4) + 0.0 AS net_change FROM w",
)
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    signed = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    weeks = events.groupBy(F.col("event_type").alias("currency"), (F.floor(src.unix_seconds("ts") / 604800) * 604800).cast("long").alias("date")).agg(F.sum(signed).alias("noncomm_net"))
    return shown(sp.cot_change(weeks), "noncomm_net", "net_change", keys=("currency", "date"), digits=4)


@query("visible_levels", f"{_LV} SELECT symbol, CAST(place AS INT) AS place, direction, {sql.r6('price', 'price')} FROM levels WHERE place <= 5")
def _(spark, d):
    levels = sg.levels(src.event_bars(spark, d))
    return shown(sp.visible_levels(levels), "price", keys=("symbol", "place", "direction"))


@query("fan_chart", f"{HEAD}{votes(NOFLAT)}, {STATS}, {EXPECTED} SELECT symbol, t + horizon * 3600 AS t, horizon, {', '.join(sql.r6(x, x) for x in ('expected', 'low2', 'high2'))} FROM xb QUALIFY row_number() OVER (PARTITION BY symbol, horizon ORDER BY xb.t DESC) = 1")
def _(spark, d):
    stats = fc.model_stats(ind.latest_atr(sg.score(src.event_bars(spark, d))))
    return shown(sp.fan(fc.expected_prices(stats), 3600), "expected", "low2", "high2", keys=("symbol", "t", "horizon"))


@query("pip_values", f"WITH {sql.bars()}, p AS (SELECT t, c FROM bars WHERE symbol = 'view'), b AS (SELECT b.symbol, b.t, r.t AS bt, r.c AS bc FROM bars b ASOF LEFT JOIN p r ON b.t >= r.t), a AS (SELECT b.*, n.t AS nt, n.c AS nc FROM b ASOF LEFT JOIN p n ON b.t <= n.t), z AS (SELECT symbol, t, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t) THEN bc ELSE nc END AS rate FROM a) SELECT symbol, t, {sql.r6('10 * CASE WHEN rate > 0 THEN rate ELSE 150 END', 'pip_value')} FROM z")
def _(spark, d):
    """Pip values with the tape of one symbol as the rate."""
    bars = src.event_bars(spark, d)
    return shown(sp.pip_values(bars, bars.where("symbol = 'view'")), "pip_value")


# -- feeds, reports, look-ups and ledgers made of the test tables --------------------------------------

_SEC = "epoch_us(ts) // 1000000"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").withColumn("at", src.unix_seconds("ts"))


_COT = f"""rw AS (SELECT event_type AS currency, event_id AS seq, CAST(ts AS DATE) AS day, value AS oi, CAST(user_id AS DOUBLE) AS nl, CAST(event_id % 97 AS DOUBLE) AS ns FROM events WHERE event_id % 50 <> 0 AND event_id % 49 <> 0),
    rp AS (SELECT currency, day, arg_max(oi, seq) AS oi, arg_max(nl, seq) - arg_max(ns, seq) AS noncomm_net FROM rw GROUP BY 1, 2)"""


def _reports(spark, d):
    e, text = _events(spark, d), lambda x: x.cast("string")
    raw = e.select(
        F.col("event_type").alias("currency"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("report_date"),
        F.when(F.col("event_id") % 49 == 0, "none").otherwise(text(F.col("value"))).alias("oi"), text(F.col("user_id")).alias("noncomm_long"), text(F.col("event_id") % 97).alias("noncomm_short"), F.lit("1").alias("comm_long"), F.lit("2").alias("comm_short"),
    )
    return src.cot_reports(raw)


@query("cot_reports", f"WITH {_COT} SELECT currency, CAST(day AS VARCHAR) AS day, {sql.r6('oi', 'oi')}, {sql.r6('noncomm_net', 'noncomm_net')} FROM rp")
def _(spark, d):
    """Text rows with bad dates and numbers among them; the last row of a date counts."""
    return shown(_reports(spark, d).withColumn("day", F.to_date(F.from_unixtime("date")).cast("string")), "oi", "noncomm_net", keys=("currency", "day"))


@query("cot_newest_reports", f"WITH {_COT} SELECT currency, CAST(day AS VARCHAR) AS day, {sql.r6('noncomm_net', 'noncomm_net')}, CASE WHEN noncomm_net = 0 THEN 'neutral' WHEN noncomm_net > 0 THEN 'supports_pair' ELSE 'weighs_on_pair' END AS context FROM rp QUALIFY row_number() OVER (PARTITION BY currency ORDER BY day DESC) <= 20")
def _(spark, d):
    newest = src.newest_reports(_reports(spark, d), 20).withColumn("day", F.to_date(F.from_unixtime("date")).cast("string"))
    return shown(newest, "noncomm_net", keys=("currency", "day")).withColumn("context", sp.cot_context(F.col("noncomm_net"), F.lit(True)))


@query("calendar_feeds", f"""WITH f AS (SELECT 'event ' || event_id % 40 AS title, upper(event_type) AS currency, {_SEC} // 3600 * 3600 AS time, CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact, event_id AS seq FROM events)
    SELECT currency, time, title, arg_max(impact, seq) AS impact FROM f GROUP BY 1, 2, 3""")
def _(spark, d):
    """Two feeds, untidy in case and spaces, with unknown impacts."""
    impact = F.element_at(F.array(F.lit(" High"), F.lit("medium"), F.lit("LOW "), F.lit("holiday")), (F.col("user_id") % 4 + 1).cast("int"))
    feed = _events(spark, d).select(F.concat(F.lit(" event "), (F.col("event_id") % 40).cast("string"), F.lit(" ")).alias("title"), F.col("event_type").alias("currency"), (F.floor(F.col("at") / 3600) * 3600).cast("long").alias("time"), impact.alias("impact"), F.col("event_id").alias("seq"))
    return src.calendar(feed.where("seq % 2 = 0"), feed.where("seq % 2 = 1"))


@query("chart_feed", f"WITH {sql.bars()} SELECT symbol, t, {', '.join(sql.r6(x, x) for x in 'ohlc')}, 0.0 AS v FROM bars WHERE t + 3600 <= {REGISTERED} AND t % 10800 <> 0")
def _(spark, d):
    """Bars as a chart service sends them, in parallel arrays with gaps and with bars still forming."""
    bars = src.event_bars(spark, d)
    row = F.struct("t", "o", "h", "l", F.when(F.col("t") % 10800 != 0, F.col("c")).alias("c"))
    payload = bars.groupBy("symbol", "tf").agg(F.array_sort(F.collect_list(row)).alias("x"))
    names = {"t": "timestamps", "o": "open", "h": "high", "l": "low", "c": "close"}
    return shown(src.normalise_chart(payload.select("symbol", "tf", *(F.col(f"x.{k}").alias(v) for k, v in names.items())), REGISTERED), *"ohlcv")


@query("source_health", f"""WITH l AS (SELECT event_type AS tf, user_id % 10 AS series, max(CASE WHEN event_id % 3 <> 0 THEN {_SEC} END) AS late FROM events GROUP BY 1, 2), n AS (SELECT tf, count(late) AS n_series, max(late) AS now FROM l GROUP BY 1), p AS (SELECT * FROM (VALUES ('click', 1), ('gone', 1705276800)) v(tf, last_success))
    SELECT coalesce(n.tf, p.tf) AS tf, coalesce(n_series, 0) AS n_series, greatest(now, last_success) AS last_success, CASE WHEN greatest(now, last_success) IS NULL OR (1706745600 - greatest(now, last_success)) / 3600.0 > 120 THEN 'fail' WHEN coalesce(n_series, 0) = 0 OR (1706745600 - greatest(now, last_success)) / 3600.0 > 6 THEN 'warn' ELSE 'ok' END AS verdict FROM n FULL JOIN p ON p.tf = n.tf""")
def _(spark, d):
    latest = _events(spark, d).groupBy(F.col("event_type").alias("tf"), (F.col("user_id") % 10).alias("series")).agg(F.max(F.when(F.col("event_id") % 3 != 0, F.col("at"))).alias("success_at"))
    before = spark.createDataFrame([("click", 1), ("gone", REGISTERED)], "tf string, last_success long")
    health = src.source_health(latest, before).withColumn("primary_ok", F.col("n_series") > 0)
    return ledger.health(health, 1706745600).drop("primary_ok")


@query("fallback_sources", "SELECT event_type AS source, event_type <> 'view' AS fallback, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return _events(spark, d).select(F.col("event_type").alias("source"), src.from_fallback(F.concat(F.upper("event_type"), F.lit(" ")), "view").alias("fallback")).groupBy("source", "fallback").agg(F.count("*").alias("n"))


@query("journal_append", f"WITH x AS (SELECT event_id AS k, {_SEC} AS t, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM events) SELECT * FROM x ORDER BY t DESC, k LIMIT 1000")
def _(spark, d):
    """A journal that meets entries it partly knows; its cap of 1000 rows is a feature of it."""
    e = _events(spark, d).select(F.col("event_id").alias("k"), F.col("at").alias("t"))
    return sp.journal_append(e.where("k % 3 = 0").withColumn("origin", F.lit("old")), e.withColumn("origin", F.lit("new")), ["k"])


def _entries(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_custkey").cast("long").alias("strategy_id"), src.unix_seconds("o_orderdate").alias("registered_at"), F.col("o_orderkey").alias("retired_at"), F.col("o_orderstatus").alias("state"))


_ENTRIES = "en AS (SELECT CAST(o_custkey AS BIGINT) AS strategy_id, epoch_us(o_orderdate) // 1000000 AS registered_at, o_orderkey AS retired_at, o_orderstatus AS state FROM orders)"


@query("latest_ledger_entries", f"WITH {_ENTRIES} SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY registered_at DESC, retired_at DESC) = 1")
def _(spark, d):
    return ledger.latest_entry(_entries(spark, d))


@query("retired_conflicts", f"WITH {_ENTRIES} SELECT strategy_id, registered_at, retired_at FROM en WHERE state = 'O' AND (strategy_id, registered_at // 2592000) IN (SELECT (strategy_id, registered_at // 2592000) FROM en WHERE state <> 'O')")
def _(spark, d):
    """Open entries of a customer and month that also has other ones."""
    entries = _entries(spark, d).withColumn("generation", F.floor(F.col("registered_at") / 2592000))
    return ledger.conflicts(entries.where("state = 'O'"), entries.where("state <> 'O'"), ["strategy_id", "generation"]).select("strategy_id", "registered_at", "retired_at")


@query("retired_profit_factors", f"WITH {TRADES} SELECT run_id, symbol, {sql.r6('CASE WHEN count(*) = 0 OR (coalesce(sum(net_yen) FILTER (net_yen < 0), 0) = 0 AND coalesce(sum(net_yen) FILTER (net_yen > 0), 0) > 0) THEN NULL ELSE sum(net_yen) FILTER (net_yen > 0) / abs(sum(net_yen) FILTER (net_yen < 0)) END', 'profit_factor')} FROM tr GROUP BY 1, 2")
def _(spark, d):
    net = F.col("net_yen")
    sums = order_trades(spark, d).groupBy("run_id", "symbol").agg(F.sum(F.when(net > 0, net).otherwise(0.0)).alias("g"), F.sum(F.when(net < 0, net).otherwise(0.0)).alias("l"), F.count("*").alias("n"))
    return shown(sums.withColumn("profit_factor", sp.retired_profit_factor(F.col("g"), F.col("l"), F.col("n"))), "profit_factor", keys=("run_id", "symbol"))


_BAD = [("id", "sid = ''"), ("timeframe", "tf NOT IN ('m15', 'm30', 'h1', 'h4', 'd1')"), ("rule", "kind <> 'rsi'"), ("stop", "stop <= 0"), ("target", "k % 13 = 0"), ("trailing", "k % 17 = 0"), ("session", "k % 19 = 0"), ("mode", "k % 23 = 0")]


@query("strategy_problems", f"""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 's' || o_orderkey // 3 END AS sid, CASE WHEN o_orderkey % 7 = 0 THEN 'w1' ELSE 'h1' END AS tf, CASE WHEN o_orderkey % 11 = 0 THEN 'odd' ELSE 'rsi' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 10.0 END AS stop FROM orders)
    {' UNION ALL '.join(f"SELECT sid AS strategy_id, '{n}' AS problem FROM s WHERE {x}" for n, x in _BAD)} UNION ALL SELECT sid, 'repeated' FROM s GROUP BY sid HAVING count(*) > 1""")
def _(spark, d):
    k, when = F.col("o_orderkey"), lambda n, a, b: F.when(F.col("o_orderkey") % n == 0, a).otherwise(b)
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        when(29, F.lit(""), F.concat(F.lit("s"), F.floor(k / 3).cast("string"))).alias("strategy_id"), when(7, F.lit("w1"), F.lit("h1")).alias("tf"), when(11, F.lit("odd"), F.lit("rsi")).alias("kind"), when(5, F.lit(0.0), F.lit(10.0)).alias("stop_pips"),
        when(13, F.lit(None), F.lit(20.0)).alias("target_pips"), when(17, F.lit(-1.0), F.lit(None)).alias("trailing_pips"), when(19, F.lit("24:00"), F.lit("08:00")).alias("session_start"), F.lit(None).cast("string").alias("session_end"), when(23, F.lit("x"), F.lit("fixedLot")).alias("mode"),
    )
    return sp.strategy_problems(rows)


_QUOTES = [k[3:] for k in sp.SPREADS]
_PAIRS = [*sp.SPREADS, "XAUUSD"]


@query(
    "reference_tables",
    f"""WITH p AS (SELECT event_id, value, ({_PAIRS!r})[user_id % {len(_PAIRS)} + 1] AS symbol FROM events), v AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {x})" for k, x in sp.SPREADS.items())}) t(symbol, spread))
    SELECT event_id, p.symbol, coalesce(CAST(spread AS DOUBLE), 0.0) AS spread, CASE WHEN p.symbol LIKE '%JPY' THEN 3 ELSE 5 END AS digits, floor(value / CASE WHEN p.symbol LIKE '%JPY' THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END * 10 + 0.5) / 10 AS pips,
        CASE WHEN substr(p.symbol, 1, 3) IN ({', '.join(f"'{x}'" for x in _QUOTES)}) THEN substr(p.symbol, 1, 3) WHEN substr(p.symbol, 4, 3) IN ({', '.join(f"'{x}'" for x in _QUOTES)}) THEN substr(p.symbol, 4, 3) ELSE 'JPY' END AS currency FROM p LEFT JOIN v ON v.symbol = p.symbol""",
)
def _(spark, d):
    """Every event as a move of a pair: its spread, digits, pips and report currency."""
    symbol = F.element_at(F.array(*map(F.lit, _PAIRS)), (F.col("user_id") % len(_PAIRS) + 1).cast("int"))
    rows = _events(spark, d).withColumn("symbol", symbol)
    return rows.select("event_id", "symbol", sp.spread_pips(F.col("symbol")).alias("spread"), sp.price_digits(F.col("symbol")).alias("digits"), sp.to_pips(F.col("symbol"), F.col("value")).alias("pips"), sp.default_currency(F.col("symbol"), _QUOTES).alias("currency"))


_CAL = f"""ev AS (SELECT event_id, upper(substr(event_type, 1, 3)) AS currency, {_SEC} AS time, CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'holiday' END AS impact FROM events)"""


def _calendar(spark, d):
    impact = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "holiday"))), (F.col("user_id") % 4 + 1).cast("int"))
    return _events(spark, d).select("event_id", F.upper(F.substring("event_type", 1, 3)).alias("currency"), F.col("at").alias("time"), impact.alias("impact"))


query("calendar_for_pair", f"WITH {_CAL} SELECT * FROM ev WHERE currency IN ('CLI', 'VIE') AND impact IN ('high', 'medium')")(lambda spark, d: sp.calendar_for(_calendar(spark, d), "CLIVIE"))
query("calendar_upcoming", f"WITH {_CAL} SELECT * FROM ev WHERE currency IN ('CLI', 'VIE') AND time > {REGISTERED} AND time <= {REGISTERED} + 259200")(lambda spark, d: sp.upcoming_for(_calendar(spark, d), "CLIVIE", REGISTERED, 259200))
query(
    "event_markers",
    f"""WITH {sql.bars(14400)}, w AS (SELECT * FROM bars WHERE t % 86400 <> 0), l AS (SELECT symbol, max(t) + 14400 AS until FROM w GROUP BY 1), e AS (SELECT event_id, event_type AS symbol, {_SEC} AS time FROM events)
    SELECT event_id, CAST(CASE WHEN time < until THEN w.t END AS DOUBLE) AS bar_t FROM e ASOF LEFT JOIN w ON w.symbol = e.symbol AND e.time >= w.t LEFT JOIN l ON l.symbol = e.symbol""",
)(lambda spark, d: asof.markers(_events(spark, d).select("event_id", F.col("event_type").alias("symbol"), F.col("at").alias("time")), src.event_bars(spark, d, "h4").where("t % 86400 <> 0"), ["symbol"], "time", 14400).select("event_id", F.col("bar_t").cast("double").alias("bar_t")))
_LATE = f"bars AS (SELECT * EXCLUDE (n) FROM (WITH {sql.bars(name='whole')} SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM whole) WHERE n <= 120)"
query(
    "newest_patterns",
    f"""WITH cp AS ({ORACLES['candle_patterns']}), ch AS ({sql.swapped(ORACLES['chart_patterns'], sql.bars(), _LATE)}), lt AS (WITH {_LATE} SELECT symbol, min(t) AS since FROM bars GROUP BY 1),
    al AS (SELECT cp.symbol, cp.t, pattern, direction, strength FROM cp JOIN lt ON lt.symbol = cp.symbol AND cp.t >= since UNION ALL SELECT symbol, t, pattern, direction, strength FROM ch), un AS (SELECT symbol, t, pattern, direction, max(strength) AS strength FROM al GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY t DESC, strength DESC, pattern) AS INT) AS place FROM un""",
)(lambda spark, d: sg.newest_patterns(src.event_bars(spark, d)).drop("tf"))

# -- confirmed history ---------------------------------------------------------------------------

_SPINE = "dy AS (SELECT DISTINCT symbol, t // 86400 AS day FROM bars), sp AS (SELECT symbol, day FROM dy QUALIFY day < max(day) OVER (PARTITION BY symbol)), ids AS (SELECT DISTINCT run_id, symbol FROM trades), dd AS (SELECT run_id, symbol, day FROM ids JOIN sp USING (symbol))"
_EQUITY = f"""{_SPINE}, cl AS (SELECT dd.*, s.t AS as_of, eq_pips, eq_yen, floor(money + 0.5) AS realised FROM dd ASOF LEFT JOIN sim s ON s.run_id = dd.run_id AND s.symbol = dd.symbol AND (dd.day + 1) * 86400 - 1 >= s.t),
    rp AS (SELECT cl.run_id, cl.symbol, cl.day, coalesce(sum(t.net_pips), 0) AS pips FROM cl LEFT JOIN trades t ON t.run_id = cl.run_id AND t.symbol = cl.symbol AND t.exit_reason <> 'end' AND t.exit_time <= cl.as_of GROUP BY ALL),
    mx AS (SELECT run_id, symbol, t // 86400 AS day, max(dd_pips) AS mp, max(dd_yen) AS my, max(dd_pct) AS mc FROM sim GROUP BY ALL),
    de AS (SELECT cl.run_id, cl.symbol, cl.day, as_of, floor((eq_pips - pips) * 10 + 0.5) / 10 AS unrealised_pips, floor(eq_yen - 1000000 - realised + 0.5) AS unrealised_yen, coalesce(mp, 0) AS max_drawdown_pips, coalesce(my, 0) AS max_drawdown_yen, coalesce(mc, 0) AS max_drawdown_pct
        FROM cl JOIN rp USING (run_id, symbol, day) LEFT JOIN mx USING (run_id, symbol, day))"""


def _persisted(spark, d):
    simulated = scratch.settled(_simulated(spark, d))
    trades = bt.trades_of(simulated)
    return trades, history.day_equity(ledger.confirmed_days(trades, src.event_bars(spark, d)), bt.equity_of(simulated), trades)


@query("confirmed_day_equity", f"{_SIM}, {_EQUITY} SELECT run_id, symbol, day, as_of, {', '.join(sql.r6(x, x) for x in ('unrealised_pips', 'unrealised_yen', 'max_drawdown_pips', 'max_drawdown_yen', 'max_drawdown_pct'))} FROM de")
def _(spark, d):
    return shown(_persisted(spark, d)[1], "unrealised_pips", "unrealised_yen", "max_drawdown_pips", "max_drawdown_yen", "max_drawdown_pct", keys=("run_id", "symbol", "day", "as_of"))


_ROLL = "OVER (PARTITION BY run_id, symbol ORDER BY exit_time, id)"
@query(
    "persisted_summary",
    f"""{_SIM}, {_EQUITY}, dn AS (SELECT * FROM trades WHERE exit_reason <> 'end'), r1 AS (SELECT *, sum(net_yen) {_ROLL} AS y, sum(net_pips) {_ROLL} AS p FROM dn), r2 AS (SELECT *, greatest(0, max(y) {_ROLL}) AS ty, greatest(0, max(p) {_ROLL}) AS tp FROM r1),
    su AS (SELECT run_id, symbol, count(*) AS trades, count(*) FILTER (net_yen > 0) AS wins, count(*) FILTER (net_yen < 0) AS losses, coalesce(sum(net_yen) FILTER (net_yen > 0), 0) AS g, coalesce(sum(net_yen) FILTER (net_yen < 0), 0) AS l, sum(net_pips) AS np, sum(net_yen) AS ny, max(ty - y) AS dy2, max(tp - p) AS dp2, max((ty - y) / (1000000 + ty) * 100) AS dc2 FROM r2 GROUP BY 1, 2),
    sq AS (SELECT run_id, symbol, max(max_drawdown_pips) AS mp, max(max_drawdown_yen) AS my, max(max_drawdown_pct) AS mc FROM de GROUP BY 1, 2)
    SELECT run_id, symbol, su.trades, wins, losses, round(CASE WHEN l <> 0 THEN g / abs(l) END, 6) AS profit_factor, floor(np * 10 + 0.5) / 10 AS net_pips, floor(ny + 0.5) AS net_yen, floor(greatest(dp2, coalesce(mp, 0)) * 10 + 0.5) / 10 AS max_drawdown_pips, floor(greatest(dy2, coalesce(my, 0)) + 0.5) AS max_drawdown_yen,
        round(greatest(dc2, coalesce(mc, 0)), 6) AS max_drawdown_pct FROM su LEFT JOIN sq USING (run_id, symbol)""",
)
def _(spark, d):
    found = history.persisted_summary(*_persisted(spark, d))
    factor = F.when(F.col("profit_factor") < float("inf"), F.round("profit_factor", 6)).alias("profit_factor")
    return found.select("run_id", "symbol", "trades", "wins", "losses", factor, "net_pips", "net_yen", "max_drawdown_pips", "max_drawdown_yen", F.round("max_drawdown_pct", 6).alias("max_drawdown_pct"))


@query(
    "history_problems",
    f"""WITH {TRADES}, d AS (SELECT DISTINCT run_id || '-' || symbol AS strategy_id, exit_time // 86400 AS day FROM tr), t AS (SELECT strategy_id, day, CASE WHEN day % 13 = 0 THEN 'day ' || day ELSE strftime(make_timestamp(CAST(day * 86400000000 AS BIGINT)), '%Y-%m-%d') END AS date FROM d)
    SELECT strategy_id, date, 'date' AS problem FROM t WHERE day % 13 = 0 UNION ALL SELECT strategy_id, date, 'sum' FROM t WHERE day % 7 = 0 UNION ALL SELECT strategy_id, date, 'trade_day' FROM t WHERE day % 11 = 0 OR day % 13 = 0 UNION ALL SELECT strategy_id, date, 'fingerprint' FROM t WHERE day % 17 = 0""",
)
def _(spark, d):
    """A history of all orders with planted faults: wrong sums, moved trades, bad dates and fingerprints."""
    day = F.col("day")
    trades = order_trades(spark, d).withColumn("day", F.floor(F.col("exit_time") / 86400))
    one = F.struct((F.col("exit_time") + F.when(day % 11 == 0, 86400).otherwise(0)).alias("exit_time"), "exit_reason", "net_pips", "net_yen")
    days = trades.groupBy(F.concat_ws("-", "run_id", "symbol").alias("strategy_id"), "day").agg(F.collect_list(one).alias("trades"), F.sum("net_pips").alias("net_pips"), F.sum("net_yen").alias("net_yen"))
    date = F.when(day % 13 == 0, F.concat(F.lit("day "), day.cast("string"))).otherwise(F.date_format(F.timestamp_seconds(day * 86400), "yyyy-MM-dd"))
    rows = days.select("strategy_id", date.alias("date"), "net_pips", (F.col("net_yen") + F.when(day % 7 == 0, 3.0).otherwise(0.0)).alias("net_yen"), F.lit(1).alias("bars"), F.lit(1e6).alias("initial_balance"), F.lit(0.5).alias("spread_pips"), F.when(day % 17 == 0, "x").otherwise(F.sha2("strategy_id", 256)).alias("fingerprint"), "trades")
    return history.problems(rows)
