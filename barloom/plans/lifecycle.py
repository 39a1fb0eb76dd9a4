"""Queries over generations of strategies, with orders as trades and registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import domains as dm
from barloom.operators import lifecycle as lc
from barloom.plans import sql
from barloom.plans.series import query, shown
from barloom.plans.trading import DAYS, TRADES, _days, order_trades
from barloom.sources import bars as src

#: Seconds of registration: long before the data, and noon of two days within it.
LONG_AGO, MIDDLE, LATE = 600000000, 788961600, 852120000

_REG = f"""{TRADES}, {sql.ORDER_BARS}, rg AS (SELECT DISTINCT run_id, symbol, CAST(CASE run_id WHEN 'F' THEN {LONG_AGO} WHEN 'O' THEN {MIDDLE} ELSE {LATE} END AS BIGINT) AS registered_at FROM tr),
    fw AS (SELECT run_id, symbol, registered_at // 86400 AS rd, t // 86400 AS day, count(*) AS bars, min(t) AS first_bar, max(t) AS last_bar FROM rg JOIN bars USING (symbol) WHERE t >= registered_at GROUP BY ALL),
    en AS (SELECT run_id, symbol, rd, min(day) AS a, max(day) AS z FROM fw GROUP BY ALL), sp AS (SELECT run_id, symbol, unnest(range(CAST(CASE WHEN a - rd > 7 THEN a + 1 ELSE rd END AS BIGINT), CAST(z AS BIGINT))) AS day FROM en),
    td AS (SELECT run_id, symbol, exit_time // 86400 AS day, count(*) AS trades, sum(net_pips) AS net_pips, sum(net_yen) AS net_yen FROM tr GROUP BY ALL),
    rd AS (SELECT sp.run_id, sp.symbol, sp.day, coalesce(bars, 0) AS bars, first_bar, last_bar, coalesce(trades, 0) AS trades, coalesce(net_pips, 0) AS net_pips, coalesce(net_yen, 0) AS net_yen FROM sp LEFT JOIN fw USING (run_id, symbol, day) LEFT JOIN td USING (run_id, symbol, day) WHERE bars > 0 OR (sp.day + 4) % 7 = 6)"""


def _registered(spark, d):
    at = F.when(F.col("run_id") == "F", LONG_AGO).when(F.col("run_id") == "O", MIDDLE).otherwise(LATE).cast("long")
    return order_trades(spark, d).select("run_id", "symbol", "tf").distinct().withColumn("registered_at", at)


def _registered_days(spark, d):
    return lc.registered_days(_registered(spark, d), src.order_bars(spark, d), order_trades(spark, d))


@query("registered_days", f"WITH {_REG} SELECT * REPLACE (coalesce(first_bar, 0) AS first_bar, coalesce(last_bar, 0) AS last_bar) FROM rd")
def _(spark, d):
    """Days without bars show 0 for their bars' times."""
    return _registered_days(spark, d).fillna(0, ["first_bar", "last_bar"]).drop("tf")


@query(
    "final_snapshots",
    f"""WITH {_REG}, mt AS (SELECT tr.* FROM tr SEMI JOIN rd ON tr.run_id = rd.run_id AND tr.symbol = rd.symbol AND tr.exit_time // 86400 = rd.day), a AS (SELECT run_id, symbol, count(*) AS trades, coalesce(sum(net_yen) FILTER (net_yen > 0), 0) AS gain, coalesce(sum(net_yen) FILTER (net_yen < 0), 0) AS loss FROM mt GROUP BY ALL),
    b AS (SELECT run_id, symbol, sum(net_yen) AS net_yen, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM rd GROUP BY ALL)
    SELECT run_id, symbol, registered_at, coalesce(trades, 0) AS trades, coalesce(net_yen, 0) AS net_yen, first_day, last_day, coalesce(days, 0) AS days, {sql.r6('CASE WHEN loss < 0 THEN gain / abs(loss) WHEN gain = 0 THEN 0 END', 'profit_factor')} FROM rg LEFT JOIN b USING (run_id, symbol) LEFT JOIN a USING (run_id, symbol)""",
)
def _(spark, d):
    snapshots = lc.final_snapshots(_registered(spark, d), _registered_days(spark, d), order_trades(spark, d))
    return shown(snapshots, "profit_factor", keys=("run_id", "symbol", "registered_at", "trades", "net_yen", "first_day", "last_day", "days"))


@query("window_balances", f"WITH {_REG}, w AS (SELECT symbol, min(t) // 86400 AS begin FROM bars WHERE t >= {LATE} GROUP BY 1), x AS (SELECT run_id, symbol, sum(net_yen) AS net FROM rd JOIN w USING (symbol) WHERE day < begin GROUP BY ALL) SELECT run_id, symbol, 1000000 + coalesce(net, 0) AS balance FROM rg LEFT JOIN x USING (run_id, symbol)")
def _(spark, d):
    """A source whose bars begin late."""
    held = src.order_bars(spark, d).where(F.col("t") >= LATE)
    return lc.window_balances(_registered(spark, d), _registered_days(spark, d), held).drop("tf")


_GEN = """g AS (SELECT o_orderkey AS no, 's' || o_custkey AS strategy_id, o_orderkey * 10 AS made_at FROM orders),
    k AS (SELECT no, strategy_id, CASE no % 5 WHEN 0 THEN strategy_id || '@' || made_at WHEN 1 THEN 'x@' || made_at WHEN 2 THEN strategy_id || '@none' ELSE strategy_id || '@' || made_at END AS key, CASE WHEN no % 3 = 0 THEN made_at WHEN no % 7 = 0 THEN -1 END AS meta, CASE WHEN no % 4 = 0 THEN made_at + 1 END AS snapshot FROM g),
    kk AS (SELECT *, CASE WHEN coalesce(meta, snapshot) > 0 THEN coalesce(meta, snapshot) WHEN starts_with(key, strategy_id || '@') AND TRY_CAST(substr(key, length(strategy_id) + 2) AS BIGINT) > 0 THEN TRY_CAST(substr(key, length(strategy_id) + 2) AS BIGINT) END AS registered_at FROM k)"""


def _generations(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("no"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("strategy_id"), (F.col("o_orderkey") * 10).cast("long").alias("made_at"))


def _entries(spark, d):
    no, made, of = F.col("no"), F.col("made_at"), F.col("strategy_id")
    key = F.when(no % 5 == 1, lc.generation_key(F.lit("x"), made)).when(no % 5 == 2, F.concat(of, F.lit("@none"))).otherwise(lc.generation_key(of, made))
    rows = _generations(spark, d).select("no", "strategy_id", key.alias("key"), F.when(no % 3 == 0, made).when(no % 7 == 0, -1).alias("meta"), F.when(no % 4 == 0, made + 1).alias("snapshot"))
    return rows.withColumn("registered_at", lc.generation_of(F.col("key"), of, F.col("meta"), F.col("snapshot")))


@query("ledger_generations", f"WITH {_GEN} SELECT no, key, coalesce(registered_at, 0) AS registered_at FROM kk")
def _(spark, d):
    """Entries with registration times in their meta data, snapshots or keys, some of them unreadable (0)."""
    return _entries(spark, d).select("no", "key", "registered_at").fillna(0, ["registered_at"])


@query("unledgered_archives", f"WITH {_GEN}, ar AS (SELECT strategy_id, made_at AS registered_at, CASE WHEN no % 11 = 0 THEN strategy_id || '.json' ELSE strategy_id || '@' || made_at || '.json' END AS file_name FROM g) SELECT *, file_name <> strategy_id || '@' || registered_at || '.json' AS misnamed FROM ar WHERE (strategy_id, registered_at) NOT IN (SELECT (strategy_id, registered_at) FROM kk WHERE registered_at IS NOT NULL)")
def _(spark, d):
    name = F.when(F.col("no") % 11 == 0, F.col("strategy_id")).otherwise(lc.generation_key(F.col("strategy_id"), F.col("made_at")))
    archives = _generations(spark, d).select("strategy_id", F.col("made_at").alias("registered_at"), F.concat(name, F.lit(".json")).alias("file_name"))
    return lc.unledgered(archives, _entries(spark, d))


@query("unretired_changes", f"WITH {_GEN}, s AS (SELECT strategy_id, max(made_at) AS registered_at FROM g GROUP BY 1), h AS (SELECT strategy_id, min(made_at) AS recorded_at FROM g GROUP BY 1) SELECT * FROM s JOIN h USING (strategy_id) WHERE registered_at <> recorded_at AND (strategy_id, recorded_at) NOT IN (SELECT (strategy_id, registered_at) FROM kk WHERE registered_at IS NOT NULL)")
def _(spark, d):
    """The newest generation of every strategy meets the history of its oldest."""
    made = _generations(spark, d).groupBy("strategy_id")
    return lc.unretired_changes(made.agg(F.max("made_at").alias("registered_at")), made.agg(F.min("made_at").alias("registered_at")), _entries(spark, d))


_OBS = "ob AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 's' ELSE 'obs-' END || o_custkey AS strategy_id FROM orders), ad AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 's' ELSE 'obs-' END || c_custkey AS strategy_id FROM customer)"


@query("observation_problems", f"WITH {_OBS} SELECT DISTINCT strategy_id, 'prefix' AS problem FROM ob WHERE NOT starts_with(strategy_id, 'obs-') UNION ALL SELECT strategy_id, 'repeated' FROM ob GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT strategy_id, 'adopted' FROM ob SEMI JOIN ad USING (strategy_id)")
def _(spark, d):
    named = lambda no, key, n: F.concat(F.when(F.col(no) % n == 0, "s").otherwise("obs-"), F.col(key).cast("string")).alias("strategy_id")
    observed = spark.read.parquet(f"{d}/orders.parquet").select(named("o_orderkey", "o_custkey", 3))
    return lc.observation_problems(observed, spark.read.parquet(f"{d}/customer.parquet").select(named("c_custkey", "c_custkey", 2)))


@query("lane_report", f"WITH {DAYS}, s AS (SELECT run_id, symbol, count(*) AS days, sum(net_yen) AS net_yen FROM days GROUP BY 1, 2), t AS (SELECT run_id, symbol, count(*) AS trades FROM tr GROUP BY 1, 2) SELECT CASE WHEN run_id = 'O' THEN 'observation' ELSE 'adopted' END AS lane, CASE WHEN run_id = 'O' THEN 'obs-O' ELSE run_id END AS run_id, symbol, days, coalesce(trades, 0) AS trades, net_yen FROM s LEFT JOIN t USING (run_id, symbol)")
def _(spark, d):
    """The open orders as observed strategies."""
    observed = F.when(F.col("run_id") == "O", "obs-O").otherwise(F.col("run_id"))
    days, trades = (x.withColumn("run_id", observed) for x in (_days(spark, d), order_trades(spark, d)))
    return lc.lanes(days, trades).select("lane", "run_id", "symbol", "days", "trades", "net_yen")


# -- conditions made of order keys: some sound, some not ------------------------------------------------

_KINDS = [*dm.RULES, "odd"]
_NUMBERS = [(k, i, p) for k in _KINDS for i, p in enumerate([*dm.WHOLE.get(k, {}), *dm.POSITIVE.get(k, {})])]
_WORDS = [(k, i, p, a) for k in _KINDS for i, (p, a) in enumerate(dm.WORDS.get(k, {}).items())]
_WHOLE = ", ".join(f"('{k}', '{p}', {a}, {'NULL' if z is None else z})" for k, x in dm.WHOLE.items() for p, (a, z) in x.items())
_POSITIVE = ", ".join(f"('{k}', '{p}', {'NULL' if z is None else z})" for k, x in dm.POSITIVE.items() for p, z in x.items())
_RISING = ", ".join(f"('{k}', '{a}', '{b}')" for k, x in dm.RISING.items() for a, b in x)


def _conditions(spark, d):
    no = F.floor(F.col("o_orderkey") / len(_KINDS))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS) + 1).cast("int"))
    half = F.when(no % 4 == 0, 2.0).otherwise(1.0) * F.when(kind == "parabolicSar", 25.0).otherwise(1.0)
    numbers, words = F.when(F.lit(False), F.create_map(F.lit(""), F.lit(0.0))), F.when(F.lit(False), F.create_map(F.lit(""), F.lit("")))
    for k in _KINDS:
        values = [x for _, i, p in (n for n in _NUMBERS if n[0] == k) for x in (F.lit(p), (no * (i + 3) % 23 - 2) / half)]
        names = [x for _, i, p, a in (w for w in _WORDS if w[0] == k) for x in (F.lit(p), F.element_at(F.array(*map(F.lit, (*a, "none"))), ((no + i) % (len(a) + 1) + 1).cast("int")))]
        numbers = numbers.when(kind == k, F.create_map(*values)) if values else numbers
        words = words.when(kind == k, F.create_map(*names)) if names else words
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), kind.alias("kind"), numbers.alias("numbers"), words.alias("words"))


@query("rule_problems", f"""WITH kd(i, kind) AS (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(_KINDS))}), np(kind, i, p) AS (VALUES {', '.join(map(str, _NUMBERS))}), wp(kind, i, p, n) AS (VALUES {', '.join(f"('{k}', {i}, '{p}', {len(a)})" for k, i, p, a in _WORDS)}),
    c AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey // {len(_KINDS)} AS no, kind FROM orders JOIN kd ON kd.i = o_orderkey % {len(_KINDS)}),
    v AS (SELECT id, kind, p, (no * (i + 3) % 23 - 2) / (CASE WHEN no % 4 = 0 THEN 2.0 ELSE 1.0 END * CASE WHEN kind = 'parabolicSar' THEN 25.0 ELSE 1.0 END) AS x FROM c JOIN np USING (kind)), w AS (SELECT id, kind, p, (no + i) % (n + 1) AS pick, n FROM c JOIN wp USING (kind)),
    wh(kind, p, a, z) AS (VALUES {_WHOLE}), po(kind, p, z) AS (VALUES {_POSITIVE}), ri(kind, a, b) AS (VALUES {_RISING})
    SELECT id, p AS parameter, 'domain' AS problem FROM v JOIN wh USING (kind, p) WHERE floor(x) <> x OR x < a OR x > z UNION ALL SELECT id, p, 'domain' FROM v JOIN po USING (kind, p) WHERE x <= 0 OR x >= z
    UNION ALL SELECT id, p, 'domain' FROM w WHERE pick = n UNION ALL SELECT id, 'kind', 'kind' FROM c WHERE kind = 'odd'
    UNION ALL SELECT l.id, l.p, 'order' FROM ri JOIN v l ON l.kind = ri.kind AND l.p = ri.a JOIN v r ON r.id = l.id AND r.p = ri.b WHERE l.x >= r.x
    UNION ALL SELECT id, p, 'order' FROM v WHERE kind = 'parabolicSar' AND p = 'step' AND x < {dm.SAR_LEAST_STEP} UNION ALL SELECT l.id, 'maximum', 'order' FROM v l JOIN v r USING (id) WHERE l.kind = 'parabolicSar' AND l.p = 'maximum' AND r.p = 'step' AND l.x < r.x
    UNION ALL SELECT l.id, 'shift', 'order' FROM v l JOIN v r USING (id) JOIN w USING (id) WHERE l.kind = 'ichimokuCross' AND l.p = 'shift' AND r.p = 'base' AND w.p = 'cloud' AND pick = 0 AND l.x <> r.x""")
def _(spark, d):
    return dm.rule_problems(_conditions(spark, d))
