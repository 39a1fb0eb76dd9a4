"""SQL fragments of the oracle queries (DuckDB)."""

from __future__ import annotations


def swapped(text: str, old: str, new: str) -> str:
    """``text`` with every ``old`` replaced; it must occur, so that a fragment that has changed is noticed."""
    if old not in text:
        raise ValueError(f"not in the SQL: {old[:60]}")
    return text.replace(old, new)


def bars(seconds: int = 3600, name: str = "bars") -> str:
    return f"""{name} AS (
        SELECT event_type AS symbol, (epoch_us(ts) // 1000000 // {seconds}) * {seconds} AS t, first(value ORDER BY ts, event_id) AS o, max(value) AS h,
            min(value) AS l, last(value ORDER BY ts, event_id) AS c, CAST(count(*) AS DOUBLE) AS v
        FROM events GROUP BY 1, 2)"""


def walk(seconds: int = 1800, name: str = "bars") -> str:
    """Half-hourly bars laid end to end, or coarser bars of them."""
    return f"""{name} AS (SELECT symbol, (t // {seconds}) * {seconds} AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c, sum(v) AS v
        FROM (SELECT symbol, t, no AS o, round(greatest(no, nc) + 0.1 * (h - greatest(o, c)), 2) AS h, round(least(no, nc) - 0.1 * (least(o, c) - l), 2) AS l, nc AS c, v
            FROM (SELECT *, round(nc - round(c - o, 2), 2) AS no FROM (SELECT *, round(10000 + sum(round(c - o, 2)) OVER (PARTITION BY symbol ORDER BY t), 2) AS nc FROM (WITH {bars(1800, 'raw')} SELECT * FROM raw)))) GROUP BY 1, (t // {seconds}) * {seconds})"""


def deal(seconds: int = 1800, name: str = "bars") -> str:
    """Half-hourly bars of single orders, four a day, or coarser bars of them."""
    w = "OVER (PARTITION BY symbol ORDER BY o_orderdate, o_orderkey"
    return f"""{name} AS (SELECT symbol, (t // {seconds}) * {seconds} AS t, first(o ORDER BY t) AS o, max(h) AS h, min(l) AS l, last(c ORDER BY t) AS c, sum(v) AS v
        FROM (SELECT symbol, CAST((19000 + k // 4) * 86400 + 28800 + k % 4 * 1800 AS BIGINT) AS t, o / 100.0::DOUBLE AS o, (greatest(o, c) + 25 + 3 * (x % 7)) / 100.0::DOUBLE AS h, (least(o, c) - 25 - 3 * (x % 5)) / 100.0::DOUBLE AS l, c / 100.0::DOUBLE AS c, CAST(1 AS DOUBLE) AS v
            FROM (SELECT symbol, k, x, c, c - step AS o FROM (SELECT *, 1000000 + CAST(sum(step) {w}) AS BIGINT) AS c
                FROM (SELECT *, row_number() {w}) - 1 AS k, CAST(2 * sum(u) {w} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) + 5 * u AS BIGINT) AS step
                    FROM (SELECT *, x % 201 - 100 AS u FROM (SELECT o_orderkey, o_orderdate, substr(o_orderpriority, 1, 1) || o_orderstatus AS symbol, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders)))))) GROUP BY 1, (t // {seconds}) * {seconds})"""


ORDER_BARS = """bars AS (
        SELECT o_orderpriority AS symbol, (epoch_us(o_orderdate) // 1000000 // 86400) * 86400 AS t, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS o, max(o_totalprice) AS h,
            min(o_totalprice) AS l, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS c, CAST(count(*) AS DOUBLE) AS v
        FROM orders GROUP BY 1, 2)"""


def over(n: int, gap: int = 0) -> str:
    end = f"{gap} PRECEDING" if gap else "CURRENT ROW"
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1 + gap} PRECEDING AND {end})"


S = "OVER (PARTITION BY symbol ORDER BY t)"


def frame(f: str, x: str, n: int, gap: int = 0) -> str:
    """Aggregate over the last n values, null until all exist."""
    return f"CASE WHEN count({x}) {over(n, gap)} = {n} THEN {f}({x}) {over(n, gap)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {S}"


def numbered(source: str = "bars") -> str:
    return f"b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM {source})"


def ema(name: str, n: int, x: str = "c", source: str = "b") -> str:
    """Recursive table (symbol, i, y); the first n non-null values of x seed it (x null only in front)."""
    a = 2 / (n + 1)
    return f"""{name}_v AS (SELECT symbol, i, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM {source} WHERE {x} IS NOT NULL),
    {name} AS (
        SELECT symbol, max(i) AS i, max(k) AS k, avg(x) AS y FROM {name}_v WHERE k <= {n} GROUP BY symbol HAVING count(*) = {n}
        UNION ALL SELECT v.symbol, v.i, v.k, v.x * {a!r} + r.y * {1 - a!r} FROM {name} r JOIN {name}_v v ON v.symbol = r.symbol AND v.k = r.k + 1)"""


def smma(name: str, n: int, x: str, source: str = "b") -> str:
    return f"""{name} AS (
        SELECT symbol, max(i) AS i, avg({x}) AS y FROM {source} WHERE i <= {n} GROUP BY symbol HAVING count(*) = {n}
        UNION ALL SELECT b.symbol, b.i, (r.y * {n - 1} + b.{x}) / {n} FROM {name} r JOIN {source} b ON b.symbol = r.symbol AND b.i = r.i + 1)"""


def rsi(name: str, n: int) -> str:
    return f"""{name}_d AS (SELECT symbol, i, greatest(c - lag(c) {S}, 0) AS g, greatest(lag(c) {S} - c, 0) AS s FROM b),
    {name} AS (
        SELECT symbol, max(i) AS i, sum(g) / {n} AS g, sum(s) / {n} AS s FROM {name}_d WHERE i BETWEEN 2 AND {n + 1} GROUP BY symbol HAVING count(*) = {n}
        UNION ALL SELECT d.symbol, d.i, (r.g * {n - 1} + d.g) / {n}, (r.s * {n - 1} + d.s) / {n} FROM {name} r JOIN {name}_d d ON d.symbol = r.symbol AND d.i = r.i + 1)"""


RSI_VALUE = "CASE WHEN g = 0 AND s = 0 THEN 50 WHEN s = 0 THEN 100 ELSE 100 - 100 / (1 + g / s) END"


def adx(name: str, n: int) -> str:
    a = 2 / (n + 1)
    return f"""{name}_m AS (SELECT symbol, i, greatest(h - lag(h) {S}, 0) AS u, greatest(lag(l) {S} - l, 0) AS d, greatest(h - l, abs(h - lag(c) {S}), abs(l - lag(c) {S})) AS w FROM b),
    {name}_x AS (SELECT symbol, i, CASE WHEN w > 0 AND u > d THEN 100 * u / w ELSE 0 END AS p, CASE WHEN w > 0 AND d > u THEN 100 * d / w ELSE 0 END AS m FROM {name}_m WHERE i >= 2),
    {name} AS (
        SELECT symbol, CAST(1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS y FROM b WHERE i = 1
        UNION ALL SELECT symbol, i, p, m, (CASE WHEN p + m = 0 THEN 0 ELSE 100 * abs((p - m) / (p + m)) END) * {a!r} + y * {1 - a!r} FROM (
            SELECT x.symbol, x.i, x.p * {a!r} + r.p * {1 - a!r} AS p, x.m * {a!r} + r.m * {1 - a!r} AS m, r.y FROM {name} r JOIN {name}_x x ON x.symbol = r.symbol AND x.i = r.i + 1))"""


def up(a: str, b: str) -> str:
    return f"coalesce({lag(a)} <= {lag(b) if not b.replace('.', '').isdigit() else b} AND {a} > {b}, false)"


def down(a: str, b: str) -> str:
    return f"coalesce({lag(a)} >= {lag(b) if not b.replace('.', '').isdigit() else b} AND {a} < {b}, false)"


def r6(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def sar(step: float = 0.02, most: float = 0.2) -> str:
    """Recursive table x: b with the parabolic stop and its side, shown once two turns and 100 bars after the first are past."""
    return f"""pr AS (
        SELECT symbol, i, false AS lng, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS DOUBLE) AS ext, CAST({step} AS DOUBLE) AS pace, h AS hi, l AS lo, h AS bh, l AS bl, CAST(NULL AS BIGINT) AS t1, CAST(NULL AS BIGINT) AS t2, CAST(NULL AS DOUBLE) AS shown_stop, CAST(NULL AS BOOLEAN) AS shown_long FROM b WHERE i = 1
        UNION ALL SELECT symbol, i, lng2, CASE WHEN lng2 THEN least(nxt, l, bl) ELSE greatest(nxt, h, bh) END, ext2, pace2, CASE WHEN turned THEN h ELSE hi1 END, CASE WHEN turned THEN l ELSE lo1 END, h, l, t1n, t2n,
            CASE WHEN t2n IS NOT NULL AND i >= greatest(t1n + 100, t2n) THEN stop2 END, CASE WHEN t2n IS NOT NULL AND i >= greatest(t1n + 100, t2n) THEN lng2 END
        FROM (SELECT *, stop2 + pace2 * (ext2 - stop2) AS nxt FROM (SELECT *, turned <> lng AS lng2, CASE WHEN turned THEN CASE WHEN lng THEN hi1 ELSE lo1 END ELSE stop1 END AS stop2,
                CASE WHEN turned THEN CASE WHEN lng THEN l ELSE h END WHEN lng THEN greatest(h, ext1) ELSE least(l, ext1) END AS ext2,
                CASE WHEN turned THEN {step} WHEN CASE WHEN lng THEN h > ext1 ELSE l < ext1 END THEN least(pace + {step}, {most}) ELSE pace END AS pace2,
                CASE WHEN turned THEN coalesce(t1, i) ELSE t1 END AS t1n, CASE WHEN turned AND t1 IS NOT NULL THEN coalesce(t2, i) ELSE t2 END AS t2n
            FROM (SELECT *, CASE WHEN lng THEN stop1 > l ELSE stop1 < h END AS turned
                FROM (SELECT p.* EXCLUDE (i), b.i, b.h, b.l, greatest(hi, b.h) AS hi1, least(lo, b.l) AS lo1, CASE WHEN b.i = 2 THEN greatest(hi, b.h) ELSE stop END AS stop1, CASE WHEN b.i = 2 THEN b.l ELSE ext END AS ext1
                    FROM pr p JOIN b ON b.symbol = p.symbol AND b.i = p.i + 1))))),
    x AS (SELECT b.*, shown_stop AS sar, shown_long AS sar_long FROM b LEFT JOIN pr USING (symbol, i))"""
