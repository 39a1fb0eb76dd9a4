"""SQL of the trade simulation: one recursive step per bar, its state as columns."""

from __future__ import annotations

from barloom.plans import sql

PIP, PIP_VALUE = "1.0", "1000.0"
TRADE = "STRUCT(id BIGINT, pos INT, entry_time BIGINT, exit_time BIGINT, entry_price DOUBLE, exit_price DOUBLE, gross DOUBLE, lot DOUBLE, balance DOUBLE, reason VARCHAR)"


def half_up(x: str, digits: int = 0) -> str:
    k = 10**digits
    return f"floor(({x}) + 0.5)" if k == 1 else f"floor(({x}) * {k} + 0.5) / {k}"


def runs(rows: list[dict]) -> str:
    """Table rn of run rows."""
    minutes = lambda x: int(x[:2]) * 60 + int(x[3:]) if x else -1
    text = lambda r: f"('{r['run_id']}', {r['stop_pips']!r}, {r['target_pips']!r}, {r['trailing_pips'] or 0.0!r}, {str(r['close_on_opposite']).lower()}, {minutes(r['session_start'])}, {minutes(r['session_end'])}, '{r['mode']}', {r['balance']!r}, {r['fixed_lot']!r}, {r['risk_pct']!r}, {r['max_lot']!r}, {r['spread_pips']!r}, '{r['directions']}')"
    kinds = "run_id, CAST(sp AS DOUBLE) AS sp, CAST(tp AS DOUBLE) AS tp, CAST(trail AS DOUBLE) AS trail, opp, sa, sb, mode, CAST(bal AS DOUBLE) AS bal, CAST(fixed AS DOUBLE) AS fixed, CAST(risk AS DOUBLE) AS risk, CAST(maxlot AS DOUBLE) AS maxlot, CAST(spread AS DOUBLE) AS spread, dirs"
    return f"rn AS (SELECT {kinds} FROM (VALUES {', '.join(map(text, rows))}) v(run_id, sp, tp, trail, opp, sa, sb, mode, bal, fixed, risk, maxlot, spread, dirs))"


def _trade(n: str, pos: str, entered: str, entry: str, price: str, gross: str, lot: str, money: str, reason: str) -> str:
    unit = f"({PIP_VALUE} * {lot})"
    return f"[CAST(ROW({n} + 1, {pos}, {entered}, t, {entry}, {price}, {gross}, {lot}, {half_up(f'bal + {money} + ({gross} * {unit} - spread * {unit})')}, {reason}) AS {TRADE})]"


def _yen(gross: str, lot: str) -> str:
    unit = f"({PIP_VALUE} * {lot})"
    return half_up(f"{gross} * {unit} - spread * {unit}")


_CAP = "least(greatest(0.01, CASE WHEN maxlot > 0 THEN maxlot ELSE 100.0 END), greatest(0.01, floor(({x}) * 100 + 0.5) / 100))"
_RISK = f"(greatest(0.0, bal + money1) * risk / 100) / ((sp + greatest(0.0, spread)) * {PIP_VALUE})"
_LOT = f"CASE mode WHEN 'compound' THEN {_CAP.format(x='fixed * greatest(0.0, (bal + money1) / bal)')} WHEN 'fixedRisk' THEN CASE WHEN bal + money1 > 0 THEN {_CAP.format(x=_RISK)} ELSE {_CAP.format(x='fixed')} END ELSE {_CAP.format(x='fixed')} END"


def simulated(signals: str) -> str:
    """Tables sig and sim (a row per run, series and bar) from the table ``signals`` (symbol, t, o, h, l, c, long, short)."""
    none = f"CAST([] AS {TRADE}[])"
    now = "((t // 60) % 1440)"
    return f"""sig AS (SELECT *, row_number() {sql.S} AS i, lead(t) {sql.S} IS NULL AS final FROM {signals}),
    sim AS (
        SELECT run_id, symbol, i, t, 0 AS pos, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS stop, CAST(0 AS DOUBLE) AS target, 'stop_loss' AS source, CAST(0 AS DOUBLE) AS lot, CAST(0 AS BIGINT) AS entered, 0 AS pending, false AS close_next,
            CAST(0 AS DOUBLE) AS pips, CAST(0 AS DOUBLE) AS money, CAST(0 AS DOUBLE) AS peak_pips, bal AS peak, CAST(0 AS BIGINT) AS n, {none} AS closed, CAST(0 AS DOUBLE) AS eq_pips, CAST(0 AS DOUBLE) AS dd_pips, {half_up('bal')} AS eq_yen, CAST(0 AS DOUBLE) AS dd_yen, CAST(0 AS DOUBLE) AS dd_pct
        FROM rn, sig WHERE i = 1
        UNION ALL
        SELECT run_id, symbol, i, t, pos5, entry2, stop4, target2, source4, lot2, entered2, CASE WHEN final OR pos5 <> 0 THEN 0 WHEN long AND contains(dirs, 'long') THEN 1 WHEN short AND contains(dirs, 'short') THEN -1 ELSE 0 END,
            NOT final AND pos5 <> 0 AND opp AND CASE WHEN pos5 = 1 THEN short ELSE long END, pips5, money5, peak_pips5, peak5, n5, closed5, {half_up('at_pips', 1)}, {half_up('greatest(0.0, peak_pips5 - at_pips)', 1)}, {half_up('at_yen')}, {half_up('greatest(0.0, peak5 - at_yen)')},
            CASE WHEN peak5 <= 0 THEN 0 ELSE greatest(0.0, peak5 - at_yen) / peak5 * 100 END
        FROM (SELECT *, CASE WHEN ends THEN 0 ELSE pos3 END AS pos5, CASE WHEN ends THEN pips4 ELSE mark_pips END AS at_pips, CASE WHEN ends THEN bal + money4 ELSE mark_yen END AS at_yen, pips4 AS pips5, money4 AS money5,
                CASE WHEN ends THEN greatest(peak_pips4, pips4) ELSE peak_pips4 END AS peak_pips5, CASE WHEN ends THEN greatest(peak4, bal + money4) ELSE peak4 END AS peak5, n3 + CAST(ends AS BIGINT) AS n5, CASE WHEN ends THEN list_concat(closed3, {_trade('n3', 'pos3', 'entered2', 'entry2', 'c', 'g4', 'lot2', 'money3', "'end'")}) ELSE closed3 END AS closed5
            FROM (SELECT *, CASE WHEN ends THEN pips3 + {half_up('g4 - spread', 1)} ELSE pips3 END AS pips4, CASE WHEN ends THEN money3 + {_yen('g4', 'lot2')} ELSE money3 END AS money4, greatest(peak_pips, mark_pips) AS peak_pips4, greatest(peak, mark_yen) AS peak4
                FROM (SELECT *, final AND pos3 <> 0 AS ends, (c - entry2) * pos3 / {PIP} AS g4, pips3 + float_pips AS mark_pips, bal + money3 + float_pips * {PIP_VALUE} * lot2 AS mark_yen
                    FROM (SELECT *, CASE WHEN pos3 = 0 THEN 0.0 ELSE (CASE WHEN pos3 = 1 THEN l ELSE h END - entry2) * pos3 / {PIP} - spread END AS float_pips,
                            CASE WHEN pos3 <> 0 AND trails THEN trailed ELSE stop2 END AS stop4, CASE WHEN pos3 <> 0 AND trails THEN 'trailing_stop' ELSE source2 END AS source4
                        FROM (SELECT *, CASE WHEN price3 IS NULL THEN pos2 ELSE 0 END AS pos3, CASE WHEN price3 IS NULL THEN pips1 ELSE pips1 + {half_up('g3 - spread', 1)} END AS pips3, CASE WHEN price3 IS NULL THEN money1 ELSE money1 + {_yen('g3', 'lot2')} END AS money3, n1 + CAST(price3 IS NOT NULL AS BIGINT) AS n3,
                                CASE WHEN price3 IS NULL THEN closed1 ELSE list_concat(closed1, {_trade('n1', 'pos2', 'entered2', 'entry2', 'price3', 'g3', 'lot2', 'money1', 'reason3')}) END AS closed3, trail > 0 AND (trailed - stop2) * pos2 > 0 AS trails
                            FROM (SELECT *, (price3 - entry2) * pos2 / {PIP} AS g3, CASE WHEN stopped THEN source2 ELSE 'take_profit' END AS reason3, CASE WHEN pos2 = 1 THEN h - trail * {PIP} ELSE l + trail * {PIP} END AS trailed
                                FROM (SELECT *, CASE WHEN stopped THEN CASE WHEN pos2 = 1 THEN least(stop2, o) ELSE greatest(stop2, o) END WHEN reached THEN target2 END AS price3
                                    FROM (SELECT *, pos2 <> 0 AND CASE WHEN pos2 = 1 THEN l <= stop2 ELSE h >= stop2 END AS stopped, pos2 <> 0 AND CASE WHEN pos2 = 1 THEN h >= target2 ELSE l <= target2 END AS reached
                                        FROM (SELECT *, CASE WHEN enters THEN pending ELSE pos1 END AS pos2, CASE WHEN enters THEN o ELSE entry END AS entry2, CASE WHEN enters THEN o - pending * sp * {PIP} ELSE stop END AS stop2, CASE WHEN enters THEN o + pending * tp * {PIP} ELSE target END AS target2,
                                                CASE WHEN enters THEN 'stop_loss' ELSE source END AS source2, CASE WHEN enters THEN {_LOT} ELSE lot END AS lot2, CASE WHEN enters THEN t ELSE entered END AS entered2
                                            FROM (SELECT *, pending <> 0 AND pos1 = 0 AND (sa < 0 OR sb < 0 OR sa = sb OR CASE WHEN sa < sb THEN {now} >= sa AND {now} < sb ELSE {now} >= sa OR {now} < sb END) AS enters
                                                FROM (SELECT *, CASE WHEN turned THEN 0 ELSE pos END AS pos1, CASE WHEN turned THEN pips + {half_up('g1 - spread', 1)} ELSE pips END AS pips1, CASE WHEN turned THEN money + {_yen('g1', 'lot')} ELSE money END AS money1, n + CAST(turned AS BIGINT) AS n1,
                                                        CASE WHEN turned THEN {_trade('n', 'pos', 'entered', 'entry', 'o', 'g1', 'lot', 'money', "'opposite_signal'")} ELSE {none} END AS closed1
                                                    FROM (SELECT s.* EXCLUDE (i, t), b.* EXCLUDE (symbol), rn.* EXCLUDE (run_id), pos <> 0 AND close_next AS turned, (b.o - entry) * pos / {PIP} AS g1
                                                        FROM sim s JOIN rn ON rn.run_id = s.run_id JOIN sig b ON b.symbol = s.symbol AND b.i = s.i + 1))))))))))))),
    td AS (SELECT run_id, symbol, spread, unnest(closed) AS x FROM sim JOIN rn USING (run_id)),
    trades AS (SELECT run_id, symbol, x.id AS id, CASE WHEN x.pos = 1 THEN 'long' ELSE 'short' END AS direction, x.entry_time AS entry_time, x.exit_time AS exit_time, x.entry_price AS entry_price, x.exit_price AS exit_price, {half_up('x.gross', 1)} AS gross_pips, spread AS spread_pips,
        {half_up('x.gross - spread', 1)} AS net_pips, x.lot AS lot, {PIP_VALUE}::DOUBLE AS pip_value, {half_up(f'x.gross * ({PIP_VALUE} * x.lot)')} AS gross_yen, {half_up(f'spread * ({PIP_VALUE} * x.lot)')} AS spread_yen, {half_up(f'x.gross * ({PIP_VALUE} * x.lot) - spread * ({PIP_VALUE} * x.lot)')} AS net_yen, x.balance AS balance_after, x.reason AS exit_reason FROM td)"""


#: Table m: metrics of every run and series of ``sim`` and ``trades``.
METRICS = """isl AS (SELECT *, sum(new) OVER (PARTITION BY run_id, symbol ORDER BY id) AS island FROM (SELECT run_id, symbol, id, sign(net_yen) AS s, CASE WHEN sign(net_yen) = lag(sign(net_yen)) OVER (PARTITION BY run_id, symbol ORDER BY id) THEN 0 ELSE 1 END AS new FROM trades)),
    lng AS (SELECT run_id, symbol, island, s, count(*) AS k FROM isl GROUP BY ALL), stk AS (SELECT run_id, symbol, coalesce(max(k) FILTER (s = 1), 0) AS max_wins, coalesce(max(k) FILTER (s = -1), 0) AS max_losses FROM lng GROUP BY ALL),
    tot AS (SELECT run_id, symbol, count(*) AS trades, count(*) FILTER (net_yen > 0) AS wins, count(*) FILTER (net_yen < 0) AS losses, sum(net_yen) AS net_yen, sum(net_pips) AS net_pips, coalesce(sum(net_yen) FILTER (net_yen > 0), 0) AS gp, coalesce(sum(net_yen) FILTER (net_yen < 0), 0) AS gl FROM trades GROUP BY ALL),
    dwn AS (SELECT run_id, symbol, max(dd_yen) AS max_drawdown_yen, max(dd_pips) AS max_drawdown_pips, max(dd_pct) AS max_drawdown_pct FROM sim GROUP BY ALL),
    m AS (SELECT run_id, symbol, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(net_yen, 0.0) AS net_yen, floor(coalesce(net_pips, 0.0) * 10 + 0.5) / 10 AS net_pips, coalesce(gp, 0.0) AS gross_profit_yen, coalesce(gl, 0.0) AS gross_loss_yen,
        max_drawdown_yen, max_drawdown_pips, max_drawdown_pct, CASE WHEN trades > 0 THEN wins * 100.0 / trades ELSE 0 END AS win_rate, CASE WHEN coalesce(gl, 0) = 0 THEN CASE WHEN gp > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END ELSE gp / abs(gl) END AS profit_factor,
        CASE WHEN coalesce(losses, 0) = 0 THEN CASE WHEN wins > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END WHEN wins > 0 THEN (gp / wins) / abs(gl / losses) ELSE 0 END AS reward_ratio, CAST(floor(CASE WHEN wins > 0 THEN gp / wins ELSE 0 END + 0.5) AS BIGINT) AS average_win_yen,
        CAST(floor(CASE WHEN losses > 0 THEN gl / losses ELSE 0 END + 0.5) AS BIGINT) AS average_loss_yen, CAST(coalesce(max_wins, 0) AS BIGINT) AS max_wins, CAST(coalesce(max_losses, 0) AS BIGINT) AS max_losses FROM dwn LEFT JOIN tot USING (run_id, symbol) LEFT JOIN stk USING (run_id, symbol))"""


def donchian(source: str, name: str = "sg") -> str:
    """Signals of the 20-bar channel break over the table ``source``."""
    return f"""{name}c AS (SELECT *, {sql.frame('max', 'h', 20, 1)} AS up, {sql.frame('min', 'l', 20, 1)} AS dn FROM {source}),
    {name} AS (SELECT symbol, t, o, h, l, c, {sql.lag('t')} IS NOT NULL AND coalesce(c > up, false) AS long, {sql.lag('t')} IS NOT NULL AND coalesce(c < dn, false) AS short FROM {name}c)"""


def crosses(source: str, name: str = "sg") -> str:
    """Signals of the mean of 5 closes crossing that of 20, over the table ``source``."""
    return f"""{name}c AS (SELECT *, {sql.frame('avg', 'c', 5)} AS f, {sql.frame('avg', 'c', 20)} AS s FROM {source}),
    {name} AS (SELECT symbol, t, o, h, l, c, {sql.lag('t')} IS NOT NULL AND {sql.up('f', 's')} AS long, {sql.lag('t')} IS NOT NULL AND {sql.down('f', 's')} AS short FROM {name}c)"""
