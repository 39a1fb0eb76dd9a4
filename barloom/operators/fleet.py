"""Many runs of the trade simulation over one series, stepped as vectors.

Element k of every array belongs to run k.  A bar without signals on which no run holds
or awaits a position changes nothing but marks, and is skipped where marks are not asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

REASONS = np.array(["stop_loss", "trailing_stop", "take_profit", "opposite_signal", "end"], object)
STOP, TRAIL, TARGET, OPPOSITE, END = range(5)


def _half_up(x: np.ndarray, digits: int = 0) -> np.ndarray:
    k = 10**digits
    return np.floor(x * k + 0.5) / k


def _minutes(text: str | None) -> int:
    """Minutes of "HH:MM"; -1 for anything else."""
    if text is None or len(text) != 5 or text[2] != ":" or not (text[:2] + text[3:]).isdigit():
        return -1
    h, m = int(text[:2]), int(text[3:])
    return h * 60 + m if h < 24 and m < 60 else -1


class Fleet:
    def __init__(self, runs: list[dict], symbol: str, tf: str, pip: float, marks: bool):
        self.symbol, self.tf, self.pip, self.marks = symbol, tf, pip, marks
        n = len(runs)
        number = lambda name, default=0.0: np.array([default if r[name] is None else r[name] for r in runs], float)
        positive = lambda name, default: np.where(np.isfinite(x := number(name, default)) & (x > 0), x, default)
        self.ids = np.array([r["run_id"] for r in runs], object)
        self.stop_pips, self.target_pips, self.trail_pips = number("stop_pips"), number("target_pips"), number("trailing_pips")
        self.trails, self.spread = self.trail_pips > 0, number("spread_pips")
        self.opposite = np.array([bool(r["close_on_opposite"]) for r in runs])
        ways = [(r["directions"] or "").split(",") for r in runs]
        self.long_ok, self.short_ok = np.array(["long" in w for w in ways]), np.array(["short" in w for w in ways])
        self.short_first = np.array(["short" in w and "long" in w and w.index("short") < w.index("long") for w in ways])
        self.begin, self.until = np.array([_minutes(r["session_start"]) for r in runs]), np.array([_minutes(r["session_end"]) for r in runs])
        self.offset = np.array([r["session_offset"] or 0 for r in runs])
        self.always = (self.begin < 0) | (self.until < 0) | (self.begin == self.until)
        modes = [r["mode"] for r in runs]
        self.compound, self.risked = np.array([m == "compound" for m in modes]), np.array([m == "fixedRisk" for m in modes])
        self.fixed, self.risk, self.most = positive("fixed_lot", 0.1), positive("risk_pct", 1.0), np.maximum(0.01, positive("max_lot", 100.0))
        self.loss_pips = positive("stop_pips", 1.0) + np.maximum(0.0, self.spread)
        self.balance = positive("balance", 1_000_000.0)
        zeros = lambda kind=float: np.zeros(n, kind)
        self.side, self.pending, self.close_next = zeros(int), zeros(int), zeros(bool)
        self.entry, self.stop, self.target, self.lot, self.unit = (zeros() for _ in range(5))
        self.trailed, self.entered = zeros(bool), zeros(np.int64)
        self.pips, self.money, self.peak_pips, self.peak = zeros(), zeros(), zeros(), self.balance.copy()
        self.trades = zeros(np.int64)
        self.worst = {x: zeros() for x in ("drawdown_pips", "drawdown_yen", "drawdown_pct")}
        self.started, self.done = False, False
        self.out: list[dict[str, np.ndarray]] = []
        self.pending_rows = 0

    # -- rows -----------------------------------------------------------------

    def _keep(self, at: np.ndarray, kind: str, **columns) -> None:
        self.out.append({"run": at, "kind": kind} | columns)
        self.pending_rows += len(at)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.done and not self.marks:
            self._keep(np.arange(len(self.ids)), "worst", **self.worst)
            self.done = False
        for part in self.out:
            n = len(part["run"])
            known = {"run_id": self.ids[part["run"]], "symbol": [self.symbol] * n, "tf": [self.tf] * n, "kind": [part["kind"]] * n}
            made = known | {k: v for k, v in part.items() if k not in ("run", "kind")}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)
        self.out, self.pending_rows = [], 0

    # -- a bar ----------------------------------------------------------------

    def _close(self, at: np.ndarray, t: int, price: np.ndarray, reason: np.ndarray) -> None:
        if not len(at):
            return
        side, entry, spread = self.side[at], self.entry[at], self.spread[at]
        gross = (price - entry) * side / self.pip
        unit = self.unit[at] * self.lot[at]
        net = gross * unit - spread * unit
        self.trades[at] += 1
        net_pips, net_yen = _half_up(gross - spread, 1), _half_up(net)
        self._keep(
            at, "trade", id=self.trades[at], direction=np.where(side > 0, "long", "short").astype(object), entry_time=self.entered[at], exit_time=np.full(len(at), t), entry_price=entry, exit_price=price,
            gross_pips=_half_up(gross, 1), spread_pips=spread, net_pips=net_pips, lot=self.lot[at], pip_value=_half_up(self.unit[at]), gross_yen=_half_up(gross * unit), spread_yen=_half_up(spread * unit),
            net_yen=net_yen, balance_after=_half_up(self.balance[at] + self.money[at] + net), exit_reason=REASONS[reason],
        )
        self.pips[at] += net_pips
        self.money[at] += net_yen
        self.side[at] = 0

    def _lots(self, at: np.ndarray, unit: float) -> np.ndarray:
        now, fixed = self.balance[at] + self.money[at], self.fixed[at]
        loss, risk = self.loss_pips[at] * unit, np.maximum(0.0, now) * self.risk[at] / 100
        risked = np.where((risk > 0) & (loss > 0), risk / np.where(loss > 0, loss, 1.0), fixed)
        lot = np.where(self.compound[at], fixed * np.maximum(0.0, now / self.balance[at]), np.where(self.risked[at], risked, fixed))
        return np.minimum(self.most[at], np.maximum(0.01, _half_up(lot, 2)))

    def _open(self, t: int, price: float, unit: float) -> None:
        now = (t // 60 + self.offset) % 1440
        inside = np.where(self.begin < self.until, (now >= self.begin) & (now < self.until), (now >= self.begin) | (now < self.until))
        at = np.flatnonzero((self.pending != 0) & (self.side == 0) & (self.always | inside))
        if len(at):
            side = self.pending[at]
            self.side[at], self.entry[at], self.entered[at] = side, price, t
            self.stop[at], self.target[at] = price - side * self.stop_pips[at] * self.pip, price + side * self.target_pips[at] * self.pip
            self.trailed[at], self.lot[at], self.unit[at] = False, self._lots(at, unit), unit
        self.pending[:] = 0

    def _leave(self, t: int, o: float, h: float, l: float) -> None:
        up, down = self.side > 0, self.side < 0
        stopped = (up & (l <= self.stop)) | (down & (h >= self.stop))
        reached = ~stopped & ((up & (h >= self.target)) | (down & (l <= self.target)))
        at = np.flatnonzero(stopped | reached)
        if len(at):
            fill = np.where(up[at], np.minimum(self.stop[at], o), np.maximum(self.stop[at], o))
            hit = stopped[at]
            self._close(at, t, np.where(hit, fill, self.target[at]), np.where(hit, np.where(self.trailed[at], TRAIL, STOP), TARGET))
        held = np.flatnonzero(self.trails & (self.side != 0))
        if len(held):
            up, distance = self.side[held] > 0, self.trail_pips[held] * self.pip
            stop = np.where(up, h - distance, l + distance)
            closer = np.where(up, stop > self.stop[held], stop < self.stop[held])
            self.stop[held[closer]] = stop[closer]
            self.trailed[held[closer]] = True

    def _mark(self, t: int, h: float, l: float, count: np.ndarray | None = None) -> None:
        """Marks all runs; only those of ``count`` (all where it is absent) show or measure it."""
        held = self.side != 0
        float_pips = np.where(held, (np.where(self.side > 0, l, h) - self.entry) * self.side / self.pip - self.spread, 0.0)
        pips, money = self.pips + float_pips, self.balance + self.money + np.where(held, float_pips * self.unit * self.lot, 0.0)
        self.peak_pips, self.peak = np.maximum(self.peak_pips, pips), np.maximum(self.peak, money)
        at = slice(None) if count is None else count
        down = np.maximum(0.0, self.peak - money)[at]
        peak = self.peak[at]
        made = {
            "drawdown_pips": _half_up(np.maximum(0.0, self.peak_pips - pips), 1)[at], "drawdown_yen": _half_up(down), "drawdown_pct": np.where(peak <= 0, 0.0, down / np.where(peak <= 0, 1.0, peak) * 100),
        }
        for name, value in made.items():
            self.worst[name][at] = np.maximum(self.worst[name][at], value)
        if self.marks:
            rows = np.arange(len(self.ids))[at]
            self._keep(rows, "equity", exit_time=np.full(len(rows), t), equity_pips=_half_up(pips, 1)[at], equity_yen=_half_up(money)[at], realised_yen=_half_up(self.money)[at], **made)

    def bar(self, t: int, o: float, h: float, l: float, c: float, long: bool, short: bool, last: bool, unit: float) -> None:
        self.done = last
        if not self.started:
            self.started = True
            self._mark(t, h, l)
            return
        if not (self.marks or last or long or short or self.side.any() or self.pending.any()):
            return
        turned = np.flatnonzero((self.side != 0) & self.close_next)
        if len(turned):
            self._close(turned, t, np.full(len(turned), o), np.full(len(turned), OPPOSITE))
            self.close_next[turned] = False
        if self.pending.any():
            self._open(t, o, unit)
        if self.side.any():
            self._leave(t, o, h, l)
        if last:
            held = np.flatnonzero(self.side)
            self._mark(t, h, l, np.flatnonzero(self.side == 0))
            if len(held):
                self._close(held, t, np.full(len(held), c), np.full(len(held), END))
                self._mark(t, h, l, held)
            return
        self._mark(t, h, l)
        self.close_next = np.where(self.side != 0, self.opposite & np.where(self.side > 0, bool(short), bool(long)), self.close_next)
        first = np.where(self.long_ok & bool(long) & ~(self.short_first & bool(short)), 1, np.where(self.short_ok & bool(short), -1, 0))
        self.pending = np.where(self.side == 0, first, 0)
