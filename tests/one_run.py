"""One run of the trade simulation, bar by bar in plain Python: what the vectors of the library must equal."""

from __future__ import annotations

import math


def half_up(x: float, digits: int = 0) -> float:
    k = 10**digits
    return math.floor(x * k + 0.5) / k


def _or(x: float | None, default: float) -> float:
    return x if x is not None and math.isfinite(x) and x > 0 else default


class Simulation:
    """State of one run; ``bar`` returns the rows that a bar causes."""

    def __init__(self, run: dict, pip: float):
        self.run, self.pip = run, pip
        self.balance = _or(run["balance"], 1_000_000.0)
        self.spread = run["spread_pips"] or 0.0
        self.position: dict | None = None
        self.pending: str | None = None
        self.close_next = False
        self.pips = self.money = self.peak_pips = 0.0
        self.peak = self.balance
        self.trades = 0
        self.last: dict | None = None

    def _lot(self, pip_value: float) -> float:
        run = self.run
        cap = lambda x: min(max(0.01, _or(run["max_lot"], 100.0)), max(0.01, half_up(x, 2)))
        fixed = _or(run["fixed_lot"], 0.1)
        now = self.balance + self.money
        if run["mode"] == "compound":
            return cap(fixed * max(0.0, now / self.balance))
        if run["mode"] == "fixedRisk":
            risk = max(0.0, now) * _or(run["risk_pct"], 1.0) / 100
            loss = (_or(run["stop_pips"], 1.0) + max(0.0, self.spread)) * pip_value
            return cap(risk / loss if risk > 0 and loss > 0 else fixed)
        return cap(fixed)

    def _move(self, price: float) -> float:
        p = self.position
        return (price - p["entry_price"] if p["direction"] == "long" else p["entry_price"] - price) / self.pip

    def _close(self, bar: dict, price: float, reason: str) -> dict:
        p, gross = self.position, self._move(price)
        unit = p["pip_value"] * p["lot"]
        self.trades += 1
        net = gross * unit - self.spread * unit
        row = {
            "kind": "trade", "id": self.trades, "direction": p["direction"], "entry_time": p["entry_time"], "exit_time": bar["t"], "entry_price": p["entry_price"], "exit_price": price,
            "gross_pips": half_up(gross, 1), "spread_pips": self.spread, "net_pips": half_up(gross - self.spread, 1), "lot": p["lot"], "pip_value": half_up(p["pip_value"]),
            "gross_yen": half_up(gross * unit), "spread_yen": half_up(self.spread * unit), "net_yen": half_up(net), "balance_after": half_up(self.balance + self.money + net), "exit_reason": reason,
        }
        self.pips += row["net_pips"]
        self.money += row["net_yen"]
        self.position = None
        return row

    def _exit(self, bar: dict) -> tuple[float, str] | None:
        p = self.position
        if p["direction"] == "long":
            if bar["l"] <= p["stop"]:
                return min(p["stop"], bar["o"]), p["source"]
            return (p["target"], "take_profit") if bar["h"] >= p["target"] else None
        if bar["h"] >= p["stop"]:
            return max(p["stop"], bar["o"]), p["source"]
        return (p["target"], "take_profit") if bar["l"] <= p["target"] else None

    def _trail(self, bar: dict) -> None:
        distance, p = self.run["trailing_pips"], self.position
        if not distance or distance <= 0:
            return
        stop = bar["h"] - distance * self.pip if p["direction"] == "long" else bar["l"] + distance * self.pip
        if stop > p["stop"] if p["direction"] == "long" else stop < p["stop"]:
            p["stop"], p["source"] = stop, "trailing_stop"

    def _mark(self, bar: dict) -> dict:
        pips = money = 0.0
        if self.position:
            pips = self._move(bar["l"] if self.position["direction"] == "long" else bar["h"]) - self.spread
            money = pips * self.position["pip_value"] * self.position["lot"]
        pips, money = self.pips + pips, self.balance + self.money + money
        self.peak_pips, self.peak = max(self.peak_pips, pips), max(self.peak, money)
        down = max(0.0, self.peak - money)
        return {
            "kind": "equity", "exit_time": bar["t"], "equity_pips": half_up(pips, 1), "drawdown_pips": half_up(max(0.0, self.peak_pips - pips), 1), "equity_yen": half_up(money),
            "drawdown_yen": half_up(down), "drawdown_pct": 0.0 if self.peak <= 0 else down / self.peak * 100, "realised_yen": half_up(self.money),
        }

    def bar(self, bar: dict) -> list[dict]:
        first, self.last = self.last is None, bar
        if first:
            return [self._mark(bar)]
        out = []
        if self.position and self.close_next:
            out.append(self._close(bar, bar["o"], "opposite_signal"))
            self.close_next = False
        if self.pending and not self.position and bar["open_session"]:
            sign = 1 if self.pending == "long" else -1
            self.position = {
                "direction": self.pending, "entry_time": bar["t"], "entry_price": bar["o"], "stop": bar["o"] - sign * self.run["stop_pips"] * self.pip, "target": bar["o"] + sign * self.run["target_pips"] * self.pip,
                "source": "stop_loss", "lot": self._lot(bar["pip_value"]), "pip_value": bar["pip_value"],
            }
        self.pending = None
        if self.position:
            found = self._exit(bar)
            if found:
                out.append(self._close(bar, *found))
            else:
                self._trail(bar)
        out.append(self._mark(bar))
        if bar["last"]:
            if self.position:
                out.append(self._close(bar, bar["c"], "end"))
                out[-2] = self._mark(bar)
            return out
        if self.position:
            other = "short" if self.position["direction"] == "long" else "long"
            self.close_next = bool(self.run["close_on_opposite"] and bar[other])
        else:
            self.pending = next((d for d in self.run["directions"].split(",") if bar[d]), None)
        return out
