"""Entry conditions: a small rule language compiled to boolean columns.

A condition is a dict with ``type`` and parameters.  ``compile_condition`` adds the
features it needs and returns the long and short columns; ``signals`` ANDs the
conditions of a strategy.  All rules are false on a series' first bar, wherever a
needed value is missing, and for parameters outside a rule's domain.  Features are
named by their parameters, so conditions that share one compute it once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import recurrent as rec
from barloom.sources.bars import series

Compiled = tuple[DataFrame, Column, Column]
RULES: dict[str, Callable[[DataFrame, dict], Compiled]] = {}

# Parameters every rule starts from.
DEFAULTS = {
    "maCross": {"fast_type": "sma", "fast": 20, "slow_type": "sma", "slow": 50},
    "rsi": {"period": 14, "comparison": "below", "threshold": 30},
    "demarker": {"period": 14, "comparison": "below", "threshold": 0.3},
    "bollinger": {"period": 20, "multiplier": 2, "band": "lower", "mode": "touch"},
    "envelope": {"period": 20, "deviation": 0.5},
    "macdCross": {"fast": 12, "slow": 26, "signal": 9},
    "ichimokuCross": {"conversion": 9, "base": 26, "span": 52, "shift": 26, "cloud": False},
    "donchianBreak": {"period": 20},
    "keltnerBreak": {"ema": 20, "atr": 10, "multiplier": 2},
    "cciBreak": {"period": 20, "level": 100},
    "adxTrend": {"period": 14, "threshold": 20},
    "parabolicSar": {"step": 0.02, "maximum": 0.2},
    "momentum": {"period": 14},
    "ao": {"fast": 5, "slow": 34},
    "rvi": {"period": 10},
    "stochastic": {"k": 14, "d": 3, "smooth": 3, "comparison": "below", "threshold": 20},
    "stochCross": {"k": 14, "d": 3, "smooth": 3},
    "alligator": {"periods": (13, 8, 5), "shifts": (8, 5, 3)},
}
MIRROR = {"below": "above", "above": "below", "crossBelow": "crossAbove", "crossAbove": "crossBelow", "upper": "lower", "lower": "upper"}


def rule(name: str):
    def register(f):
        RULES[name] = f
        return f

    return register


def before(x: Column | str) -> Column:
    return F.lag(x).over(series())


def crossed(a: str, b: str | float, up: bool) -> Column:
    """a was at or under b and is above it now (``up``), or the mirror image."""
    b_now = F.col(b) if isinstance(b, str) else F.lit(float(b))
    b_then = before(b) if isinstance(b, str) else b_now
    return (before(a) <= b_then) & (F.col(a) > b_now) if up else (before(a) >= b_then) & (F.col(a) < b_now)


def compared(x: str, how: str, level: float) -> Column:
    now, then = F.col(x), before(x)
    return {"below": now <= level, "above": now >= level, "crossBelow": (then > level) & (now <= level), "crossAbove": (then < level) & (now >= level)}[how]


def _named(bars: DataFrame, names: dict[str, str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add an indicator under parameter names, unless they are there already."""
    if all(n in bars.columns for n in names.values()):
        return bars
    out = add(bars)
    for old, new in names.items():
        out = out.withColumnRenamed(old, new)
    return out.select(*bars.columns, *names.values())


def _never(bars: DataFrame) -> Compiled:
    return bars, F.lit(False), F.lit(False)


def period(x: float) -> int:
    return max(1, int(x + 0.5))


def _mean(bars: DataFrame, kind: str, n: int) -> tuple[DataFrame, str]:
    name = f"{kind}{period(n)}"
    add = ind.sma if kind == "sma" else rec.ema
    return _named(bars, {name: name}, lambda b: add(b, period(n))), name


@rule("maCross")
def _(bars, p):
    bars, fast = _mean(bars, p["fast_type"], p["fast"])
    bars, slow = _mean(bars, p["slow_type"], p["slow"])
    return bars, crossed(fast, slow, True), crossed(fast, slow, False)


def _levels(bars: DataFrame, x: str, p: dict, whole: float) -> Compiled:
    return bars, compared(x, p["comparison"], p["threshold"]), compared(x, MIRROR[p["comparison"]], whole - p["threshold"])


@rule("rsi")
def _(bars, p):
    name = f"rsi{period(p['period'])}"
    return _levels(_named(bars, {"rsi": name}, lambda b: rec.rsi(b, period(p["period"]))), name, p, 100)


@rule("demarker")
def _(bars, p):
    if p["period"] != int(p["period"]) or p["period"] < 1 or not 0 <= p["threshold"] <= 1:
        return _never(bars)
    name = f"demarker{p['period']}"
    return _levels(_named(bars, {"demarker": name}, lambda b: ind.demarker(b, p["period"])), name, p, 1)


@rule("bollinger")
def _(bars, p):
    key = f"{period(p['period'])}_{p['multiplier']}".replace(".", "d")
    names = {"bb_upper": f"bbu{key}", "bb_lower": f"bbl{key}"}
    bars = _named(bars, names, lambda b: ind.bollinger(b, period(p["period"]), p["multiplier"]))

    def side(band: str) -> Column:
        level = F.col(names[f"bb_{band}"])
        return (F.col("h" if p["mode"] == "touch" else "c") >= level) if band == "upper" else (F.col("l" if p["mode"] == "touch" else "c") <= level)

    return bars, side(p["band"]), side(MIRROR[p["band"]])


@rule("envelope")
def _(bars, p):
    if p["period"] != int(p["period"]) or not 2 <= p["period"] <= 1000 or not p["deviation"] > 0:
        return _never(bars)
    key = f"{p['period']}_{p['deviation']}".replace(".", "d")
    names = {"env_upper": f"envu{key}", "env_lower": f"envl{key}"}
    bars = _named(bars, names, lambda b: ind.envelope(b, p["period"], p["deviation"]))
    both = F.col(names["env_lower"]).isNotNull()
    return bars, both & crossed("c", names["env_upper"], True), both & crossed("c", names["env_lower"], False)


@rule("macdCross")
def _(bars, p):
    fast, slow, signal = period(p["fast"]), period(p["slow"]), period(p["signal"])
    if fast >= slow:
        return _never(bars)
    names = {"macd": f"macd{fast}_{slow}", "macd_signal": f"macds{fast}_{slow}_{signal}"}
    bars = _named(bars, names, lambda b: rec.macd(b, fast, slow, signal))
    return bars, crossed(*names.values(), True), crossed(*names.values(), False)


@rule("ichimokuCross")
def _(bars, p):
    key = f"{p['conversion']}_{p['base']}_{p['span']}_{p['shift']}"
    names = {n: f"{n}{key}" for n in ("tenkan", "kijun", "span_a", "span_b")}
    bars = _named(bars, names, lambda b: ind.ichimoku(b, p["conversion"], p["base"], p["span"], p["shift"]))
    tenkan, kijun, a, b = names.values()
    up, down = crossed(tenkan, kijun, True), crossed(tenkan, kijun, False)
    if p["cloud"]:
        there = F.col(a).isNotNull() & F.col(b).isNotNull()
        up, down = up & there & (F.col("c") > F.greatest(a, b)), down & there & (F.col("c") < F.least(a, b))
    return bars, up, down


@rule("donchianBreak")
def _(bars, p):
    n = period(p["period"])
    names = {"don_upper": f"donu{n}", "don_lower": f"donl{n}"}
    bars = _named(bars, names, lambda b: ind.donchian(b, n))
    return bars, F.col("c") > F.col(names["don_upper"]), F.col("c") < F.col(names["don_lower"])


@rule("keltnerBreak")
def _(bars, p):
    key = f"{p['ema']}_{p['atr']}_{p['multiplier']}".replace(".", "d")
    bars, mid = _mean(bars, "ema", p["ema"])
    width = f"kelta{key}"
    bars = _named(bars, {"atr": width}, lambda b: ind.atr(b, period(p["atr"])))
    moving, reach = F.col(width) > 0, p["multiplier"] * F.col(width)
    return bars, moving & (F.col("c") >= F.col(mid) + reach), moving & (F.col("c") <= F.col(mid) - reach)


@rule("cciBreak")
def _(bars, p):
    if not p["level"] > 0:
        return _never(bars)
    name = f"cci{period(p['period'])}"
    bars = _named(bars, {"cci": name}, lambda b: ind.cci(b, period(p["period"])))
    return bars, F.col(name) >= p["level"], F.col(name) <= -p["level"]


@rule("adxTrend")
def _(bars, p):
    n = period(p["period"])
    if n < 2 or not 0 < p["threshold"] < 100:
        return _never(bars)
    names = {"plus_di": f"pdi{n}", "minus_di": f"mdi{n}", "adx": f"adx{n}"}
    bars = _named(bars, names, lambda b: rec.adx(b, n))
    strong = F.col(names["adx"]) >= p["threshold"]
    return bars, strong & crossed(names["plus_di"], names["minus_di"], True), strong & crossed(names["plus_di"], names["minus_di"], False)


@rule("parabolicSar")
def _(bars, p):
    if not 0 < p["step"] <= p["maximum"]:
        return _never(bars)
    key = f"{p['step']}_{p['maximum']}".replace(".", "d")
    names = {"sar": f"sar{key}", "sar_long": f"sarl{key}"}
    bars = _named(bars, names, lambda b: rec.parabolic_sar(b, p["step"], p["maximum"]))
    now, then = F.col(names["sar_long"]), before(names["sar_long"])
    return bars, ~then & now, then & ~now


@rule("momentum")
def _(bars, p):
    if p["period"] != int(p["period"]) or p["period"] < 1:
        return _never(bars)
    name = f"momentum{p['period']}"
    bars = _named(bars, {"momentum": name}, lambda b: ind.momentum(b, p["period"]))
    return bars, crossed(name, 100.0, True), crossed(name, 100.0, False)


@rule("ao")
def _(bars, p):
    if not 1 <= p["fast"] < p["slow"]:
        return _never(bars)
    name = f"ao{p['fast']}_{p['slow']}"
    bars = _named(bars, {"ao": name}, lambda b: ind.ao(b, p["fast"], p["slow"]))
    return bars, crossed(name, 0.0, True), crossed(name, 0.0, False)


@rule("rvi")
def _(bars, p):
    names = {"rvi": f"rvi{p['period']}", "rvi_signal": f"rvis{p['period']}"}
    bars = _named(bars, names, lambda b: ind.rvi(b, p["period"]))
    return bars, crossed(*names.values(), True), crossed(*names.values(), False)


@rule("stochastic")
def _(bars, p):
    name = f"stochk{p['k']}_{p['smooth']}"
    return _levels(_named(bars, {"stoch_k": name}, lambda b: ind.stochastic(b, p["k"], p["d"], p["smooth"])), name, p, 100)


@rule("stochCross")
def _(bars, p):
    if not (2 <= p["k"] <= 1000 and 2 <= p["d"] <= 1000 and p["smooth"] >= 1):
        return _never(bars)
    key = f"{p['k']}_{p['d']}_{p['smooth']}"
    names = {"stochf_k": f"stochfk{key}", "stochf_d": f"stochfd{key}"}
    bars = _named(bars, names, lambda b: ind.stochastic_fresh(b, p["k"], p["d"], p["smooth"]))
    return bars, crossed(*names.values(), True), crossed(*names.values(), False)


@rule("alligator")
def _(bars, p):
    (a, b, c), (x, y, z) = p["periods"], p["shifts"]
    if not (a > b > c >= 1 and 500 >= x > y > z >= 0):
        return _never(bars)
    key = "_".join(map(str, (*p["periods"], *p["shifts"])))
    names = {n: f"{n}{key}" for n in ("jaw", "teeth", "lips")}
    bars = _named(bars, names, lambda d: rec.alligator(d, p["periods"], p["shifts"]))
    jaw, teeth, lips = names.values()
    return bars, crossed(lips, teeth, True) & (F.col(teeth) > F.col(jaw)), crossed(lips, teeth, False) & (F.col(teeth) < F.col(jaw))


def _recurrences(kind: str, p: dict) -> list[tuple[Callable[[], object], list[str], dict[str, str]]]:
    """(kernel, inputs, outputs) of the recurrences that a rule reads, under the names its compiler looks for."""
    if kind == "maCross":
        sides = [period(p[side]) for side in ("fast", "slow") if p[f"{side}_type"] == "ema"]
        return [(partial(rec.Ema, n), ["c"], {f"ema{n}": "double"}) for n in sides]
    if kind == "rsi":
        return [(partial(rec.Rsi, n), ["c"], {f"rsi{n}": "double"}) for n in [period(p["period"])]]
    if kind == "macdCross":
        a, b, s = period(p["fast"]), period(p["slow"]), period(p["signal"])
        return [(partial(rec.Macd, a, b, s), ["c"], {f"macd{a}_{b}": "double", f"macds{a}_{b}_{s}": "double", f"__macdh{a}_{b}_{s}": "double"})] if a < b else []
    if kind == "keltnerBreak":
        return [(partial(rec.Ema, n), ["c"], {f"ema{n}": "double"}) for n in [period(p["ema"])]]
    if kind == "adxTrend":
        n = period(p["period"])
        return [(partial(rec.Adx, n), ["h", "l", "c"], {f"pdi{n}": "double", f"mdi{n}": "double", f"adx{n}": "double"})] if n >= 2 else []
    if kind == "parabolicSar" and 0 < p["step"] <= p["maximum"]:
        key = f"{p['step']}_{p['maximum']}".replace(".", "d")
        return [(partial(rec.Sar, p["step"], p["maximum"]), ["h", "l"], {f"sar{key}": "double", f"sarl{key}": "boolean"})]
    if kind == "alligator":
        (a, b, c), (x, y, z) = p["periods"], p["shifts"]
        key = "_".join(map(str, (*p["periods"], *p["shifts"])))
        return [(partial(rec.Alligator, p["periods"], p["shifts"]), ["h", "l"], {f"{n}{key}": "double" for n in ("jaw", "teeth", "lips")})] if a > b > c >= 1 and 500 >= x > y > z >= 0 else []
    return []


def with_recurrences(bars: DataFrame, conditions: list[dict]) -> DataFrame:
    """Bars with the recurrent features of all conditions, computed in one scan; the compilers find them by name."""
    found: dict[tuple, tuple] = {}
    for condition in conditions:
        kind = condition["type"]
        for kernel, inputs, outputs in _recurrences(kind, DEFAULTS.get(kind, {}) | {k: v for k, v in condition.items() if k != "type"}):
            if not set(outputs) <= set(bars.columns):
                found[tuple(outputs)] = (kernel, inputs, outputs)
    kernels, seen = [], set(bars.columns)
    for kernel, inputs, outputs in found.values():
        fresh = {n if n not in seen else f"__again{len(seen)}_{n}": t for n, t in outputs.items()}
        seen |= set(fresh)
        kernels.append((kernel, inputs, fresh))
    out = rec.fused(bars, kernels) if kernels else bars
    return out.drop(*(n for _, _, outputs in kernels for n in outputs if n.startswith("__")))


def compile_condition(bars: DataFrame, condition: dict) -> Compiled:
    kind = condition["type"]
    if kind not in RULES:
        raise ValueError(f"no such condition: {kind}")
    unknown = condition.keys() - DEFAULTS[kind].keys() - {"type"}
    if unknown:
        raise ValueError(f"{kind} has no {', '.join(sorted(unknown))}")
    bars, up, down = RULES[kind](bars, DEFAULTS[kind] | {k: v for k, v in condition.items() if k != "type"})
    later = before("t").isNotNull()
    return bars, F.coalesce(later & up, F.lit(False)), F.coalesce(later & down, F.lit(False))


def signals(bars: DataFrame, conditions: list[dict], long: str = "long", short: str = "short") -> DataFrame:
    """Bars with the columns ``long`` and ``short``: all conditions hold (no conditions: never)."""
    up = down = F.lit(bool(conditions))
    out = with_recurrences(bars, conditions)
    for condition in conditions:
        out, a, b = compile_condition(out, condition)
        up, down = up & a, down & b
    return out.withColumn(long, up).withColumn(short, down)


# How a rule is shown.
LABELS = {
    "maCross": "{fast_type}{fast} x {slow_type}{slow}",
    "rsi": "RSI{period} {comparison} {threshold}",
    "demarker": "DeMarker{period} {comparison} {threshold}",
    "bollinger": "BB{period}/{multiplier} {band} {mode}",
    "envelope": "Envelope{period}/{deviation}% ブレイク",
    "macdCross": "MACD {fast}/{slow}/{signal} クロス",
    "ichimokuCross": "一目{conversion}/{base}/{span} クロス{cloud}",
    "donchianBreak": "Donchian{period} ブレイク",
    "keltnerBreak": "Keltner{ema}/{atr} x{multiplier} ブレイク",
    "stochastic": "Stoch{k}/{d}/{smooth} {comparison} {threshold}",
    "stochCross": "Stoch{k}/{d}/{smooth} %K/%D クロス",
    "cciBreak": "CCI{period} ±{level} ブレイク",
    "adxTrend": "ADX{period}/{threshold} DIクロス",
    "parabolicSar": "SAR{step}/{maximum} フリップ",
    "momentum": "Momentum{period} 100クロス",
    "ao": "AO{fast}/{slow} ゼロラインクロス",
    "rvi": "RVI{period} シグナルクロス",
    "alligator": "Alligator {periods} ({shifts}) クロス",
}


def label(condition: dict) -> str:
    """A rule as shown in lists."""
    kind = condition["type"]
    p = DEFAULTS[kind] | {k: v for k, v in condition.items() if k != "type"}
    shown = {k: int(v) if isinstance(v, float) and v == int(v) else v for k, v in p.items()}
    if kind == "maCross":
        shown |= {k: p[k].upper() for k in ("fast_type", "slow_type")}
    if kind == "ichimokuCross":
        shown["cloud"] = "(雲フィルタ)" if p["cloud"] else ""
    if kind == "alligator":
        shown |= {k: "/".join(map(str, p[k])) for k in ("periods", "shifts")}
    return LABELS[kind].format(**shown)


def minutes_of(text: str) -> int | None:
    h, _, m = text.partition(":")
    ok = h.isdigit() and m.isdigit() and len(h) == 2 and len(m) == 2 and int(h) < 24 and int(m) < 60
    return int(h) * 60 + int(m) if ok else None


def in_session(t: Column, start: str, end: str, offset_minutes: int = 0) -> Column:
    """Whether a time of day lies in [start, end), across midnight where end is before start; malformed or equal: always."""
    a, b = minutes_of(start), minutes_of(end)
    if a is None or b is None or a == b:
        return F.lit(True)
    now = F.pmod(F.floor(t / 60) + offset_minutes, F.lit(1440))
    return (now >= a) & (now < b) if a < b else (now >= a) | (now < b)
