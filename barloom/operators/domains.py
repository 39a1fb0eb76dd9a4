"""Which parameters of entry rules may be registered; stricter than what the rules can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.conditions import RULES

# Whole numbers from, to (None: any).
WHOLE = {
    "maCross": {"fast": (1, None), "slow": (1, None)},
    "rsi": {"period": (2, None)},
    "demarker": {"period": (2, 1000)},
    "bollinger": {"period": (2, None)},
    "envelope": {"period": (2, 1000)},
    "macdCross": {"fast": (1, None), "slow": (1, None), "signal": (1, None)},
    "ichimokuCross": {"conversion": (1, None), "base": (1, None), "span": (1, None), "shift": (1, None)},
    "donchianBreak": {"period": (1, None)},
    "keltnerBreak": {"ema": (1, None), "atr": (1, None)},
    "cciBreak": {"period": (2, None)},
    "adxTrend": {"period": (2, None)},
    "momentum": {"period": (2, 1000)},
    "ao": {"fast": (2, 1000), "slow": (2, 1000)},
    "rvi": {"period": (2, 1000)},
    "stochastic": {"k": (1, None), "d": (1, None), "smooth": (1, None)},
    "stochCross": {"k": (2, 1000), "d": (2, 1000), "smooth": (1, None)},
    "alligator": {"jaw": (2, 1000), "teeth": (2, 1000), "lips": (2, 1000), "jaw_shift": (0, 500), "teeth_shift": (0, 500), "lips_shift": (0, 500)},
}
# Numbers above 0 and below (None: any finite one).
POSITIVE = {
    "rsi": {"threshold": 100},
    "demarker": {"threshold": 1},
    "bollinger": {"multiplier": None},
    "envelope": {"deviation": None},
    "keltnerBreak": {"multiplier": None},
    "cciBreak": {"level": None},
    "adxTrend": {"threshold": 100},
    "parabolicSar": {"step": 1, "maximum": 1},
    "stochastic": {"threshold": 100},
}
# Words.
_COMPARED = ("below", "above", "crossBelow", "crossAbove")
WORDS = {
    "maCross": {"fast_type": ("sma", "ema"), "slow_type": ("sma", "ema")},
    "rsi": {"comparison": _COMPARED},
    "demarker": {"comparison": _COMPARED},
    "bollinger": {"mode": ("touch", "break"), "band": ("lower", "upper")},
    "ichimokuCross": {"cloud": ("true", "false")},
    "stochastic": {"comparison": _COMPARED},
}
# The first is less than the second.
RISING = {
    "maCross": [("fast", "slow")],
    "macdCross": [("fast", "slow")],
    "ao": [("fast", "slow")],
    "alligator": [("teeth", "jaw"), ("lips", "teeth"), ("teeth_shift", "jaw_shift"), ("lips_shift", "teeth_shift")],
}
SAR_LEAST_STEP = 0.02


def _checks() -> list[tuple[str, str, str, Column]]:
    """(rule, parameter, problem, whether it is sound)."""
    number, word = (lambda p: F.try_element_at("numbers", F.lit(p))), (lambda p: F.try_element_at("words", F.lit(p)))
    out = []
    for kind, params in WHOLE.items():
        for p, (least, most) in params.items():
            x = number(p)
            out.append((kind, p, "domain", (F.floor(x) == x) & (x >= least) & (x <= most if most else x < float("inf"))))
    for kind, params in POSITIVE.items():
        out += [(kind, p, "domain", (number(p) > 0) & (number(p) < float(most or "inf"))) for p, most in params.items()]
    for kind, params in WORDS.items():
        out += [(kind, p, "domain", word(p).isin(*allowed)) for p, allowed in params.items()]
    for kind, pairs in RISING.items():
        out += [(kind, a, "order", number(a) < number(b)) for a, b in pairs]
    out.append(("parabolicSar", "step", "order", number("step") >= SAR_LEAST_STEP))
    out.append(("parabolicSar", "maximum", "order", number("maximum") >= number("step")))
    out.append(("ichimokuCross", "shift", "order", (word("cloud") != "true") | (number("shift") == number("base"))))
    return out


def rule_problems(conditions: DataFrame) -> DataFrame:
    """Every reason why a condition (id, kind, numbers, words) may not be registered: id, parameter, problem.

    ``numbers`` and ``words`` map parameters to values.  ``domain``: missing or out of
    its domain; ``order``: not so in relation to another one, or to the least step;
    ``kind``: no such rule.  Sound conditions give no row.
    """
    row = lambda p, problem: F.struct(F.lit(p).alias("parameter"), F.lit(problem).alias("problem"))
    by_kind: dict[str, list[Column]] = {}
    for kind, p, problem, sound in _checks():
        by_kind.setdefault(kind, []).append(F.when(~F.coalesce(sound, F.lit(False)), row(p, problem)))
    known = F.coalesce(F.col("kind").isin(*RULES), F.lit(False))
    found = F.when(~known, F.array(row("kind", "kind")))
    for kind, rows in by_kind.items():
        found = found.when(F.col("kind") == kind, F.array_compact(F.array(*rows)))
    return conditions.select("id", F.explode(found).alias("x")).select("id", "x.*")
