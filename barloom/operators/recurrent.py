"""Indicators whose value depends on their own previous value.

``scan`` deals series to tasks, sorts them and streams them through a kernel that
keeps its state between Arrow batches, so a series of any length needs the memory
of one batch.  Kernels are small classes with ``step``; one task holds one series'
order, and tasks run over series in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.bars import KEY


def scan(df: DataFrame, kernel: Callable[[], object], inputs: list[str], outputs: dict[str, str], keys: tuple[str, ...] = KEY) -> DataFrame:
    """Add ``outputs`` (name -> type): per row ``kernel().step(*inputs)`` returns their values in order of t."""
    names = list(keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{k}` {v}" for k, v in outputs.items())])
    types = [{"double": pa.float64(), "boolean": pa.bool_()}[v] for v in outputs.values()]
    at, of = [df.columns.index(k) for k in names], [df.columns.index(k) for k in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            keyed = zip(*(batch.column(k).to_pylist() for k in at), strict=True)
            read = {k: batch.column(k).to_pylist() for k in set(of)}
            for key, values in zip(keyed, zip(*(read[k] for k in of), strict=True), strict=True):
                if key != now:
                    now, state = key, kernel()
                rows.append(state.step(*(None if x != x else x for x in values)))
            found = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found, types)], [*batch.schema.names, *outputs])

    dealt = df.repartition(*names).sortWithinPartitions(*names, "t")
    return dealt.mapInArrow(run, schema)


def decided(df: DataFrame, kernels: list[tuple[Callable[[], object], list[str], dict[str, str]]], asked: str, together: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The rows where ``asked`` is given, with the outputs (doubles) of kernels that see every row of their series in order of t.

    ``kernel.take(*inputs, rows)`` gets the next rows of a series as arrays and the places of
    the asked ones; ``kernel.answers()`` returns the outputs of all rows asked since, NaN for
    null.  At most about ``together`` asked rows wait for their answers.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {t}" for _, _, out in kernels for n, t in out.items())])
    outputs = [n for _, _, out in kernels for n in out]
    at, of, named = df.columns.index(asked), [[df.columns.index(x) for x in names] for _, names, _ in kernels], [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, waiting, n = None, [], [], 0

        def answered() -> list[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            for name, values in zip(outputs, [x for state in states for x in state.answers()], strict=True):
                rows = rows.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
            return rows.to_batches(max_chunksize=10_000)

        for batch in batches:
            keyed = list(zip(*(batch.column(k).to_pylist() for k in named), strict=True))
            edges = [k for k in range(len(keyed)) if k == 0 or keyed[k] != keyed[k - 1]]
            for first, end in zip(edges, [*edges[1:], len(keyed)], strict=True):
                if keyed[first] != now:
                    if n:
                        yield from answered()
                    now, states, waiting, n = keyed[first], [kernel() for kernel, _, _ in kernels], [], 0
                part = batch.slice(first, end - first)
                mask = part.column(at).is_valid()
                rows = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
                for state, names in zip(states, of, strict=True):
                    state.take(*(part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in names), rows)
                if len(rows):
                    waiting.append(part.filter(mask))
                    n += len(rows)
                if n >= together:
                    yield from answered()
                    waiting, n = [], 0
        if n:
            yield from answered()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, "t")
    return dealt.mapInArrow(run, schema)


class Ema:
    """Seeded with the mean of the first n values; nulls are skipped and the state survives them."""

    def __init__(self, n: int):
        self.n, self.alpha, self.seed, self.now = n, 2 / (n + 1), [], None

    def next(self, x: float | None) -> float | None:
        if x is None:
            return None
        if self.now is None:
            self.seed.append(x)
            if len(self.seed) < self.n:
                return None
            self.now = sum(self.seed, 0.0) / self.n
        else:
            self.now = x * self.alpha + self.now * (1 - self.alpha)
        return self.now

    def step(self, x: float | None) -> tuple:
        return (self.next(x),)


class Rsi:
    """Wilder's index; a flat series is 50, one without losses 100 (``flat``: 50 applies)."""

    def __init__(self, n: int, flat: bool = True):
        self.n, self.flat, self.count, self.gain, self.loss, self.last = n, flat, 0, 0.0, 0.0, None

    def step(self, x: float | None) -> tuple:
        if self.last is None or x is None:
            self.last = x
            return (None,)
        up = x - self.last
        self.last, self.count = x, self.count + 1
        gain, loss = max(up, 0.0), max(-up, 0.0)
        if self.count <= self.n:
            self.gain += gain
            self.loss += loss
            if self.count < self.n:
                return (None,)
            self.gain /= self.n
            self.loss /= self.n
        else:
            self.gain = (self.gain * (self.n - 1) + gain) / self.n
            self.loss = (self.loss * (self.n - 1) + loss) / self.n
        if self.loss == 0:
            return (50.0 if self.flat and self.gain == 0 else 100.0,)
        return (100 - 100 / (1 + self.gain / self.loss),)


class Macd:
    """Difference of two averages, its own average, and their difference."""

    def __init__(self, fast: int, slow: int, signal: int):
        if fast >= slow:
            raise ValueError("fast must be below slow")
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def step(self, x: float | None) -> tuple:
        a, b = self.fast.next(x), self.slow.next(x)
        line = None if a is None or b is None else a - b
        signal = self.signal.next(line)
        return line, signal, None if signal is None else line - signal


class Smma:
    """(previous * (n - 1) + x) / n after a mean of the first n; a gap starts anew."""

    def __init__(self, n: int):
        self.n = n
        self.clear()

    def clear(self) -> None:
        self.count, self.sum, self.now = 0, 0.0, None

    def next(self, x: float | None) -> float | None:
        if x is None:
            self.clear()
            return None
        if self.now is None:
            self.sum += x
            self.count += 1
            if self.count == self.n:
                self.now = self.sum / self.n
        else:
            self.now = (self.now * (self.n - 1) + x) / self.n
        return self.now


class Alligator:
    """Three smoothed means of the median price, each read ``shift`` bars late."""

    def __init__(self, periods: tuple[int, int, int], shifts: tuple[int, int, int]):
        self.lines = [Smma(n) for n in periods]
        self.late = [deque([None] * s, s + 1) for s in shifts]

    def step(self, high: float | None, low: float | None) -> tuple:
        mid = None if high is None or low is None else (high + low) / 2
        out = []
        for line, late in zip(self.lines, self.late, strict=True):
            late.append(line.next(mid))
            out.append(late[0])
        return tuple(out)


class Adx:
    """Directional movement over true range, smoothed from zero; an invalid bar starts anew."""

    def __init__(self, n: int):
        self.n, self.alpha, self.last = n, 2 / (n + 1), None
        self.clear()

    def clear(self) -> None:
        self.plus = self.minus = self.adx = 0.0
        self.count = 0

    def step(self, high: float | None, low: float | None, close: float | None) -> tuple:
        bar = None if None in (high, low, close) else (high, low, close)
        before, self.last = self.last, bar
        if bar is None or before is None:
            self.clear()
            return None, None, None
        up, down = max(high - before[0], 0.0), max(before[1] - low, 0.0)
        up, down = (up if up > down else 0.0), (down if down > up else 0.0)
        width = max(high - low, abs(high - before[2]), abs(low - before[2]))
        share = lambda x: 100 * x / width if width else 0.0
        mix = lambda new, old: new * self.alpha + old * (1 - self.alpha)
        self.plus, self.minus = mix(share(up), self.plus), mix(share(down), self.minus)
        both = self.plus + self.minus
        self.adx = mix(100 * abs((self.plus - self.minus) / both) if both else 0.0, self.adx)
        self.count += 1
        shown = self.count >= self.n
        return (self.plus if shown else None), (self.minus if shown else None), (self.adx if self.count >= 2 * self.n else None)


class Sar:
    """Parabolic stop and reverse.

    A stop is shown from the second reversal on, and not before ``CONVERGED`` bars
    after the first; a missing price ends the series.
    """

    CONVERGED = 100

    def __init__(self, step: float, most: float):
        self.increment, self.most, self.i = step, most, -1
        self.valid = 0 < step <= most
        self.turns: list[int] = []

    def step(self, high: float | None, low: float | None) -> tuple:
        self.i += 1
        if not self.valid or high is None or low is None:
            self.valid = False
            return None, None
        if self.i == 0:
            self.highest, self.lowest, self.before = high, low, (high, low)
            return None, None
        self.highest, self.lowest = max(self.highest, high), min(self.lowest, low)
        if self.i == 1:
            self.long, self.stop, self.extreme, self.pace = False, self.highest, low, self.increment
        turned = self.stop > low if self.long else self.stop < high
        if turned:
            self.long = not self.long
            self.stop = self.lowest if self.long else self.highest
            self.extreme = high if self.long else low
            self.pace, self.highest, self.lowest = self.increment, high, low
            self.turns = [*self.turns, self.i][:2]
        elif high > self.extreme if self.long else low < self.extreme:
            self.extreme, self.pace = (high if self.long else low), min(self.pace + self.increment, self.most)
        shown = len(self.turns) == 2 and self.i >= max(self.turns[0] + self.CONVERGED, self.turns[1])
        out = (self.stop, self.long) if shown else (None, None)
        self.stop += self.pace * (self.extreme - self.stop)
        self.stop = min(self.stop, low, self.before[1]) if self.long else max(self.stop, high, self.before[0])
        self.before = (high, low)
        return out


def ema(bars: DataFrame, n: int, column: str = "c", out: str | None = None) -> DataFrame:
    return scan(bars, lambda: Ema(n), [column], {out or f"ema{n}": "double"})


def rsi(bars: DataFrame, n: int = 14, flat: bool = True) -> DataFrame:
    return scan(bars, lambda: Rsi(n, flat), ["c"], {"rsi" if flat else "rsi_noflat": "double"})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return scan(bars, lambda: Macd(fast, slow, signal), ["c"], {"macd": "double", "macd_signal": "double", "macd_hist": "double"})


def alligator(bars: DataFrame, periods: tuple[int, int, int] = (13, 8, 5), shifts: tuple[int, int, int] = (8, 5, 3)) -> DataFrame:
    return scan(bars, lambda: Alligator(periods, shifts), ["h", "l"], {"jaw": "double", "teeth": "double", "lips": "double"})


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    return scan(bars, lambda: Adx(n), ["h", "l", "c"], {"plus_di": "double", "minus_di": "double", "adx": "double"})


def parabolic_sar(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    return scan(bars, lambda: Sar(step, most), ["h", "l"], {"sar": "double", "sar_long": "boolean"})


def keltner(bars: DataFrame, n: int = 20, atr_n: int = 10, k: float = 2.0) -> DataFrame:
    """kelt_upper, kelt_lower: an exponential mean and k average true ranges."""
    from barloom.operators.indicators import atr

    both = ema(atr(bars, atr_n), n, out="kelt_mid")
    return both.withColumn("kelt_upper", F.col("kelt_mid") + k * F.col("atr")).withColumn("kelt_lower", F.col("kelt_mid") - k * F.col("atr"))


def fused(df: DataFrame, kernels: list[tuple[Callable[[], object], list[str], dict[str, str]]], keys: tuple[str, ...] = KEY) -> DataFrame:
    """Add the outputs of several kernels (factory, inputs, outputs) in one pass over the sorted series."""
    inputs = [x for _, names, _ in kernels for x in names]
    outputs = {n: t for _, _, out in kernels for n, t in out.items()}
    make = [(factory, len(names)) for factory, names, _ in kernels]
    return scan(df, lambda: Many([(factory(), width) for factory, width in make]), inputs, outputs, keys)


class Many:
    """Several kernels in one pass: inputs and outputs are concatenated."""

    def __init__(self, kernels: list[tuple[object, int]]):
        self.kernels = kernels

    def step(self, *values) -> tuple:
        out, at = [], 0
        for kernel, width in self.kernels:
            out += kernel.step(*values[at : at + width])
            at += width
        return tuple(out)
