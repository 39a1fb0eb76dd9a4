"""Decisions that are answered together: statistics, levels and patterns of whole blocks of bars."""

import random

import numpy as np
import pytest

from barloom.operators import recurrent, rolling
from barloom.sources.bars import KEY
from tests.test_rolling import from_scratch, walk


@pytest.mark.parametrize(("horizon", "block", "together"), [(1, 1000, 10_000), (5, 333, 200), (20, 7, 10_000)])
def test_blocks_as_if_fitted_from_scratch(horizon, block, together, monkeypatch):
    monkeypatch.setattr(rolling, "FIRST", 256)
    monkeypatch.setattr(rolling, "SLAB", 500)
    monkeypatch.setattr(rolling, "PAIRS", 1)
    monkeypatch.setattr(rolling, "FEW", 4)
    rows = walk(2300, horizon)
    columns, state, got, waiting = np.array(rows).T, rolling.Refits(horizon), [], 0
    asks = [d for d in range(len(rows)) if d % 37 == 0 or d in (79, 80, 81, 82, 110, 111, 2299)]
    for a in range(0, len(rows), block):
        here = np.array([d - a for d in asks if a <= d < a + block], int)
        state.take(*columns[:, a : a + block], here)
        waiting += len(here)
        if waiting >= together or a + block >= len(rows):
            got += zip(*state.answers(), strict=True)
            waiting = 0
    assert len(got) == len(asks)
    for d, row in zip(asks, got, strict=True):
        want = [float("nan") if x is None else x for x in from_scratch(rows[: d + 1], horizon)]
        assert row == pytest.approx(want, abs=1e-9, nan_ok=True)


def test_like_decisions_share_samples(monkeypatch):
    """20,000 decisions over 50,000 samples hold few of the pairs one by one, and equal samples only once."""
    rng, pairs = np.random.default_rng(1), []
    moved = rolling._moved
    monkeypatch.setattr(rolling, "_moved", lambda x, least, most, at, w, found: (pairs.append(len(least) * len(at)), moved(x, least, most, at, w, found)))
    points = np.hstack([np.clip(rng.normal(0.5, 0.12, (3, 50_000)), 0.02, 0.98), np.full((3, 50_000), 0.5)])
    w = rng.dirichlet((4, 4, 4), 20_000)
    found = np.zeros((len(w), 10, 3))
    rolling.tally(points, (rng.random(100_000) < 0.5).astype(float), w, found)
    assert (found[:, :, 0].sum(axis=1) == 100_000).all()
    assert sum(pairs) < 0.15 * 50_000 * 20_000
    for k in range(0, 20_000, 4999):
        mixed = rolling._mix(points.T, w[k])
        assert np.array_equal(found[k, :, 0], np.bincount(rolling._bin(mixed), minlength=10))
        assert np.allclose(found[k, :, 2], np.bincount(rolling._bin(mixed), mixed, 10))


def test_moves_of_any_blocks():
    """Blocks do not matter; steps from or to a price that is not positive have no return, equal returns no variance."""
    rnd = random.Random(3)
    close = [100.0]
    for k in range(400):
        close.append(close[-1] + rnd.choice([-2, -1, 1, 2]) if k % 50 else -1.0 if k else 100.0)
        if close[-1] < 20 and k % 50:
            close[-1] = 100.0
    close = np.array([2.0**k for k in range(90)] + close)
    whole = rolling.Moves().take(close)
    for block in (1, 7, 90):
        state = rolling.Moves()
        assert np.allclose(np.hstack([state.take(close[a : a + block]) for a in range(0, len(close), block)]), whole, rtol=1e-9, atol=1e-12)
    assert (whole[2, :90] == 0).all() and whole[1, 89] == pytest.approx(np.log(2))
    r = np.log(close[1:301][(close[1:301] > 0) & (close[:300] > 0)] / close[:300][(close[1:301] > 0) & (close[:300] > 0)])[-80:]
    j = np.arange(80.0)
    assert whole[0, 300] == pytest.approx(max(r.std(), abs(r.mean()), 1e-6))
    assert whole[1, 300] == pytest.approx(np.polyval(np.polyfit(j, r, 1), 80.0))
    assert whole[2, 300] == pytest.approx(r[-1] * np.corrcoef(r[1:], r[:-1])[0, 1])


class _Seen:
    """Number of rows so far and their sum, at asked rows."""

    def __init__(self):
        self.n, self.sum, self.out = 0, 0.0, []

    def take(self, c, rows):
        sums = self.sum + np.cumsum(c)
        self.out += [(self.n + k + 1, sums[k]) for k in rows.tolist()]
        self.n, self.sum = self.n + len(c), sums[-1]

    def answers(self):
        out, self.out = np.array(self.out, float).T, []
        return list(out)


@pytest.mark.parametrize("together", [1, 4, 1000])
def test_decided(spark, together):
    rows = [(s, "h1", t, float(t), 1.0 if t % 3 == k else None) for k, s in enumerate("abc") for t in range(20)]
    df = spark.createDataFrame(rows, "symbol string, tf string, t long, c double, asked double")
    found = recurrent.decided(df, [(_Seen, ["c"], {"n": "double", "sum": "double"})], "asked", together, KEY).collect()
    assert sorted((r.symbol, r.t, r.n, r.sum) for r in found) == [(s, t, t + 1.0, t * (t + 1) / 2) for s, _, t, _, asked in rows if asked]
