"""Statistics re-trained at every decision, against a fit from scratch."""

import math
import random

import numpy as np
import pytest

from barloom.operators import rolling
from barloom.operators.forecast import PRIOR


def walk(n, seed):
    rnd = random.Random(seed)
    close, rows = 100.0, []
    for _ in range(n):
        close += rnd.choice([-1, 0, 1, 2, -2])
        rows.append((close, rnd.choice([0.3, 0.4, 0.5, 0.6]), rnd.uniform(0.02, 0.98), min(0.98, max(0.02, rnd.gauss(0.5, 0.1)))))
    return rows


def from_scratch(rows, horizon):
    """Everything fitted on ``rows`` alone, as at a decision on the last of them."""
    known = [(j, rows[j][1:], rows[j + horizon][0] > rows[j][0]) for j in range(80, len(rows) - horizon)]
    weights = tuple(PRIOR.values())
    accuracies = []
    if known:
        decay = [0.5 ** ((len(known) - 1 - k) / 100) for k in range(len(known))]
        for m in range(3):
            accuracies.append(sum(d for d, (_, p, up) in zip(decay, known, strict=True) if (p[m] >= 0.5) == up) / sum(decay))
    if len(known) >= 30:
        parts = [math.exp(math.log(q) + (a - 0.5) / 0.08) for q, a in zip(PRIOR.values(), accuracies, strict=True)]
        weights = tuple(x / sum(parts) for x in parts)
    mix = lambda p: min(0.98, max(0.02, sum(a * b for a, b in zip(p, weights, strict=True))))
    bins = [[] for _ in range(10)]
    for _, p, up in known:
        bins[min(9, int(mix(p) * 10))].append((mix(p), up))
    raw = [(sum(u for _, u in b) + 1) / (len(b) + 2) if b else (k + 0.5) / 10 for k, b in enumerate(bins)]
    size = [max(len(b), 0.001) for b in bins]
    mean = lambda i, j: sum(r * s for r, s in zip(raw[i : j + 1], size[i : j + 1], strict=True)) / sum(size[i : j + 1])
    fitted = [max(min(mean(i, j) for j in range(k, 10)) for i in range(k + 1)) for k in range(10)]
    points = sorted((sum(p for p, _ in b) / len(b) if b else (k + 0.5) / 10, min(0.99, max(0.01, fitted[k]))) for k, b in enumerate(bins))
    p = mix(rows[-1][1:])
    return (*weights, p, rolling.read_off(points, p), sum(a * w for a, w in zip(accuracies, weights, strict=True)) if known else None, float(len(known)))


@pytest.mark.parametrize("horizon", [1, 5, 20])
def test_as_if_fitted_from_scratch(horizon, monkeypatch):
    monkeypatch.setattr(rolling, "FIRST", 256)
    rows = walk(2300, horizon)
    state = rolling.Refit(horizon)
    for d, row in enumerate(rows):
        asked = d % 97 == 0 or d in (79, 80, 81, 82, 110, 111, 2299)
        got = state.step(*row, 1.0 if asked else None)
        if asked:
            assert got == pytest.approx(from_scratch(rows[: d + 1], horizon), abs=1e-9)
        else:
            assert got == (None,) * 7


def test_work_grows_slower_than_samples():
    """A decision opens the cells across borders of bins: 64 times the samples, far fewer than 64 times the cells."""
    rnd = np.random.default_rng(1)
    looked = []
    for n in (1 << 12, 1 << 18):
        points = np.clip(rnd.normal(0.5, 0.12, (n, 3)), 0.02, 0.98)
        ups = rnd.random(n) < 0.5
        samples = rolling.Samples()
        samples.trees = [rolling._Cells(points, ups.astype(float))]
        w = (0.3, 0.5, 0.2)
        k, up, total = samples.bins(w)
        mixed = points @ np.array(w)
        at = np.minimum(9, np.floor(mixed * 10)).astype(int)
        assert np.abs(k - np.bincount(at, minlength=10)).sum() <= 2 and k.sum() == n
        assert np.allclose(total, np.bincount(at, mixed, 10), atol=1) and abs(up.sum() - ups.sum()) == 0
        looked.append(samples.looked)
    assert looked[1] < 32 * looked[0]


def test_isotonic():
    assert rolling.isotonic([0.1, 0.5, 0.3, 0.9], [1, 1, 1, 1]) == [0.1, 0.4, 0.4, 0.9]
    assert rolling.isotonic([0.9, 0.1], [3, 1]) == pytest.approx([0.7, 0.7])


def test_tree_sizes_double(monkeypatch):
    monkeypatch.setattr(rolling, "FIRST", 256)
    samples = rolling.Samples()
    for k in range(7 * rolling.FIRST + 5):
        samples.add((0.5, 0.5, 0.5), k % 2 == 0)
    assert [t.size for t in samples.trees] == [4 * rolling.FIRST, 2 * rolling.FIRST, rolling.FIRST] and samples.n == 5
    assert samples.bins((1.0, 0.0, 0.0))[0].sum() == 7 * rolling.FIRST + 5
