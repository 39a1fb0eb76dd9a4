"""64-bit hashes of word runs, computed for all words of a text at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

RADIX = 0x9E3779B97F4A7C15
SEED = 20240230
SPAN = 1 << 16


def split_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd radix and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(RADIX, -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (np.uint64(RADIX), inverse))


@cache
def _values() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def run_hashes(words: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Hashes of every run of ``n`` words, or of the whole sequence where it is shorter, in spans of SPAN words.

    A run is hashed as its words with single spaces between, by a polynomial over
    bytes whose prefix sums serve all runs.
    """
    if not words:
        return
    for a in range(0, max(1, len(words) - n + 1), SPAN):
        plain = np.frombuffer(b" ".join(words[a : a + SPAN + n - 1]), np.uint8)
        up, down = _powers(1 << max(12, len(plain).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values()[plain] * up[: len(plain)])])
        gaps = np.flatnonzero(plain == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(plain)]])
        many = max(1, len(starts) - n + 1)
        first, last = starts[:many], ends[-many:]
        yield mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
