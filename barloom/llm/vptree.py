"""Vantage-point tree over norm-augmented integer vectors: inner-product windows are distance annuli.

A vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm; a query q is scaled
to the norm M and gets a zero.  Then |x' - q'|^2 = 2 M^2 - 2 x.q M/|q|: the higher the score, the
nearer, and a window of scores is an annulus around the query.  A node knows the range of distances
between its vantage point and the rows of each child; by the triangle inequality a child
is left out where it lies wholly inside the annulus' hole or beyond its rim, and the
others are opened nearest first until no unopened one can hold a better row.

Bounds are floats with slack; scores are exact, and decide.  Where products of two rows
may exceed 2**52 in size, no bound is used and scores are Python integers, held to +-(2**63 - 1).
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np

LEAF, TRIALS, SAMPLE = 256, 6, 512
WIDE = 2.0**52
MOST = 2**63 - 1
#: Stands for a null id: last among equal scores.
NO_ID = np.iinfo(np.int64).max


class Tree:
    """Rows of equal dimension with ids and labels; rows of a leaf lie together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, seed: int = 0):
        self.x, self.ids, self.labels = x, ids, labels
        with np.errstate(over="ignore"):
            square = np.einsum("nd,nd->n", x, x)
        self.wide = bool(len(x)) and not square.max() < WIDE
        self.most = 0.0 if self.wide or not len(x) else float(square.max())  # M^2
        last = np.zeros(len(x)) if self.wide else np.sqrt(np.maximum(0.0, self.most - square))
        order, nodes = np.arange(len(x)), []
        with np.errstate(over="ignore", invalid="ignore"):
            self._split(np.column_stack([x, last]), order, 0, len(x), nodes, np.random.default_rng(seed))
        # a node: first row, last row, vantage row (-1: leaf), inner and outer child, nearest and farthest distance of each child
        self.nodes = np.array(nodes, float).reshape(-1, 9)
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        inner = self.nodes[:, 2] >= 0
        self.nodes[inner, 2] = place[self.nodes[inner, 2].astype(np.int64)]
        self._ready()

    def _ready(self) -> None:
        self.spans = [(int(a), int(b)) for a, b in self.nodes[:, :2]]
        self.inner = np.flatnonzero(self.nodes[:, 2] >= 0)
        self.at = {int(k): j for j, k in enumerate(self.inner)}
        self.points = self.x[self.nodes[self.inner, 2].astype(np.int64)]
        self.children = [((int(r[3]), r[5], r[6]), (int(r[4]), r[7], r[8])) for r in self.nodes]
        one = [self.labels[a:b] for a, b in self.spans]
        self.only = [int(y[0]) if len(y) and (y == y[0]).all() else None for y in one]

    def _split(self, z: np.ndarray, order: np.ndarray, a: int, b: int, nodes: list, rng) -> int:
        me = len(nodes)
        nodes.append([a, b, -1, -1, -1, 0, 0, 0, 0])
        if b - a <= LEAF:
            return me
        mine = order[a:b]
        sample = z[rng.choice(mine, min(SAMPLE, b - a), replace=False)]
        tried = rng.choice(mine, min(TRIALS, b - a), replace=False)
        # the candidate whose distances spread most tells rows apart best
        vantage = max(tried, key=lambda v: float(np.var(np.linalg.norm(sample - z[v], axis=1))))
        far = np.concatenate([np.linalg.norm(z[mine[k : k + 4096]] - z[vantage], axis=1) for k in range(0, b - a, 4096)])
        middle = (b - a) // 2
        by = np.argpartition(far, middle)
        order[a:b], far = mine[by], far[by]
        near, rest = far[:middle], far[middle:]
        nodes[me][2:] = [vantage, 0, 0, near.min(), near.max(), rest.min(), rest.max()]
        nodes[me][3] = self._split(z, order, a, a + middle, nodes, rng)
        nodes[me][4] = self._split(z, order, a + middle, b, nodes, rng)
        return me

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, ids=self.ids, labels=self.labels, nodes=self.nodes, most=self.most, wide=self.wide)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree, found = cls.__new__(cls), np.load(io.BytesIO(data))
        tree.x, tree.ids, tree.labels, tree.nodes = (found[k] for k in ("x", "ids", "labels", "nodes"))
        tree.most, tree.wide = float(found["most"]), bool(found["wide"])
        tree._ready()
        return tree


class Probe:
    """One query vector against one tree; distances and leaf scores are kept for its next window."""

    def __init__(self, tree: Tree, q: np.ndarray, own: int, label: int):
        self.tree, self.q, self.own, self.label = tree, q, own, label
        with np.errstate(over="ignore"):
            square = float(q @ q)
        self.exact = tree.wide or not square * max(1.0, tree.most) < WIDE**2
        # scaled to the length M, the query lies on the rows' sphere, where distances tell rows apart best
        self.scale = math.sqrt(tree.most / square) if square > 0 and not self.exact else 1.0
        self.sum = tree.most + (tree.most if square > 0 else 0.0)
        self.slack = 0.0 if self.exact else 1e-6 * math.sqrt(self.sum) + 1e-6
        self.far = None if self.exact else np.sqrt(np.maximum(0.0, self.sum - 2 * self.scale * (tree.points @ q))).tolist()
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _leaf(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, which rows have the query's label) of a leaf."""
        found = self.kept.get(node)
        if found is None:
            a, b = self.tree.spans[node]
            x = self.tree.x[a:b]
            if self.exact:
                q = [int(v) for v in self.q.tolist()]
                scores = [sum(int(v) * w for v, w in zip(row, q, strict=True)) for row in x.tolist()]
                scores = np.array([max(-MOST, min(MOST, s)) for s in scores], object)
            else:
                scores = x @ self.q
            found = self.kept[node] = scores, self.tree.labels[a:b] == self.label
        return found

    def _distance(self, score: float) -> float:
        return math.sqrt(max(0.0, self.sum - 2.0 * self.scale * score))

    def best(self, same: bool, k: int, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the first ``k`` rows by score downwards, then id, of the same or of other labels, with low <= score <= high.

        Rows with the query's own id are never of the same label's answer.
        """
        tree = self.tree
        hole = 0.0 if high is None or self.exact else self._distance(high) - self.slack
        rim = math.inf if low is None or self.exact else self._distance(low) + self.slack
        heap, best = [(0.0, 0)] if len(tree.ids) else [], []
        while heap:
            near, node = heapq.heappop(heap)
            if len(best) == k and not self.exact and near > self._distance(best[-1][0]) + self.slack:
                break
            if tree.nodes[node, 2] < 0:
                scores, alike = self._leaf(node)
                a, b = tree.spans[node]
                ids = tree.ids[a:b]
                ok = alike & (ids != self.own) if same else ~alike
                if low is not None:
                    ok &= (scores >= low) & (scores <= high)
                if len(best) == k:
                    ok &= scores >= best[-1][0]
                rows = np.flatnonzero(ok)
                if len(rows):
                    if len(rows) > k and not self.exact:
                        rows = rows[np.lexsort((ids[rows], -scores[rows]))[:k]]
                    best += [(int(scores[j]), int(ids[j])) for j in rows]
                    best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
                continue
            d = 0.0 if self.exact else self.far[tree.at[node]]
            for child, least, most in tree.children[node]:
                only = tree.only[child]
                if only is not None and (only == self.label) != same:
                    continue
                if self.exact:
                    heapq.heappush(heap, (0.0, child))
                    continue
                lower = max(near, d - most, least - d, hole)
                if lower <= rim + self.slack and d + most >= hole - self.slack:
                    heapq.heappush(heap, (lower, child))
        return best

