"""Hierarchical navigable small-world graphs in numpy, many queries per step."""

from __future__ import annotations

import io

import numpy as np

UPPER, BASE = 16, 32
BUILD_BEAM, UPPER_BEAM, WIDTH = 64, 12, 4
BATCH = 512


def levels_of(n: int, seed: int) -> np.ndarray:
    """Level of every node, geometric with ratio 1 / UPPER."""
    u = np.random.default_rng(seed).random(n)
    return np.minimum((-np.log(1 - u) / np.log(UPPER)).astype(np.int32), 6)


class Graph:
    """Unit vectors, and per level the neighbours of every node (-1: none)."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        self.level = levels_of(n, seed)
        self.links = [np.full((n, BASE if k == 0 else UPPER), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.beam = BUILD_BEAM
        self.exact = False
        self.into = np.zeros(0, np.int32)
        order = np.arange(n)
        for a in range(0, n, BATCH):
            self._insert(order[a : a + BATCH])

    # -- search -----------------------------------------------------------

    def _top(self, into: np.ndarray) -> tuple[int, np.ndarray]:
        level = int(self.level[into].max())
        return level, into[self.level[into] == level][:256]

    def _walk(self, k: int, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes of level ``k`` found from ``start`` for every query (ids, similarities), unsorted."""
        rows, links = len(q), self.links[k]
        out_ids, out_sims = np.full((rows, beam), -1, np.int32), np.full((rows, beam), -np.inf, np.float32)
        live = np.arange(rows)
        seen = np.zeros((rows, len(self.x)), bool)
        ids, sims = out_ids.copy(), out_sims.copy()
        width = min(start.shape[1], beam)
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("rkd,rd->rk", self.x[ids[:, :width]], q), -np.inf)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        closed = ids < 0
        while len(live):
            best = np.where(closed, -np.inf, sims)
            step = min(WIDTH, beam)
            pick = np.argpartition(-best, step - 1, axis=1)[:, :step]
            value = np.take_along_axis(best, pick, 1)
            over = ~np.isfinite(value).any(axis=1)
            if over.any():
                out_ids[live[over]], out_sims[live[over]] = ids[over], sims[over]
                go = ~over
                live, ids, sims, closed, pick, value, q, seen = live[go], ids[go], sims[go], closed[go], pick[go], value[go], q[go], seen[go]
                if not len(live):
                    break
            np.put_along_axis(closed, pick, True, 1)
            chosen = np.where(np.isfinite(value), np.take_along_axis(ids, pick, 1), -1)
            near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            row = np.arange(len(live))[:, None]
            new = (near >= 0) & ~seen[row, near]
            most = int(new.sum(axis=1).max(initial=0))
            if not most:
                continue
            place = np.argsort(~new, axis=1, kind="stable")[:, :most]
            near, new = np.take_along_axis(near, place, 1), np.take_along_axis(new, place, 1)
            r, c = np.nonzero(new)
            seen[r, near[r, c]] = True
            value = np.where(new, np.matmul(self.x[near], q[:, :, None])[:, :, 0], -np.inf)
            ids, sims, closed = np.concatenate([ids, near], 1), np.concatenate([sims, value], 1), np.concatenate([closed, ~new], 1)
            keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, closed = (np.take_along_axis(x, keep, 1) for x in (ids, sims, closed))
            ids[~np.isfinite(sims)] = -1
        return out_ids, out_sims

    def _best(self, ids: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
        n = min(n, ids.shape[1])
        return np.take_along_axis(ids, np.argpartition(-sims, n - 1, axis=1)[:, :n], 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        if self.exact:
            return np.broadcast_to(np.arange(len(self.x), dtype=np.int32), (len(q), len(self.x))), q @ self.x.T
        level, tops = self._top(self.into)
        start = self._best(np.broadcast_to(tops, (len(q), len(tops))), q @ self.x[tops].T, WIDTH)
        for k in range(level, 0, -1):
            start = self._best(*self._walk(k, q, start, UPPER_BEAM), WIDTH)
        return self._walk(0, q, start, min(beam, len(self.x)))

    # -- construction -----------------------------------------------------

    def _choose(self, ids: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
        """Up to ``n`` of each row's candidates: those nearer to the row's node than to any chosen one first, then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        x = self.x[ids]
        between = np.matmul(x, x.transpose(0, 2, 1))
        there = np.isfinite(sims)
        chosen = np.zeros(ids.shape, bool)
        worst = np.full(ids.shape, -np.inf, np.float32)  # similarity to the nearest chosen candidate
        count = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            take = there[:, c] & (count < n) & (worst[:, c] < sims[:, c])
            chosen[:, c] = take
            count += take
            worst = np.where(take[:, None], np.maximum(worst, between[:, c]), worst)
        rank = np.where(chosen, 0, 1) + np.where(there, 0, 2)
        first = np.argsort(rank, axis=1, kind="stable")[:, :n]
        out = np.where(np.take_along_axis(there, first, 1), np.take_along_axis(ids, first, 1), -1)
        return np.pad(out, ((0, 0), (0, n - out.shape[1])), constant_values=-1)

    def _join(self, k: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[k]
        wide = links.shape[1]
        most = min(ids.shape[1], BUILD_BEAM + wide)
        top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        picked = self._choose(np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), wide)
        links[nodes] = picked
        # the other direction: every picked node gets its nearest new neighbours
        r, c = np.nonzero(picked >= 0)
        if not len(r):
            return
        to, back = picked[r, c], nodes[r]
        near = np.einsum("rd,rd->r", self.x[to], self.x[back])
        order = np.lexsort((-near, to))
        to, back = to[order], back[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate([first, [len(to)]])))
        owners = to[first]
        more = np.full((len(owners), wide), -1, np.int32)
        ok = place < wide
        more[np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(to)]])))[ok], place[ok]] = back[ok]
        for a in range(0, len(owners), 1024):
            own = owners[a : a + 1024]
            both = np.concatenate([links[own], more[a : a + 1024]], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            value = np.where(both >= 0, np.matmul(self.x[both], self.x[own][:, :, None])[:, :, 0], -np.inf)
            free = (both >= 0).sum(axis=1) <= wide
            if free.any():
                links[own[free]] = self._best(both[free], value[free], wide)
            if not free.all():
                links[own[~free]] = self._choose(both[~free], value[~free], wide)

    def _insert(self, nodes: np.ndarray) -> None:
        q = self.x[nodes]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        level, start = -1, None
        if len(self.into):
            level, tops = self._top(self.into)
            start = self._best(np.broadcast_to(tops, (len(q), len(tops))), q @ self.x[tops].T, WIDTH)
        for k in range(len(self.links) - 1, -1, -1):
            mine = self.level[nodes] >= k
            ids, sims = np.full((len(nodes), 1), -1, np.int32), np.full((len(nodes), 1), -np.inf, np.float32)
            if k <= level:
                ids, sims = self._walk(k, q, start, min(UPPER_BEAM if k else BUILD_BEAM, max(1, len(self.into))))
                start = self._best(ids, sims, WIDTH)
            if mine.sum():
                others = nodes[mine].astype(np.int32)
                value = among[np.ix_(mine, mine)]
                n = min(len(others), BUILD_BEAM)
                top = np.argpartition(-value, n - 1, axis=1)[:, :n]
                all_ids = np.concatenate([ids[mine], others[top]], 1)
                all_sims = np.concatenate([sims[mine], np.take_along_axis(value, top, 1)], 1)
                self._join(k, others, all_ids, all_sims)
        self.into = np.concatenate([self.into, nodes.astype(np.int32)])

    # -- recall audit -----------------------------------------------------

    def audit(self, cosine: float, seed: int = 1, sample: int = 256) -> float:
        """Share of planted neighbours found: sampled nodes turned away to exactly ``cosine``, and the nodes themselves."""
        n, d = self.x.shape
        rng = np.random.default_rng(seed)
        at = rng.choice(n, min(n, sample), replace=False)
        v = self.x[at]
        side = rng.normal(size=v.shape).astype(np.float32)
        side -= np.einsum("rd,rd->r", side, v)[:, None] * v
        length = np.linalg.norm(side, axis=1, keepdims=True)
        turned = cosine * v + np.sqrt(1 - cosine**2) * side / np.where(length > 0, length, 1)
        ids, _ = self.search(np.concatenate([turned, v]), self.beam)
        return float((ids == np.concatenate([at, at])[:, None]).any(axis=1).mean())

    def widen(self, cosine: float, recall: float) -> None:
        """Double the beam until the audit passes; if none passes, every search looks at all nodes."""
        while self.audit(cosine) < recall:
            if self.beam >= len(self.x):
                self.exact = True
                break
            self.beam = min(2 * self.beam, max(1, len(self.x)))

    # -- bytes ------------------------------------------------------------

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, level=self.level, beam=self.beam, exact=self.exact, **{f"links{k}": v for k, v in enumerate(self.links)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        got = np.load(io.BytesIO(data))
        graph = cls.__new__(cls)
        graph.x, graph.level, graph.beam, graph.exact = got["x"], got["level"], int(got["beam"]), bool(got["exact"])
        graph.links = [got[f"links{k}"] for k in range(sum(name.startswith("links") for name in got.files))]
        graph.into = np.arange(len(graph.x), dtype=np.int32)
        return graph, {k: got[k] for k in got.files if k not in ("x", "level", "beam", "exact") and not k.startswith("links")}
