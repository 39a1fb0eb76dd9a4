import math

import numpy as np

from barloom.llm import neighbours
from barloom.llm.hnsw import Graph


def brute(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                    links[a] += 1
                    links[b] += 1
                    up[max(find(a), find(b))] = min(find(a), find(b))
    return [(rows[k][0], links[k], rows[find(k)][0] if ok[k] else rows[k][0]) for k in range(len(rows))]


def made(n=300, d=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[60:180] = x[0] + 0.12 * rng.normal(size=(120, d)) * np.linalg.norm(x[0]) / 4
    x[200:210] = x[199]
    x[220] = 3 * x[219]
    return x


def test_equals_brute_force(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(made())]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0] * 15 + [None]), (1004, [1.0] * 15 + [float("nan")]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (1007, [float("inf")] * 16)]
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in rows]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], f"vec_id long, embedding array<{kind}>, label int, class string")
        got = neighbours.link(df).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert neighbours.link(df.limit(0)).count() == 0


def test_graph_recall_and_bytes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    graph.widen(0.95, 0.995)
    assert graph.audit(0.95, seed=9) >= 0.98
    again, more = Graph.load(graph.dump(a=np.arange(3)))
    assert (more["a"] == np.arange(3)).all() and again.beam == graph.beam
    ids, _ = again.search(x[:50], 64)
    assert (ids == np.arange(50)[:, None]).any(axis=1).all()
    exact = np.argsort(-x[:50] @ x.T, axis=1)[:, :10]
    ids, _ = again.search(x[:50], 256)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), ids.tolist())]) > 0.9


def test_tiny_graphs():
    for n in (1, 2, 3):
        graph = Graph(np.eye(4, dtype=np.float32)[:n])
        ids, sims = graph.search(np.eye(4, dtype=np.float32)[:n], 64)
        assert all(k in row for k, row in enumerate(ids.tolist()))


def test_very_large_and_very_small_doubles(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [1e300, -1e300]), (6, [5e-324, -5e-324]), (7, [1e308, 0.0]), (8, [1.0, 1e-300]), (9, [-0.0, 0.0])]
    got = neighbours.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 1, 7), (9, 0, 9)}


def test_shards_bounded_in_bytes_and_exact_scan_where_no_audit_passes(spark, monkeypatch):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(made())]
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 12 * 16 * 40)
    monkeypatch.setattr(neighbours, "RECALL", 1.1)
    got = neighbours.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))


def test_graph_that_fails_its_audit_is_scanned():
    x = np.eye(8, dtype=np.float32)
    graph = Graph(x)
    graph.links[0][:] = -1  # nobody is reachable but the entry points
    graph.into = graph.into[:1]
    graph.widen(0.95, 0.995)
    again, _ = Graph.load(graph.dump())
    assert graph.exact and again.exact and (again.search(x, 4)[1].argmax(axis=1) == np.arange(8)).all()
