import numpy as np
import pytest

from corpusloom.llm import embedding_dedup as H


def cloud(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    for k in range(copies):
        v[n - 1 - k] = v[k % 7] + 0.02 * rng.normal(size=dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_graph_recall():
    v = cloud(1500, 24, 1).astype(np.float32)
    g = H.Graph.load(H.build(v, np.arange(1500)).dump())
    ids, _ = H.search(g, v[:200], 64)
    truth = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(g.ids[ids[i]]) & set(truth[i])) / 10 for i in range(200)]) > 0.95


def test_many_partners_have_no_cap():
    rng = np.random.default_rng(3)
    v = cloud(900, 16, 2)
    v[300:800] = v[0] + 0.01 * rng.normal(size=(500, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    g = H.build(v, np.arange(900))
    i, j = H.partners(g, v, 0.95, 0.98, 64, 8)
    got = set(zip(i.tolist(), g.ids[j].tolist()))
    want = set(zip(*map(lambda x: x.tolist(), np.nonzero(v @ v.T >= 0.95))))
    assert len(got & want) >= 0.98 * len(want)


def components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_equal_brute_force(spark):
    v = cloud(700, 16, 4, copies=60)
    v[100] = v[101]
    df = spark.createDataFrame([(i, [float(x) for x in r], "k", 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, component string, label int")
    got = {r.vec_id: r.component_id for r in H.deduplicate(df, threshold=0.9, shard_rows=250, block_rows=200).collect()}
    want = components(700, [(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.9)) if i < j])
    assert np.mean([got[i] == want[i] for i in range(700)]) > 0.99 and got[101] == 100


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.component_id, r.keep) for r in H.deduplicate(df).collect()}
    assert got == {1: (1, True), 2: (1, False), **{k: (k, True) for k in (3, 4, 5, 6, 7, 8, 9)}}
    assert H.deduplicate(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 65])
def test_small_graphs(n):
    v = cloud(n, 8, 9).astype(np.float32)
    g = H.build(v, np.arange(n))
    ids, sims = H.search(g, v, 4)
    assert np.allclose(sims[:, 0], 1, atol=1e-5)


@pytest.mark.parametrize("first, last, audit", [(1, 18, 64), (0, 400, 64)])
def test_the_audit_is_of_partners_besides_oneself(monkeypatch, first, last, audit):
    """No link leads to the partners, so a search misses them all though each query finds itself."""
    monkeypatch.setattr(H, "SCAN", 1)
    v, k = cloud(1200 + last - first, 16, 6), last - first
    v[1200:] = v[first:last] + 0.001
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    g = H.build(v, np.arange(len(v)))
    g.layers = [np.where(g.ids[x] >= 1200, -1, x).astype(np.int32) for x in g.layers]
    i, j = H.partners(g, v[:1200], 0.99, 0.98, audit, 32, np.arange(1200))
    got = set(zip(i.tolist(), g.ids[j].tolist()))
    assert sum((first + x, 1200 + x) in got for x in range(k)) >= 0.98 * k


def test_the_audit_searches_only_queries_with_partners(monkeypatch):
    monkeypatch.setattr(H, "SCAN", 1)
    v = cloud(1200, 16, 6)
    v[600:640] = v[:40] + 0.001
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    g, calls, plain = H.build(v, np.arange(1200)), [], H.searched
    monkeypatch.setattr(H, "searched", lambda graph, q, close, beam: calls.append(len(q)) or plain(graph, q, close, beam))
    i, j = H.partners(g, v, 0.99, 0.98, 16, 32, np.arange(1200))
    assert 16 <= calls[0] <= 80 and len(calls) == 2
    got = set(zip(i.tolist(), g.ids[j].tolist()))
    assert sum((x, 600 + x) in got for x in range(40)) >= 0.98 * 40
