"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt by hash to shards of about ``shard_rows``; each shard builds a
graph of its own, in a task of its own.  Every vector then queries every shard:
the graphs are broadcast in waves of ``WAVE``, whose size is bounded by the shards',
and the vectors are read where they lie, in blocks, once a wave; neither vectors
nor graphs are copied through a shuffle.  In each block a sample of queries is compared with the whole shard by
brute force, and extended until ``audit`` of them have a partner besides
themselves.  While the search finds fewer than ``recall`` of these partners, over
all pairs or as the mean of the queries, the beam is doubled.  Where partners are
too rare for that, or a wide beam would cost more than a look at all points, the
block is compared by brute force, which is exact.  A query whose beam is full of
partners has its own beam doubled until it isn't, so the number of partners has no
cap; the audit is of what comes out after that.  What is found is verified by cosine
in double precision, and the pairs are united to components.

Graphs are built and searched for many points in step with one another: points
are put in by descending level, so a layer is a prefix of the points, in batches
that double; a batch is searched in the graph so far and against itself.

Equal vectors are put together first and come back as members of one component.

Defined cases: a vector that is null, empty, of length zero, or has a null or
non-finite entry is alone in its component; vectors of different dimension are
never compared; rows without vec_id are left out; rows that repeat a vec_id are
one vector if any of their vectors are alike, and one component in any case;
ties keep the least vec_id; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import cut, fresh_path, ship, written
from .textkit import mix

LINKS, LINKS_0, BEAM_BUILD = 12, 24, 64
#: Points that a scan compares in the time that a search takes for one place of its beam.
SCAN = 256
#: Graphs that are broadcast at once: at 32,768 vectors of 64 numbers, 12 MB each.
WAVE = 8


class Graph:
    """Unit vectors in descending level, and for each layer the links of the first points, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.ids, self.layers = vectors, ids, layers

    def dump(self) -> bytes:
        head = np.array([*self.vectors.shape, len(self.layers), *[x for l in self.layers for x in l.shape]], np.int64)
        return b"".join([np.array([len(head)], np.int64).tobytes(), head.tobytes(), self.ids.astype(np.int64).tobytes(), self.vectors.tobytes(), *[l.tobytes() for l in self.layers]])

    @staticmethod
    def load(blob: bytes) -> Graph:
        k = int(np.frombuffer(blob, np.int64, 1)[0])
        head = np.frombuffer(blob, np.int64, k, 8).tolist()
        at, (n, dim, count) = 8 * (k + 1), head[:3]
        ids = np.frombuffer(blob, np.int64, n, at)
        at += 8 * n
        vectors = np.frombuffer(blob, np.float32, n * dim, at).reshape(n, dim)
        at += 4 * n * dim
        layers = []
        for i in range(count):
            r, c = head[3 + 2 * i : 5 + 2 * i]
            layers.append(np.frombuffer(blob, np.int32, r * c, at).reshape(r, c))
            at += 4 * r * c
        return Graph(vectors, ids, layers)


def beam_search(q: np.ndarray, vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int, n: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest found among the first n points from its entries: ids (-1: none) and cosines, descending."""
    nq, width = len(q), links.shape[1]
    beam = min(beam, n)
    seen = np.zeros(nq * n, bool)  # flat, as take is several times as fast as an index of two arrays
    row = np.arange(nq)[:, None]
    seen[row * n + entry] = True
    ids = np.full((nq, beam), -1, np.int64)
    sims = np.full((nq, beam), -np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    e = min(entry.shape[1], beam)
    s = np.einsum("qd,qed->qe", q, vectors[entry])
    o = np.argsort(-s, axis=1)[:, :e]
    ids[:, :e], sims[:, :e], done[:, :e] = entry[row, o], s[row, o], False
    live = np.arange(nq)
    while len(live):
        open_ = ~done[live]
        rank = np.cumsum(open_, axis=1)
        pick = open_ & (rank <= expand)
        some = pick.any(1)
        live, pick = live[some], pick[some]
        if not len(live):
            break
        order = np.argsort(~pick, axis=1, kind="stable")[:, :expand]
        good = np.take_along_axis(pick, order, 1)
        at = np.where(good, ids[live[:, None], order], 0)
        done[live[:, None], order] |= good
        nb = links.take(at, axis=0).reshape(len(live), -1)
        ok = (nb >= 0) & np.repeat(good, width, axis=1)
        nb = np.where(ok, nb, 0)
        place = live[:, None] * n + nb
        ok &= ~seen.take(place)
        seen[place[ok]] = True
        r = np.nonzero(ok)[0]
        new = np.full(nb.shape, -np.inf, np.float32)
        new[ok] = np.einsum("kd,kd->k", q.take(live[r], axis=0), vectors.take(nb[ok], axis=0))
        all_s = np.concatenate([sims[live], new], 1)
        all_i = np.concatenate([ids[live], np.where(ok, nb, -1)], 1)
        all_d = np.concatenate([done[live], ~ok], 1)
        o = np.argsort(-all_s, axis=1, kind="stable")[:, : beam + expand] + np.arange(len(live))[:, None] * all_s.shape[1]
        s, i, d = all_s.take(o), all_i.take(o), all_d.take(o)
        # one point met by two links in this step stands next to itself
        twin = np.zeros(i.shape, bool)
        twin[:, 1:] = (i[:, 1:] == i[:, :-1]) & (i[:, 1:] >= 0)
        if twin.any():
            s = np.where(twin, -np.inf, s)
            i, d = np.where(twin, -1, i), d | twin
            o = np.argsort(-s, axis=1, kind="stable")
            s, i, d = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1), np.take_along_axis(d, o, 1)
        m = min(beam, s.shape[1])
        sims[live, :m], ids[live, :m], done[live, :m] = s[:, :m], i[:, :m], d[:, :m]
    return ids, sims


def spread(vectors: np.ndarray, point: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """The links of each point among its candidates (descending): those nearer to it than to a link before, then the nearest others."""
    n, k = cand.shape
    out = np.full((n, most), -1, np.int32)
    ok = (cand >= 0) & (cand != point[:, None])
    kept = np.zeros((n, k), bool)
    near = np.full((n, k), -np.inf, np.float32)  # to the nearest link so far
    v = vectors.take(np.where(ok, cand, 0), axis=0)
    count = np.zeros(n, np.int64)
    for j in range(k):
        take = ok[:, j] & (near[:, j] <= sim[:, j]) & (count < most)
        kept[:, j] = take
        count += take
        if take.any() and j + 1 < k:
            t = np.flatnonzero(take)
            near[t, j + 1 :] = np.maximum(near[t, j + 1 :], np.einsum("nd,nkd->nk", v[t, j], v[t, j + 1 :]))
    rank = np.where(kept, 0, np.where(ok, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :most]
    good = np.take_along_axis(ok, order, 1)
    out[:, : order.shape[1]] = np.where(good, np.take_along_axis(cand, order, 1), -1)
    return out


def build(vectors: np.ndarray, ids: np.ndarray, seed: int = 0) -> Graph:
    """The graph of unit vectors."""
    n = len(vectors)
    u = (mix(ids.astype(np.uint64) ^ mix(np.full(1, seed, np.uint64))) >> np.uint64(11)).astype(float) / (1 << 53)
    level = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(LINKS)).astype(np.int64)
    order = np.lexsort((ids, -level))
    vectors, ids, level = np.ascontiguousarray(vectors[order], np.float32), ids[order], level[order]
    sizes = [int((level >= l).sum()) for l in range(int(level.max(initial=0)) + 1)]
    layers = [np.full((s, LINKS_0 if l == 0 else LINKS), -1, np.int32) for l, s in enumerate(sizes)]
    at = 0
    while at < n:
        stop = min(n, at + max(64, min(at, 1024)))
        new = np.arange(at, stop)
        q = vectors[new]
        entry = np.zeros((len(new), 1), np.int64)
        for l in range(len(layers) - 1, -1, -1):
            own = new[new < sizes[l]]
            if at and at <= sizes[l] or at:
                have = min(at, sizes[l])
                if have:
                    found, sim = beam_search(q, vectors, layers[l], entry, BEAM_BUILD if len(own) else 1, have)
                    entry = np.maximum(found[:, : 1 if not len(own) else 8], 0)
                else:
                    found, sim = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32)
            else:
                found, sim = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32)
            if not len(own):
                continue
            m = len(own)
            inner = q[:m] @ q[:m].T
            np.fill_diagonal(inner, -np.inf)
            top = min(BEAM_BUILD // 2, m - 1)
            parts_i, parts_s = [found[:m]], [sim[:m]]
            if top > 0:
                best = np.argpartition(-inner, top - 1, axis=1)[:, :top]
                parts_i.append(own[best])
                parts_s.append(np.take_along_axis(inner, best, 1))
            cand, s = np.concatenate(parts_i, 1), np.concatenate(parts_s, 1)
            o = np.argsort(-s, axis=1, kind="stable")[:, :BEAM_BUILD]
            cand, s = np.take_along_axis(cand, o, 1), np.take_along_axis(s, o, 1)
            if not cand.shape[1]:
                continue
            links = spread(vectors, own, cand, s, LINKS)
            layers[l][own, :LINKS] = links
            _back(vectors, layers[l], own, links)
        at = stop
    return Graph(vectors, ids, layers)


def _back(vectors: np.ndarray, layer: np.ndarray, own: np.ndarray, links: np.ndarray) -> None:
    """Links back from the neighbours of new points; lists that would be too long are chosen anew."""
    src, dst = np.repeat(own, links.shape[1]), links.ravel().astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    if not len(nodes):
        return
    width, most = layer.shape[1], int(count.max())
    add = np.full((len(nodes), most), -1, np.int64)
    add[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
    old = layer[nodes].astype(np.int64)
    both = np.concatenate([old, add], 1)
    both = np.sort(both, axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    have = (both >= 0).sum(1)
    easy = have <= width
    packed = -np.sort(-both, axis=1)
    w = min(width, packed.shape[1])
    layer[nodes[easy], :w] = packed[easy, :w]
    hard = np.flatnonzero(~easy)
    for a in range(0, len(hard), 256):
        h = hard[a : a + 256]
        cand = packed[h, : int(have[h].max())]
        sim = np.where(cand >= 0, np.einsum("nd,nkd->nk", vectors[nodes[h]], vectors[np.maximum(cand, 0)]), -np.inf)
        o = np.argsort(-sim, axis=1, kind="stable")
        layer[nodes[h]] = spread(vectors, nodes[h], np.take_along_axis(cand, o, 1), np.take_along_axis(sim, o, 1), width)


def search(graph: Graph, q: np.ndarray, beam: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    n, ids, sims = len(graph.vectors), [], []
    for a in range(0, len(q), step):
        part = q[a : a + step]
        entry = np.zeros((len(part), 1), np.int64)
        for layer in graph.layers[:0:-1]:
            found, _ = beam_search(part, graph.vectors, layer, entry, 1, len(layer), expand=1)
            entry = found
        i, s = beam_search(part, graph.vectors, graph.layers[0], entry, beam, n)
        ids.append(i), sims.append(s)
    return np.concatenate(ids), np.concatenate(sims)


def scan(graph: Graph, q: np.ndarray, close: np.float32, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """All (query, point) pairs of at least ``close``, by brute force."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(q), step):
        r, c = np.nonzero((q[a : a + step] @ graph.vectors.T) >= close)
        rows.append(a + r), cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def searched(graph: Graph, q: np.ndarray, close: np.float32, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The (query, point) pairs of at least ``close`` that the graph finds; beams full of partners are doubled."""
    n = len(graph.vectors)
    rows, cols, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(q))
    while len(full):
        ids, sims = search(graph, q[full], beam)
        hit = sims >= close
        r, c = np.nonzero(hit)
        rows.append(full[r]), cols.append(ids[r, c])
        full = full[hit.all(1)] if beam < n else full[:0]
        beam *= 2
        if beam * SCAN >= n:  # a look at all points is cheaper
            r, c = scan(graph, q[full], close)
            rows.append(full[r]), cols.append(c)
            break
    return np.concatenate(rows), np.concatenate(cols)


def partners(graph: Graph, q: np.ndarray, threshold: float, recall: float, audit: int, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs of at least ``threshold``; see the module for the audit and the beams. ``own``: ids of the queries."""
    n = len(graph.vectors)
    close = np.float32(threshold - 1e-6)
    order = np.random.default_rng(0).permutation(len(q))
    exact, judged, at, have = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    while at < len(q) and have < audit:
        part = order[at : at + max(audit, at)]
        r, c = scan(graph, q[part], close)
        exact.append(part[r] * n + c)
        # a query finds itself in any graph, so that says nothing
        other = np.ones(len(r), bool) if own is None else own[part[r]] != graph.ids[c]
        judged.append(exact[-1][other])
        have += len(np.unique(r[other]))
        at += len(part)
    rest, truth = order[at:], np.concatenate(judged)
    # of the sample only queries with partners can be judged, so no other is searched
    sample, query = np.unique(truth // n, return_inverse=True)
    while len(rest):
        if len(rest) * n <= len(q) * beam * SCAN or beam >= n:
            r, c = scan(graph, q[rest], close)
            break
        r, c = searched(graph, q[sample], close, beam)
        hit = np.isin(truth, sample[r] * n + c)
        if min(hit.mean(), (np.bincount(query, hit) / np.bincount(query)).mean()) >= recall:
            r, c = searched(graph, q[rest], close, beam)
            break
        beam *= 2
    if len(rest):
        exact.append(rest[r] * n + c)
    pair = np.unique(np.concatenate(exact))
    return pair // n, pair % n


def unit(rows: pd.Series) -> np.ndarray:
    v = np.stack(rows.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _valid(df: DataFrame) -> DataFrame:
    ok = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.where(F.col("v").isNotNull() & ok)


def near_pairs(vectors: DataFrame, *, threshold: float = 0.95, recall: float = 0.98, audit: int = 128, beam: int = 32, shard_rows: int = 32_768, block_rows: int = 16_384) -> DataFrame:
    """(a, b) for vec_ids a < b that are linked: pairs of different vectors found and verified, and equal vectors to the least of them."""
    ship(vectors.sparkSession)
    all_ = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null")
    groups = cut(_valid(all_).groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("ids")))
    equal = groups.where(F.size("ids") > 1).select(F.col("id").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    n = groups.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // block_rows))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    points = groups.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    points = written(points.repartition(max(blocks, min(2 * cores, n // 1024 + 1))), "points")

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = build(unit(pdf["v"]).astype(np.float32), pdf["id"].to_numpy(np.int64))
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "blob": [graph.dump()]})

    # a number of partitions that is asked for isn't merged, so the graphs are built side by side
    graphs = written(points.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(built, "dim int, shard int, blob binary"), "graphs")
    names = sorted((r.dim, r.shard) for r in graphs.select("dim", "shard").collect())  # one row for each shard
    sc, found = vectors.sparkSession.sparkContext, None
    path = fresh_path(vectors.sparkSession, "pairs")
    for at in range(0, len(names), WAVE):
        mine = F.lit(False)
        for dim, shard in names[at : at + WAVE]:
            mine = mine | ((F.col("dim") == dim) & (F.col("shard") == shard))
        held = sc.broadcast([(r.dim, bytes(r.blob)) for r in graphs.where(mine).collect()])
        dims = sorted({d for d, _ in names[at : at + WAVE]})
        points.where(F.col("dim").isin(dims)).select("id", "v", "dim").mapInArrow(_searcher(held, threshold, recall, audit, beam, block_rows), "a long, b long").write.mode("append").parquet(path)
        held.unpersist()
        found = path
    if found is None:
        return equal
    return vectors.sparkSession.read.schema("a long, b long").parquet(path).union(equal).distinct()


def _searcher(held, threshold: float, recall: float, audit: int, beam: int, block_rows: int):
    def block(ids: np.ndarray, v: pd.Series, dim: np.ndarray) -> Iterator[pa.RecordBatch]:
        for d, blob in held.value:
            own = np.flatnonzero(dim == d)
            own = own[np.argsort(ids[own], kind="stable")]
            if not len(own):
                continue
            graph, q, exact = Graph.load(blob), ids[own], unit(v.iloc[own])
            i, j = partners(graph, exact.astype(np.float32), threshold, recall, audit, beam, q)
            a, b = q[i], graph.ids[j]
            keep = a != b
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            points = graph.vectors.astype(np.float64)
            points /= np.linalg.norm(points, axis=1, keepdims=True)
            ok = np.concatenate([np.einsum("kd,kd->k", exact[i[s : s + 65536]], points[j[s : s + 65536]]) >= threshold - 1e-7 for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
            pair = np.unique(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= block_rows:
                yield from _as_block(waiting, block)
                waiting = []
        if waiting:
            yield from _as_block(waiting, block)

    return run


def _as_block(batches: list[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    if len(t):
        yield from block(t["id"].to_numpy(), t["v"].to_pandas(), t["dim"].to_numpy())


def deduplicate(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, component_id, keep): each component of near pairs keeps its least vec_id."""
    comp = components(near_pairs(vectors, **options))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    out = ids.join(comp, ids["vec_id"] == comp["node"], "left").select("vec_id", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("keep", F.col("vec_id") == F.col("component_id"))
