"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, and exact weighted-shingle similarity.

A benchmark item of m words is compared with every window of m words of every
document.  Windows and items are multisets of word shingles; a shingle weighs
the bytes of its words, so that runs of function words count little.  The
similarity is the weighted Jaccard coefficient, sum of min over sum of max.

1. *Bound.*  A window of weight A that reaches similarity s shares at least s*A
   with the item.  Windows whose shingles lie in items of their length with less
   than that weight can't qualify and aren't fingerprinted; nothing is lost.
2. *SimHash.*  The other windows and all items get 64-bit fingerprints, of
   running weighted sums of the shingles' hash bits.
3. *Multi-index.*  Fingerprints are cut into radius+1 blocks; two within
   ``radius`` agree on a block, so the union of the block tables holds every
   item in the radius.
4. *Check.*  The similarity of each candidate is computed exactly.

The benchmark goes to the executors in parts of about ``ITEMS_PER_PASS`` items, each
part a pass over the documents, so that what the driver holds and broadcasts is
bounded: a part's index is made, used and given up before the next one.

With radius 20 the 21 blocks have three or four bits, so that a fingerprint shares
some block with most items, and what the tables save is little; the bound before
them is what keeps windows away.  A smaller radius would lose windows that are
similar enough: at a similarity of 0.6 about 15 bits of 64 differ, give or take 3.

Defined cases: null, empty or word-less texts and items match nothing; a
document shorter than the item is one window; items of fewer than ``n`` words
have one shingle of all their words; repeated items each match, repeated
documents are judged row by row and a null doc_id is carried as it is; of equally
similar windows the first is reported; empty tables give an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .session import fresh_path, ship, written
from .textkit import Words, slices

ITEMS_PER_PASS = 100_000
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints(h: np.ndarray, weight: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles from ``start``, by running sums."""
    low, high = int(start.min()), int(start.max()) + size
    signed = np.where((h[low:high, None] & _BITS) != 0, 1, -1) * weight[low:high, None]
    total = np.zeros((high - low + 1, 64), np.int64)
    np.cumsum(signed, axis=0, out=total[1:])
    return ((total[start - low + size] - total[start - low]) > 0) @ _BITS


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two multisets of hashes with their weights."""
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = float((np.minimum(ca[xa], cb[xb]) * wa[ia[xa]]).sum())
    return shared / (float(wa.sum()) + float(wb.sum()) - shared) if len(a) or len(b) else 0.0


def _shingled(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, weight and row of each shingle, and where each row's begin."""
    h, row, at = words.shingles(n)
    size = np.append(0, np.cumsum(words.end - words.start))
    last = np.minimum(at + n, words.first[1:][row])
    return h, size[last] - size[at], row, np.searchsorted(row, np.arange(len(words.first)))


class Index:
    """The items of one pass, by window length."""

    def __init__(self, items: list[tuple[object, str | None]], n: int, radius: int):
        self.radius = radius
        words = Words(pa.array([t for _, t in items], pa.string()))
        lengths = np.diff(words.first)
        self.classes: dict[tuple[int, int], dict] = {}
        for k in sorted({min(n, int(m)) for m in lengths if m}):
            h, w, _, first = _shingled(words, k)
            for m in np.unique(lengths[(lengths > 0) & (np.minimum(lengths, n) == k)]).tolist():
                own = np.flatnonzero(lengths == m)
                size = m - k + 1
                cuts = [slice(first[i], first[i + 1]) for i in own]
                known = np.unique(np.concatenate([h[c] for c in cuts]))
                prints = np.concatenate([fingerprints(h[c], w[c], np.zeros(1, np.int64), size) for c in cuts])
                self.classes[k, m] = {
                    "size": size, "ids": [items[i][0] for i in own], "h": [h[c] for c in cuts], "w": [w[c] for c in cuts],
                    "least": min(w[c].sum() for c in cuts), "known": known, "prints": prints, "blocks": self._blocks(prints),
                }
        # which classes have a shingle, by shingle length
        self.lookup = {}
        for k in {k for k, _ in self.classes}:
            names = [c for c in self.classes if c[0] == k]
            h = np.concatenate([self.classes[c]["known"] for c in names])
            which = np.repeat(np.arange(len(names)), [len(self.classes[c]["known"]) for c in names])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.lookup[k] = names, h[order], which[order], seen

    def _edges(self) -> list[int]:
        return [64 * i // (self.radius + 1) for i in range(self.radius + 2)]

    def _block(self, prints: np.ndarray, i: int) -> np.ndarray:
        e = self._edges()
        return (prints >> np.uint64(e[i])) & np.uint64((1 << (e[i + 1] - e[i])) - 1)

    def _blocks(self, prints: np.ndarray) -> list[dict[int, np.ndarray]]:
        out = []
        for i in range(self.radius + 1):
            b = self._block(prints, i)
            out.append({v: np.flatnonzero(b == np.uint64(v)) for v in np.unique(b).tolist()})
        return out

    def within(self, kind: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, distance) within the radius, by the block tables."""
        found = []
        for i, table in enumerate(kind["blocks"]):
            for v, which in enumerate_values(self._block(prints, i)):
                items = table.get(v)
                if items is not None:
                    found.append(np.repeat(which, len(items)) * len(kind["ids"]) + np.tile(items, len(which)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        pair = np.unique(np.concatenate(found))
        win, item = pair // len(kind["ids"]), pair % len(kind["ids"])
        far = np.bitwise_count(prints[win] ^ kind["prints"][item]).astype(np.int64)
        ok = far <= self.radius
        return win[ok], item[ok], far[ok]

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, object, float, int, int, int]]:
        """(row, item id, similarity, distance, first word, words) of the best window for each row and item."""
        words = Words(texts)
        rows, found = len(words.first) - 1, []
        if not len(words):
            return found
        for k, (names, known, which, seen) in self.lookup.items():
            h, w, row, first = _shingled(words, k)
            maybe = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
            n_classes = hi - lo
            pos = np.repeat(maybe, n_classes)
            cls = which[np.repeat(lo, n_classes) + np.arange(len(pos)) - np.repeat(np.cumsum(n_classes) - n_classes, n_classes)]
            weight = np.bincount(row[pos] * len(names) + cls, w[pos], minlength=rows * len(names)) if len(pos) else np.zeros(rows * len(names))
            least = np.array([self.classes[c]["least"] for c in names])
            order = np.argsort(cls, kind="stable")
            pos, ends = pos[order], np.searchsorted(cls[order], np.arange(len(names) + 1))
            for r, c in zip(*np.nonzero(weight.reshape(rows, -1) >= threshold * least - 1e-9)):
                if not weight[r * len(names) + c]:
                    continue
                kind = self.classes[names[c]]
                mine = pos[ends[c] : ends[c + 1]]
                a, b = int(first[r]), int(first[r + 1])
                mine = mine[np.searchsorted(mine, a) : np.searchsorted(mine, b)] - a
                found += self._row(int(r), kind, h[a:b], w[a:b], np.sort(mine), threshold, names[c])
        return found

    def _row(self, row: int, kind: dict, h: np.ndarray, w: np.ndarray, hits: np.ndarray, threshold: float, name: tuple[int, int]) -> list[tuple]:
        size = min(kind["size"], len(h))
        hit = np.zeros(len(h), np.int64)
        hit[hits] = w[hits]
        got, all_ = np.append(0, np.cumsum(hit)), np.append(0, np.cumsum(w))
        start = np.arange(len(h) - size + 1)
        shared = got[start + size] - got[start]
        start = start[(shared >= threshold * (all_[start + size] - all_[start]) - 1e-9) & (shared > 0)]
        best: dict[int, tuple] = {}
        for part in _runs(start, size):
            win, item, far = self.within(kind, fingerprints(h, w, part, size))
            for j, i, f in zip(part[win].tolist(), item.tolist(), far.tolist()):
                if i in best and best[i][0] == 1.0:
                    continue
                sim = weighted_jaccard(h[j : j + size], w[j : j + size], kind["h"][i], kind["w"][i])
                if sim >= threshold and (i not in best or sim > best[i][0]):
                    best[i] = sim, f, j
        return [(row, kind["ids"][i], sim, f, j, min(name[1], len(h) + name[0] - 1)) for i, (sim, f, j) in best.items()]


def _runs(start: np.ndarray, size: int, most: int = 4096) -> Iterator[np.ndarray]:
    """Window starts cut where they are far apart, so that the running sums stay short."""
    if len(start):
        cuts = np.flatnonzero((np.diff(start) > size) | (np.arange(1, len(start)) % most == 0)) + 1
        yield from np.split(start, cuts)


def enumerate_values(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value with the places that have it."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else []
    for a, b in zip(at, np.append(at[1:], len(v)) if len(v) else []):
        yield int(v[a]), order[a:b]


def _passes(benchmark: DataFrame, n: int, radius: int) -> tuple[int, Iterator[Index]]:
    """How many parts the benchmark makes, and their indexes, of which the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t")).where("t is not null")
    parts = max(1, -(-items.count() // ITEMS_PER_PASS))
    # by row, as an id may be null or come more than once
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    return parts, (Index([(r.i, r.t) for r in items.where(part == p).toLocalIterator()], n, radius) for p in range(parts))


def find(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, radius: int = 20, threshold: float = 0.6) -> DataFrame:
    """(doc_id, item_id, similarity, distance, start_word, n_words): for each document and item the most similar window, if at least ``threshold``."""
    spark = docs.sparkSession
    ship(spark)
    item = benchmark.schema["item_id"].dataType.simpleString()
    d = docs.select(F.col("doc_id"), F.col("text").alias("t")).where("t is not null")
    doc = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc}, item_id {item}, similarity double, distance int, start_word int, n_words int"
    parts, indexes = _passes(benchmark, n, radius)
    path = fresh_path(spark, "matches")
    for index in indexes:
        held = spark.sparkContext.broadcast(index)
        del index
        found = d.mapInArrow(_finder(held, threshold), schema)
        if parts == 1:
            return found
        found.write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema(schema).parquet(path)


def _finder(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                m = held.value.matches(batch.column(1)[a:b], threshold)
                if m:
                    ids = batch.column(0)[a:b].take(pa.array([x[0] for x in m]))
                    yield pa.RecordBatch.from_pydict({"doc_id": ids, "item_id": [x[1] for x in m], "similarity": [x[2] for x in m], "distance": pa.array([x[3] for x in m], pa.int32()), "start_word": pa.array([x[4] for x in m], pa.int32()), "n_words": pa.array([x[5] for x in m], pa.int32())})

    return run


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, radius: int = 20, threshold: float = 0.6) -> DataFrame:
    """The rows, all columns as they are, that hold no benchmark item."""
    spark = docs.sparkSession
    ship(spark)
    parts, indexes = _passes(benchmark, n, radius)
    for index in indexes:
        held = spark.sparkContext.broadcast(index)
        del index
        docs = docs.where(_verdict(held, threshold)(docs["text"]))
        if parts > 1:
            docs = written(docs, "clean")
            held.destroy()
    return docs


def _verdict(held, threshold: float):
    def verdict(texts: pa.Array) -> pa.Array:
        ok = np.ones(len(texts), bool)
        for a, b in slices(texts):
            for m in held.value.matches(texts[a:b], threshold):
                ok[a + m[0]] = False
        return pa.array(ok)

    return arrow_udf(verdict, "boolean")
