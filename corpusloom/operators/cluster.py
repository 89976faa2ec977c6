"""Spherical k-means over unit vectors (vec_id, v)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..checkpoints import ship, spread, written
from ..functions.vectors import unit



def assign(vectors: DataFrame, centroids: np.ndarray, v: str = "v") -> DataFrame:
    """The rows with cluster (the first of the nearest centroids) and cosine; centroids are k literals, whatever the rows."""
    spark = vectors.sparkSession
    cents = F.broadcast(spark.createDataFrame([([[float(x) for x in c] for c in centroids],)], "__c array<array<double>>"))
    sims = F.transform("__c", lambda c: F.aggregate(F.zip_with(F.col(v), c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    out = vectors.crossJoin(cents).withColumn("__s", sims).withColumn("cosine", F.array_max("__s"))
    return out.withColumn("cluster", (F.array_position("__s", F.col("cosine")) - 1).cast("int")).drop("__s", "__c")


@dataclass
class Fit:
    centroids: np.ndarray
    objective: float
    rounds: int


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = x @ cents.T
    at = np.round(s, 12).argmax(1)
    return at, s[np.arange(len(x)), at]


def _pass(points: DataFrame, now: list[np.ndarray], before: list[np.ndarray | None]) -> list[tuple[np.ndarray, float, int]]:
    """For each of some sets of centroids the sums of its clusters, the sum of cosines, and how many points were elsewhere under the set before. One look at the points; a row for each partition reaches the driver."""
    cents = np.array(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cosines, moved = np.zeros_like(cents), np.zeros(len(cents)), np.zeros(len(cents), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            for r, c in enumerate(cents):
                at, cos = _nearest(x, c)
                own = np.zeros((len(x), len(c)))
                own[np.arange(len(x)), at] = 1.0
                sums[r] += own.T @ x
                cosines[r] += cos.sum()
                moved[r] += len(x) if before[r] is None else int((_nearest(x, before[r])[0] != at).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([sums.tobytes()]), pa.array([cosines.tobytes()]), pa.array([moved.tobytes()])], ["p", "sums", "cosines", "moved"])

    parts = sorted(points.select("v").mapInArrow(run, "p long, sums binary, cosines binary, moved binary").collect())
    total = lambda name, kind: sum(np.frombuffer(bytes(p[name]), kind) for p in parts)
    sums, cosines, moved = total("sums", float).reshape(cents.shape), total("cosines", float), total("moved", np.int64)
    return [(sums[r], float(cosines[r]), int(moved[r])) for r in range(len(cents))]


def _plusplus(points: DataFrame, k: int, seeds: list[int], key: str) -> list[np.ndarray]:
    order = lambda seed: F.xxhash64(F.lit(seed), F.col(key))
    row = points.agg(*[F.min(F.struct(order(s), F.col(key), F.col("v"))).alias(f"s{r}") for r, s in enumerate(seeds)]).first()
    cents = [np.array([row[f"s{r}"]["v"]], float) for r in range(len(seeds))]
    schema = StructType([StructField("r", LongType()), StructField("t", DoubleType()), points.schema[key], points.schema["v"]])
    for i in range(1, k):
        known = list(cents)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                for r, c in enumerate(known):
                    cos = np.clip(_nearest(x, c)[1], -1.0, 1.0)
                    far = cos <= -1 + 1e-12
                    weight = np.where(far, 1e6, 2 * np.sqrt(1 - cos * cos) / np.where(far, 1.0, 1 + cos))
                    with np.errstate(divide="ignore"):
                        t = np.where(weight > 0, -np.log(batch.column(2 + r).to_numpy()) / weight, np.inf)
                    at = np.flatnonzero((t == t.min()) & np.isfinite(t)) if len(t) else []
                    if len(at):
                        b = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r)), pa.array(t[at]), b.column(0), b.column(1)], names=schema.names)

        # the least of exponential clocks with these rates is a draw in proportion to them
        u = [((F.pmod(F.xxhash64(F.lit(s), F.lit(i), F.col(key)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)).alias(f"u{r}") for r, s in enumerate(seeds)]
        best = points.select(key, "v", *u).mapInArrow(run, schema).groupBy("r").agg(F.min(F.struct("t", key, "v")).alias("s")).collect()
        drawn = {b.r: b.s["v"] for b in best}
        cents = [np.vstack([c, drawn.get(r, c[0])]) for r, c in enumerate(cents)]
    return cents


def start(vectors: DataFrame, k: int, how: str, seeds: list[int], v: str = "v", key: str = "vec_id") -> list[np.ndarray]:
    """First centroids for each seed: ``uniform`` on the sphere, ``samples`` of the points by hash, or ``plusplus``.

    plusplus takes each next point with a chance in proportion to
    2 sin(t) / (1 + cos(t)) of its angle t to the nearest centroid so far; a pass
    draws one for all seeds.
    """
    if how == "uniform":
        dim = vectors.select(F.size(v)).first()[0]
        x = [np.random.default_rng(seed).normal(size=(k, dim)) for seed in seeds]
        return [a / np.linalg.norm(a, axis=1, keepdims=True) for a in x]
    if how == "samples":
        return [np.array([r[0] for r in vectors.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k).select(v).collect()], float) for seed in seeds]
    return _plusplus(vectors.select(key, F.col(v).alias("v")), k, seeds, key)


def fit(vectors: DataFrame, k: int, *, how: str = "samples", restarts: int = 5, max_rounds: int = 100, eps: float = 0.001, seed: int = 0, v: str = "embedding", key: str = "vec_id") -> Fit:
    """The best of some restarts. A run ends once less than ``eps`` of the points change cluster, or after ``max_rounds``.

    All restarts go side by side, so a round is one pass over the points for all
    that still run; an empty cluster keeps its centroid.
    """
    ship(vectors.sparkSession)
    whole = vectors.where(F.col(v).isNotNull() & ~F.exists(v, F.isnull)).select(key, unit(F.col(v)).alias("v"))
    points = written(spread(whole), "points")
    n = points.count()
    cents = start(points, k, how, [seed + r for r in range(restarts)], "v", key)
    before, rounds, running = [None] * restarts, [0] * restarts, list(range(restarts))
    while running and max_rounds:
        got = _pass(points, [cents[r] for r in running], [before[r] for r in running])
        left = []
        for r, (sums, _, moved) in zip(running, got):
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            before[r], cents[r] = cents[r], np.where(size > 0, sums / np.where(size > 0, size, 1.0), cents[r])
            rounds[r] += 1
            if moved >= eps * n and rounds[r] < max_rounds:
                left.append(r)
        running = left
    objective = [o for _, o, _ in _pass(points, cents, [None] * restarts)]
    best = max(range(restarts), key=lambda r: objective[r])
    return Fit(cents[best], objective[best], rounds[best])
