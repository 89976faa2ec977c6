"""Measures of all pairs of vectors with one label.

The pairs are quadratic in number by their nature.  Vectors are put into blocks by
hash, and a task has two blocks at a time and yields slices of their products, so
its memory follows neither the pairs nor a label's size; what crosses the shuffle
is each block once for every block of its label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import ship

#: The most and least vectors of a block, rows of a slice of products, and the most partitions.
BLOCK, LEAST, SLICE, PARTITIONS = 2048, 256, 1 << 17, 20_000

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 where a vector is zero."""
    d = np.sqrt(_squares(x))[:, None] * np.sqrt(_squares(y))
    return np.divide(x @ y.T, d, out=np.zeros_like(d), where=d != 0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; those of near vectors by their differences, where the product form has lost its digits."""
    size = _squares(x)[:, None] + _squares(y)
    out = size - 2 * (x @ y.T)
    i, j = np.nonzero(~(out > 1e-4 * size))
    for k in range(0, len(i), 1 << 15):
        s = slice(k, k + (1 << 15))
        out[i[s], j[s]] = _squares(x[i[s]] - y[j[s]])
    return out


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(x, y))


def gauss(sigma: float) -> Measure:
    return lambda x, y: np.exp(-squared(x, y) / float(sigma) ** 2)


def vmf(kappa: float) -> Measure:
    return lambda x, y: np.exp(float(kappa) * cosine(x, y))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    with np.errstate(invalid="ignore"):
        whole += np.where(np.abs(y - whole) >= 0.5, np.copysign(1.0, y), 0.0)
    return np.where(np.isfinite(y), whole / 10.0**digits + 0.0, x)


def _block(s: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    v = s.values
    ids, x = v.field("id").to_numpy(zero_copy_only=False), v.field("x")
    return ids, x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def _measured(measure: Measure, digits: int):
    def unit(a, b) -> Iterator[pa.RecordBatch]:
        (ia, x), (ib, y) = a, b
        step = max(1, SLICE // max(1, len(ib)))
        for k in range(0, len(ia), step):
            own = ia[k : k + step]
            with np.errstate(all="ignore"):
                value = rounded(measure(x[k : k + step], y), digits)
            # in one block each pair comes twice: that with the ids in order stays
            keep = own[:, None] < ib if a is b else own[:, None] != ib
            i, j = np.nonzero(keep)
            first, second = own[i], ib[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)), pa.array(np.maximum(first, second)), pa.array(value[keep])], ["a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column(0):
                got = [_block(s) for s in blocks]
                yield from unit(got[0], got[-1])

    return run


def measured_pairs(vectors: DataFrame, measure: Measure, plain: Callable[[Column, Column], Column], digits: int = 6) -> DataFrame:
    """(a, b, value) of all pairs a < b of ``vectors`` (id, label, x) with one label.

    ``plain`` is the measure as an expression, for pairs that are no matrix: of
    different lengths, null, or with nulls in them.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.where("id is not null and label is not null").withColumn("size", F.when(~F.exists("x", F.isnull), F.size("x")))
    per = v.where("size > 0").groupBy("label", "size").agg(F.count("*").alias("n"))
    got = per.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("n2")).first()
    cores = spark.sparkContext.defaultParallelism
    block = int(min(BLOCK, max(LEAST, ((got.n2 or 0) / 2 / (16 * cores)) ** 0.5)))
    blocks = per.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    units = blocks.agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    put = v.join(blocks.select("label", "size", "blocks"), ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    held = put.groupBy("label", "size", "blocks", "block").agg(F.collect_list(F.struct("id", "x")).alias("s"))
    sent = held.select("label", "size", "block", "s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keys = ["label", "size", "low", "high"]
    sent = sent.select("label", "size", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "s")
    pairs = sent.repartition(int(min(max(units, cores), PARTITIONS)), *keys).groupBy(*keys).agg(F.collect_list("s").alias("s"))
    # a block without rows leaves its partner alone in a unit that isn't its own
    pairs = pairs.where((F.size("s") == 2) | (F.col("low") == F.col("high"))).select("s")
    out = pairs.mapInArrow(_measured(measure, digits), "a long, b long, value double")
    if not v.groupBy("label").agg(F.count_distinct(F.coalesce("size", F.lit(-1))).alias("kinds"), F.min(F.coalesce("size", F.lit(-1))).alias("least")).where("kinds > 1 or least < 1").take(1):
        return out
    a = v.select(F.col("id").alias("a"), "label", F.col("x").alias("x"), F.col("size").alias("m"))
    b = v.select(F.col("id").alias("b"), "label", F.col("x").alias("y"), F.col("size").alias("n"))
    odd = a.join(b, "label").where("a < b and not (coalesce(m, -1) > 0 and coalesce(m = n, false))")
    return out.union(odd.select("a", "b", F.round(plain(F.col("x"), F.col("y")), digits).alias("value")))
