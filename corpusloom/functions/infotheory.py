"""Information theory, contingency statistics and feature selection over long-form tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(p: Column, total: Column | None) -> Column:
    return p if total is None else p / total


def kl(rows: DataFrame, p: str, q: str, by: list[str] | None = None, normalize: bool = True) -> DataFrame:
    """(by.., kl) in bits: sum of p log2(p/q); p = 0 adds nothing and q = 0 < p makes it infinite."""
    by = by or []
    r = rows
    if normalize:
        sums = rows.groupBy(*by).agg(F.sum(p).alias("__p"), F.sum(q).alias("__q"))
        r = (rows.join(sums, by) if by else rows.crossJoin(F.broadcast(sums))).withColumn(p, F.try_divide(F.col(p), F.col("__p"))).withColumn(q, F.try_divide(F.col(q), F.col("__q")))
    term = F.when(F.col(p) <= 0, F.lit(0.0)).when(F.col(q) <= 0, F.lit(float("inf"))).otherwise(F.col(p) * F.log2(F.try_divide(F.col(p), F.col(q))))
    return r.groupBy(*by).agg(F.sum(term).alias("kl"))


def entropy(rows: DataFrame, p: str, by: list[str] | None = None, q: str | None = None, normalize: bool = True) -> DataFrame:
    """(by.., h) in bits: entropy, or cross-entropy against q."""
    by = by or []
    r, c = rows, q or p
    if normalize:
        aggs = [F.sum(x).alias(f"__{x}") for x in {p, c}]
        sums = rows.groupBy(*by).agg(*aggs)
        r = rows.join(sums, by) if by else rows.crossJoin(F.broadcast(sums))
        for x in {p, c}:
            r = r.withColumn(x, F.try_divide(F.col(x), F.col(f"__{x}")))
    term = F.when(F.col(p) <= 0, F.lit(0.0)).when(F.col(c) <= 0, F.lit(float("inf"))).otherwise(-F.col(p) * F.log2(F.when(F.col(c) > 0, F.col(c))))
    return r.groupBy(*by).agg(F.sum(term).alias("h"))


def joint(pairs: DataFrame, a: str, b: str, smoothing: float = 0.0) -> DataFrame:
    """(a, b, p, pa, pb) on the full grid of values, with ``smoothing`` added to each cell."""
    counts = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    grid = counts.select("a").distinct().crossJoin(counts.select("b").distinct())
    cells = grid.join(counts, ["a", "b"], "left").select("a", "b", (F.coalesce("c", F.lit(0)) + F.lit(float(smoothing))).alias("c"))
    pa = cells.groupBy("a").agg(F.sum("c").alias("ca"))
    pb = cells.groupBy("b").agg(F.sum("c").alias("cb"))
    total = cells.agg(F.sum("c").alias("t"))
    j = cells.join(pa, "a").join(pb, "b").crossJoin(F.broadcast(total))
    return j.select("a", "b", (F.col("c") / F.col("t")).alias("p"), (F.col("ca") / F.col("t")).alias("pa"), (F.col("cb") / F.col("t")).alias("pb"))


def mutual_information(pairs: DataFrame, a: str, b: str, smoothing: float = 0.0) -> DataFrame:
    """(mi, h1, h2, nmi): one row, in bits; nmi is 2 mi / (h1 + h2), null where both entropies are 0."""
    j = joint(pairs, a, b, smoothing)
    bits = lambda x, y: F.when(x > 0, x * F.log2(F.try_divide(x, y))).otherwise(0.0)
    mi = j.agg(F.sum(bits(F.col("p"), F.col("pa") * F.col("pb"))).alias("mi"))
    h1 = j.select("a", "pa").distinct().agg(F.sum(-F.col("pa") * F.log2(F.when(F.col("pa") > 0, F.col("pa")))).alias("h1"))
    h2 = j.select("b", "pb").distinct().agg(F.sum(-F.col("pb") * F.log2(F.when(F.col("pb") > 0, F.col("pb")))).alias("h2"))
    return mi.crossJoin(h1).crossJoin(h2).withColumn("nmi", F.try_divide(2 * F.col("mi"), F.col("h1") + F.col("h2")))


def contingency(rows: DataFrame, cls: str, feature: str, weight: str | None = None) -> DataFrame:
    """(cls, feature, cnt), with zeros."""
    c = rows.groupBy(F.col(cls).alias("cls"), F.col(feature).alias("feature")).agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("cnt"))
    grid = c.select("cls").distinct().crossJoin(c.select("feature").distinct())
    return grid.join(c, ["cls", "feature"], "left").select("cls", "feature", F.coalesce("cnt", F.lit(0.0)).alias("cnt"))


def information_gain(table: DataFrame) -> DataFrame:
    """(ig) of a table (cls, feature, cnt), in nats: the entropy of the classes less that within the features."""
    nats = lambda p: F.sum(F.when(p > 0, -p * F.log(F.when(p > 0, p))).otherwise(0.0))
    total = table.agg(F.sum("cnt").alias("t"))
    by_class = table.groupBy("cls").agg(F.sum("cnt").alias("c")).crossJoin(F.broadcast(total)).agg(nats(F.col("c") / F.col("t")).alias("h"))
    by_feature = table.groupBy("feature").agg(F.sum("cnt").alias("f")).where("f > 0")
    inner = table.join(by_feature, "feature").groupBy("feature", "f").agg(nats(F.col("cnt") / F.col("f")).alias("hf"))
    within = inner.crossJoin(F.broadcast(total)).agg(F.sum(F.col("f") / F.col("t") * F.col("hf")).alias("w"))
    return by_class.crossJoin(within).select((F.col("h") - F.col("w")).alias("ig"))


def chi_squared(table: DataFrame) -> DataFrame:
    """(chi2, dof, p_value): Pearson's statistic of a table (cls, feature, cnt); expected cells of 0 add nothing."""
    from .special import chi2_tail

    r = table.groupBy("cls").agg(F.sum("cnt").alias("rc"))
    c = table.groupBy("feature").agg(F.sum("cnt").alias("cf"))
    t = table.agg(F.sum("cnt").alias("t"))
    e = table.join(r, "cls").join(c, "feature").crossJoin(F.broadcast(t)).withColumn("e", F.col("rc") * F.col("cf") / F.col("t"))
    stat = e.agg(
        F.sum(F.coalesce(F.try_divide((F.col("cnt") - F.col("e")) * (F.col("cnt") - F.col("e")), F.col("e")), F.lit(0.0))).alias("chi2"),
        ((F.count_distinct("cls") - 1) * (F.count_distinct("feature") - 1)).alias("dof"),
    )
    return stat.withColumn("p_value", chi2_tail(F.col("chi2"), F.col("dof")))
