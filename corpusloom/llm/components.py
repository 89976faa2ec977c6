"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its least node.

    Each round is two shuffles on the node and one checkpoint, and the number of
    rounds is about logarithmic in the longest chain.  Edges with a null end and
    loops are left out; repeated edges and either direction count once; an empty
    table gives an empty one.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.distinct())
    seen = None
    by_u = Window.partitionBy("u")
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.withColumn("m", F.least("u", F.min("v").over(by_u)))
            .where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.withColumn("m", F.min("v").over(by_u))
        small = low.select("v", "m").where("v <> m").union(low.select(F.col("u").alias("v"), "m"))
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
