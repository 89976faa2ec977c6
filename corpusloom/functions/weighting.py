"""Term weighting and cosine ranking over postings (doc_id, token, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idf(df: Column, n: Column, offset: float = 1.0) -> Column:
    """offset + ln(n / df)"""
    return F.lit(offset) + F.log(n / df)


def sublinear_tf(tf: Column) -> Column:
    return F.log1p(tf.cast("double"))


def weighted(postings: DataFrame, df: DataFrame, n: DataFrame, *, sublinear: bool = False, offset: float = 1.0, by: str = "doc_id") -> DataFrame:
    """(by, token, w) for terms that have a document frequency; ``n`` is one row with the number of documents."""
    tf = sublinear_tf(F.col("cnt")) if sublinear else F.col("cnt").cast("double")
    weights = df.crossJoin(F.broadcast(n)).select("token", idf(F.col("df"), F.col("n"), offset).alias("__idf"))
    return postings.join(weights, "token").select(by, "token", (tf * F.col("__idf")).alias("w"))


def norms(w: DataFrame, by: str = "doc_id") -> DataFrame:
    return w.groupBy(by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def tfidf(postings: DataFrame, df: DataFrame, n: DataFrame, *, sublinear: bool = False, normalize: bool = True, offset: float = 1.0) -> DataFrame:
    """(doc_id, token, w); rows have length 1 if normalised, and rows of length zero stay zero."""
    w = weighted(postings, df, n, sublinear=sublinear, offset=offset)
    if not normalize:
        return w
    return unit_rows(w)


def unit_rows(w: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, token, w) with rows of length 1, or zero; a sum over each row's entries, without a second look at the input."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(by)))
    return w.select(by, "token", F.coalesce(F.try_divide(F.col("w"), norm), F.lit(0.0)).alias("w"))


def rank(queries: DataFrame, postings: DataFrame, df: DataFrame, n: DataFrame, *, sublinear: bool = True) -> DataFrame:
    """(query_id, doc_id, score): weighted cosine of query bags (query_id, token, cnt) with the documents that share a term. Others have 0."""
    w = weighted(postings, df, n, sublinear=sublinear)
    q = unit_rows(weighted(queries, df, n, sublinear=sublinear, by="query_id"), "query_id")
    dot = w.join(q.select("query_id", "token", F.col("w").alias("qw")), "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dot.join(norms(w), "doc_id").select("query_id", "doc_id", F.coalesce(F.try_divide(F.col("dot"), F.col("norm")), F.lit(0.0)).alias("score"))


def top_per_query(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
