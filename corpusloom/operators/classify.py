"""Nearest-neighbour and n-gram Bayes classifiers of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions import weighting
from . import lm
from .nearest import nearest
from .ngrams import BROADCAST_ROWS


def plane_weight(token: Column, plane: int, seed: int = 0) -> Column:
    """A token's coordinate in a random plane, +1 or -1 by the parity of a hash digit, the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{plane}:"), token))
    return F.when(F.substring(digest, 1, 1) < "8", 1.0).otherwise(-1.0)


class NearestNeighbours:
    """k nearest neighbours by cosine of sublinear tf-idf, in the query's hash bucket.

    ``train``: postings (doc_id, token, cnt); ``labels``: (doc_id, cls), None for a
    search that classifies nothing.  With
    ``planes`` = L the buckets are the L sign bits of random projections; 0 puts
    all in one bucket, and the search is exact.
    """

    def __init__(self, train: DataFrame, labels: DataFrame | None, k: int = 5, planes: int = 0, min_features: int = 1, seed: int = 0):
        self.k, self.planes, self.seed = k, planes, seed
        t = train if labels is None else written(train.join(labels.select("doc_id"), "doc_id", "left_semi"), "train")
        if min_features > 1:
            t = t.join(t.groupBy("doc_id").agg(F.count("*").alias("f")).where(F.col("f") >= min_features), "doc_id", "left_semi")
        self.labels = None if labels is None else labels.select(F.col("doc_id").alias("neighbour"), "cls")
        self.df = t.groupBy("token").agg(F.count("*").alias("df"))
        self.n = t.select("doc_id").distinct().agg(F.count("*").alias("n"))
        self.train = written(self._vectors(t), "vectors")

    def _vectors(self, postings: DataFrame) -> DataFrame:
        return weighting.unit_rows(weighting.weighted(postings, self.df, self.n, sublinear=True))

    def buckets(self, vectors: DataFrame) -> DataFrame:
        """(doc_id, bucket)"""
        if not self.planes:
            return vectors.select("doc_id").distinct().withColumn("bucket", F.lit(0).cast("long"))
        sides = [F.round(F.sum(F.col("w") * plane_weight(F.col("token"), i, self.seed)), 9).alias(f"s{i}") for i in range(self.planes)]
        dots = vectors.groupBy("doc_id").agg(*sides)
        bits = [F.when(F.col(f"s{i}") >= 0, 1 << i).otherwise(0) for i in range(self.planes)]
        return dots.select("doc_id", reduce(lambda a, b: a + b, bits).cast("long").alias("bucket"))

    def query(self, postings: DataFrame) -> DataFrame:
        """(query_id, neighbour, score, rank): the k nearest training documents in the bucket but the query itself, ties by id."""
        q, t = written(self._vectors(postings), "queries"), self.train
        if self.planes:
            q, t = q.join(self.buckets(q), "doc_id"), t.join(self.buckets(t), "doc_id")
        else:
            q, t = (x.withColumn("bucket", F.lit(0).cast("long")) for x in (q, t))
        s = nearest(q, t, self.k)
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "neighbour")
        return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)

    def classify(self, postings: DataFrame, weight: Column | None = None) -> DataFrame:
        """(query_id, cls, confidence): the class with most votes and its share; null where a bucket has no neighbours."""
        near = self.query(postings).join(self.labels, "neighbour")
        votes = near.groupBy("query_id", "cls").agg(F.sum(F.lit(1.0) if weight is None else weight).alias("v"))
        w = Window.partitionBy("query_id").orderBy(F.desc("v"), "cls")
        best = votes.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("query_id"))).withColumn("r", F.row_number().over(w)).where("r = 1")
        ids = postings.select(F.col("doc_id").alias("query_id")).distinct()
        return ids.join(best, "query_id", "left").select("query_id", "cls", F.col("share").alias("confidence"))


def train_bayes(token_lists: DataFrame, labels: DataFrame, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """(counts by class, priors): all n-grams up to n of each class, and (cls, log_prior)."""
    t = token_lists.join(labels.select("doc_id", "cls"), "doc_id")
    counts = lm.train(t, n, by=["cls"])
    size = t.groupBy("cls").agg(F.count("*").alias("c"))
    total = t.agg(F.count("*").alias("t"))
    return counts, size.crossJoin(F.broadcast(total)).select("cls", F.log(F.col("c") / F.col("t")).alias("log_prior"))


def _met(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined to ``table``, whose heaviest rows are broadcast, so that of the rows only those with rarer keys cross a shuffle."""
    sizes = sorted(table.groupBy(weight).agg(F.count("*").alias("rows")).collect(), reverse=True)
    least, held = None, 0
    for s in sizes:
        held += s["rows"]
        if held > BROADCAST_ROWS:
            break
        least = s[weight]
    if held <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    if least is None:
        return rows.join(table, keys)
    head = F.broadcast(table.where(F.col(weight) >= least))
    rare = rows.join(head.select(*keys), keys, "left_anti")
    return rows.join(head, keys).unionByName(rare.join(table.where(F.col(weight) < least), keys))


def bayes_scores(token_lists: DataFrame, counts: DataFrame, priors: DataFrame, n: int = 2, delta: float = 0.1) -> DataFrame:
    """(doc_id, cls, logp): log prior plus the additive-smoothed log probability under each class's n-grams.

    ln((c + delta) / (ct + v delta)) is taken apart: what an unseen n-gram after an
    unseen context has counts once for each token, and only n-grams and contexts that
    a class has seen are joined, for what they add to it.
    """
    d = F.lit(float(delta))
    v = counts.where("n = 1").groupBy("cls").agg(F.count("*").alias("v"))
    classes = priors.join(v, "cls").select("cls", "log_prior", (F.col("v") * d).alias("vd"))
    pos = lm.positions(token_lists, n).select("doc_id", "context", "token")
    gain = lambda c, base: F.collect_list(F.struct("cls", (F.log(F.col(c) + base) - F.log(base)).alias("x"))).alias("gains")
    grams = written(counts.join(F.broadcast(classes.select("cls")), "cls").groupBy("context", "token").agg(gain("total", d), F.sum("total").alias("weight")), "grams")
    totals = counts.groupBy("cls", "context").agg(F.sum("total").alias("ct"))
    contexts = written(totals.join(F.broadcast(classes), "cls").groupBy("context").agg(gain("ct", F.col("vd")), F.sum("ct").alias("weight")), "contexts")
    seen = _met(pos, grams, ["context", "token"], "weight").select("doc_id", F.inline("gains")).select("doc_id", "cls", "x")
    after = _met(pos.select("doc_id", "context"), contexts, ["context"], "weight").select("doc_id", F.inline("gains")).select("doc_id", "cls", (-F.col("x")).alias("x"))
    docs = token_lists.where(F.size("tokens") > 0).select("doc_id", F.size("tokens").alias("k"))
    rest = docs.crossJoin(F.broadcast(classes)).select("doc_id", "cls", (F.col("k") * (F.log(d) - F.log("vd"))).alias("x"))
    s = seen.unionByName(after).unionByName(rest).groupBy("doc_id", "cls").agg(F.sum("x").alias("s"))
    return s.join(F.broadcast(priors), "cls").select("doc_id", "cls", (F.col("s") + F.col("log_prior")).alias("logp"))


def bayes_classify(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("logp", 6)), "cls")
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "cls", "logp")
