"""Evaluation: precision-recall curves, folds, metrics, paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_tail
from .corpus import ranked


def pr_curve(rows: DataFrame, order: str = "pos", truth: str = "truth", pred: str = "pred", positive: int = 1) -> DataFrame:
    """(i, threshold, precision, recall): N+1 points of a sweep over rising scores, ties by ``order``.

    Point i takes all but the i lowest as positive; point 0 has precision 0 and
    recall 1, point N precision 1 and recall 0.  The sweep is ranked and summed
    inside range partitions, so no one task orders all rows.
    """
    r = ranked(rows.select(order, pred, (F.col(truth) == positive).cast("long").alias("t")), [F.col(pred), F.col(order)], "t").withColumnRenamed("__rank", "i")
    everything = r.agg(F.sum("t").alias("p"), F.count("*").alias("n"))
    x = r.withColumn("fn", F.col("__run")).crossJoin(F.broadcast(everything))
    tp = F.col("p") - F.col("fn")
    kept = F.col("n") - F.col("i")
    points = x.select(
        F.col("i").cast("long").alias("i"), F.col(pred).cast("double").alias("threshold"),
        F.when(kept == 0, 1.0).otherwise(F.try_divide(tp, kept)).alias("precision"), F.coalesce(F.try_divide(tp, F.col("p")), F.lit(0.0)).alias("recall"),
    )
    zero = everything.where("n > 0").select(F.lit(0).cast("long").alias("i"), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("precision"), F.lit(1.0).alias("recall"))
    return zero.union(points)


def k_folds(keys: DataFrame, key: str, k: int, order: list | None = None, seed: int = 0) -> DataFrame:
    """(key, fold): keys in hash order (or ``order``), cut at round(i N / k) rounded to an integer downwards."""
    n = keys.agg(F.count("*").alias("n"))
    x = ranked(keys, order or [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]).select(key, (F.col("__rank") - 1).alias("r")).crossJoin(F.broadcast(n))
    bound = lambda i: F.floor(F.round(F.lit(i) * F.col("n") / k, 8)).cast("long")
    fold = F.lit(k - 1)
    for i in range(k - 1, 0, -1):
        fold = F.when(F.col("r") < bound(i), F.lit(i - 1)).otherwise(fold)
    return x.select(key, fold.cast("int").alias("fold"))


def metrics(rows: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred", positive: int = 1) -> DataFrame:
    """(by.., precision, recall, f1, accuracy, n); undefined ones are 0."""
    t, p = F.col(truth) == positive, F.col(pred) == positive
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x = rows.groupBy(*by).agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    prec, rec = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return x.select(*by, prec.alias("precision"), rec.alias("recall"), safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))


def cross_validate(folds: DataFrame, classifiers: dict, key: str = "doc_id", truth: str = "truth") -> DataFrame:
    """(classifier, fold, metrics..): each classifier, a function (train keys, test keys) -> (key, pred), on each fold of ``folds(key, fold, truth)``."""
    out = None
    k = sorted(r.fold for r in folds.select("fold").distinct().collect())
    for name, classify in classifiers.items():
        for i in k:
            train, test = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
            got = classify(train.select(key, truth), test.select(key))
            m = metrics(test.join(got, key).select(F.lit(name).alias("classifier"), F.lit(i).alias("fold"), truth, "pred"), ["classifier", "fold"], truth)
            out = m if out is None else out.unionByName(m)
    return out


def paired_t(results: DataFrame, value: str = "f1") -> DataFrame:
    """(better, worse, t, dof, p_value) for each pair of classifiers over their folds (classifier, fold, value)."""
    a = results.select(F.col("classifier").alias("a"), "fold", F.col(value).alias("x"))
    b = results.select(F.col("classifier").alias("b"), "fold", F.col(value).alias("y"))
    d = a.join(b, "fold").where("a < b").groupBy("a", "b").agg(F.avg(F.col("x") - F.col("y")).alias("m"), F.stddev_samp(F.col("x") - F.col("y")).alias("s"), F.count("*").alias("n"))
    t = F.when(F.col("s") > 0, F.col("m") / (F.when(F.col("s") > 0, F.col("s")) / F.sqrt("n"))).otherwise(F.when(F.col("m") == 0, 0.0).otherwise(F.signum("m") * float("inf")))
    x = d.withColumn("t0", t)
    first = F.col("m") >= 0
    return x.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"), F.abs("t0").alias("t"), (F.col("n") - 1).alias("dof")).withColumn("p_value", t_tail(F.col("t"), F.col("dof")))
