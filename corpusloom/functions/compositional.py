"""Compositional data: arrays of non-negative parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def closure(v: Column) -> Column:
    """Divided by the sum; null parts where that is 0."""
    t = total(v)
    return F.transform(v.cast("array<double>"), lambda x: F.try_divide(x, t))


def clr(v: Column) -> Column:
    """ln p less the mean of ln p."""
    logs = F.transform(v.cast("array<double>"), lambda x: F.log(x))
    mean = F.try_divide(total(logs), F.size(v))
    return F.transform(logs, lambda x: x - mean)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v.cast("array<double>"), lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def center(rows: DataFrame, parts: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by.., k, center): softmax of the (weighted) mean of the rows' clr; k counts the parts from 0."""
    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = rows.select(*by, w.alias("__w"), F.posexplode(clr(F.col(parts))).alias("k", "x"))
    mean = long.groupBy(*by, "k").agg((F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("m"))
    one = mean.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("s"))
    return one.select(*by, F.posexplode(softmax(F.col("s.m"))).alias("k", "center"))
