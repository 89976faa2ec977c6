"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm_sq(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(norm_sq(v))


def unit(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: F.try_divide(x, n)))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y))


def gauss_kernel(a: Column, b: Column, sigma: float) -> Column:
    """exp(-|a - b|^2 / sigma^2)"""
    return F.exp(-norm_sq(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)) / F.lit(float(sigma) ** 2))


def vmf_kernel(a: Column, b: Column, kappa: float) -> Column:
    """exp(kappa cos(a, b)), not normalised."""
    return F.exp(F.lit(float(kappa)) * cosine(a, b))
