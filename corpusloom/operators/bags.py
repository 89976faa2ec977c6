"""Multisets in long form: rows (keys.., cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag(tokens: DataFrame, by: list[str], key: str = "token") -> DataFrame:
    """(by.., key, cnt) of rows with one token each."""
    return tokens.groupBy(*by, key).agg(F.count("*").alias("cnt"))


def weighted_bag(rows: DataFrame, by: list[str], weight: str, key: str = "token") -> DataFrame:
    return rows.groupBy(*by, key).agg(F.sum(weight).alias("cnt"))


def add(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset sum."""
    return a.select(*keys, "cnt").unionByName(b.select(*keys, "cnt")).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """max(0, a - b) for each key; keys that come to nothing are dropped."""
    less = b.select(*keys, F.col("cnt").alias("__less"))
    left = F.greatest(F.col("cnt") - F.coalesce("__less", F.lit(0)), F.lit(0))
    return a.join(less, keys, "left").select(*keys, left.alias("cnt")).where("cnt > 0")


def drop(a: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(gone.select(*keys).distinct(), keys, "left_anti")


def total(a: DataFrame, by: list[str] | None = None) -> DataFrame:
    return a.groupBy(*(by or [])).agg(F.sum("cnt").alias("total"))


def totals_by_length(a: DataFrame, n: str = "n") -> DataFrame:
    """(n, total_ngrams, distinct_ngrams) of a bag of n-grams (n, token, cnt)."""
    return a.groupBy(n).agg(F.sum("cnt").alias("total_ngrams"), F.count_distinct("token").alias("distinct_ngrams"))


def as_map(a: DataFrame, by: list[str], key: str = "token") -> DataFrame:
    """One row for each of ``by``, its counts as a map."""
    return a.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, "cnt"))).alias("bag"), F.sum("cnt").alias("total"))
