"""Maps as tables (key, value): composed, put in place of keys, and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _mapped(rows: DataFrame, column: str, mapping: DataFrame, check: bool) -> DataFrame:
    """``rows`` with the column's values replaced by those of ``mapping`` (key, value).

    A value without a partner is an error: with ``check`` before anything is
    returned, else as the rows are computed.
    """
    m = mapping.select(F.col("key").alias("__key"), F.col("value").alias("__value"), F.lit(True).alias("__there"))
    if check and rows.join(m, rows[column].eqNullSafe(m["__key"]), "left_anti").take(1):
        raise ValueError(f"the map has not all values of {column!r}")
    out = rows.join(m, rows[column].eqNullSafe(m["__key"]), "left")
    kind = mapping.schema["value"].dataType
    lost = F.raise_error(F.concat(F.lit("the map has no "), F.coalesce(rows[column].cast("string"), F.lit("null")))).cast(kind)
    value = F.when(F.col("__there"), F.col("__value")).otherwise(lost)
    return out.select(*[value.alias(c) if c == column else rows[c] for c in rows.columns])


def substitute_keys(table: DataFrame, subs: DataFrame, check: bool = False) -> DataFrame:
    """(key, value) with each key replaced by what ``subs`` (key, value) has for it; where two become one, the value of the greatest old key stays."""
    new = _mapped(table.select(F.col("key").alias("old"), "key", "value"), "key", subs, check)
    return new.groupBy("key").agg(F.max_by("value", "old").alias("value"))


def compose_maps(first: DataFrame, second: DataFrame, check: bool = False) -> DataFrame:
    """(key, value): what ``second`` has for the value that ``first`` has for the key."""
    return _mapped(first.select("key", "value"), "value", second, check)


def first_reaching(lists: DataFrame, queries: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """For each query (by.., x) the least ``order`` at which the ascending ``value`` of its list is at least x, null where none is: the search by which a share is drawn.

    The values are laid out with the queries and swept once, so a list of any
    length is looked up without a loop; equal values count by the first.
    """
    rows = lists.select(*by, F.col(value).cast("double").alias("__v"), F.col(order).alias(order), F.lit(None).cast("double").alias("x"), F.lit(1).alias("__side"))
    asked = queries.select(*by, F.col("x").cast("double").alias("__v"), F.lit(None).cast(lists.schema[order].dataType).alias(order), F.col("x").cast("double").alias("x"), F.lit(0).alias("__side"))
    # from the greatest down: the last list value seen before a query is the first that reaches it
    w = Window.partitionBy(*by).orderBy(F.desc("__v"), F.desc("__side"), F.desc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(asked).withColumn(order, F.last(order, ignorenulls=True).over(w))
    return swept.where("__side = 0").select(*by, "x", order)
