"""Token counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day(t: Column) -> Column:
    return F.date_trunc("day", t).cast("timestamp_ntz")


def month(t: Column) -> Column:
    return F.date_trunc("month", t).cast("timestamp_ntz")


def year(t: Column) -> Column:
    return F.date_trunc("year", t).cast("timestamp_ntz")


def num_days(n: int = 7):
    """Tumbling buckets of n days since 1970-01-01."""

    def f(t: Column) -> Column:
        days = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date"))
        return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(days / n) * n).cast("int")).cast("timestamp_ntz")

    return f


def year_fraction(parts: int = 52):
    """Equal parts of the calendar year, to the microsecond."""

    def f(t: Column) -> Column:
        micros = lambda x: F.unix_micros(x.cast("timestamp"))
        begin = F.date_trunc("year", t)
        begin_us = micros(begin)
        length = micros(F.add_months(begin.cast("date"), 12)) - begin_us
        part = F.floor((micros(t) - begin_us) * parts / length)
        return F.timestamp_micros(begin_us + F.floor(part * length / parts).cast("long")).cast("timestamp_ntz")

    return f


CONVERTERS = {"day": day, "month": month, "year": year, "7d": num_days(7), "yearfrac": year_fraction(52)}


class TokenSeries:
    """``tokens``: rows (time, token, cnt); rows without a time are left out."""

    def __init__(self, tokens: DataFrame, converter: str = "day", time: str = "time"):
        f = CONVERTERS[converter] if isinstance(converter, str) else converter
        self.rows = tokens.where(F.col(time).isNotNull()).withColumn("bucket", f(F.col(time)))

    def totals(self) -> DataFrame:
        """(bucket, total): all tokens of each bucket."""
        return self.rows.groupBy("bucket").agg(F.sum("cnt").alias("total"))

    def series(self, tokens: list[str], *, normalize: bool = False, min_time=None, max_time=None, doc_filter: Column | None = None) -> DataFrame:
        """(token, bucket, value), in order: counts, or shares of all tokens of the bucket, whatever the filter. Limits are inclusive, on buckets."""
        r = self.rows.where(F.col("token").isin(tokens))
        if doc_filter is not None:
            r = r.where(doc_filter)
        if min_time is not None:
            r = r.where(F.col("bucket") >= F.lit(min_time))
        if max_time is not None:
            r = r.where(F.col("bucket") <= F.lit(max_time))
        c = r.groupBy("token", "bucket").agg(F.sum("cnt").alias("value"))
        if normalize:
            c = c.join(self.totals(), "bucket").select("token", "bucket", (F.col("value") / F.col("total")).alias("value"))
        return c.select("token", "bucket", "value").orderBy("token", "bucket")
