"""Exports to text formats of other tools."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.corpus import dense_ids


def mallet_lines(token_lists: DataFrame, label: str, doc_filter: Column | None = None) -> DataFrame:
    """(value): "id label token token ..." for each document."""
    d = token_lists if doc_filter is None else token_lists.where(doc_filter)
    return d.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col(label).cast("string"), F.array_join("tokens", " ")).alias("value"))


def write_mallet(token_lists: DataFrame, label: str, path: str, doc_filter: Column | None = None) -> None:
    mallet_lines(token_lists, label, doc_filter).write.text(path)


def slice_width(n: int, min_slice: int, max_slices: int) -> float:
    """Documents in a time slice: at least ``min_slice``, in at most ``max_slices`` slices."""
    if n < min_slice:
        return float(max(n, 1))
    return n / max_slices if ceil(n / min_slice) > max_slices else n / (n // min_slice)


class DynamicTopicFiles:
    """The four files of a dynamic topic model, as tables with a line number and the line.

    ``postings``: (doc_id, token, cnt); ``dates``: (doc_id, date).  Documents are
    numbered by date and id; terms from 0 in order of the term.
    """

    def __init__(self, postings: DataFrame, dates: DataFrame, min_slice: int = 1000, max_slices: int = 100):
        with_date = dates.where(F.col("date").isNotNull()).join(postings.select("doc_id").distinct(), "doc_id", "left_semi")
        n = with_date.count()
        width = slice_width(n, min_slice, max_slices)
        self.order = dense_ids(with_date.select("doc_id", "date"), [F.col("date"), F.col("doc_id")]).withColumnRenamed("term_id", "idx")
        self.order = self.order.withColumn("slice", F.floor(F.col("idx") / F.lit(width)).cast("long"))
        self.terms = dense_ids(postings.select("token").distinct(), [F.col("token")])
        self.postings = postings

    def voc(self) -> DataFrame:
        return self.terms.select(F.col("term_id").alias("line"), F.col("token").alias("value"))

    def mult(self) -> DataFrame:
        """"distinct id:count id:count ..." for each document, in order of date."""
        p = self.postings.join(self.terms, "token").join(self.order.select("doc_id", "idx"), "doc_id")
        s = p.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("term_id", "cnt"))).alias("s"))
        pairs = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["term_id"].cast("string"), x["cnt"].cast("string"))), " ")
        return s.select(F.col("idx").alias("line"), F.concat_ws(" ", F.size("s").cast("string"), pairs).alias("value"))

    def seq(self) -> DataFrame:
        """The number of slices, then the documents of each."""
        c = self.order.groupBy("slice").agg(F.count("*").alias("n"))
        return c.select((F.col("slice") + 1).alias("line"), F.col("n").cast("string").alias("value")).union(c.agg(F.lit(0).cast("long").alias("line"), F.count("*").cast("string").alias("value")))

    def dates(self) -> DataFrame:
        """First and last date of each slice."""
        return self.order.groupBy("slice").agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.col("slice").alias("line"), F.concat_ws(" ", F.date_format("a", "yyyy-MM-dd"), F.date_format("b", "yyyy-MM-dd")).alias("value"))

    def write(self, prefix: str) -> None:
        for name in ("voc", "mult", "seq", "dates"):
            getattr(self, name)().orderBy("line").select("value").write.text(f"{prefix}-{name}.dat")


def ordered_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.row_number().over(Window.orderBy("line")) - 1)
