"""Document sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..checkpoints import ship


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", *, extensions: list[str] | None = None, recursive: bool = False, schema: str | None = None, **options) -> DataFrame:
    """Documents from a file or folder. ``extensions`` (with dot) match exactly; folders are read at their top level unless ``recursive``; a missing path is an error."""
    reader = spark.read.format(fmt).options(**options).option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(sorted(extensions)) + "}")
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def read_nested_json(spark: SparkSession, path: str, key: str, **options) -> DataFrame:
    """Records of JSON files that hold an object with an array under ``key``."""
    whole = spark.read.json(path, multiLine=True, **options)
    return whole.select(F.inline(F.col(key)))


def read_records(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[dict]], schema: str, *, recursive: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """Records that ``parse`` makes of each file's bytes; files are spread over the tasks, and one is in memory at a time."""
    files = read_documents(spark, path, "binaryFile", recursive=recursive, extensions=extensions).select("content")
    ship(spark)
    target = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse(content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in target.names} for r in rows])

    return files.mapInArrow(run, target)


def with_ids(docs: DataFrame, name: str = "doc_id", order: str | None = None) -> DataFrame:
    """Documents without ids get them, from 0 in the order of a column, nulls last and ties by the other columns, or of no defined order."""
    if order is None:
        return docs.withColumn(name, F.monotonically_increasing_id())
    from ..operators.corpus import dense_ids

    ties = [F.col(f.name) for f in docs.schema if f.name != order and not isinstance(f.dataType, (MapType, VariantType))]
    return dense_ids(docs, [F.col(order).asc_nulls_last()], ties).withColumnRenamed("term_id", name)


def filter_documents(docs: DataFrame, postings: DataFrame, *, min_features: int = 0, features: DataFrame | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Documents with at least so many distinct features, counted among ``features`` (token) if given."""
    p = postings.join(features.select("token"), "token", "left_semi") if features is not None else postings
    if min_features <= 0:
        return docs
    good = p.groupBy("doc_id").agg(F.count_distinct("token").alias("f")).where(F.col("f") >= min_features).select(F.col("doc_id").alias("__d"))
    return docs.join(good, docs[doc_id] == good["__d"], "left_semi")
