"""Keyed tables: specifications, schema evolution, inserts with a conflict policy, and upserts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import read_config

TYPES = {"TEXT": T.StringType(), "INTEGER": T.LongType(), "INT": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType(), "NUMERIC": T.DoubleType()}


@dataclass(frozen=True)
class TableSpec:
    """Name, fields with types, primary key, secondary indexes."""

    name: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    index: tuple[str, ...] = ()

    @staticmethod
    def read(name: str, given: dict) -> TableSpec:
        fields = []
        for field, kind in given["schema"]:
            if str(kind).upper() not in TYPES:
                raise ValueError(f"{name}: unknown type {kind!r} of {field!r}")
            fields.append(T.StructField(field, TYPES[str(kind).upper()]))
        names = [f.name for f in fields]
        keys, index = tuple(given.get("keys") or ()), tuple(given.get("index") or given.get("indices") or ())
        for k in (*keys, *index):
            if k not in names:
                raise ValueError(f"{name}: {k!r} is not a field")
        return TableSpec(name, T.StructType(fields), keys, index)

    @staticmethod
    def load(path: str) -> TableSpec:
        from pathlib import Path

        return TableSpec.read(Path(path).stem, read_config(path))


def read_specs(folder: str) -> dict[str, TableSpec]:
    from pathlib import Path

    return {p.stem: TableSpec.load(str(p)) for p in sorted(Path(folder).iterdir()) if p.suffix in (".yml", ".yaml", ".json")}


def create_table(spark: SparkSession, spec: TableSpec, suffix: str = "", buckets: int = 0, path: str | None = None) -> None:
    """Create the table if it isn't there, at ``path`` if given; with ``buckets``, rows are clustered and sorted by key (there are no secondary indexes: sorted files prune by their statistics)."""
    name = spec.name + suffix
    if spark.catalog.tableExists(name):
        have = set(spark.table(name).columns)
        new = [f for f in spec.schema.fields if f.name not in have]
        if new:
            spark.sql(f"ALTER TABLE `{name}` ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        return
    writer = spark.createDataFrame([], spec.schema).write.format("parquet")
    if buckets and spec.keys:
        writer = writer.bucketBy(buckets, *spec.keys).sortBy(*(spec.index or spec.keys))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def create_all(spark: SparkSession, specs: Iterable[TableSpec], path: str | None = None) -> None:
    """Create the tables, each in a folder of ``path`` if given."""
    for s in specs:
        create_table(spark, s, path=path and f"{path}/{s.name}")


def evolve(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The rows with the specification's fields that they lack, as nulls, after their own."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema.fields if f.name not in df.columns])


def last_of_each(rows: DataFrame, keys: list[str], seq: str | None) -> DataFrame:
    """One row for each key: the last in order of ``seq``."""
    if seq is None:
        return rows.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", seq)


def insert(table: DataFrame, rows: DataFrame, keys: list[str], how: str = "replace", seq: str | None = None) -> DataFrame:
    """The table after an insert: ``replace`` takes the new row on a conflict, ``ignore`` the old, and ``abort``, ``fail`` and ``rollback`` raise."""
    new = last_of_each(rows, keys, seq).select(*table.columns)
    if how == "replace":
        return table.join(new, keys, "left_anti").select(*table.columns).unionByName(new)
    if how == "ignore":
        return table.unionByName(new.join(table, keys, "left_anti").select(*table.columns))
    if how in ("abort", "fail", "rollback"):
        if rows.groupBy(*keys).count().where("count > 1").take(1) or new.join(table, keys, "left_semi").take(1):
            raise ValueError("a key is there already")
        return table.unionByName(new)
    raise ValueError(f"unknown conflict policy {how!r}")


def update(table: DataFrame, rows: DataFrame, keys: list[str], *, add_new: bool = True, seq: str | None = None) -> DataFrame:
    """The table after an upsert: fields that the new rows have and that aren't null replace the old ones; other keys are added if ``add_new``.

    With ``seq``, the last value that isn't null counts for each field by itself.
    """
    missing = [k for k in keys if k not in rows.columns]
    if missing:
        raise KeyError(missing[0])
    fields = [c for c in rows.columns if c not in keys and c != seq]
    if seq is None:
        merged = rows.dropDuplicates(keys)
    else:
        merged = rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields])
    new = merged.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fields], F.lit(True).alias("__there"))
    joined = table.withColumn("__old", F.lit(True)).join(new, keys, "full" if add_new else "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def batches(rows: Iterable, size: int) -> Iterator[list]:
    """Lists of ``size``, the last one perhaps shorter."""
    it = iter(rows)
    while chunk := list(islice(it, size)):
        yield chunk
