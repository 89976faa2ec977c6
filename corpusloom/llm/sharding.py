"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its key modulo ``SLOTS`` and never changes.  Bytes are
added up by slot, so whatever the table's size, what is decided on has as many
rows as there are slots.  Version 1 of the map cuts the slots, in order, into
shards of about equal bytes.  A later version edits the map before it: each old
shard keeps its slots, in order, while their bytes fit the new share; what is
beyond goes, in order of shard and slot, to the new shards, cut into about equal
parts.  Slots that stay aren't written again, and old versions stay readable.

Defined cases: a null key has the slot of the empty string; a null text has no
bytes; repeated rows count as often as they come and share a slot; slots
without records are in the map too, with no bytes; an empty table gives a map of
shard 0 alone and no assignments; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 28 bits of the MD5 of the key's text, modulo ``slots``: the same in any engine."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), F.lit(slots))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, n_records, n_bytes) for every slot of records (doc_id, text)."""
    spark = records.sparkSession
    used = records.select(slot_of(F.col("doc_id"), slots).alias("slot"), F.octet_length("text").cast("long").alias("b")).groupBy("slot").agg(F.count("*").alias("n_records"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"))
    every = spark.range(slots).select(F.col("id").alias("slot"))
    return every.join(F.broadcast(used), "slot", "left").select("slot", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_records", "n_bytes")])


def _cut(before: Column, total: Column, shards: int) -> Column:
    """The part in which the ``before``-th of ``total`` bytes lies, of ``shards`` equal parts."""
    return F.when(total == 0, F.lit(0)).otherwise(F.least(F.expr(f"0L + {shards} - 1"), F.floor(before * shards / total))).cast("int")


def first_map(usage: DataFrame, shards: int) -> DataFrame:
    """Version 1: (version, slot, shard, n_bytes). ``usage`` has one row for each slot, so one task may order them."""
    if shards < 1:
        raise ValueError("shards must be positive")
    w = Window.orderBy("slot")
    before = F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
    total = F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return usage.select(F.lit(1).alias("version"), "slot", _cut(before, total, shards).alias("shard"), "n_bytes")


def grown_map(old: DataFrame, shards: int) -> DataFrame:
    """The next version, over ``shards`` shards, of a map whose shards are fewer and numbered from 0."""
    had = (old.agg(F.max("shard")).first()[0] or 0) + 1
    return _grown(old, had, shards)


def _grown(old: DataFrame, had: int, shards: int) -> DataFrame:
    if shards <= had:
        raise ValueError("a grown map needs more shards")
    all_ = Window.partitionBy(F.lit(0))
    own = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    kept = old.select("version", "slot", "shard", "n_bytes", F.sum("n_bytes").over(all_).alias("total"), F.sum("n_bytes").over(own).alias("upto"))
    kept = kept.withColumn("moves", F.col("upto") * shards > F.col("total"))
    pool = Window.partitionBy("moves").orderBy("shard", "slot")
    before = F.sum("n_bytes").over(pool.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes")
    moved = F.sum("n_bytes").over(Window.partitionBy("moves"))
    return kept.select(
        (F.col("version") + 1).alias("version"), "slot",
        F.when(F.col("moves"), F.lit(had) + _cut(before, moved, shards - had)).otherwise(F.col("shard")).cast("int").alias("shard"), "n_bytes",
    )


class SlotMap:
    """Versions of a map as a Parquet table, one partition a version; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, version: DataFrame) -> int:
        number = version.agg(F.max("version")).first()[0]
        version.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={number}")
        return number

    def get(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}").select(F.lit(version).alias("version"), "slot", "shard", "n_bytes")


def assign(records: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, slot, shard, map_version) for every record; the map, of a fixed size, is broadcast."""
    m = slot_map.select(F.col("slot").alias("__slot"), "shard", F.col("version").alias("map_version"))
    r = records.select("doc_id", slot_of(F.col("doc_id"), slots).alias("slot"))
    return r.join(F.broadcast(m), F.col("slot") == F.col("__slot")).select("doc_id", "slot", "shard", "map_version")


def oracle(slots: int, first: int, grown: int) -> str:
    """The query of `assign` under version 2 in DuckDB's SQL."""
    return f"""
with r as (select doc_id, (('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 7))::bigint) % {slots} as slot, strlen(text) as b from documents),
usage as (select s.slot, cast(coalesce(sum(r.b), 0) as bigint) as n_bytes from (select unnest(range({slots})) as slot) s left join r on r.slot = s.slot group by s.slot),
w as (select slot, n_bytes, sum(n_bytes) over (order by slot) - n_bytes as before, sum(n_bytes) over () as total from usage),
v1 as (select slot, n_bytes, case when total = 0 then 0 else least({first} - 1, cast(floor(cast(before * {first} as double) / total) as bigint)) end as shard from w),
k as (select *, sum(n_bytes) over (partition by shard order by slot) * {grown} > sum(n_bytes) over () as moves from v1),
p as (select *, sum(n_bytes) over (partition by moves order by shard, slot) - n_bytes as before, sum(n_bytes) over (partition by moves) as moved from k),
had as (select max(shard) + 1 as h from v1),
v2 as (select slot, case when moves then h + case when moved = 0 then 0 else least({grown} - h - 1, cast(floor(cast(before * ({grown} - h) as double) / moved) as bigint)) end else shard end as shard from p, had)
select r.doc_id, r.slot, cast(v2.shard as integer) as shard, 2 as map_version from r join v2 using (slot)
"""
