"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, decontamination, embedding_dedup, jaccard_join, language_id, packing, quality, secret_scan, sharding, token_coding
from .session import fresh_path

#: Shards of op3's first map and of the one it is grown to.
SHARDS = (64, 80)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(_table(spark, sf_dir, "embeddings"))


def op3_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    maps = sharding.SlotMap(spark, fresh_path(spark, "slot-map"))
    maps.put(sharding.first_map(sharding.slot_bytes(docs), SHARDS[0]))
    maps.put(sharding.grown_map(maps.get(1), SHARDS[1]))
    return sharding.assign(docs, maps.get(2))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_coding.write_ids(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_embedding_dedup, op3_slot_sharding, op4_decontamination, op5_chunk_dedup, op6_quality_classifier, op7_token_ids, op8_secret_scan, op9_ngram_jaccard_join, op10_language_id, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_slot_sharding": sharding.oracle(sharding.SLOTS, *SHARDS)}
