"""Durable notes and the evidence they cite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MEMORY_SOURCES, MEMORY_TYPES

MEMORY = "memory_id string, type string, content string, source string, created_at double, updated_at double"
EVIDENCE = "memory_id string, chunk_key string"


def problems(rows: DataFrame) -> DataFrame:
    """``rows`` (type, content, source, chunk_keys) plus ``problem``, null if none."""
    keys = F.filter(F.coalesce("chunk_keys", F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    return rows.withColumn("problem", (
        F.when(~F.trim("type").isin(*MEMORY_TYPES), F.concat(F.lit("Unsupported memory type: "), F.trim("type")))
        .when(~F.trim("source").isin(*MEMORY_SOURCES), F.concat(F.lit("Unsupported memory source: "), F.trim("source")))
        .when(F.trim("content") == "", "memory content must be non-empty")
        .when((F.trim("source") == "derived_from_evidence") & (F.size(keys) == 0), "derived_from_evidence memory requires at least one chunk_key")
    ))


def add(memory: DataFrame, evidence: DataFrame, kind: str, content: str, source: str, chunk_keys=(), memory_id: str | None = None, now: float = 0.0) -> tuple[DataFrame, DataFrame, str]:
    spark = memory.sparkSession
    name = memory_id or str(uuid.uuid4())
    keys = sorted({k.strip() for k in chunk_keys if k.strip()})
    row = spark.createDataFrame([(kind, content, source, keys)], "type string, content string, source string, chunk_keys array<string>")
    if (bad := problems(row).first()["problem"]) is not None:
        raise ValueError(bad)
    new = spark.createDataFrame([(name, kind.strip(), content.strip(), source.strip(), now, now)], MEMORY)
    return memory.unionByName(new), evidence.unionByName(spark.createDataFrame([(name, k) for k in keys], EVIDENCE)), name


def delete(memory: DataFrame, evidence: DataFrame, memory_id: str) -> tuple[DataFrame, DataFrame, bool]:
    there = bool(memory.where(F.col("memory_id") == memory_id).limit(1).count())
    return memory.where(F.col("memory_id") != memory_id), evidence.where(F.col("memory_id") != memory_id), there


def listing(memory: DataFrame, evidence: DataFrame) -> DataFrame:
    """Notes with their sorted chunk keys, latest first."""
    keys = evidence.groupBy("memory_id").agg(F.array_sort(F.collect_set("chunk_key")).alias("chunk_keys"))
    rows = memory.join(keys, "memory_id", "left").withColumn("chunk_keys", F.coalesce("chunk_keys", F.array().cast("array<string>")))
    return rows.orderBy(F.desc("updated_at"), "memory_id")


def evidence_keys(evidence: DataFrame) -> DataFrame:
    return evidence.select("chunk_key").distinct().orderBy("chunk_key")


def dangling(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    return evidence.join(chunks.select("chunk_key"), "chunk_key", "left_anti")


def export(memory: DataFrame, evidence: DataFrame, schema_version: int = 1, now: float = 0.0) -> DataFrame:
    """One row ``json``: {schema_version, exported_at, items}.  The export is one document by contract."""
    items = F.array_sort(F.collect_list(F.struct(-F.col("updated_at"), "memory_id", F.struct(*memory.columns, "chunk_keys").alias("item"))))
    rows = listing(memory, evidence).agg(F.transform(items, lambda x: x["item"]).alias("items"))
    return rows.select(F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), F.lit(now).alias("exported_at"), "items")).alias("json"))
