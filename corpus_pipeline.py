"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination,
mixing to target weights, sharding.

Each stage gets the rows that its predecessor kept, decides on its own input,
and returns the columns of ``documents``; the last adds ``shard``.  ``run``
writes every stage's result as Parquet in the shared folder and rereads it.

Every stage takes nulls in any column, texts of any length (read whole), rows
that repeat, an empty table (no rows come out) and extra columns, whatever their
names (they are passed through).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bytecnn, editmatch, mixing, sharding, simhash
from millrace.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects text that is null or has no letter, and text whose
    best language scores under ``bytecnn.LEAST_SCORE``.  Rows with equal texts
    go or stay together; with no language to learn from every row goes."""
    return bytecnn.keep_identified(docs, bytecnn.train_language(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of texts that are alike in nine words
    of ten, by their five-word shingle sets, the row with the smallest id stays.  Empty and
    blank texts are one group; of rows equal in id and text one stays; rows with
    a null id stay."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: drops documents in which an item occurs within
    its error budget (a tenth of its length).  Null and empty texts stay; null
    and empty items match nothing."""
    return editmatch.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: samples documents to raked source, language and topic weights.
    Null source or language is a value of its own; texts without a token stay;
    rows with equal ids go or stay together."""
    return mixing.sample_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: adds ``shard``, 0 to 39, equal texts (null counts as empty)
    together, bytes near equal; a column of that name is replaced."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL can express neither the trained model nor the similarity groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
