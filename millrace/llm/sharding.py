"""Sharding: longest-processing-time scheduling of groups that stay together.

Groups (rows with equal ``group`` keys) are totalled in one aggregation.  Each
group of at least 1 / (shards * bundles_per_shard) of all bytes is scheduled by
itself.  Smaller groups, of which there may be any number, are dealt by hash
into a fixed number of bundles, and a bundle is scheduled like a group: it holds
about that share of the bytes as well.  The schedulable units are therefore at
most ``2 * shards * bundles_per_shard``, whatever the input: they are sorted by
size and go, largest first, to the least-loaded shard through a heap, which
leaves the loads apart by about the smallest units.  Slots are numbered inside
blocks of a shard, so that no task ever holds a whole shard.

Defined results: null text is the empty text (size 16, crc 0, one group); texts
of any length count whole; equal sizes are scheduled in unit order, equal loads
by shard number; repeated rows stay together and get slots of their own, rows
with equal or null ids by the hash of their text; empty input gives no rows;
``shard_frame`` returns its seven columns only, ``shard_documents`` passes the
columns of the input through and resolves a clash with ``shard`` in favour of
the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 40
BUNDLES_PER_SHARD = 512
#: Rows that one task numbers at most, about.
BLOCK_ROWS = 100_000


def lpt(units: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time first; ties by unit name, then shard number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def assign_shards(rows: DataFrame, totals: DataFrame, shards: int = SHARDS, bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """``rows`` plus ``shard`` (int).  ``rows`` has ``__text``, the group key;
    ``totals`` (``__text``, ``size``) is a cheap table of what there is to place."""
    spark = rows.sparkSession
    bundles = shards * bundles_per_shard
    whole = totals.agg(F.sum("size")).first()[0] or 0
    bound = max(1, -(-whole // bundles))  # at most ``bundles`` groups are as large
    alone = F.concat(F.lit("g"), F.col("__text").cast("string"))
    dealt = F.concat(F.lit("b"), F.pmod(F.xxhash64(F.col("__text"), F.lit(17)), F.lit(bundles)).cast("string"))
    groups = totals.groupBy("__text").agg(F.sum("size").alias("s"))
    units = groups.groupBy(F.when(F.col("s") >= bound, alone).otherwise(dealt).alias("u")).agg(F.sum("s").alias("n"))
    placed = sorted(lpt([(r["u"], r["n"]) for r in units.collect()], shards).items())  # <= 2 * bundles units
    large = F.broadcast(spark.createDataFrame([x for x in placed if x[0][0] == "g"], "__u string, __own int"))  # <= bundles rows
    small = F.broadcast(spark.createDataFrame([x for x in placed if x[0][0] == "b"], "__b string, __dealt int"))  # <= bundles rows
    return (
        rows.withColumns({"__u": alone, "__b": dealt}).join(large, "__u", "left").join(small, "__b", "left")
        .withColumn("shard", F.coalesce("__own", "__dealt").cast("int")).drop("__u", "__b", "__own", "__dealt")
    )


def add_slots(rows: DataFrame, key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (with ``shard``) plus ``slot``: gapless from 0 in each shard."""
    counts = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    blocks = max(8, -(-counts // block_rows))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(F.col(key), F.col("__text"), F.lit(5)), F.lit(blocks)))
    sizes = rows.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks, not rows
    offsets = sizes.select("shard", "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("shard", "__block").orderBy(key, "__text")
    return (
        rows.join(offsets, ["shard", "__block"])
        .withColumn("slot", (F.col("__from") + F.row_number().over(inside) - 1).cast("long")).drop("__block", "__from")
    )


def shard_frame(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = materialize(
        docs.select(F.col(key), text_size(F.col(text)).alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(body).alias("__text")),
        "shard-rows",
    )
    placed = add_slots(assign_shards(slim, slim, shards), key)
    return placed.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``docs`` as they are plus ``shard`` (groups: equal texts)."""
    group = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__text")
    totals = materialize(docs.select(group, text_size(F.col(text)).alias("size")).groupBy("__text").agg(F.sum("size").alias("size")), "shard-sizes")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "shard"]).alias("__row"), group)  # packed: no name can clash
    return assign_shards(rows, totals, shards).select("__row.*", "shard")


def op2_sharding_lpt(spark, sf_dir: str) -> DataFrame:
    return shard_frame(table(spark, sf_dir, "documents"))
