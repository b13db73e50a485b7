"""Counters that are kept with a table and merged, never counted again.

A line holds, for one group of rows, exact counts, a sketch of distinct values
and a sketch of quantiles.  Lines of parts of a table add up to the line of the
whole, so each bucket's lines are written when the bucket is, and totals over
sources, languages and schemes, or over everything, come from a few lines.

Distinct values are a HyperLogLog sketch of ``LG_K`` (a relative error of about
1.04 / 2**(LG_K / 2)); quantiles a histogram of logarithmic bins, ``PER_OCTAVE``
to a doubling, which merges by addition and is off by a bin at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
#: Bins of the histogram between a number and its double.
PER_OCTAVE = 16
#: Largest relative error of a quantile: half a bin.
QUANTILE_ERROR = 2 ** (1 / PER_OCTAVE / 2) - 1


def bin_of(value: Column) -> Column:
    """0 for what is not positive, else 1 + the bin."""
    return F.when(value > 0, F.floor(F.log2(value.cast("double")) * PER_OCTAVE) + 1 + (1 << 20)).otherwise(0).cast("int")


def middle_of(bin_: int) -> float:
    return 0.0 if not bin_ else 2 ** ((bin_ - 1 - (1 << 20) + 0.5) / PER_OCTAVE)


def lines(rows: DataFrame, by: list[str], distinct: str, number: str) -> DataFrame:
    """``by``, rows, total (of ``number``), distinct (a sketch), bins (a map from
    bin to count) of each group.  Nulls are no value; two aggregations, the first
    of which leaves a row for each bin of a group."""
    number_ = F.col(number)
    parts = rows.groupBy(*by, F.when(number_.isNotNull(), bin_of(number_)).alias("__bin")).agg(
        F.count("*").alias("rows"), F.sum(number_.cast("decimal(38,6)")).alias("total"), F.hll_sketch_agg(F.col(distinct), F.lit(LG_K)).alias("distinct"),
    )
    return _joined(parts.withColumn("bins", F.when(F.col("__bin").isNotNull(), F.map_from_arrays(F.array("__bin"), F.array("rows")))), by)


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Lines of parts as lines of the whole, over the columns ``by`` (none: one line)."""
    return _joined(parts, by)


def _joined(parts: DataFrame, by: list[str]) -> DataFrame:
    counts = parts.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.hll_union_agg("distinct").alias("distinct"))
    flat = parts.select(*by, F.explode("bins").alias("__k", "__v")).groupBy(*by, "__k").agg(F.sum("__v").alias("__v"))
    bins = flat.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__k", "__v")))).alias("bins"))  # bins of one group
    if not by:
        return counts.crossJoin(F.broadcast(bins)).where("rows IS NOT NULL")  # one line each
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return counts.alias("a").join(bins.alias("b"), same, "left").select(*[F.col(f"a.{c}").alias(c) for c in by], "rows", "total", "distinct", "bins")


def roll_up(parts: DataFrame, by: list[str]) -> DataFrame:
    """Lines over every set of the columns ``by``; a column that is summed over
    is null, and ``level`` has a bit for each that is (the last column: 1)."""
    out = None
    for left in range(1 << len(by)):
        kept = [c for i, c in enumerate(by) if not left >> (len(by) - 1 - i) & 1]
        one = _joined(parts, kept)
        one = one.select(*[F.col(c) if c in kept else F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in by], F.lit(left).alias("level"), "rows", "total", "distinct", "bins")
        out = one if out is None else out.unionByName(one)
    return out


def read(found: DataFrame, *quantiles: float) -> DataFrame:
    """Lines as numbers: distinct (an estimate), q50, ... of ``quantiles``."""
    keys = F.map_keys("bins")
    counts = F.map_values("bins")
    running = F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))

    def at(q: float) -> Column:
        goal = F.ceil(F.lit(q) * F.get(running, F.size(counts) - 1))
        place = F.array_position(F.transform(running, lambda r: r >= F.greatest(goal, F.lit(1))), True) - 1
        bin_ = F.get(keys, place.cast("int"))
        return F.when(bin_ == 0, 0.0).otherwise(F.pow(F.lit(2.0), (bin_ - 1 - (1 << 20) + 0.5) / PER_OCTAVE))

    return found.withColumns({f"q{round(q * 100)}": at(q) for q in quantiles}).withColumn("distinct", F.hll_sketch_estimate("distinct")).drop("bins")


def distinct_error(sigmas: float = 3.0) -> float:
    return sigmas * 1.04 / math.sqrt(1 << LG_K)
