"""Joins by order and by overlap, and sessions: what equality cannot say.

*As-of join.*  Each row of one side gets the last row of the other, of the same
key, at or before its time.  Both sides are one table, sorted in ranges of
(key, time) that split a hot key; inside a range the last row seen is carried,
and each range starts with the last row of the ranges before it, if the key
goes on: one row for each range.

*Interval join.*  Pairs of intervals [start, end) of one key that overlap.
An interval's class is its length's power of two; it stands in the bins of that
width that it touches, two at most.  Of two intervals that overlap the longer
one's class is at least the other's, so the shorter side looks into the bins of
every class there is from its own on, and a pair is made in one bin only.

*Sessions.*  Events of a key with gaps under a limit, in one pass over ranges as
above for a table, or with a watermark for a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def carried(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str, stage=materialize) -> DataFrame:
    """``rows`` plus ``name``: the last non-null ``value`` at or before a row,
    among rows with equal ``by``, in ``order``.

    Sorted by ranges, so a key with most rows is split; a range's first rows get
    the last value of the ranges before it that hold their key."""
    keys = [F.col(c) for c in by]
    placed = rows.withColumn("__v", value).withColumn("__tie", F.monotonically_increasing_id())
    placed = stage(placed.repartitionByRange(*keys, *order, "__tie").sortWithinPartitions(*keys, *order, "__tie").withColumn("__at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    inside = Window.partitionBy("__part", *by).orderBy("__at")
    placed = placed.withColumn("__last", F.last("__v", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = placed.groupBy("__part", *by).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__at"))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("__carry", F.last("__end", True).over(before)).where("__carry IS NOT NULL").select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], "__carry")
    # a range goes on with one key at most, so this has a row for each range
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    return placed.join(F.broadcast(carry), [F.col("__part") == F.col("__p"), *same], "left").select(*rows.columns, F.coalesce("__last", "__carry").alias(name))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], stage=materialize) -> DataFrame:
    """``left`` plus ``columns`` of the last row of ``right`` with the same
    ``by`` whose time is at or before the row's; null if there is none.  Of right
    rows with equal times that with the largest ``columns`` counts; null keys and
    null times match nothing."""
    known = [F.col(c).isNotNull() for c in by]
    usable = F.col(right_time).isNotNull()
    for k in known:
        usable = usable & k
    r = right.where(usable).groupBy(*by, F.col(right_time).alias("__t")).agg(F.max(F.struct(*columns)).alias("__r"))
    l_cols = F.struct(*[F.col(c) for c in left.columns if c not in by]).alias("__l")
    both = left.select(*by, F.col(left_time).alias("__t"), l_cols, F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__side"))
    both = both.unionByName(r.select(*by, "__t", F.lit(None).cast(both.schema["__l"].dataType).alias("__l"), "__r", F.lit(0).alias("__side")))
    found = carried(both, by, [F.col("__t"), F.col("__side")], F.col("__r"), "__found", stage).where("__side = 1")
    matched = F.col("__t").isNotNull()
    for k in known:
        matched = matched & k
    return found.select(*by, "__l.*", *[F.when(matched, F.col(f"__found.{c}")).alias(c) for c in columns])


def length_class(start: Column, end: Column) -> Column:
    """k of the least 2**k that is no shorter than the interval."""
    return F.ceil(F.log2((end - start).cast("double"))).cast("int")


def overlaps(left: DataFrame, right: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``by``, l and r (structs of the other columns) of all pairs of intervals
    that overlap.  Empty intervals, and null keys or ends, meet nothing; equal
    rows give as many pairs as there are."""
    width = lambda k: F.pow(F.lit(2.0), k)
    bins = lambda k: F.sequence(F.floor(F.col("__s") / width(k)).cast("long"), F.floor((F.col("__e") - 1) / width(k)).cast("long"))
    sides = {}
    for name, t in (("l", left), ("r", right)):
        t = t.where(F.col(end) > F.col(start))
        own = F.struct(*[F.col(c) for c in t.columns if c not in by])
        sides[name] = t.select(*by, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"), own.alias(name)).withColumn("__k", length_class(F.col("__s"), F.col("__e")))
    classes = {n: sorted(r[0] for r in t.select("__k").distinct().collect()) for n, t in sides.items()}  # 64 at most
    out = None
    # the long side in bins of its own class, the short side looks them up; equal classes meet once
    for long_, short, least in (("l", "r", 0), ("r", "l", 1)):
        if not classes[long_]:
            continue
        held = sides[long_].withColumn("__bin", F.explode(bins(F.col("__k"))))
        held = held.select(*by, F.col("__s").alias("__ls"), F.col("__e").alias("__le"), F.col("__k").alias("__lk"), "__bin", long_)
        asked = sides[short].withColumn("__lk", F.explode(F.filter(F.array(*map(F.lit, classes[long_])), lambda x: x >= F.col("__k") + least)))
        asked = asked.withColumn("__bin", F.explode(bins(F.col("__lk"))))
        pairs = asked.select(*by, "__s", "__e", "__lk", "__bin", short).join(held, [*by, "__lk", "__bin"])
        owner = F.floor(F.greatest("__s", "__ls") / width(F.col("__lk"))).cast("long")  # the bin in which the overlap begins
        pairs = pairs.where((F.col("__s") < F.col("__le")) & (F.col("__ls") < F.col("__e")) & (F.col("__bin") == owner)).select(*by, "l", "r")
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        l, r = (sides[x].limit(0).select(*by, x) for x in "lr")
        return l.join(r, by)
    return out


def sessions(events: DataFrame, by: list[str], time: str, gap_s: float, stage=materialize) -> DataFrame:
    """``by``, session_start, session_end (the last event), events: events less
    than ``gap_s`` seconds apart are one session, a hot key is split."""
    t, gap = F.unix_micros(F.col(time).cast("timestamp")), round(gap_s * 1e6)
    rows = events.where(F.col(time).isNotNull()).select(*by, t.alias("__t"))
    placed = stage(rows.repartitionByRange(*by, "__t").sortWithinPartitions(*by, "__t").withColumn("__at", F.monotonically_increasing_id()), "events").withColumn("__part", F.shiftright("__at", 33))
    inside = Window.partitionBy("__part", *by).orderBy("__at")
    begins = F.coalesce(F.col("__t") - F.lag("__t").over(inside) >= gap, F.lit(True))
    placed = placed.withColumn("__n", F.sum(begins.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = placed.groupBy("__part", *by, "__n").agg(F.min("__t").alias("a"), F.max("__t").alias("z"), F.count("*").alias("n"))
    # sessions of one range that touch are joined: a row for each session
    order = Window.partitionBy(*by).orderBy("a", "__part", "__n")
    fresh = F.coalesce(F.col("a") - F.lag("z").over(order) >= gap, F.lit(True))
    joined = parts.withColumn("__s", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*by, "__s").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("events")).select(*by, F.timestamp_micros("a").alias("session_start"), F.timestamp_micros("z").alias("session_end"), "events")
