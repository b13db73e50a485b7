"""Prefix trie of conversations from the LCP array of their sorted order.

Turns are 128-bit digests of (role, text) with a count of words.  They are
sorted by conversation and turn in ranges, so positions in a conversation come
from a scan within ranges plus a carry for each range, however long one
conversation is.  Rebuilt conversations stand in rows of ``BLOCK`` turns.

*Order.*  The sort key of a conversation is its first ``BLOCK`` turns, then up
to ``BLOCK`` names of blocks of as many turns, then of blocks of such blocks,
as far as the longest needs.  Names are the ranks of the distinct blocks, so
keys stand in the order of the whole sequences and no row holds a long
conversation.  Equal conversations stand in the order of their ids.

*LCP.*  Neighbours are compared key part by key part; where two names differ,
their blocks are looked up, level by level.

*Tree.*  For every place the nearest smaller LCP on both sides bounds an
interval of conversations: in groups of ``GROUP`` places by a stack, across
groups by the minima of all groups and, in the group that they name, by its
chain of strict minima.  Places with equal LCP in one interval are one node of
the Cartesian tree; sums over its interval are differences of prefix sums, its
smallest id is a minimum over parts of groups and whole groups.  A node stands
for the depths below its parent's; they are expanded by a join with the blocks
of the node's smallest member.

The driver holds two keys for each range of the sort and one line of minima and
sums for each ``GROUP`` conversations.

Defined results: a null role or text is empty; rows with a null ``conv_id``
belong to no conversation; a null turn comes first, rows with equal turns are
in the order of their digests, repeated rows count each; a conversation without
turns is a member of the root; an empty table has no node; extra columns are
ignored; texts are read whole and do not leave the first pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_ready, discard, materialize, table

#: Turns, or names of blocks, in one row.
BLOCK = 64
#: Neighbours whose nearest smaller values one task finds at once (a power of 2).
GROUP = 1 << 16
#: Conversations that share turns (see ``rebuilt``), and turns shared at most.
FAMILY, SHARED = 20, 3
NO_ID = (1 << 63) - 1
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def slim_turns(conversations: DataFrame) -> DataFrame:
    """c, turn, key (16 bytes), words of every turn."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), key.alias("key"), words.alias("words"))


def positioned(turns: DataFrame) -> DataFrame:
    """c, pos, key, words, w (words up to and with the turn), materialised."""
    arrow_ready(turns.sparkSession)
    by = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("tie")]  # ties: a hot turn is split as well
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches):
        last, n, total = None, 0, 0
        for b in batches:
            if not len(b):
                continue
            c, words = b.column("c").to_numpy(), b.column("words").to_numpy()
            cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(cut, len(c)))
            pos, w = np.arange(len(c)) - np.repeat(cut, size), np.cumsum(words)
            w -= np.repeat((w - words)[cut], size)
            if c[0] == last:
                pos[: size[0]] += n
                w[: size[0]] += total
            last, n, total = c[-1], int(pos[-1]) + 1, int(w[-1])
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("c"), pa.array(pos), b.column("key"), b.column("words"), pa.array(w)], ["part", "c", "pos", "key", "words", "w"])

    found = materialize(ranged.select(F.spark_partition_id().alias("part"), "c", "key", "words").mapInArrow(run, "part int, c long, pos long, key binary, words long, w long"), "turns")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("part", "c").agg((F.max("pos") + 1).alias("n"), F.max("w").alias("total"))
    # a range continues one conversation at most: as many rows as ranges
    carry = parts.select("part", "c", F.sum("n").over(before).alias("dn"), F.sum("total").over(before).alias("dw")).where("dn IS NOT NULL")
    found = found.join(F.broadcast(carry), ["part", "c"], "left")
    return found.select("c", (F.col("pos") + F.coalesce("dn", F.lit(0))).alias("pos"), "key", "words", (F.col("w") + F.coalesce("dw", F.lit(0))).alias("w"))


def word_sum(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s + t["words"])


def rebuilt(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(c, n, total; c, b, t): of every conversation its number of turns and of
    words, and its blocks of turns (pos, key, words, w).  Its first h turns are
    those of conversation c - c % 20, h being crc32(c) % 4; then come its own
    without their first h."""
    first = F.sort_array(F.collect_list(F.when(F.col("pos") < SHARED, F.struct("pos", "key", "words"))))
    heads = materialize(turns.groupBy("c").agg((F.max("pos") + 1).alias("n"), F.max("w").alias("total"), first.alias("first")), "heads")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    family = heads.select(F.col("c").alias("of"), F.col("first").alias("lead"))
    both = heads.withColumn("h", h).withColumn("of", F.col("c") - F.col("c") % FAMILY).join(family, "of", "left")
    lead = F.when(F.col("lead").isNull() | (F.col("h") == 0), F.expr("slice(first, 1, 0)")).otherwise(F.expr("slice(lead, 1, h)"))
    both = both.withColumn("lead", lead).withColumn("k", F.size("lead"))
    own = F.when(F.col("h") == 0, F.lit(0).cast("long")).otherwise(word_sum(F.expr("slice(first, 1, h)")))
    both = both.withColumn("shift", word_sum(F.col("lead")) - own)
    fixes = materialize(both.select("c", "h", "k", "shift", "lead", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"), (F.col("total") + F.col("shift")).alias("total")), "rebuilt")
    rest = turns.join(fixes.select("c", "h", "k", "shift"), "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "words", (F.col("w") + F.col("shift")).alias("w"))
    led = fixes.select("c", "lead", F.posexplode("lead").alias("pos", "x")).select("c", F.col("pos").cast("long").alias("pos"), "x.key", "x.words", word_sum(F.expr("slice(lead, 1, pos + 1)")).alias("w"))
    at = F.floor(F.col("pos") / block).cast("long")
    blocks = rest.union(led).groupBy("c", at.alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words", "w"))).alias("t"))
    blocks = materialize(blocks, "blocks")
    discard(heads)
    return fixes.select("c", "n", "total"), blocks


def sort_keys(convs: DataFrame, blocks: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(c, n, total, k0, k1, ...; the names of each level: name, arr)."""
    keyed = convs.join(blocks.where("b = 0").select("c", F.transform("t", lambda x: x["key"]).alias("k0")), "c", "left")
    keyed = keyed.withColumn("k0", F.coalesce("k0", F.array().cast("array<binary>")))
    left = (convs.agg(F.max("n")).first()[0] or 0) - block
    level, names = blocks.where("b > 0").select("c", (F.col("b") - 1).alias("j"), F.transform("t", lambda x: x["key"]).alias("arr")), []
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("j", "name"))), lambda x: x["name"])
    while left > 0:
        k = f"k{len(names) + 1}"
        names.append(materialize(level.select("arr").distinct().repartitionByRange("arr").sortWithinPartitions("arr").withColumn("name", F.monotonically_increasing_id()), "names"))
        named = level.join(names[-1], "arr").select("c", "j", "name")
        keyed = keyed.join(named.where(F.col("j") < block).groupBy("c").agg(in_order.alias(k)), "c", "left")
        keyed = keyed.withColumn(k, F.coalesce(k, F.array().cast("array<long>")))
        left = -(-left // block) - block
        level = named.where(F.col("j") >= block).withColumn("to", F.floor(F.col("j") / block).cast("long") - 1).groupBy("c", F.col("to")).agg(in_order.alias("arr")).withColumnRenamed("to", "j")
    return keyed, names


def shared_length(x, y) -> int:
    return next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def meet(x: tuple, y: tuple, block: int) -> tuple:
    """(LCP so far, level, name, name) of two keys; level 0: whole; -1: equal keys."""
    base, unit = 0, 1
    for q, (a, b) in enumerate(zip(x, y)):
        if a != b:
            j = shared_length(a, b)
            deeper = q > 0 and j < min(len(a), len(b))
            return base + j * unit, q if deeper else 0, a[j] if deeper else None, b[j] if deeper else None
        base += block * unit
        unit *= block
    return 0, -1, None, None


def neighbours(keyed: DataFrame, names: list[DataFrame], block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """In the order of the keys, a row for each run of equal conversations (of a
    batch): rank, c (the smallest id), cnt, ids, n, total, v (LCP with the row
    before, -1 for the first), same (equal to the row before), n_prev."""
    spark = keyed.sparkSession
    arrow_ready(spark)
    parts = [f"k{q}" for q in range(len(names) + 1)]
    ranged = keyed.repartitionByRange(*parts, "c").sortWithinPartitions(*parts, "c").withColumn("rank", F.monotonically_increasing_id())
    kinds = ", ".join(["k0 array<binary>", *(f"{k} array<long>" for k in parts[1:])])
    schema = f"rank long, c long, cnt long, ids string, n long, total long, v long, q int, x long, y long, n_prev long, edge int, {kinds}"
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        before, held = None, []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], fields)

        types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] + [pa.list_(pa.binary())] + [pa.list_(pa.int64())] * (len(parts) - 1)
        none = [None] * len(parts)
        for b in batches:
            cols = b.to_pydict()
            keys = list(zip(*(cols[k] for k in parts)))
            rows, ids = [], []
            for i, key in enumerate(keys):
                if i and key == before[0]:
                    ids.append(cols["c"][i])
                    continue
                if rows:
                    rows[-1][2:4] = len(ids), ",".join(map(str, ids))
                ids = [cols["c"][i]]
                v, q, x, y = meet(before[0], key, block) if before else (None, 0, None, None)
                n = cols["n"][i]
                rows.append([cols["rank"][i], ids[0], 0, "", n, cols["total"][i], n if q < 0 else v, q, x, y, before and before[1], 0 if before else 1, *(none if before else key)])
                before = key, n
            if rows:
                rows[-1][2:4] = len(ids), ",".join(map(str, ids))
                if held:
                    yield out(held)
                held = rows
        if held:  # the first and the last key of a range stay, for the neighbours across
            held[-1][11] += 2
            held[-1][12:] = before[0]
            yield out(held)

    found = materialize(ranged.mapInArrow(run, schema), "neighbours")
    edges = found.where("edge > 0").select("rank", "edge", "n", *parts).orderBy("rank").collect()
    fixed, last = [], None
    for r in edges:
        key = tuple(r[k] for k in parts)
        if r["edge"] & 1:
            v, q, x, y = meet(last[0], key, block) if last else (-1, 0, None, None)
            fixed.append((r["rank"], r["n"] if q < 0 else v, q, x, y, last[1] if last else None))
        if r["edge"] & 2:
            last = key, r["n"]
    fixed = spark.createDataFrame(fixed, "rank long, v2 long, q2 int, x2 long, y2 long, n_prev2 long")
    rows = found.drop("edge", "ids", *parts).join(F.broadcast(fixed), "rank", "left")  # one row for each range
    pick = lambda a: F.when(F.col("v2").isNotNull(), F.col(a + "2")).otherwise(F.col(a)).alias(a)
    rows = rows.select("rank", "c", "cnt", "n", "total", *map(pick, ("v", "q", "x", "y", "n_prev")))
    if names:
        deep = rows.where("q > 0").select("rank", "q", "v", "x", "y")
        for q in range(len(names), 0, -1):
            arr = names[q - 1]
            here = deep.where(F.col("q") == q).join(arr.select(F.col("name").alias("x"), F.col("arr").alias("ax")), "x").join(arr.select(F.col("name").alias("y"), F.col("arr").alias("ay")), "y")
            m = F.least(F.size("ax"), F.size("ay"))
            here = here.withColumn("m", m).withColumn("at", F.array_position(F.zip_with(F.expr("slice(ax, 1, m)"), F.expr("slice(ay, 1, m)"), lambda a, b: a == b), F.lit(False)))
            here = here.withColumn("j", F.when(F.col("at") == 0, F.col("m")).otherwise(F.col("at") - 1).cast("long"))
            inside = (F.col("at") > 0) & F.lit(q > 1)
            name = lambda a: F.when(inside, F.get(F.col(a), F.col("j").cast("int"))).cast("long") if q > 1 else F.lit(None).cast("long")  # noqa: E731, B023
            here = here.select("rank", F.when(inside, F.lit(q - 1)).otherwise(0).alias("q"), (F.col("v") + F.col("j") * F.lit(block ** (q - 1))).alias("v"), name("ax").alias("x"), name("ay").alias("y"))
            deep = deep.where(F.col("q") != q).unionByName(here)
        rows = rows.drop("x", "y").join(deep.select("rank", F.col("v").alias("deep")), "rank", "left").withColumn("v", F.coalesce("deep", "v")).drop("deep")
    return rows.select("rank", "c", "cnt", "n", "total", "v", (F.col("q") < 0).alias("same"), "n_prev"), found.select("rank", "ids")


def smaller(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller values to the left and to the right, or -1."""
    left, right, stack = np.full(len(v), -1), np.full(len(v), -1), []
    for i, x in enumerate(v.tolist()):
        while stack and stack[-1][1] > x:
            right[stack.pop()[0]] = i
        left[i] = stack[-1][0] if stack and stack[-1][1] < x else left[stack[-1][0]] if stack else -1
        stack.append((i, x))
    return left, right


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) of each (lo, hi), hi over lo."""
    levels = [x]
    while 2 << len(levels) <= 2 * len(x):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][: len(levels[-1]) - half], levels[-1][half:]))
    out = np.empty(len(lo), x.dtype)
    width = np.log2(hi - lo).astype(int)
    for k in np.unique(width):
        at = np.flatnonzero(width == k)
        out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k)])
    return out


class Groups:
    """One line for each group of places: minima and prefix sums."""

    SUMS = ("cnt", "cw", "u", "g")

    def __init__(self, rows):
        col = lambda k: np.array([r[k] for r in rows], np.int64)
        self.group, self.low, self.v0, self.rank0, self.id = map(col, ("grp", "low", "v0", "rank0", "least"))
        self.before = {k: np.concatenate(([0], np.cumsum(col(k)))) for k in self.SUMS}

    def at(self, group: int) -> int:
        return int(np.searchsorted(self.group, group))

    def follows(self, k: int) -> tuple[int, int | None]:
        """(LCP, rank) of the first place after group number ``k``."""
        return (int(self.v0[k + 1]), int(self.rank0[k + 1])) if k + 1 < len(self.group) else (-1, None)

    def to_left(self, k: int, v: np.ndarray) -> np.ndarray:
        """Number of the last group before ``k`` with a value under each of ``v``."""
        low = np.minimum.accumulate(self.low[:k][::-1])  # falls
        return k - 1 - np.searchsorted(-low, -v, "right")

    def to_right(self, k: int, v: np.ndarray) -> np.ndarray:
        """Number of the first group after ``k``; the number of groups if there is none."""
        low = np.minimum.accumulate(self.low[k + 1 :])
        return k + 1 + np.searchsorted(-low, -v, "right")

    def least(self, lo: int, hi: int) -> int:
        return int(self.id[lo:hi].min(initial=NO_ID))


SIDE = ("rank", "v", "n", "cnt", "cw", "u", "g", "wl")


def sides(t: dict[str, np.ndarray], groups: Groups, k: int) -> dict[str, np.ndarray]:
    """What an interval needs to know of the place that bounds it: sums before
    the place (of ``g``: up to and with it)."""
    out = {x: t[x] for x in ("rank", "v", "n", "wl")}
    for name in Groups.SUMS:
        out[name] = groups.before[name][k] + np.cumsum(t[name]) - (0 if name == "g" else t[name])
    return out


def read_group(table: pa.Table) -> dict[str, np.ndarray]:
    t = {x: table.column(x).to_numpy() for x in ("rank", "c", "cnt", "cw", "u", "g", "n", "total", "v", "wl")}
    t["same"] = table.column("same").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(t["rank"])
    return {x: y[order] for x, y in t.items()}


def places(rows: DataFrame, groups: Groups) -> DataFrame:
    """Of each place its interval, as far as its group can tell: l_*, r_* (null:
    beyond the group), least (the smallest id in the group's part), and what
    follows it (next_v, next_rank)."""

    def run(table: pa.Table) -> pa.Table:
        t = read_group(table)
        m, k = len(t["rank"]), groups.at(table.column("grp")[0].as_py())
        left, right = smaller(t["v"])
        own = sides(t, groups, k)
        end = groups.to_right(k, t["v"]) == len(groups.group)
        end &= right < 0
        least = range_min(t["c"], np.maximum(left, 0), np.where(right < 0, m, right))
        if end.any():
            least = np.where(end, np.minimum(least, groups.least(k + 1, len(groups.group))), least)
        cols = {x: t[x] for x in ("rank", "v", "n", "cnt", "total", "c")} | {"same": t["same"], "least": least, "end": end}
        for x in SIDE:
            cols["l_" + x] = pa.array(own[x][left], mask=left < 0)
            at_end = -1 if x == "v" else int(groups.before[x][-1]) + (x == "g") if x in Groups.SUMS else 0
            cols["r_" + x] = pa.array(np.where(end, at_end, own[x][right]), mask=(right < 0) & (~end | (x == "rank")))
        v, rank = groups.follows(k)
        cols["next_v"] = np.append(t["v"][1:], v)
        cols["next_rank"] = pa.array([*t["rank"][1:].tolist(), rank], pa.int64())
        cols["grp"] = np.full(m, groups.group[k])
        return pa.table({x: pa.array(y) for x, y in cols.items()})

    longs = ["rank", "v", "n", "cnt", "total", "c"], ["least"], ["end"], [f"{s}_{x}" for x in SIDE for s in "lr"], ["next_v", "next_rank", "grp"]
    schema = ", ".join([*(f"{x} long" for x in longs[0]), "same boolean", "least long", "end boolean", *(f"{x} long" for x in longs[3]), *(f"{x} long" for x in longs[4])])
    return rows.groupBy("grp").applyInArrow(run, schema)


def questions(rows: DataFrame, groups: Groups) -> DataFrame:
    """What groups ask of each other, and what answers it, materialised.

    asks: for a value that no place of ``src`` on that side is smaller than, the
    group ``grp`` that has one, and the smallest id of the groups between.
    Else: a strict minimum of ``grp`` from its edge; it answers the values over
    ``val`` up to ``upper``, with the smallest id from the edge to it."""

    def run(table: pa.Table) -> pa.Table:
        t = read_group(table)
        k, own = groups.at(table.column("grp")[0].as_py()), None
        own = sides(t, groups, k)
        out = {x: [] for x in ("asks", "side", "src", "grp", "val", "upper", "least", *SIDE)}

        def add(**row):
            for x in out:
                out[x].append(row.get(x))

        for side in "lr":
            step = 1 if side == "l" else -1
            v, c = t["v"][::step], t["c"][::step]
            low = np.minimum.accumulate(v)
            open_ = np.unique(low[v == low])  # no smaller value between the place and the edge
            open_ = open_[open_ >= 0]
            target = groups.to_left(k, open_) if side == "l" else groups.to_right(k, open_)
            for x, to in zip(open_.tolist(), target.tolist()):
                if 0 <= to < len(groups.group):
                    lo, hi = sorted((k, to))
                    add(asks=True, side=side, src=int(groups.group[k]), grp=int(groups.group[to]), val=x, least=groups.least(lo + 1, hi))
            # answers stand on the other edge: asked from the right, the last smaller value
            v, c = t["v"][::-step], t["c"][::-step]
            strict = np.flatnonzero(np.append(True, v[1:] < np.minimum.accumulate(v)[:-1]))
            ids, upper = np.minimum.accumulate(c), NO_ID
            for i in strict.tolist():
                place = len(v) - 1 - i if side == "l" else i
                least = int(ids[i]) if side == "l" else int(ids[i - 1]) if i else NO_ID
                add(asks=False, side=side, grp=int(groups.group[k]), val=int(v[i]), upper=upper, least=least, **{x: int(own[x][place]) for x in SIDE})
                upper = int(v[i])
        return pa.table({x: pa.array(y, pa.bool_() if x == "asks" else pa.string() if x == "side" else pa.int64()) for x, y in out.items()})

    schema = ", ".join(["asks boolean", "side string", *(f"{x} long" for x in ("src", "grp", "val", "upper", "least", *SIDE))])
    return materialize(rows.groupBy("grp").applyInArrow(run, schema), "questions")


def intervals(rows: DataFrame, group: int = GROUP) -> DataFrame | None:
    """``places`` with every interval whole, materialised; None for no rows.
    ``rows``: rank, c, cnt, n, total, v, same, n_prev, wl (words up to the LCP)."""
    rows = rows.withColumns({"grp": F.floor(F.col("rank") / group).cast("long"), "cw": F.col("cnt") * F.col("total"), "u": F.col("total") - F.col("wl"), "g": F.coalesce((F.col("v") < F.col("n_prev")).cast("long"), F.lit(0).cast("long"))})
    rows = materialize(rows, "places")
    lines = rows.groupBy("grp").agg(F.min("v").alias("low"), F.min_by("v", "rank").alias("v0"), F.min("rank").alias("rank0"), F.min("c").alias("least"), *[F.sum(x).alias(x) for x in Groups.SUMS]).orderBy("grp").collect()
    if not lines:
        return None
    groups = Groups(lines)
    out, asked = places(rows, groups), questions(rows, groups)
    if len(lines) > 1:
        a, q = asked.where("NOT asks").drop("asks", "src").alias("a"), asked.where("asks").alias("q")
        meets = (F.col("a.side") == F.col("q.side")) & (F.col("a.grp") == F.col("q.grp")) & (F.col("a.val") < F.col("q.val")) & (F.col("q.val") <= F.col("a.upper"))
        answers = materialize(q.join(a, meets).select("q.side", F.col("q.src").alias("grp"), F.col("q.val").alias("v"), F.least("q.least", "a.least").alias("least"), *[F.col(f"a.{x}").alias("at_" + x) for x in SIDE]), "answers")
        for side in "lr":
            mine = answers.where(F.col("side") == side).select("grp", "v", F.col("least").alias("more"), *["at_" + x for x in SIDE])
            out = out.join(mine, ["grp", "v"], "left")
            is_open = F.col(f"{side}_v").isNull()
            out = out.withColumn("least", F.when(is_open, F.least("least", F.coalesce("more", F.lit(NO_ID)))).otherwise(F.col("least")))
            new = {f"{side}_{x}": F.when(is_open, F.col(f"at_{x}")).otherwise(F.col(f"{side}_{x}")) for x in SIDE}
            out = out.withColumns(new).drop("more", *["at_" + x for x in SIDE])
    return materialize(out, "intervals")


def tree(found: DataFrame) -> DataFrame:
    """The nodes that branch or end: conv, depth, up (the parent's depth, -1 for
    the top), parent (its smallest id), n_convs, leaves, children, cw, used
    (sums for the tokens), leader (rank of the conversations that end here)."""
    one = [F.max(x).alias(x) for x in ("least", *(f"{s}_{x}" for x in SIDE for s in "lr") ) if x != "l_rank"]
    inner = found.where("v >= 0").groupBy("l_rank", "v").agg(F.count_if(~F.col("same")).alias("k"), *one)
    ends = F.col("l_n") == F.col("v")
    up = F.greatest("l_v", "r_v")
    inner = inner.select(
        F.col("least").alias("conv"), F.col("v").alias("depth"), up.alias("up"),
        F.when(up < 0, None).when(F.col("l_v") >= F.col("r_v"), F.col("l_rank")).otherwise(F.col("r_rank")).alias("place"),
        (F.col("r_cnt") - F.col("l_cnt")).alias("n_convs"), (F.col("r_g") - F.col("l_g")).alias("leaves"),
        (F.col("k") + F.when(ends, 0).otherwise(1)).alias("children"), (F.col("r_cw") - F.col("l_cw")).alias("cw"),
        (F.col("r_u") - F.col("l_u") + F.col("l_wl")).alias("used"), F.when(ends, F.col("l_rank")).alias("leader"),
    )
    up = F.greatest("v", "next_v")
    tips = found.where("v < n AND next_v < n").select(
        F.col("c").alias("conv"), F.col("n").alias("depth"), up.alias("up"),
        F.when(up < 0, None).when(F.col("v") >= F.col("next_v"), F.col("rank")).otherwise(F.col("next_rank")).alias("place"),
        F.col("cnt").alias("n_convs"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("children"),
        (F.col("cnt") * F.col("total")).alias("cw"), F.col("total").alias("used"), F.col("rank").alias("leader"),
    )
    return inner.union(tips).join(found.select(F.col("rank").alias("place"), F.col("least").alias("parent")), "place", "left")


def ends_digests(found: DataFrame, ids: DataFrame) -> DataFrame:
    """leader, ends: SHA-256 of the comma-joined ids of equal conversations.  A
    group in several rows is hashed in order, row by row."""
    same = found.where("same").select(F.col("l_rank").alias("leader"), "rank")
    many = same.union(same.select("leader", F.col("leader").alias("rank")).distinct())
    arrow_ready(found.sparkSession)

    def run(batches):
        at, digest = None, None
        for b in batches:
            leaders, texts = [], []
            for leader, text in zip(b.column("leader").to_pylist(), b.column("ids").to_pylist()):
                if leader == at:
                    digest.update(b"," + text.encode())
                    continue
                if at is not None:
                    leaders.append(at)
                    texts.append(digest.hexdigest())
                at, digest = leader, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(leaders, pa.int64()), pa.array(texts, pa.string())], ["leader", "whole"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], ["leader", "whole"])

    whole = many.join(ids, "rank").repartition("leader").sortWithinPartitions("leader", "rank").select("leader", "ids").mapInArrow(run, "leader long, whole string")
    return ids.select(F.col("rank").alias("leader"), F.sha2("ids", 256).alias("ends")).join(whole, "leader", "left").select("leader", F.coalesce("whole", "ends").alias("ends"))


def expand(nodes: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each depth that a node stands for."""
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    nodes = nodes.withColumn("since", F.greatest("up", F.lit(0)))
    spans = nodes.where("depth > since").withColumn("b", F.explode(F.sequence(F.floor(F.col("since") / block), F.floor((F.col("depth") - 1) / block))))
    turns = spans.join(blocks.withColumnRenamed("c", "conv"), ["conv", "b"]).withColumn("x", F.explode(F.filter("t", lambda x: (x["pos"] >= F.col("since")) & (x["pos"] < F.col("depth")))))
    root = nodes.where("up < 0").withColumns({"d": F.lit(0).cast("long"), "w": F.lit(0).cast("long")})
    turns = turns.withColumns({"d": F.col("x.pos") + 1, "w": F.col("x.w") - F.col("x.words")}).select(*root.columns)
    last = F.col("d") == F.col("depth")
    return turns.union(root).select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == 0, None).when(F.col("d") == F.col("up") + 1, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("cw") - F.col("n_convs") * F.col("w") - F.col("used") + F.col("w")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", empty)).otherwise(empty).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The trie's nodes over the rebuilt conversations (see the module)."""
    spark = conversations.sparkSession
    convs, blocks = rebuilt(positioned(slim_turns(conversations)), block)
    keyed, names = sort_keys(convs, blocks, block)
    rows, ids = neighbours(keyed, names, block)
    # words up to the LCP, from the block that holds its last turn
    rows = rows.withColumn("b", F.when(F.col("v") > 0, F.floor((F.col("v") - 1) / block).cast("long"))).join(blocks, ["c", "b"], "left")
    rows = rows.withColumn("wl", F.coalesce(F.expr(f"get(t, cast((v - 1) % {block} AS int)).w"), F.lit(0).cast("long"))).drop("t", "b")
    found = intervals(rows, group)
    if found is None:
        return spark.createDataFrame([], NODE)
    nodes = tree(found)
    ending = nodes.where("leader IS NOT NULL").join(ends_digests(found, ids), "leader")
    nodes = ending.unionByName(nodes.where("leader IS NULL").withColumn("ends", F.lit(None).cast("string")))
    return expand(nodes, blocks, block)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


CRC32 = """
  list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, x: list_reduce([xor(s, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda t, y: xor(t >> 1, 3988292384 * (t & 1))))
"""
ORACLE = rf"""
WITH src AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) - 1 AS pos FROM src
), convs AS (
  SELECT c, n, CAST(xor({CRC32}, 4294967295) % 4 AS BIGINT) AS h, c - c % 20 AS of FROM (SELECT c, count(*) AS n FROM own GROUP BY c)
), shifts AS (
  SELECT a.c, a.h, a.of, least(a.h, coalesce(b.n, 0)) AS k FROM convs a LEFT JOIN convs b ON b.c = a.of
), turns AS (
  SELECT s.c, o.pos, o.role, o.text FROM shifts s JOIN own o ON o.c = s.of WHERE o.pos < s.h
  UNION ALL
  SELECT s.c, o.pos - s.h + s.k, o.role, o.text FROM shifts s JOIN own o ON o.c = s.c WHERE o.pos >= s.h
), paths AS (
  SELECT c, pos + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY pos) AS path FROM turns
  UNION ALL
  SELECT c, 0, 0, [] FROM convs
), members AS (
  SELECT c, depth, words, min(c) OVER w AS conv_id, count(*) OVER w AS n_convs, max(depth) OVER (PARTITION BY c) AS n
  FROM paths WINDOW w AS (PARTITION BY depth, path)
), nodes AS (
  SELECT m.conv_id, m.depth, m.words, m.n_convs, p.conv_id AS parent
  FROM members m LEFT JOIN members p ON p.c = m.c AND p.depth = m.depth - 1 WHERE m.c = m.conv_id
), counted AS (
  SELECT n.*, coalesce(k.children, 0) AS children FROM nodes n
  LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY ALL) k
  ON k.parent = n.conv_id AND k.depth = n.depth
), sums AS (
  SELECT m.conv_id, m.depth, sum((x.n_convs - 1) * x.words) AS saved, count(*) FILTER (x.children = 0) AS leaves
  FROM counted x JOIN members m ON m.c = x.conv_id AND m.depth <= x.depth GROUP BY ALL
), ends AS (
  SELECT conv_id, depth, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM members WHERE depth = n GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent AS parent_conv_id, n.n_convs, n.children AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted n JOIN sums s ON s.conv_id = n.conv_id AND s.depth = n.depth LEFT JOIN ends e ON e.conv_id = n.conv_id AND e.depth = n.depth
"""
