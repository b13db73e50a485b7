"""SimHash near-duplicates by the generalised pigeonhole principle.

*Fingerprints.*  A-Z is lowered, words are runs of bytes other than 0x20 and
0x09-0x0D, shingles are ``words`` consecutive words joined by a space, repeats
included; a bit is 1 if set in over half of the shingles' XXH64 (seed 42).

*Plan.*  Over all distinct fingerprints the bit frequencies and correlations
are counted.  For each number of partitions m the bits are grouped so that
correlated bits share a partition, and a dynamic program gives partition i a
threshold T_i >= -1 with sum(T_i) = radius - m + 1 at the least estimated cost
(rows made plus candidate pairs checked).  Two fingerprints within the radius
are within T_i in some partition, so nothing is lost, whatever the estimates.

*Probe.*  A fingerprint is indexed under its value in each partition with
T_i >= 0 and probes the values at 1 to T_i flips that are larger than its own
(the partner finds the other half).  Rows meet by (partition, value); a value
with many rows is cut into blocks and each pair of blocks is one unit of work.
A worker checks pairs as bit operations on arrays and emits, for each batch,
only a spanning forest of the links it verified: never the pairs of a group.

*Near-duplicate removal* links texts that are alike in nine words of ten, as
their sets of five-word shingles tell: with J the sets' Jaccard index, the share
of like words is 1 + ln(2 J / (1 + J)) / 5 (an edited word breaks five shingles,
so the share of shared ones falls with its fifth power).  A likeness of 0.9 is a
share 2 |A and B| / (|A| + |B|) of exp(-0.5) = 0.607, a Jaccard index of 0.435.

1. Equal sets are one node, with a SimHash of 512 bits over the set.  Nodes
   whose first 64 bits are within the radius find each other by the plan and the
   probe above.
2. Pairs of that similarity can be far beyond any radius that can be probed
   (on average 150 of the 512 bits, at the limit), so for those there is an exact
   way.  All shingles are put in one order, those found often in a sample last.
   Two sets that similar share one of the first n - ceil(J n) + 1 shingles of
   either (n: its size), so nodes meet by these and nothing is lost, whatever the
   sample says.
3. Nodes that meet so are sieved by SimHash: 512 bits over the set, sizes within
   the ratio the similarity allows, and at most as many differing bits as a
   similar pair has on average plus six standard deviations (the average is
   exact for the size; fewer than one similar pair in 10**8 is beyond it).
   All that meet at a shingle are compared with one of them, and those that do
   not pass with all others; what passes makes a spanning forest, which says
   what may belong together, and no more.
4. Inside each group that arises every pair of sets is compared exactly, block
   by block, and only verified links make components.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; fewer words than a shingle make one shingle; texts are read
whole, at any length; a row with a null id links others like any row, and the
component of rows with null ids only is null; repeated rows are one
fingerprint; an empty table gives no rows; extra columns are ignored by the
operator and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, arrow_ready, discard, materialize, mix, table, text_buffer
from .graph import components, stars

SEED, WORDS, RADIUS = 42, 3, 3
#: Near-duplicate removal: shingles of five words, nine words of ten alike; and
#: that as the share of shingles, 2 |A and B| / (|A| + |B|).
SET_WORDS, LIKENESS = 5, 0.9
SIMILARITY = math.exp((LIKENESS - 1) * SET_WORDS)
#: Bits of the sieve (64 for each salt), and its slack in standard deviations.
SALTS = np.arange(8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
BITS, SIGMAS = 64 * len(SALTS), 6.0
#: Texts sampled for the order of the shingles, and shingles it puts last; they
#: set the cost, never the result.
SAMPLE_TEXTS, COMMON = 4_000, 100_000
#: Fingerprints sampled for the plan of partitions (its cost, not the result).
SAMPLE_PRINTS = 4_000
#: Sets that a task remembers, so as to send them once; sets the cost only.
REMEMBERED = 1 << 17
#: Shingles that a task packs at once; buckets they are dealt to, and bytes of
#: text for one; shingles of a bucket held at once; ids in a list of rows that meet.
PACKED, LEAST_BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 1 << 21, 1 << 10, 1 << 16, 1 << 24
HELD, LIST_ROWS = 1 << 23, 1 << 12
#: Bits of the filter of ids that spares other rows a shuffle: for each id, and at most.
ID_BITS, MOST_BITS = 16, 1 << 24
#: Rows of one value that a worker holds at once, per side.
BLOCK_ROWS = 2048
#: Sets, and their shingles, of one block that is compared exactly.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 18
#: Cost of a row that is shuffled and of a pair that is checked, in ns.
ROW_NS, PAIR_NS = 2500.0, 8.0


def bit_majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of an (n, k) uint64 array, packed."""
    raw = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1)
    count = np.zeros(raw.shape[1] * 8, np.int64)
    for i in range(0, len(raw), 255):  # sums of at most 255 fit a byte
        count += np.unpackbits(raw[i : i + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(count * 2 > len(raw), bitorder="little").view("<u8")


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    own = text.lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    k = min(words, len(own))
    starts = [0, *(ends[: len(own) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist())), "<u8", len(starts))
    return int(bit_majority(h[:, None])[0])


def shingle_set(text: bytes, words: int = SET_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(own), np.uint8)
    w = Words(raw, np.array([0, len(raw)], np.int64))
    k = min(words, len(own))
    return np.unique(w.hashes(w.starts[: len(own) - k + 1], w.ends[k - 1 :]))


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits by which equal sets are known, as two signed numbers."""
    return struct.unpack("<2q", xxhash.xxh3_128_digest(np.ascontiguousarray(shingles, "<u8").tobytes()))


def add_fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fp (long)."""
    arrow_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fps)], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, fp long")


def common_shingles(docs: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several of the sampled texts (sorted), and how often."""
    every = max(1, docs.count() // SAMPLE_TEXTS)
    sample = shingles(docs.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0), key)
    rows = sample.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "g").limit(COMMON).collect()
    h, n = np.array([r["g"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def rare_prefix(h: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which a set shares one with every set as similar: it has
    similarity / (2 - similarity) of its own in common with the smallest such."""
    known, times = common
    n = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        n = np.where(known[at] == h, times[at], 0)
    return h[np.lexsort((h, n))[: len(h) - math.ceil(similarity / (2 - similarity) * len(h) - 1e-9) + 1]]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The ``BITS`` majority bits of a set, 64 for each salt."""
    if not len(shingles):
        return np.zeros(len(SALTS), np.uint64)
    return bit_majority(mix(shingles[:, None] ^ SALTS[None]))


def differing_share(a: int, b: int, shared: int) -> float:
    """Probability that a majority bit differs between sets of ``a`` and ``b``
    members with ``shared`` in common, for random hashes: exact."""
    binomial = lambda n: np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n
    over = lambda own, n: np.array([binomial(own)[max(0, n // 2 - s + 1) :].sum() for s in range(shared + 1)])
    p, q = over(a - shared, a), over(b - shared, b)
    return float((binomial(shared) * (p * (1 - q) + q * (1 - p))).sum())


def bit_limits(similarity: float = SIMILARITY, most: int = 64) -> np.ndarray:
    """For the smaller set's size (the last entry: and all above) the most bits
    that the sketches of a similar pair differ in, but for ``SIGMAS``."""
    limits = [BITS]
    for a in range(1, most + 1):
        sizes = range(a, math.floor(a * (2 - similarity) / similarity + 1e-9) + 1)
        p = min(0.5, max(differing_share(a, b, math.ceil(similarity * (a + b) / 2 - 1e-9)) for b in sizes))
        limits.append(min(BITS, math.floor(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))))
    return np.maximum.accumulate(np.array(limits[::-1]))[::-1]  # a larger set never has a wider limit


def shingle_names(docs: DataFrame, key: str) -> DataFrame:
    """key, h0, h1 (a hash of the shingle set), n_set (its size) and sketch of each row."""
    arrow_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            raw = data.tobytes()
            sets = [shingle_set(raw[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)]
            names = np.array([set_name(x) for x in sets], np.int64).reshape(-1, 2)
            size = np.array([len(x) for x in sets], np.int32)
            bits = np.concatenate([np.zeros(0, np.uint64), *map(sketch, sets)]).view(np.int64)
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * len(SALTS))
            cols = [b.column(key), *(pa.array(np.ascontiguousarray(x)) for x in names.T), pa.array(size), pa.ListArray.from_arrays(ends, pa.array(bits))]
            yield pa.RecordBatch.from_arrays(cols, [key, "h0", "h1", "n_set", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, h0 long, h1 long, n_set int, sketch array<long>")


def chosen_shingles(batches, key: str, choose, once: bool):
    """Of each Arrow batch the shingles that ``choose`` leaves of its rows' sets,
    and the ``key`` of each.  With ``once`` a task sends a set that it remembers
    no more, so a text with very many copies sends its shingles a few times for
    each task."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        data, offs = text_buffer(b.column("text"))
        raw = data.tobytes()
        sets = []
        for i in range(len(offs) - 1):
            own = shingle_set(raw[offs[i] : offs[i + 1]])
            name = set_name(own) if once else None
            if name in seen:
                own = own[:0]
            elif once:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
            sets.append(choose(own))
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        yield np.concatenate([np.zeros(0, np.uint64), *sets]), b.column(key).take(pa.array(row))


def shingles(docs: DataFrame, key: str, choose=lambda h: h) -> DataFrame:
    """g, key: the shingles that ``choose`` leaves of each row's set."""
    arrow_ready(docs.sparkSession)

    def run(batches):
        for g, ids in chosen_shingles(batches, key, choose, False):
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), ids], ["g", key])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"g long, {key} {kind}")


def pack(g: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """bucket, g, ids: shingles and their rows' ids, a row for each bucket.  The
    bucket and 32 bits tell the shingle; the ids are ascending, as differences,
    the bytes of equal weight side by side, so what compresses stands together."""
    by = np.argsort(ids, kind="stable")
    by = by[np.argsort((g[by] >> np.uint64(32)) % np.uint64(buckets), kind="stable")]
    g, ids = g[by], ids[by]
    bucket = ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    low = g.astype("<u4")
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(g) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(g))
    planes = lambda x: np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    cols = [pa.array(bucket[cut]), pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([planes(ids[a:b]) for a, b in zip(cut, ends)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "g", "ids"])


def unpack(g: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(8, -1).T).view("<i8")[:, 0]
    return np.frombuffer(g, "<u4"), np.cumsum(steps, dtype=np.int64)


def met_rows(bucket: int, g: np.ndarray, ids: np.ndarray, known: np.ndarray | None, flush: int, length: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """x1, x2, part, ids of each shingle of a bucket that several rows have, in
    lists of ``length``; the shingles told; which of the rows are told.

    x1 and x2 tell the rows (two sums of 64 bits, repeats included), so shingles
    that stand in the same rows have equal names.  Of a bucket that is told in
    several goes (``known``: the shingles told so far) they tell the shingle."""
    by = np.lexsort((ids, g))
    g, ids = g[by], ids[by]
    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(g)))
    met = (n > 1) if known is None else (n > 1) | np.isin(g[cut], known)
    told = np.repeat(met, n)
    shingle, rows, n = g[cut[met]], ids[told], n[met]
    first = np.cumsum(n) - n
    if known is None:
        x1, x2 = (np.add.reduceat(mix(mix(rows.view(np.uint64) + salt)), first) if len(n) else np.zeros(0, np.uint64) for salt in SALTS[1:3])
    else:
        x1, x2 = shingle.astype(np.uint64), np.full(len(n), bucket, np.uint64)
    lists = -(-n // length)
    part = np.arange(lists.sum()) - np.repeat(np.cumsum(lists) - lists, lists)
    offs = np.append(np.repeat(first, lists) + part * length, len(rows)).astype(np.int32)
    x1, x2 = (pa.array(np.repeat(x, lists).view(np.int64)) for x in (x1, x2))
    cols = [x1, x2, pa.array(part + (flush << 32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(rows))]
    left = np.zeros(len(by), bool)
    left[by] = told
    return pa.RecordBatch.from_arrays(cols, ["x1", "x2", "part", "ids"]), shingle, left


def met_groups(docs: DataFrame, key: str, choose, buckets: int, most: int = HELD, length: int = LIST_ROWS) -> DataFrame:
    """x1, x2, part, ids (``met_rows``) of the shingles, as ``choose`` leaves
    them, that several rows have.

    Shingles are shuffled packed, once.  A task holds one bucket at a time; when
    that has more than ``most`` shingles it tells those met so far, and holds of
    each other shingle the one row it has."""
    arrow_ready(docs.sparkSession)

    def send(batches):
        held, n = [], 0

        def packed():
            g, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pack(g, ids, buckets)

        for g, ids in chosen_shingles(batches, key, choose, True):
            held.append((g, ids.cast(pa.int64()).to_numpy(zero_copy_only=False)))
            n += len(g)
            if n >= PACKED:
                yield packed()
                n = 0
        if n:
            yield packed()

    def meet(batches):
        now, held, n, known, flush = None, [], 0, None, 0
        for b in batches:
            for bucket, g, ids in zip(b.column("bucket").to_pylist(), b.column("g"), b.column("ids")):
                if bucket != now:
                    if held:
                        yield met_rows(now, *map(np.concatenate, zip(*held)), known, flush, length)[0]
                    now, held, n, known, flush = bucket, [], 0, None, 0
                held.append(unpack(g.as_py(), ids.as_py()))
                n += len(held[-1][0])
                if n > most:
                    g, ids = map(np.concatenate, zip(*held))
                    known = np.zeros(0, np.uint32) if known is None else known
                    told, more, left = met_rows(now, g, ids, known, flush, length)
                    yield told
                    held, known, flush = [(g[~left], ids[~left])], np.union1d(known, more), flush + 1
                    n = 0  # as many again before the next look
        if held:
            yield met_rows(now, *map(np.concatenate, zip(*held)), known, flush, length)[0]

    sent = docs.select(key, "text").mapInArrow(send, "bucket int, g binary, ids binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "x1 long, x2 long, part long, ids array<long>")


def unit_links(rep: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as ``rep``) of the rows whose sets are similar to
    ``similarity`` or more: all pairs are compared, except those within side 1
    or within side 2 of a pair of blocks (side 0: all)."""
    n = np.array([len(x) for x in sets], np.int64)
    row, (_, at, times) = np.repeat(np.arange(len(sets)), n), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    row, at = row[often[at]], number[at[often[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    left, right = (np.flatnonzero(side < 2), np.flatnonzero(side != 1)) if side.any() else (np.arange(len(sets)),) * 2
    shared = np.zeros((len(left), len(right)), np.float32)  # whole numbers under 2**24
    width = max(64, (1 << 22) // len(sets))
    for lo in range(0, int(often.sum()), width):
        part = slice(*np.searchsorted(at, (lo, lo + width)))
        held = np.zeros((len(sets), min(width, int(often.sum()) - lo)), np.float32)
        held[row[part], at[part] - lo] = 1
        shared += held[left] @ held[right].T
    i, j = np.nonzero(2.0 * shared >= similarity * (n[left][:, None] + n[right][None, :]) - 1e-9)
    return stars(rep[left[i]], rep[right[j]])


def maybe_among(ids: DataFrame, key: str) -> Column:
    """False for rows whose ``key`` is not in ``ids``, true for all others but
    rows with no key: a filter of at most 2 MB, so that a join shuffles little
    else than what it keeps.  What it says of the others has to be checked."""
    n = ids.count()
    bits = min(MOST_BITS, max(1 << 12, 1 << (ID_BITS * n).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    words = ids.groupBy(F.floor(place / 63).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 63).cast("int"))).alias("w")).collect()
    flat = np.zeros(bits // 63 + 1, np.int64)
    flat[[r["at"] for r in words]] = [r["w"] for r in words]
    shared = ids.sparkSession.sparkContext.broadcast(flat)

    @F.pandas_udf("boolean")
    def among(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series((shared.value[x // 63] >> (x % 63) & 1).astype(bool))

    return among(F.coalesce(place, F.lit(0))) & F.col(key).isNotNull()


def exact_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, key: str, similarity: float) -> DataFrame:
    """(a, b): a forest over ``nodes`` (rep, h0, h1, n_set: one for each set)
    whose components are those of all pairs of a group of ``groups`` (node,
    component) with similar sets.  A group is cut into blocks by the class of
    the set's size (powers of the largest ratio of similar sets, so only
    neighbours can link) and by the hash of the set; each pair of blocks is a
    unit that holds its sets."""
    arrow_ready(docs.sparkSession)
    ends = groups.select(F.col("node").alias("rep"), "component").union(groups.select("component", "component")).distinct()
    step = math.log((2 - similarity) / similarity)
    members = nodes.join(ends, "rep").withColumn("cls", F.ceil(F.log(F.greatest(F.col("n_set"), F.lit(1))) / step + 1e-9).cast("int"))
    members = materialize(members.select("rep", "h0", "h1", "n_set", "component", "cls"), "members")
    per = members.groupBy("component", "cls").agg(F.greatest(F.ceil(F.sum("n_set") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"), F.sum("n_set").alias("size"), F.count("*").alias("n"))
    per = per.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("cls", "blocks"))).alias("blocks"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    members = members.join(per, "component")
    whole = (F.col("size") <= BLOCK_SHINGLES) & (F.col("n") <= BLOCK_SETS)
    of = lambda d: F.coalesce(F.try_element_at("blocks", F.col("cls") + d), F.lit(0))
    own = F.pmod(F.xxhash64("h0", "h1", "rep"), of(0)).cast("int")
    # the pair of blocks (class, number) in order, and on which side of it the row is; 0: within one block
    same = F.transform(F.sequence(F.lit(0), of(0) - 1), lambda o: F.struct(F.col("cls").alias("c"), F.least(own, o).alias("x"), F.col("cls").alias("d"), F.greatest(own, o).alias("y"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))
    up = F.transform(F.filter(F.sequence(F.lit(0), of(1)), lambda o: o < of(1)), lambda o: F.struct(F.col("cls").alias("c"), own.alias("x"), (F.col("cls") + 1).alias("d"), o.alias("y"), F.lit(1).alias("side")))
    down = F.transform(F.filter(F.sequence(F.lit(0), of(-1)), lambda o: o < of(-1)), lambda o: F.struct((F.col("cls") - 1).alias("c"), o.alias("x"), F.col("cls").alias("d"), own.alias("y"), F.lit(2).alias("side")))
    lone = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("x"), F.lit(0).alias("d"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    units = members.withColumn("at", F.explode(F.when(whole, lone).otherwise(F.concat(same, up, down))))
    units = units.select(F.col("rep").alias(key), "h0", "h1", F.xxhash64("component", "at.c", "at.x", "at.d", "at.y").alias("u"), F.col("at.side").alias("side"))
    # texts are sent, which take less room than their sets, and only those of members
    among = maybe_among(members.select(F.col("rep").alias(key)), key)
    rows = docs.select(key, "text").where(among).join(units, key).select("u", F.col(key).alias("rep"), "h0", "h1", "side", "text")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table):
            data, offs = text_buffer(t.column("text"))
            raw = data.tobytes()
            sets = [shingle_set(raw[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)]
            u, rep, side, *name = (t.column(x).to_numpy() for x in ("u", "rep", "side", "h0", "h1"))
            own = [i for i, x in enumerate(sets) if set_name(x) == (name[0][i], name[1][i])]  # an id may have other texts
            u, rep, side, sets = u[own], rep[own], side[own], [sets[i] for i in own]
            cut = np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u))
            found = [unit_links(rep[lo:hi], side[lo:hi], sets[lo:hi], similarity) for lo, hi in zip(cut, cut[1:]) if hi - lo > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in zip(*found)] if found else [pa.array([], pa.int64())] * 2, ["a", "b"])

        last = None
        for batch in batches:
            at = np.stack([batch.column(x).to_numpy() for x in ("u", "rep", "h0", "h1")], 1)
            new = np.append(last is None or (at[0] != last).any(), (at[1:] != at[:-1]).any(1)) if len(at) else np.zeros(0, bool)
            last = at[-1] if len(at) else last
            held.append(batch.filter(pa.array(new)))  # repeated rows count once
            if sum(x.nbytes for x in held) < 1 << 24:
                continue
            t = pa.Table.from_batches(held)
            u = t.column("u").to_numpy()
            cut = int(np.searchsorted(u, u[-1], "left"))  # the last unit may go on
            if cut:
                yield work(t.slice(0, cut).combine_chunks())
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("u").sortWithinPartitions("u", "rep", "h0", "h1").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- planning


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often bits i and j are both set, over all."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097), pa.int32()), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["at", "n"])

    got = dict(fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect())
    return got.get(4096, 0), np.array([got.get(i, 0) for i in range(4096)], float).reshape(64, 64)


@dataclass
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        return [sum(1 << b for b in c) for t in range(1, self.threshold + 1) for c in combinations(self.bits, t)]


def group_bits(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of nearly equal width; each grows by the bit most correlated with it."""
    q = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(q * (1 - q), 1e-9))
    like = np.abs(both / max(n, 1) - np.outer(q, q)) / np.outer(sd, sd)
    np.fill_diagonal(like, 0)
    left, groups = set(range(64)), []
    for i in range(m):
        width = len(left) // (m - i)
        group = [min(left, key=lambda b: (abs(q[b] - 0.5) < 0.5, -like[b][list(left)].sum(), b))]
        left.discard(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (like[b][group].sum(), -b)))
            left.discard(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def sample_prints(nodes: DataFrame, n: int, most: int = SAMPLE_PRINTS) -> np.ndarray:
    """About ``most`` fingerprints, at most twice as many, by a hash of them."""
    every = max(1, n // most)
    rows = nodes.where(F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(every)) == 0).select("fp").limit(2 * most).collect()
    return np.array([r["fp"] for r in rows], np.int64).view(np.uint64)


def within(sample: np.ndarray, mask: int, most: int) -> list[float]:
    """Share of pairs of fingerprints at most 0..most of the bits of ``mask``
    apart: counted over the pairs of values of a sample, with the share that
    random bits would have added as one more pair."""
    width = mask.bit_count()
    chance = np.cumsum([math.comb(width, t) for t in range(most + 1)]) / 2.0**width
    part, times = np.unique(sample & np.uint64(mask), return_counts=True)
    near = np.zeros(most + 1)
    for lo in range(0, len(part), 256):
        apart = np.bitwise_count(part[lo : lo + 256, None] ^ part[None])
        pairs = times[lo : lo + 256, None] * times[None]
        near += [pairs[apart <= t].sum() for t in range(most + 1)]
    own = len(sample)
    return ((near - own + chance) / (own * (own - 1) + 1)).tolist()


def plan(n: int, both: np.ndarray, radius: int, sample: np.ndarray, most: int = 2) -> list[Partition]:
    """Partitions and thresholds of the least estimated cost."""
    best: tuple[float, list[Partition]] = (math.inf, [])
    for m in range(1, radius + 2):
        groups = group_bits(n, both, m)
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in groups:
            near = within(sample, Partition(bits, 0).mask, most)
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (cost, chosen) in state.items():
                for t in range(-1, most + 1):
                    made = 0.0 if t < 0 else n * (1 + sum(math.comb(len(bits), k) for k in range(1, t + 1)) / 2) * ROW_NS
                    pairs = 0.0 if t < 0 else n * n / 2 * near[t] * PAIR_NS
                    c = cost + made + pairs
                    if s + t not in new or c < new[s + t][0]:
                        new[s + t] = (c, (*chosen, t))
            state = new
        if (radius - m + 1) in state and state[radius - m + 1][0] < best[0]:
            cost, chosen = state[radius - m + 1]
            best = (cost, [Partition(b, t) for b, t in zip(groups, chosen)])
    return [p for p in best[1] if p.threshold >= 0]


# ---------------------------------------------------------------- linking


def in_blocks(rows: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """``rows`` (g, ...) of values that more than one row has, as units of work:
    u, side, ``cols``.  A value with many rows is cut into blocks and each pair
    of blocks is one unit (side 1 and 2; 0: one block, or all)."""
    rows = rows.repartition("g")
    met = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(met, "g").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))  # dealt alike: no further shuffle
    rows = rows.withColumn("own", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    unit = F.when(F.col("blocks") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(unit.alias("u"), side.alias("side"), *cols)


def forest_of(units: DataFrame, passes) -> DataFrame:
    """(a, b): a spanning forest of the pairs of rows of one unit that pass.

    ``passes(c, i, j)`` says which pairs of row numbers of the columns ``c``
    link; it is asked for every pair of a unit, but those of one side of a pair
    of blocks and those already connected by way of one row.  A task reduces
    what it found to one forest.
    """
    arrow_ready(units.sparkSession)

    def run(batches):
        held: pa.Table | None = None
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def work(t: pa.Table):
            c = {x: _flat(t.column(x)) for x in t.column_names}
            more = group_links(c["u"], c, passes)
            return stars(np.concatenate((a, more[0])), np.concatenate((b, more[1])))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 1 << 15:
                continue
            u = held.column("u").to_numpy()
            cut = int(np.searchsorted(u, u[-1], "left"))  # the last unit may go on
            if cut:
                a, b = work(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
            if len(a) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
        if held is not None and held.num_rows:
            a, b = work(held.combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return units.repartition("u").sortWithinPartitions("u").mapInArrow(run, "a long, b long")


def _flat(col: pa.ChunkedArray) -> np.ndarray:
    """A column as numpy; of lists of equal length an array for each place."""
    if not pa.types.is_list(col.type):
        return col.to_numpy() if not pa.types.is_boolean(col.type) else col.to_numpy().astype(bool)
    flat = col.combine_chunks().flatten().to_numpy()
    return np.ascontiguousarray(flat.reshape(len(col), -1).T) if len(col) else flat.reshape(1, 0)


def group_links(g: np.ndarray, c: dict[str, np.ndarray], passes) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as ``rep``) of the passing pairs of rows with equal ``g`` (sorted)."""
    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    size = np.diff(np.append(cut, len(g)))
    held: list[tuple[np.ndarray, ...]] = []

    def reduce():
        cols = [np.concatenate(x) for x in zip(*held)]
        held[:] = [stars(*cols)]

    far = c.get("far", np.ones(len(g), bool))

    def keep(i, j, wanted=True):
        """Row numbers, or a column and a line of them for all their pairs; the rows that linked."""
        sides = c["side"][i] * c["side"][j]
        i, j, ok = np.broadcast_arrays(i, j, passes(c, i, j) & (sides != 1) & (sides != 4) & wanted)
        i, j = i[ok], j[ok]
        held.append((c["rep"][i], c["rep"][j]))
        if sum(len(x[0]) for x in held) > 1 << 19:
            reduce()
        return j

    few = size <= 48
    rest = np.repeat(np.where(few, size, 0), size) - np.concatenate([np.arange(s) for s in size]) if len(size) else size  # rows of the group from here on
    at = np.flatnonzero(rest > 1)
    d = 1
    while len(at):
        keep(at, at + d)
        d += 1
        at = at[rest[at] > d]
    for lo, n in zip(cut[~few], size[~few]):
        row = np.arange(lo, lo + n)
        # rows connected by way of one row, and of one that links to it, are not compared among themselves
        near = np.zeros(n, bool)
        at = lo + int(far[lo : lo + n].argmax())
        near[at - lo] = True
        first = keep(np.array([at]), row, row != at)
        near[first - lo] = True
        if len(first):
            near[keep(first[-1:], row, row != first[-1]) - lo] = True
        left = row[~near]
        step = max(1, (1 << 20) // n)
        for k in range(0, len(left), step):
            i = left[k : k + step, None]
            keep(i, row[None], near[None] | (i < row[None]))
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    reduce()
    return held[0]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): a forest over nodes whose components are those of all links.

    ``nodes`` has a row for each fingerprint: rep long, fp long.  It is read
    several times.
    """
    n, both = bit_counts(nodes)
    parts = plan(n, both, radius, sample_prints(nodes, n))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    cols = ["rep", "fp"]
    rows = None
    for k, p in enumerate(parts):
        own = nodes.withColumn("v", F.col("fp").bitwiseAND(F.lit(signed(p.mask))))
        made = own.select(*cols, F.col("v").alias("key"), F.lit(False).alias("probe"))
        if flips := p.flips():
            probe = own.withColumn("flip", F.explode(F.array(*[F.lit(signed(x)) for x in flips]))).withColumn("key", F.col("v").bitwiseXOR(F.col("flip")))
            made = made.union(probe.where("key > v").select(*cols, "key", F.lit(True)))
        made = made.withColumn("part", F.lit(k))
        rows = made if rows is None else rows.union(made)

    def passes(c, i, j):
        near = np.bitwise_count(c["fp"][i].view(np.uint64) ^ c["fp"][j].view(np.uint64)) <= radius
        return near & ~(c["probe"][i] & c["probe"][j])  # two probes find each other where one is indexed

    rows = rows.select(F.xxhash64("part", "key").alias("g"), "probe", *cols)
    return forest_of(in_blocks(rows, "rep", "probe", *cols), passes)


def simhash_components(docs: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (hex), component_id for every row."""
    rows = materialize(add_fingerprints(docs, key), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(key).alias("first")).withColumn("rep", F.col("fp")), "nodes")
    found = components(links(nodes, radius))
    of = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", "first", F.coalesce("component", "rep").alias("component"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(least, "component").select("fp", "component_id")
    return rows.join(of, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def meetings(docs: DataFrame, names: DataFrame, key: str, choose) -> DataFrame:
    """(g, rep): the nodes that have a prefix shingle in common with another.

    ``names`` says the node of each row.  Shingles that stand in the same rows
    count once, and only the rows of one of them are turned into nodes."""
    ided = docs.where(F.col(key).isNotNull())
    size = ided.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    met = met_groups(ided, key, choose, min(MOST_BUCKETS, max(LEAST_BUCKETS, size // BUCKET_BYTES)))
    once = met.dropDuplicates(["x1", "x2", "part"]).select(F.xxhash64("x1", "x2").alias("g"), F.explode("ids").alias(key))
    return materialize(once.join(names.select(key, "rep"), key).select("g", "rep").distinct(), "tokens")


def may_belong_together(nodes: DataFrame, tokens: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): a forest over ``nodes`` (rep, n_set, sketch) whose components hold
    every pair that shares a shingle of ``tokens`` (g, rep) and passes the sieve.

    The nodes of a shingle are compared with the smallest of them first, in
    expressions; those that pass are connected by way of it, so only the others
    are compared with all.
    """
    limits, ratio = bit_limits(similarity), (2 - similarity) / similarity

    def passes(c, i, j):
        n, bits = c["n_set"], c["sketch"].view(np.uint64)
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        off = sum(np.bitwise_count(bits[k][i] ^ bits[k][j]).astype(np.int16) for k in range(len(SALTS)))
        return (off <= limits[np.minimum(small, len(limits) - 1)]) & (small * ratio + 1e-9 >= large) & (c["far"][i] | c["far"][j])

    over = Window.partitionBy("g")
    shared = tokens.withColumns({"hub": F.min("rep").over(over), "last": F.max("rep").over(over)}).where("hub < last").drop("last")  # copies are one node
    hubs = nodes.select(F.col("rep").alias("hub"), F.col("n_set").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    rows = shared.join(nodes.select("rep", "n_set", "sketch"), "rep").join(hubs, "hub")
    small, large = F.least("n_set", "hub_n"), F.greatest("n_set", "hub_n")
    limit = F.element_at(F.array(*[F.lit(int(x)) for x in limits]), F.least(small, F.lit(len(limits) - 1)) + 1)
    off = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("hub_sketch")[k])) for k in range(len(SALTS))), F.lit(0))
    far = ~((off <= limit) & (small * F.lit(ratio) + 1e-9 >= large)) & (F.col("rep") != F.col("hub"))
    rows = materialize(rows.select("g", "rep", "hub", far.alias("far")), "shared")
    near = rows.where("NOT far AND rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    rest = forest_of(far_and_all(rows).join(nodes.select("rep", "n_set", "sketch"), "rep"), passes)  # sketches go only where they are compared
    found = materialize(near.union(rest), "groups")
    discard(rows)
    return found


def far_and_all(rows: DataFrame, *cols: str) -> DataFrame:
    """``rows`` (g, rep, far, ...) of values that have far rows, as units that
    bring each far row of a value together with every other row of it: u, side
    (1: two blocks of far rows, 2: the second of them, 0: else), rep, far."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("far").alias("n_far")).where("n_far > 0")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    rows = rows.join(sizes, "g").withColumns({"fb": blocks(F.col("n_far")), "nb": blocks(F.col("n") - F.col("n_far"))})
    whole = F.col("n") <= BLOCK_ROWS
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("far"), F.col("fb")).otherwise(F.greatest("nb", F.lit(1)))).cast("int")
    rows = rows.withColumn("own", own)
    pair = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    o = F.col("own")
    with_far = F.transform(upto(F.col("fb")), lambda k: pair(0, F.least(o, k), F.greatest(o, k), F.when(o == k, 0).when(o < k, 1).otherwise(2)))
    with_near = F.transform(upto(F.col("nb")), lambda k: pair(1, o, k, F.lit(1)))
    to_far = F.transform(upto(F.col("fb")), lambda k: pair(1, k, o, F.lit(2)))
    at = F.when(whole, F.array(pair(2, F.lit(0), F.lit(0), F.lit(0)))).when(F.col("far"), F.concat(with_far, with_near)).otherwise(to_far)
    rows = rows.withColumn("at", F.explode(at))
    return rows.select(F.xxhash64("g", "at.kind", "at.x", "at.y").alias("u"), F.col("at.side").alias("side"), "rep", "far", *cols)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that have a near copy with a smaller id.

    Texts link if their five-word shingle sets share ``similarity`` of their
    members or more; of each component the row with the smallest id stays.  Of rows with
    equal ids and equal texts one stays; an id that stands for several texts
    stays for all of them if it stays for one; rows with null ids are kept.
    """
    common = common_shingles(docs, key)
    rows = materialize(shingle_names(docs, key), "sets")
    # equal sets are one node, no others
    one = F.first(F.struct("n_set", "sketch")).alias("s")
    nodes = materialize(rows.groupBy("h0", "h1").agg(F.min(key).alias("rep"), one).where("rep IS NOT NULL").select("rep", "h0", "h1", "s.*"), "nodes")
    names = rows.select(key, "h0", "h1").join(nodes.select("rep", "h0", "h1"), ["h0", "h1"])
    alike = links(nodes.select("rep", F.col("sketch")[0].alias("fp")), RADIUS)
    tokens = meetings(docs, names, key, lambda h: rare_prefix(h, similarity, common))
    groups = components(alike.union(may_belong_together(nodes, tokens, similarity)))
    discard(rows, tokens)
    found = components(exact_links(docs, nodes.drop("sketch"), groups, key, similarity))
    lost = nodes.join(found, nodes["rep"] == found["node"], "left_semi").select("rep")
    keep = nodes.select("rep").join(lost, "rep", "left_anti")
    gone = materialize(docs.select(key).where(F.col(key).isNotNull()).distinct().join(keep.withColumnRenamed("rep", key), key, "left_anti"), "gone")
    among = maybe_among(gone, key)
    kept = docs.where(F.col(key).isNotNull() & ~among).unionByName(docs.where(among).join(gone, key, "left_anti"))
    again = materialize(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    once = kept.join(again, key, "left_semi").dropDuplicates([key, "text"])  # only rows of ids that come again are shuffled
    return kept.join(again, key, "left_anti").unionByName(once).unionByName(docs.where(F.col(key).isNull())).select(*docs.columns)


def op10_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
