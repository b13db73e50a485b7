"""Document fingerprints: context-triggered piecewise hashing.

A hash of the last seven bytes, rolled over the whole text, ends a chunk where
it hits the block size; each chunk gives one base-64 character of its own hash.
A fingerprint holds the signatures at a block size and at twice that size.
Two fingerprints are compared where their block sizes are equal or differ by
the factor two, by insert-delete edit distance of the signatures, and only if
these share a run of ``COMMON`` characters.

Rolling and chunk hashes of a text come from one prefix sum over its bytes.

Defined results: null and empty texts have the fingerprint ``3::``; equal
fingerprints have likeness 1; texts are hashed whole (a signature keeps 64
characters: its last chunk then takes all that follows); rows with equal or null
ids follow one another by text hash; repeated rows are compared each; a table of
one row is its own next document; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _INV, _MULT, _power, arrow_ready, materialize, mix, table

WINDOW, LEAST_BLOCK, LENGTH, COMMON = 7, 3, 64, 5
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _signature(ends: np.ndarray, n: int, sums: np.ndarray, down: np.ndarray, most: int) -> str:
    if len(ends) >= most:
        ends = ends[: most - 1]
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return _CHARS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    n = len(text)
    if not n:
        return f"{LEAST_BLOCK}::"
    b = np.frombuffer(text, np.uint8)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", _MULT, n), out=sums[1:])
    down = _power("down", _INV, n + 1)
    roll = np.empty(n, np.uint64)
    first = min(WINDOW, n)
    roll[:first] = sums[1 : first + 1]
    roll[first:] = (sums[WINDOW + 1 :] - sums[1 : n - WINDOW + 1]) * down[1 : n - WINDOW + 1] if n > WINDOW else roll[first:]
    roll = (mix(roll) >> np.uint64(33)).astype(np.uint32)
    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2
    while True:
        ends = np.flatnonzero(roll % np.uint32(block) == block - 1) + 1
        if len(ends) >= LENGTH // 2 - 1 or block == LEAST_BLOCK:
            break
        block //= 2
    wide = ends[roll[ends - 1] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(ends, n, sums, down, LENGTH)}:{_signature(wide, n, sums, down, LENGTH // 2)}"


def _calm(s: str) -> str:
    """Runs of one character are cut to three: they say little."""
    out = []
    for c in s:
        if len(out) < 3 or not out[-1] == out[-2] == out[-3] == c:
            out.append(c)
    return "".join(out)


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    a, b = _calm(a), _calm(b)
    k = min(COMMON, len(a), len(b))
    grams = {a[i : i + k] for i in range(len(a) - k + 1)}
    if not any(b[i : i + k] in grams for i in range(len(b) - k + 1)):
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:  # longest common subsequence, a bit for each character of a
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    common = len(a) - s.bit_count()
    return 2.0 * common / (len(a) + len(b))  # 1 - insert-delete distance / total length


def likeness(x: str, y: str) -> float:
    """0 to 1."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if int(bx) == 2 * int(by):
        return _alike(x1, y2)
    if 2 * int(bx) == int(by):
        return _alike(x2, y1)
    return 0.0


def edited(text: str, after: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(text: str, own: str, after: str, other: str) -> tuple:
    changed = edited(text, after).encode()
    new = fingerprint(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), own, new, likeness(own, new), likeness(own, other)


def _arrow(kind: str):
    return {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind]


def compare_with_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each row against its edited text and the next row by descending key.

    Texts are shuffled once, by range (of id and text hash, so that equal ids
    may spread); a task works through its range in order and hands on only its
    first and last row.  These are joined up by the numbers of the ranges.
    """
    arrow_ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString().replace("bigint", "long")
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [_arrow(x.split()[1]) for x in RESULT.split(", ")]

    def batch(ids, rows, edges, texts, at=0):
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(ids, ids_type), *[pa.array(c, t) for c, t in zip(cols, types)], pa.array(edges, pa.int32()), pa.array([at] * len(ids), pa.int32()), pa.array(texts, pa.string())], [key, *names, "edge", "part", "text"])

    ids_type = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    none = (None,) * len(names)

    def run(batches):
        last, at = None, TaskContext.get().partitionId()
        for b in batches:
            ids, rows, edges, texts = [], [], [], []
            for i, text in zip(b.column(key).to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                own = fingerprint(text.encode())
                if last is None:
                    ids, rows, edges, texts = [*ids, i], [*rows, none], [*edges, 0], [*texts, text]
                else:
                    ids.append(last[0])
                    rows.append(_row(last[1], last[2], text, own))
                    edges.append(-1)
                    texts.append(None)
                last = (i, text, own)
            yield batch(ids, rows, edges, texts, at)
        if last is not None:
            yield batch([last[0]], [none], [1], [last[1]], at)

    order = [F.col(key).desc(), F.xxhash64("text")]
    ordered = docs.select(key, "text").repartitionByRange(*order).sortWithinPartitions(*order)
    done = materialize(ordered.mapInArrow(run, f"{key} {kind}, {RESULT}, edge int, part int, text string"), "ctph")
    first = done.where("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("after"))
    every = Window.orderBy("part")  # a number for each range
    following = F.coalesce(F.lead("part").over(every), F.first("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranges = done.where("edge = 1").select("part").withColumn("next", following)
    seams = done.where("edge = 1").select(key, "part", "text").join(ranges, "part").join(first, "next").select(key, "text", "after")

    def join_up(batches):
        for b in batches:
            ids = b.column(key).to_pylist()
            rows = [_row(t, fingerprint(t.encode()), a, fingerprint(a.encode())) for t, a in zip(b.column("text").to_pylist(), b.column("after").to_pylist())]
            yield batch(ids, rows, [-1] * len(ids), [None] * len(ids))

    stitched = seams.mapInArrow(join_up, f"{key} {kind}, {RESULT}, edge int, part int, text string")
    return done.where("edge = -1").unionByName(stitched).drop("edge", "part", "text")


def op9_fingerprints_ctph(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))

