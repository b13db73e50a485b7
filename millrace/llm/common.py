"""Helpers shared by the training-data operators.

Text reaches Python as Arrow batches; :func:`text_buffer` exposes the UTF-8
bytes of a whole batch as one numpy array plus offsets, so per-byte work is
vectorised and no Python string is built.  Intermediate tables are written as
Parquet in the shared folder (:mod:`millrace.scratch`).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, scratch_path, shared_dir  # noqa: F401

#: Rows and bytes per Arrow batch, whichever is reached first.
ARROW_ROWS, ARROW_BYTES = 512, 1 << 24
#: Bytes of text worked on at once; one longer text is worked on whole.
PIECE_BYTES = 1 << 20
#: Bytes of the longest text drawn for the training of a classifier.
TRAIN_TEXT_BYTES = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pick_rows(labels: DataFrame, key: str, n: int, *values: str) -> list:
    """The ``n`` rows with the smallest hash of ``key``: a bounded, repeatable
    training sample (``n`` is a documented parameter of every caller)."""
    return (labels.select(key, *values).orderBy(F.xxhash64(F.col(key).cast("string")), key)
            .limit(n).collect())


def short_enough(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` whose document has a text of at most
    ``TRAIN_TEXT_BYTES``: what a training sample may be drawn from."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return labels.join(docs.where(size <= TRAIN_TEXT_BYTES).select("doc_id"), "doc_id", "left_semi")


def warn_untrained(label: str, counts: dict, drawn: list) -> None:
    """Says so if a class that is labelled has no text to learn from."""
    if lacking := sorted({v for v, n in counts.items() if n} - set(drawn)):
        warnings.warn(f"no labelled text of at most {TRAIN_TEXT_BYTES} bytes for {label} = {', '.join(map(str, lacking))}: scores are the share of labels", stacklevel=3)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offs: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of whole texts of about ``size`` bytes: (first, end, bytes, offsets)."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        grown = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        grown[0] = 1
        have = _powers[kind] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that high and low bits are usable alone."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of a batch of texts,
    with hashes of any byte range from one prefix sum."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        word = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~word[:-1]
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = before[1:] if n < 2 else ~word[1:]
        self.starts = np.flatnonzero(word & (before | edge[:n]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.starts, offs, "left")
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _MULT, n), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal bytes have equal hashes, wherever they stand."""
        down = _power("down", _INV, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def probability(z: np.ndarray) -> np.ndarray:
    """Scores from logits, to nine places: what is compared is what is returned."""
    return np.round(logistic(z), 9)


def on_grid(x: np.ndarray, levels: int) -> tuple[np.ndarray, float]:
    """``x`` as whole numbers of at most ``levels``, and the unit they count.

    Sums of products of whole numbers below the mantissa's size are exact in
    any order, so a result does not depend on what shares its batch.
    """
    unit = float(np.abs(x).max(initial=0.0)) / levels or 1.0
    return np.round(x / unit).astype(x.dtype), unit


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic link from margins to labels (Newton)."""
    a, b = 1.0, 0.0
    hi = (weight[y > 0].sum() + 1) / (weight[y > 0].sum() + 2)
    lo = 1 / (weight[y <= 0].sum() + 2)
    t = np.where(y > 0, hi, lo)
    for _ in range(steps):
        p = logistic(a * margin + b)
        g = weight * (p - t)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margin).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)
