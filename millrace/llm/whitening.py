"""Embedding whitening by matrix-free block Lanczos.

Each entry c of a vector becomes the whole number x = floor(1024 c) + 100000.
One pass gives the number of rows n and the exact sums S of each dimension, a
second the exact deviations sum((n x - S) ** 2) and with them the trace of the
covariance V.  V itself is never formed: a pass over the rows computes V Q for a
block of vectors Q as the sum of (x - S/n)' ((x - S/n) Q) over the rows of each
task.  The driver holds the basis (dimension times at most ``MOST_BASIS``) and
its products, orthogonalises every block twice against the whole basis, and
takes Ritz vectors.  Directions that vanish (a breakdown) are replaced by random
ones, a full basis is restarted from its best Ritz vectors, and the passes end
when the residuals of the wanted components are at rounding, or when the basis
spans the space.

What leaves a task is one block of sums; they are added by place in a shuffle.

Defined results: a row whose vector is null, or holds a null, NaN or infinite
entry, is dropped; so is a vector shorter than the longest that remains, which
lacks entries.  A null ``vec_id`` is an id like any other, repeated rows count
each time, extra columns are ignored.  There are as many components as the
covariance has rank (to rounding), at most ``COMPONENTS``: a single row, equal
rows and an empty table give none, and so no rows.  A deviation beyond a long is
null; an entry of 2**30 or more is an error.  Of a component, the entry of largest size is positive; components of
equal eigenvalues are any basis of their space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, table

COMPONENTS = 8
#: Vectors that one pass multiplies, and the widest basis that the driver holds.
BLOCK, MOST_BASIS = 16, 512
#: Residual, as a share of the largest eigenvalue, at which a component is done;
#: a direction, and an eigenvalue, smaller than ``RANK`` of it counts as zero.
TOLERANCE, RANK = 1e-13, 1e-13
#: Passes without progress after which residuals count as rounding.
STALLED = 6
SCALE, OFFSET = 1024.0, 100_000
#: Scaled entries from here on could overflow a task's sums.
MOST_ENTRY = 2.0**40


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, v (array of doubles): rows whose entries are all there and finite."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(key).alias(key), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def entries(batch: pa.RecordBatch) -> np.ndarray:
    """The x of a batch, a row for each vector; all have the same length."""
    col = batch.column("v")
    c = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False))
    if np.abs(c).max(initial=0) >= MOST_ENTRY:
        raise OverflowError(f"an embedding entry of {MOST_ENTRY / SCALE:.3g} or more")
    return (c.astype(np.int64) + OFFSET).reshape(len(col), -1)


def added(rows: DataFrame, partial, size: int, kind: str) -> np.ndarray:
    """Sums over all batches of ``partial(x)``, an array of ``size`` numbers:
    each task adds its own, a shuffle adds those of one place."""
    dtype = np.dtype(np.int64 if kind == "long" else np.float64)

    def run(batches):
        total = np.zeros(size, dtype)
        for b in batches:
            if len(b):
                total += partial(entries(b)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "part"])

    whole = F.col("part").cast("decimal(38,0)") if kind == "long" else F.col("part")
    got = rows.select("v").mapInArrow(run, f"at int, part {kind}").groupBy("at").agg(F.sum(whole).alias("s")).collect()
    out = np.zeros(size, object if kind == "long" else dtype)
    for r in got:
        out[r["at"]] = int(r["s"]) if kind == "long" else r["s"]
    return out


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """sum((n x - S) ** 2) of each row, exact: longs, or objects if a long is too small."""
    ends = [(n * int(lo) - int(s), n * int(hi) - int(s)) for lo, hi, s in zip(x.min(0), x.max(0), sums)]
    most = max(abs(v) for pair in ends for v in pair)
    if most * most * x.shape[1] < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(1)
    return ((n * x.astype(object) - sums) ** 2).sum(1)


class Lanczos:
    """The ``k`` largest eigenpairs of a symmetric positive operator of size
    ``d``; ``multiply(q)`` is one pass for a (d, b) block."""

    def __init__(self, multiply, d: int, k: int, block: int = BLOCK, most: int = MOST_BASIS, seed: int = 5):
        self.multiply, self.d, self.k = multiply, d, min(k, d)
        self.block = min(max(block, self.k), d)
        self.most = min(d, max(most, 4 * self.block))
        self.random = np.random.default_rng(seed)
        self.q, self.aq = np.zeros((d, 0)), np.zeros((d, 0))
        self.passes = 0

    def orthogonal(self, w: np.ndarray, scale: float) -> np.ndarray:
        """An orthonormal block outside the basis from ``w``; columns that vanish
        against ``scale`` are drawn anew, as far as the space has room."""
        want = min(w.shape[1], self.d - self.q.shape[1])
        out = np.zeros((self.d, 0))
        for col in [*w.T, *([None] * (4 * want))]:
            if out.shape[1] == want:
                break
            col, least = (self.random.standard_normal(self.d), 1e-6) if col is None else (col, RANK * scale)
            for _ in range(2):  # once more takes out what rounding left
                for basis in (self.q, out):
                    col = col - basis @ (basis.T @ col)
            size = np.linalg.norm(col)
            if size > least:
                col = col / size
                for basis in (self.q, out):
                    col = col - basis @ (basis.T @ col)
                out = np.column_stack((out, col / np.linalg.norm(col)))
        return out

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        new = self.orthogonal(self.random.standard_normal((self.d, self.block)), 0.0)
        least, idle = np.inf, 0
        while True:
            made = self.multiply(new)
            self.passes += 1
            self.q, self.aq = np.column_stack((self.q, new)), np.column_stack((self.aq, made))
            t = self.q.T @ self.aq
            e, s = np.linalg.eigh((t + t.T) / 2)
            e, s = e[::-1], s[:, ::-1]
            top = s[:, : self.k]
            left = np.linalg.norm(self.aq @ top - (self.q @ top) * e[: self.k], axis=0)
            scale = max(float(e[0]), 0.0)
            idle = 0 if left.max() < least / 2 else idle + 1
            least = min(least, left.max())
            done = (left <= TOLERANCE * scale).all() or idle >= STALLED and (left <= 1e-10 * scale).all()
            if self.q.shape[1] >= self.d or self.q.shape[1] >= 2 * self.block and done:
                v = self.q @ top
                return e[: self.k], v / np.linalg.norm(v, axis=0)
            following = made - self.q @ (self.q.T @ made)
            if self.q.shape[1] + self.block > self.most:  # restart from the best half
                keep = s[:, : self.most // 2]
                self.q, r = np.linalg.qr(self.q @ keep)
                self.aq = np.linalg.solve(r.T, (self.aq @ keep).T).T
            new = self.orthogonal(following, scale)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error,
    eigenvalue of each remaining row and component."""
    spark = vectors.sparkSession
    arrow_ready(spark)
    rows = whole_vectors(vectors, key, column)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    nothing = spark.createDataFrame([], schema)
    d = rows.agg(F.max(F.size("v"))).first()[0]
    if not d:
        return nothing
    rows = rows.where(F.size("v") == d)
    counted = added(rows, lambda x: np.append(x.sum(0), len(x)), d + 1, "long")
    n, sums = int(counted[d]), counted[:d]
    mean = np.array([int(s) // n for s in sums], np.int64), np.array([int(s) % n / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - mean[0]) - mean[1]

    trace = float(added(rows, lambda x: np.array([float(sum(deviations(x, n, sums).tolist()))]), 1, "double")[0]) / n**3
    if not trace:
        return nothing

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x):
            y = centred(x)
            return y.T @ (y @ q)

        return added(rows, part, q.size, "double").reshape(q.shape) / n

    e, v = Lanczos(multiply, d, k).solve()
    e, v = e[e > RANK * d * e[0]], v[:, : int((e > RANK * d * e[0]).sum())]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    k, unit = len(e), v / np.sqrt(e)
    centre = added(rows, lambda x: (centred(x) @ unit).sum(0), k, "double") / n

    def spread(x):
        w = centred(x) @ unit - centre
        return w.T @ w

    error = float(np.abs(added(rows, spread, k * k, "double").reshape(k, k) / n - np.eye(k)).max())

    def project(batches):
        for b in batches:
            if not len(b):
                continue
            x = entries(b)
            flat = pa.array((centred(x) @ unit).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([v if v < 1 << 63 else None for v in deviations(x, n, sums).tolist()], pa.int64()), lists], [key, "deviation", "w"])

    out = rows.mapInArrow(project, f"{key} {kind}, deviation long, w array<double>").select(key, "deviation", F.posexplode("w").alias("at", "whitened"))
    share, value = (F.array(*[F.lit(float(x)) for x in y]) for y in (e / trace, e))
    return out.select(key, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), F.get(value, F.col("at")).alias("eigenvalue"))


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
