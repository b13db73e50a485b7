"""Top-k for a table of questions, and an index of vectors by cells.

*Batched search.*  Questions are cut into blocks and vectors into shards; each
pair of them is one task's matrix product, of which it keeps the best k rows of
each question, and the parts are merged.  No pair of rows is ever a row.

*Cells.*  Centres are found by k-means on a bounded sample (its size is a
parameter), every vector belongs to the cell of the nearest centre, and the
table is written partitioned by cell.  A question probes the nearest ``probes``
cells, whose rows are scored exactly; a search for one question prunes the other
partitions.  A cell with many rows is cut into shards like any table.  With
``probes`` at the number of cells the search is exact.

Scores are inner products rounded to ``DIGITS`` places; ties go by key.  Vectors
of another length than the question, null or not finite, score with no one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import DIGITS

#: Questions of a block, and vectors of a shard.
BLOCK_QUESTIONS, SHARD_ROWS = 512, 16_384
#: Vectors in the sample of k-means, and its rounds.
SAMPLE, ROUNDS = 20_000, 12
#: Scores that are held at once, and rows whose copies for several cells are.
HELD, CELL_ROWS = 1 << 19, 1024


def clean(table: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (array of doubles) of rows whose vector is whole."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col(key).alias("key"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def best_of(questions: pa.Table, rows: pa.Table, k: int, kind: pa.DataType) -> pa.Table:
    """(qid, key, score): of each question its best ``k`` rows by rounded score and key."""
    out = []
    q_len, r_len = (t.column("n").to_numpy() for t in (questions, rows))
    for width in np.intersect1d(q_len, r_len):
        q, r = questions.filter(pa.array(q_len == width)), rows.filter(pa.array(r_len == width))
        keys = r.column("key").to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        x, keys = matrix(r.column("v"), width)[order], keys[order]
        y, ids = matrix(q.column("v"), width), q.column("key").to_numpy(zero_copy_only=False)
        step = max(1, HELD // len(keys))
        for lo in range(0, len(ids), step):
            score = np.round(y[lo : lo + step] @ x.T, DIGITS) + 0.0
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # keys stand in order, so ties go by key
            qid = np.repeat(ids[lo : lo + step], top.shape[1])
            out.append(pa.table({"qid": pa.array(qid, kind[0]), "key": pa.array(keys[top.ravel()], kind[1]), "score": np.take_along_axis(score, top, 1).ravel()}))
    return pa.concat_tables(out) if out else pa.table({"qid": pa.array([], kind[0]), "key": pa.array([], kind[1]), "score": pa.array([], pa.float64())})


def merged(parts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each question: first of groups of its parts, then of these."""
    by = [F.desc("score"), F.asc("key")]
    some = parts.withColumn("r", F.row_number().over(Window.partitionBy("qid", F.pmod(F.xxhash64("key"), F.lit(8))).orderBy(*by))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col("rank") <= k).select("qid", "key", "score", "rank")


def in_units(questions: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(qid, key, score) of the best of each unit.  Both sides have unit, key, v."""
    names = [t.schema["key"].dataType.simpleString() for t in (questions, rows)]
    kind = tuple(pa.int64() if n == "bigint" else pa.int32() if n == "int" else pa.string() for n in names)
    q, r = (t.select("unit", "key", "v", F.size("v").alias("n")) for t in (questions, rows))
    return q.groupBy("unit").cogroup(r.groupBy("unit")).applyInArrow(lambda a, b: best_of(a, b, k, kind), f"qid {names[0]}, key {names[1]}, score double")


def topk(questions: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", qid: str = "vec_id") -> DataFrame:
    """qid, key, score, rank: for every question its best ``k`` vectors, exact.
    Either table is scanned once for its size and once for its rows."""
    q, r = clean(questions, qid, vector), clean(vectors, key, vector)
    blocks, shards = (max(1, -(-t.count() // size)) for t, size in ((q, BLOCK_QUESTIONS), (r, SHARD_ROWS)))
    of = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    q = q.withColumn("b", of(blocks, 1)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    r = r.withColumn("s", of(shards, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    unit = F.struct("b", "s").alias("unit")
    return merged(in_units(q.select(unit, "key", "v"), r.select(unit, "key", "v"), k), k)


# ---------------------------------------------------------------- cells


def centres(vectors: DataFrame, n: int, key: str, vector: str, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """``n`` centres by k-means on the ``sample`` vectors of the smallest key hash."""
    rows = clean(vectors, key, vector)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return np.zeros((0, 0))
    picked = rows.where(F.size("v") == width["n"]).orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()
    x = np.unique(np.array([r["v"] for r in picked]), axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n]]
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        for j in range(len(c)):
            own = x[at == j]
            c[j] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` centres nearest to each row, nearest first."""
    far = (c * c).sum(1) - 2 * (x @ c.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def with_cells(table: DataFrame, c: np.ndarray, n: int = 1) -> DataFrame:
    """key, v, cell: a row for each of the ``n`` cells nearest to a vector; -1
    is the cell of vectors of another length."""
    kind = table.schema["key"].dataType.simpleString()

    def run(batches):
        for b in (b.slice(lo, CELL_ROWS) for b in batches for lo in range(0, len(b), CELL_ROWS)):
            v, size = b.column("v"), b.column("v").value_lengths().to_numpy()
            fits = size == c.shape[1]
            cells = np.full((len(b), n if fits.any() else 1), -1)
            if fits.any():
                x = v.filter(pa.array(fits)).flatten().to_numpy().reshape(-1, c.shape[1])
                cells[fits] = nearest(x, c, n)
            row, col = np.nonzero(np.where(fits[:, None], True, np.arange(cells.shape[1]) == 0))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), v.take(at), pa.array(cells[row, col].astype(np.int32))], ["key", "v", "cell"])

    return table.select("key", "v").mapInArrow(run, f"key {kind}, v array<double>, cell int")


class CellIndex:
    """Vectors written by cell under ``path``, and the centres."""

    def __init__(self, spark, path: str, c: np.ndarray):
        self.spark, self.path, self.centres = spark, path, c

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int, key: str = "vec_id", vector: str = "embedding", **how) -> "CellIndex":
        c = centres(vectors, cells, key, vector, **how)
        rows = with_cells(clean(vectors, key, vector), c) if len(c) else clean(vectors, key, vector).withColumn("cell", F.lit(-1))
        rows.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        return cls(vectors.sparkSession, path, c)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, question: list[float], k: int, probes: int) -> DataFrame:
        """key, score, rank for one question: reads the partitions it probes."""
        spark = self.spark
        q = spark.createDataFrame([(0, [float(x) for x in question])], "key long, v array<double>")
        probed = nearest(np.array([question], float), self.centres, probes)[0].tolist() if self.centres.shape[1] == len(question) else [-1]
        return self._best(q.withColumn("cell", F.explode(F.array(*map(F.lit, probed)))), self.rows().where(F.col("cell").isin(probed)), k).drop("qid")

    def topk(self, questions: DataFrame, k: int, probes: int, qid: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """qid, key, score, rank for a table of questions; exact if ``probes``
        is the number of cells."""
        return self._best(with_cells(clean(questions, qid, vector), self.centres, probes) if len(self.centres) else clean(questions, qid, vector).withColumn("cell", F.lit(-1)), self.rows(), k)

    def _best(self, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """Cells are cut into shards and their questions into blocks, by counts."""
        pieces = lambda t, size, name: t.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        cut = pieces(rows, SHARD_ROWS, "shards").join(pieces(asked, BLOCK_QUESTIONS, "blocks"), "cell")  # a row for each cell
        of = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = asked.join(F.broadcast(cut), "cell").withColumn("b", of("blocks", 1)).withColumn("s", each("shards"))
        r = rows.join(F.broadcast(cut), "cell").withColumn("s", of("shards", 2)).withColumn("b", each("blocks"))
        unit = F.struct("cell", "b", "s").alias("unit")
        return merged(in_units(q.select(unit, "key", "v"), r.select(unit, "key", "v"), k), k)
