"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed word unigrams, word bigrams and byte trigrams are scaled
by the log-count ratio of the two classes; a linear hinge-loss model is fitted
on the scaled indicators by dual coordinate descent, blended with its mean
weight, and its margins are mapped to probabilities on rows kept out of the
fit.  Scoring folds ratio and weight into one table, so a text costs one pass.

Defined results: a null or empty text has no indicator and gets the score of
the offset alone; texts are scored whole, at any length (training draws none
over ``TRAIN_TEXT_BYTES``); equal texts get equal scores, whatever shares their
batch; repeated rows are scored each; extra columns of the input are ignored by
the fit and kept out of the result; with no rows of one class the score is the
constant prior; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRAIN_TEXT_BYTES, Words, arrow_ready, is_held_out, mix, pick_rows, short_enough, pieces, platt, probability, table, text_buffer, warn_untrained

BITS = 18
#: Bound of the training sample: labelled rows of each class.
TRAIN_PER_CLASS = 3000


def indicator_sets(data: np.ndarray, offs: np.ndarray, bits: int = BITS):
    """For each text the sorted distinct indicators, by way of a reused bitmap."""
    shift = np.uint64(64 - bits)
    flags = np.zeros(1 << bits, bool)
    for _, _, raw, at in pieces(data, offs):
        w = Words(raw, at)
        uni = w.word_hashes()
        pair = mix(uni[:-1] * np.uint64(3) + uni[1:]) if len(uni) > 1 else uni[:0]
        one, two = (uni >> shift).astype(np.int64), (pair >> shift).astype(np.int64)
        b = raw.astype(np.uint32)
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(np.uint64) if len(b) > 2 else np.zeros(0, np.uint64)
        three = (mix((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        for i in range(len(at) - 1):
            lo, hi = w.first[i], w.first[i + 1]
            got = np.concatenate((one[lo:hi], two[lo : max(lo, hi - 1)], three[at[i] : max(at[i], at[i + 1] - 2)]))
            flags[got] = True
            yield np.flatnonzero(flags)
            flags[got] = False


@dataclass
class NbSvm:
    table: np.ndarray  # weight times ratio, by indicator
    offset: float
    slope: float
    shift: float
    bits: int = BITS

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.array([self.table[x].sum(dtype=np.float64) / np.sqrt(max(1, len(x))) for x in indicator_sets(data, offs, self.bits)]) + self.offset

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return probability(self.slope * self.margins(data, offs) + self.shift)


def dual_descent(rows: list[np.ndarray], values: list[float], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """L1-loss linear support vectors by dual coordinate descent with shrinking
    step order; row i has ``ratio[rows[i]] * values[i]`` and a constant 1."""
    w, b = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([(ratio[x] ** 2).sum() * v * v + 1.0 for x, v in zip(rows, values)])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            x = rows[i]
            r = ratio[x] * values[i]
            grad = y[i] * (w[x] @ r + b) - 1.0
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0.0:
                w[x] += d * r
                b += d
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, b


def fit(rows: list[np.ndarray], y: np.ndarray, prior: float, bits: int = BITS, smooth: float = 1.0, cost: float = 1.0, blend: float = 0.25, epochs: int = 12) -> NbSvm:
    """``y`` is 0/1; ``prior`` is the share of class 1 outside the sample."""
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return NbSvm(np.zeros(size, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))), bits)
    sign = np.where(y > 0, 1.0, -1.0)
    check = np.arange(len(rows)) % 5 == 4
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check[:] = False

    def train(use: np.ndarray) -> tuple[np.ndarray, float]:
        count = np.full((2, size), smooth)
        for i in np.flatnonzero(use):
            count[int(y[i]), rows[i]] += 1
        ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
        own = [rows[i] for i in np.flatnonzero(use)]
        w, b = dual_descent(own, [1 / np.sqrt(max(1, len(x))) for x in own], ratio, sign[use], np.full(use.sum(), cost), epochs)
        w = blend * np.abs(w).mean() + (1 - blend) * w
        return w * ratio, b

    share = y.mean()
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    held = check if check.any() else np.ones(len(y), bool)
    table, b = train(~check)
    margin = np.array([table[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b for i in np.flatnonzero(held)])
    slope, shift = platt(margin, y[held], weight[held])
    return NbSvm(table.astype(np.float32), float(b), slope, shift, bits)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS) -> NbSvm:
    """Fit on at most ``per_class`` labelled rows of each class that are not held
    out and have a text of at most ``TRAIN_TEXT_BYTES``."""
    spark = docs.sparkSession
    arrow_ready(spark)
    known = labels.select("doc_id", label).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    usable = short_enough(docs, known)
    chosen = [r for v in (0, 1) for r in pick_rows(usable.where(F.col(label) == v), "doc_id", per_class, label)]
    warn_untrained(label, counts, [r[label] for r in chosen])
    if not chosen:
        return fit([], np.zeros(0, int), 0.5)
    picked = F.broadcast(spark.createDataFrame([(r["doc_id"], r[label]) for r in chosen], "doc_id long, y int"))  # 2 * per_class rows at most

    def features(batches):
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            sets = [x.astype(np.int32).tobytes() for x in indicator_sets(data, offs)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(sets, pa.binary())], ["doc_id", "y", "x"])

    found = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= TRAIN_TEXT_BYTES).join(picked, "doc_id").mapInArrow(features, "doc_id long, y int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    order = np.random.default_rng(11).permutation(len(found))
    return fit([np.frombuffer(found[i]["x"], np.int32) for i in order], np.array([found[i]["y"] for i in order], int), prior)


def score_quality(docs: DataFrame, model: NbSvm) -> DataFrame:
    """doc_id, held_out, score for every row of ``docs``."""
    arrow_ready(docs.sparkSession)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(*text_buffer(b.column("text"))), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score")


def op1_quality_nbsvm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
