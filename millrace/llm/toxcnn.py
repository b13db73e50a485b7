"""Toxicity: a convolutional text classifier.

Letters A-Z are lowered, ASCII other than letters and digits separates words.
A word is the sum of two hashed embeddings, of the whole word and of its first
five bytes.  Filters of widths 1 to 3 run over the words of a whole text, the
maxima feed a logistic output.  Everything is trained here, in numpy.

Thresholds are calibrated by language: the language of a text is read from the
text itself, by the word counts of the training texts of each language, and
the score is shifted so that its language's best threshold stands at
``THRESHOLD``.

The trained weights are put on a grid of whole numbers on which every sum is
exact, so a text's score does not depend on the texts that share its batch.

Defined results: a null, empty or wordless text is one word of zeros; texts are
scored whole, at any length (training draws none over ``TRAIN_TEXT_BYTES``);
equal texts get equal scores, wherever they stand; a threshold never cuts
inside a run of equal scores; repeated rows are scored each; with one class
only, or no labels, the score is the constant prior; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TRAIN_TEXT_BYTES, Words, arrow_ready, is_held_out, logistic, on_grid, pick_rows, short_enough, pieces, platt, probability, table, text_buffer, warn_untrained

BITS, DIM, FILTERS, WIDTHS, PREFIX = 16, 12, 16, (1, 2, 3), 5
#: Bound of the training sample: labelled rows of each class.
TRAIN_PER_CLASS = 3000
EPOCHS, LEAST_STEPS = 6, 1500
THRESHOLD = 0.3
#: Levels of embeddings, filters and output weights.  Two embeddings times a
#: filter, summed over DIM and the widest filter, stay under 2**24 (float32);
#: that times an output weight, over all filters, stays under 2**53 (float64).
LEVELS = (512, 256, 1 << 20)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def word_rows(data: np.ndarray, offs: np.ndarray):
    """For each text an (n, 2) array: embedding rows of its words and prefixes."""
    shift = np.uint64(64 - BITS)
    for _, _, raw, at in pieces(data, offs):
        w = Words(_FOLD[raw], at)
        one = (w.word_hashes() >> shift).astype(np.int32)
        two = (w.hashes(w.starts, np.minimum(w.ends, w.starts + PREFIX)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32)
        both = np.stack((one, two), 1)
        for i in range(len(at) - 1):
            yield both[w.first[i] : w.first[i + 1]]


def _lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all texts with padding (the last embedding) after each, which
    closes its last windows; first row and end of each text without padding."""
    pad = np.full((max(WIDTHS) - 1, 2), 1 << BITS, np.int32)
    rows = np.concatenate([x for t in texts for x in ((t if len(t) else pad[:1]), pad)])
    size = np.array([max(1, len(t)) for t in texts])
    ends = np.cumsum(size + len(pad)) - len(pad)
    return rows, ends - size, ends


@dataclass
class ToxCnn:
    embed: np.ndarray  # (2**BITS + 1) x DIM, the last row zero
    filters: np.ndarray  # DIM x (sum(WIDTHS) * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    unit: float = 1.0  # what a whole number of the logit counts
    slope: float = 1.0
    shift: float = 0.0
    langs: np.ndarray | None = None  # 2**BITS x languages: log shares
    lang_shift: np.ndarray | None = None

    def convolve(self, rows: np.ndarray) -> np.ndarray:
        e = self.embed[rows[:, 0]] + self.embed[rows[:, 1]]
        p = e @ self.filters
        z = np.empty((len(rows), len(WIDTHS) * FILTERS), np.float32)
        col = 0
        for k, w in enumerate(WIDTHS):
            own = z[:, k * FILTERS : (k + 1) * FILTERS]
            own[:] = p[:, col : col + FILTERS]
            for j in range(1, w):
                own[:-j] += p[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
            col += w * FILTERS
        return z

    def logits(self, texts: list[np.ndarray], words: int = 1 << 14) -> np.ndarray:
        """Texts are taken together up to about ``words`` words, which stay in the cache."""
        found, lo, size = [np.zeros(0)], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= words or i == len(texts) - 1:
                rows, starts, ends = _lay_out(texts[lo : i + 1])
                # windows that begin in the padding would reach into the next text
                top = np.maximum.reduceat(self.convolve(rows), np.stack((starts, ends), 1).ravel(), axis=0)[::2]
                h = np.maximum(top.astype(np.float64) + self.bias, 0)
                found.append((h @ self.out) * self.unit + self.out_bias)
                lo, size = i + 1, 0
        return np.concatenate(found)

    def language(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.array([self.langs[t[:, 0]].sum(0).argmax() if len(t) else 0 for t in texts], int)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        z = self.slope * self.logits(texts) + self.shift
        if self.langs is not None and len(texts):
            z = z + self.lang_shift[self.language(texts)]
        return probability(z)

    def exact(self) -> "ToxCnn":
        """The same model on whole numbers."""
        embed, a = on_grid(self.embed, LEVELS[0])
        filters, b = on_grid(self.filters, LEVELS[1])
        out, c = on_grid(self.out.astype(np.float64), LEVELS[2])
        return ToxCnn(embed, filters, np.round(self.bias.astype(np.float64) / (a * b)), out, self.out_bias, a * b * c)


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5, rate: float = 0.004, batch: int = 32) -> ToxCnn:
    rng = np.random.default_rng(seed)
    n_filters = len(WIDTHS) * FILTERS
    m = ToxCnn(rng.normal(0, 0.1, ((1 << BITS) + 1, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32), np.zeros(n_filters, np.float32), rng.normal(0, 0.1, n_filters).astype(np.float32), 0.0)
    m.embed[-1] = 0
    square = np.full(len(m.embed), 1e-3, np.float32)  # Adagrad by embedding row
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("filters", m.filters), ("bias", m.bias), ("out", m.out))}
    t = 0
    # a small sample is passed over more often
    for _ in range(min(20, max(epochs, -(-LEAST_STEPS * batch // max(1, len(texts)))))):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            rows, starts, ends = _lay_out([texts[i] for i in own])
            z = m.convolve(rows)
            peak = np.stack([z[a:b].argmax(0) + a for a, b in zip(starts, ends)])
            h = z[peak, np.arange(n_filters)] + m.bias
            a = np.maximum(h, 0)
            d = (logistic(a @ m.out + m.out_bias) - y[own]).astype(np.float32) / len(own)
            g = {"out": a.T @ d + 1e-4 * m.out, "filters": np.zeros_like(m.filters)}
            dh = d[:, None] * m.out[None] * (h > 0)
            g["bias"] = dh.sum(0)
            at, back = [], []
            col = 0
            for k, w in enumerate(WIDTHS):
                dk, pk = dh[:, k * FILTERS : (k + 1) * FILTERS], peak[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    r = rows[np.minimum(pk + j, len(rows) - 1)]
                    e = m.embed[r[..., 0]] + m.embed[r[..., 1]]
                    f = m.filters[:, col : col + FILTERS]
                    g["filters"][:, col : col + FILTERS] = np.einsum("nf,nfk->kf", dk, e)
                    at.append(r.reshape(-1, 2))
                    back.append((dk[..., None] * f.T[None]).reshape(-1, DIM))
                    col += FILTERS
            at, back = np.concatenate(at), np.concatenate(back)
            hit, where = np.unique(at, return_inverse=True)
            de = np.zeros((len(hit), DIM), np.float32)
            where = where.reshape(at.shape)
            np.add.at(de, where[:, 0], back)
            np.add.at(de, where[:, 1], back)
            square[hit] += (de * de).mean(1)
            m.embed[hit] -= 0.05 * de / np.sqrt(square[hit])[:, None]
            m.embed[-1] = 0
            m.out_bias -= 0.02 * float(d.sum())
            t += 1
            for k, v in g.items():
                m1, m2 = state[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.01 * (v * v - m2)
                getattr(m, k)[...] -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return m.exact()


def language_table(texts: list[np.ndarray], langs: list, names: list[str]) -> np.ndarray:
    count = np.full((1 << BITS, len(names)), 0.1)
    for t, lang in zip(texts, langs):
        if lang is not None:
            np.add.at(count[:, names.index(lang)], t[:, 0], 1)
    return np.log(count / count.sum(0)).astype(np.float32)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best weighted F1: halfway from the last row of a run
    of equal scores to the next score (kept within 0.02 and 0.98)."""
    order = np.argsort(-p, kind="stable")
    after = np.append(p[order][1:], 0.0)
    hits, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = np.where(p[order] > after, 2 * hits / (taken + (weight * y).sum()), -1.0)
    k = int(f1.argmax())
    return float(np.clip((p[order[k]] + after[k]) / 2, 0.02, 0.98))


def fit(texts: list[np.ndarray], y: np.ndarray, langs: list, prior: float, **how) -> ToxCnn:
    if len(set(y.tolist())) < 2:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return ToxCnn(np.zeros(((1 << BITS) + 1, DIM), np.float32), np.zeros((DIM, sum(WIDTHS) * FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, shift=float(np.log(p / (1 - p))))
    check = np.arange(len(y)) % 5 == 4
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check[:] = False
    model = train([texts[i] for i in np.flatnonzero(~check)], y[~check], **how)
    held = np.flatnonzero(check) if check.any() else np.arange(len(y))
    share = y.mean()
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))[held]
    own, ty = [texts[i] for i in held], y[held]
    z = model.logits(own)
    model.slope, model.shift = platt(z, ty, weight)
    names = sorted({x for x in langs if x is not None}) or ["any"]
    model.langs = language_table(texts, langs, names)
    p, of = probability(model.slope * z + model.shift), model.language(own)
    logit = lambda q: np.log(q / (1 - q))
    shifts = []
    for k in range(len(names)):
        mine = of == k
        some = mine if (ty[mine] > 0).sum() >= 5 and (ty[mine] == 0).sum() >= 5 else np.ones(len(ty), bool)
        shifts.append(logit(THRESHOLD) - logit(best_threshold(p[some], ty[some], weight[some])))
    model.lang_shift = np.array(shifts)
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = TRAIN_PER_CLASS) -> ToxCnn:
    """Fit on at most ``per_class`` labelled rows of each class that are not held
    out and have a text of at most ``TRAIN_TEXT_BYTES``."""
    spark = docs.sparkSession
    arrow_ready(spark)
    known = labels.select("doc_id", label).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    usable = short_enough(docs, known)
    chosen = [(r["doc_id"], r[label]) for v in (0, 1) for r in pick_rows(usable.where(F.col(label) == v), "doc_id", per_class, label)]
    warn_untrained(label, counts, [r[1] for r in chosen])
    if not chosen:
        return fit([], np.zeros(0, int), [], 0.5)
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int"))  # 2 * per_class rows

    def run(batches):
        for b in batches:
            rows = [t.tobytes() for t in word_rows(*text_buffer(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("lang"), pa.array(rows, pa.binary())], ["doc_id", "y", "lang", "x"])

    found = docs.select("doc_id", "lang", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= TRAIN_TEXT_BYTES).join(picked, "doc_id").select("doc_id", "y", "lang", "text").mapInArrow(run, "doc_id long, y int, lang string, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["x"])))
    order = np.random.default_rng(13).permutation(len(found))
    return fit([np.frombuffer(found[i]["x"], np.int32).reshape(-1, 2) for i in order], np.array([found[i]["y"] for i in order], int), [found[i]["lang"] for i in order], prior)


def score_toxicity(docs: DataFrame, model: ToxCnn) -> DataFrame:
    """doc_id, held_out, score for every row of ``docs``."""
    arrow_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            p = model.scores(list(word_rows(*text_buffer(b.column("text")))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score")


def op6_toxicity_cnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
