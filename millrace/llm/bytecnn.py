"""Language ID: a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a
window of ``WINDOW`` bytes and classified by softmax.  It is trained here, in
numpy, on windows of labelled texts.  A document is cut into as many windows as
it fills; its class probabilities are the means over them, by bytes.

For prediction the convolutions are folded into tables by byte pair: a filter
of width 4 is the sum of two looked-up rows, which is exact and spares the
products.

The trained weights are put on a grid of whole numbers on which every sum is
exact, so a result does not depend on the texts that share its batch.

Defined results: null text and text without a letter (Unicode category L) is
``und`` with score 0; with no labelled text every text is ``und``; texts are
read whole, at any length; equal texts get equal results, wherever they stand;
of equal probabilities the first language in order wins; repeated rows get a
result each; an empty table gives no rows; extra columns are ignored by
``predict_language`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, is_held_out, on_grid, table, text_buffer

WINDOW, DIM, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
#: Bound of the training sample: documents of each language, windows of each,
#: and documents of all languages together, who share them evenly.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_TOTAL = 700, 5, 70_000
EPOCHS = 6
#: Documents below this score are not identified.
LEAST_SCORE = 0.35
#: Levels of embeddings, filters and output weights: sums over a filter stay
#: under 2**24 (float32), those over all filters under 2**53 (float64).
LEVELS = (512, 256, 1 << 20)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: dict[int, np.ndarray]  # width -> (width * DIM) x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    unit: float = 1.0  # what a whole number of the logits counts

    def exact(self) -> "ByteCnn":
        """The same model on whole numbers."""
        embed, a = on_grid(self.embed, LEVELS[0])
        flat, b = on_grid(np.concatenate([self.filters[w] for w in WIDTHS]), LEVELS[1])
        cuts = np.cumsum([w * DIM for w in WIDTHS])[:-1]
        out, c = on_grid(self.out.astype(np.float64), LEVELS[2])
        return ByteCnn(self.langs, embed, dict(zip(WIDTHS, np.split(flat, cuts))), np.round(self.bias.astype(np.float64) / (a * b)), out, self.out_bias, a * b * c)

    def tables(self) -> "PairTables":
        return PairTables(self)


class PairTables:
    def __init__(self, model: ByteCnn):
        self.model = model
        part = lambda w, j: (model.embed @ model.filters[w][j * DIM : (j + 1) * DIM]).astype(np.float32)
        pair = lambda w, j: (part(w, j)[:, None, :] + part(w, j + 1)[None, :, :]).reshape(65536, FILTERS)
        self.two, self.three, self.third = pair(2, 0), pair(3, 0), part(3, 2)
        self.four, self.fourth = pair(4, 0), pair(4, 2)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes -> (windows, 3 * FILTERS) maxima."""
        out = np.empty((len(x), 3 * FILTERS), np.float32)
        for lo in range(0, len(x), 32):
            w = x[lo : lo + 32]
            code = w[:, :-1].astype(np.int64) << 8 | w[:, 1:]
            out[lo : lo + 32, :FILTERS] = self.two[code].max(1)
            t = self.three[code[:, :-1]]
            t += self.third[w[:, 2:]]
            out[lo : lo + 32, FILTERS : 2 * FILTERS] = t.max(1)
            t = self.four[code[:, :-2]]
            t += self.fourth[code[:, 2:]]
            out[lo : lo + 32, 2 * FILTERS :] = t.max(1)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        m = self.model
        z = (np.maximum(self.pooled(x).astype(np.float64) + m.bias, 0) @ m.out) * m.unit + m.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def documents(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean class probabilities of each text, by bytes; zeros for empty ones."""
        size = np.diff(offs)
        count = -(-size // WINDOW)
        result = np.zeros((len(size), len(self.model.langs)))
        total = np.maximum(size, 1)
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
        lo = 0
        while lo < len(size):  # about 4 MB of windows at once
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + 16384, "right")) - 1)
            n = first[hi] - first[lo]
            flat = np.zeros(n * WINDOW, np.uint8)
            for i in range(lo, hi):
                at = (first[i] - first[lo]) * WINDOW
                flat[at : at + size[i]] = data[offs[i] : offs[i + 1]]
            if n:
                of = np.repeat(np.arange(lo, hi), count[lo:hi])
                left = size[of] - (np.arange(n) - (first[of] - first[lo])) * WINDOW
                share = np.minimum(left, WINDOW) / total[of]
                np.add.at(result, of, self.probabilities(flat.reshape(n, WINDOW)) * share[:, None])
            lo = hi
        return result


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 3, rate: float = 0.004) -> ByteCnn:
    """Adam on the cross entropy, a batch of 64 windows a step."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.3, (256, DIM)), "bias": np.zeros(len(WIDTHS) * FILTERS), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "out_bias": np.zeros(len(langs))}
    p |= {f"f{w}": rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            b, n = x[own], len(own)
            e = p["embed"][b]
            cols, tops, peak = {}, [], {}
            for w in WIDTHS:
                c = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                z = (c.reshape(-1, w * DIM) @ p[f"f{w}"]).reshape(n, -1, FILTERS)
                peak[w] = z.argmax(1)
                cols[w] = c
                tops.append(np.take_along_axis(z, peak[w][:, None], 1)[:, 0])
            h = np.concatenate(tops, 1) + p["bias"]
            a = np.maximum(h, 0)
            z = a @ p["out"] + p["out_bias"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), y[own]] -= 1
            q /= n
            g = {"out": a.T @ q, "out_bias": q.sum(0)}
            dh = (q @ p["out"].T) * (h > 0)
            g["bias"] = dh.sum(0)
            g["embed"] = np.zeros_like(p["embed"])
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                rows = cols[w][np.arange(n)[:, None], peak[w]]  # n x FILTERS x w * DIM
                g[f"f{w}"] = np.einsum("nf,nfk->kf", d, rows)
                back = d[:, :, None] * p[f"f{w}"].T[None]
                for j in range(w):
                    np.add.at(g["embed"], b[np.arange(n)[:, None], peak[w] + j], back[:, :, j * DIM : (j + 1) * DIM])
            t += 1
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)
    return ByteCnn(langs, p["embed"], {w: p[f"f{w}"] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"].astype(np.float64)).exact()


def sample_windows(data: np.ndarray, offs: np.ndarray, seeds: list[int], most: int = TRAIN_WINDOWS) -> list[list[bytes]]:
    """Windows at random places of each whole text, one in three cut short."""
    found = []
    for i, seed in enumerate(seeds):
        rng = np.random.default_rng(abs(seed))
        body, own = data[offs[i] : offs[i + 1]], []
        for _ in range(min(most, -(-len(body) // WINDOW))):
            at = int(rng.integers(0, max(1, len(body) - WINDOW + 1)))
            size = WINDOW if rng.random() > 0.33 else int(rng.integers(12, WINDOW))
            own.append(body[at : at + size].tobytes().ljust(WINDOW, b"\0"))
        found.append(own)
    return found


def train_language(docs: DataFrame, per_lang: int = TRAIN_DOCS, total: int = TRAIN_TOTAL) -> ByteCnn | None:
    """Fit on the ``per_lang`` documents of each language, with text and not held
    out, whose ids have the smallest hashes (``total`` in all languages at most).

    The counts by language say below which hash these lie, give or take a
    margin, so one scan finds them for all languages.
    """
    spark = docs.sparkSession
    arrow_ready(spark)
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # the classes
    if not counts:
        return None
    if len(counts) > total:
        raise ValueError(f"{len(counts)} languages are more than the {total} documents to learn from")
    langs, most = sorted(counts), min(per_lang, total // len(counts))
    share = [min(1.0, (most + 8 * most**0.5 + 16) / counts[x]) for x in langs]
    cuts = [(x, k, (1 << 63) - 1 if f == 1 else int((2 * f - 1) * 2.0**63)) for k, (x, f) in enumerate(zip(langs, share))]
    below = F.broadcast(spark.createDataFrame(cuts, "lang string, y int, cut long"))  # a row for each class
    drawn = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).join(below, "lang").where("h <= cut").select("doc_id", "h", "y", "text")

    def windows(batches):
        for b in batches:
            own = sample_windows(*text_buffer(b.column("text")), b.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("h"), b.column("doc_id"), pa.array(own, pa.list_(pa.binary()))], ["y", "h", "doc_id", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = drawn.select("y", "h", "doc_id", "text").mapInArrow(windows, f"y int, h long, doc_id {kind}, w array<binary>").collect()
    rows.sort(key=lambda r: (r["y"], r["h"], r["doc_id"], [bytes(w) for w in r["w"]]))
    seen = [0] * len(langs)
    x, y = [], []
    for r in rows:
        seen[r["y"]] += 1
        if seen[r["y"]] <= most:
            x += [bytes(w) for w in r["w"]]
            y += [r["y"]] * len(r["w"])
    return train(np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW), np.array(y), langs)


def label_batch(model: ByteCnn | None, tables: PairTables | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    data, offs = text_buffer(texts)
    n = len(offs) - 1
    if model is None:
        return ["und"] * n, np.zeros(n)
    names = np.array([*model.langs, "und"], object)
    p = np.round(tables.documents(data, offs), 9)
    best, score = p.argmax(1), p.max(1)
    seen = np.concatenate((np.zeros(1, np.int64), np.cumsum(_ASCII_LETTER[data])))
    for i in np.flatnonzero(seen[offs[1:]] == seen[offs[:-1]]):
        if not any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))):  # category L
            best[i], score[i] = len(model.langs), 0.0
    return names[best].tolist(), np.minimum(score, 1.0)


def predict_language(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    arrow_ready(docs.sparkSession)

    def run(batches):
        tables = model.tables() if model else None
        for b in batches:
            langs, score = label_batch(model, tables, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: ByteCnn | None, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose text is ``und`` or scores below ``least``."""
    arrow_ready(docs.sparkSession)

    def run(batches):
        tables = model.tables() if model else None
        for b in batches:
            langs, score = label_batch(model, tables, b.column("text"))
            yield b.filter(pa.array([x != "und" and v >= least for x, v in zip(langs, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_langid_bytecnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_language(docs, train_language(docs))
