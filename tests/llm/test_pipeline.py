"""The pipeline against a brute-force version of every stage."""

import importlib
import os

import duckdb
import numpy as np
import pytest

from millrace.llm import bytecnn, editmatch, mixing, simhash
from millrace.llm.common import text_buffer

pa = pytest.importorskip("pyarrow")
HERE = os.path.dirname(os.path.abspath(__file__))


def least_distances(items, text):
    """Least edit distance of every item to a substring of ``text``: plain
    dynamic programming, all items side by side."""
    most = max(map(len, items))
    grid = np.array([[ord(c) for c in t.ljust(most, "\0")] for t in items])
    steps = np.arange(most + 1)
    row = np.tile(steps, (len(items), 1))
    ends = np.array(list(map(len, items)))
    best = row[np.arange(len(items)), ends].copy()
    for c in map(ord, text):
        new = np.empty_like(row)
        new[:, 0] = 0
        new[:, 1:] = np.minimum(row[:, :-1] + (grid != c), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, row[np.arange(len(items)), ends])
    return best


@pytest.mark.skipif(not os.path.exists(os.path.join(HERE, "../../corpus_pipeline.py")), reason="no pipeline")
def test_run(spark, sf, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = source.toPandas().sort_values("doc_id").reset_index(drop=True)

    model = bytecnn.train_language(source)
    tables = model.tables()
    keep = []
    for t in docs.text:
        p = tables.documents(*text_buffer(pa.array([t])))[0]
        keep.append(any(c.isalpha() for c in t) and p.max() >= bytecnn.LEAST_SCORE)
    docs = docs[keep].reset_index(drop=True)

    words = [t.encode().lower().split() for t in docs.text]  # five-word shingles, compared exactly
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 2 * len(sets[i] & sets[j]) >= simhash.SIMILARITY * (len(sets[i]) + len(sets[j])):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    docs = docs[[label[i] == i for i in range(len(docs))]].reset_index(drop=True)

    items = [t for t in (editmatch.normalise(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text) if t]
    budget = np.array([int(editmatch.RATE * len(t)) for t in items])
    docs = docs[[not (least_distances(items, editmatch.normalise(t)) <= budget).any() for t in docs.text]].reset_index(drop=True)

    con = duckdb.connect()
    con.register("documents", docs)
    rows = con.sql(mixing.ORACLE).df()
    docs = docs[docs.doc_id.isin(rows[rows.kept].doc_id)]

    got = pipeline.run(spark, sf)
    assert got.columns == [*source.columns, "shard"]
    got = got.toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got[source.columns].to_dict("records") == docs.to_dict("records")
    assert got.shard.between(0, 39).all() and got.groupby("text").shard.nunique().max() == 1
    assert 0 < len(got) < source.count()
