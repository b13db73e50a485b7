"""Indexes for search, batched vector search, joins by order and overlap."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.operators import postings, retrieval, timejoin, vectorindex
from millrace.plans import queries
from millrace.sources import store

NEEDLES = ["the", "a", "", "ab", "The g", "ZEBRA", "é d", "..", "on\nthe", "tion the", "nd 𝄞"]


def chunk_rows(spark, n=120, seed=0):
    rng = random.Random(seed)
    words = "the grey heron and a pike on\nthe sea é du 𝄞 tion Zebra x ..".split(" ")
    rows = [(i // 3, i % 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    return spark.createDataFrame([*rows, (900, 0, ""), (901, 0, None), (902, 0, "ab")], "doc_id long, chunk_index int, text string")


def built(spark, path, chunks, buckets=4):
    s = store.Store(spark, path, "search", buckets=buckets)
    s.publish(postings.update(s, s.snapshot(), chunks, None))
    s.unstage()
    return s


def test_trigram_search_is_the_scan(spark, tmp_path):
    chunks = chunk_rows(spark).cache()
    grams = built(spark, f"file://{tmp_path}/s", chunks).table("grams")
    for needle in NEEDLES:
        rows = lambda df: [(r["doc_id"], r["chunk_index"], r["hit_pos"]) for r in df.collect()]
        want = rows(retrieval.search(chunks, needle, 10))
        assert rows(postings.search(chunks, grams, needle, 10)) == want, needle
    plan = postings.candidates(grams, "heron")._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters")[1][:200] and "In(gram" in plan


def test_updated_postings_equal_rebuilt_ones(spark, tmp_path):
    """One changed document, one new, one gone: their buckets are written again."""
    old, n = chunk_rows(spark), 4
    s = built(spark, f"file://{tmp_path}/s", old, n)
    first = s.state()["tables"]
    new = old.where("doc_id NOT IN (5, 7)").unionByName(spark.createDataFrame([(5, 0, "another heron"), (1000, 0, "a new sea")], old.schema))
    touched = sorted({r[0] for r in spark.createDataFrame([(5,), (7,), (1000,)], "i long").select(store.bucket_of("i", n)).collect()})
    base = s.snapshot()
    s.publish(postings.update(s, base, new.where(store.bucket_of("doc_id", n).isin(touched)), touched), base=base)
    s.unstage()
    for name in ("grams", "words"):
        assert {k for k in first[name]["folders"] if s.state()["tables"][name]["folders"][k] != first[name]["folders"][k]} <= {str(t) for t in touched}
    other = built(spark, f"file://{tmp_path}/t", new, n)
    for name in ("grams", "words", "lengths"):
        assert sorted(s.table(name).collect()) == sorted(other.table(name).collect())


def test_bm25_by_hand(spark):
    chunks = chunk_rows(spark)
    texts = {(r["doc_id"], r["chunk_index"]): re.findall(r"[^\W_]+", (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for r in chunks.collect()}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    score = {}
    for w in ("heron", "zebra", "é"):
        df = sum(w in t for t in texts.values())
        for k, t in texts.items():
            if tf := t.count(w):
                score[k] = score.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    want = sorted((-round(v, 6), *k) for k, v in score.items())[:15]
    got = postings.bm25(postings.word_postings(chunks), postings.lengths(chunks, F.lit(0)), "Heron, ZEBRA heron é nowhere", 15).collect()
    assert [(r["doc_id"], r["chunk_index"]) for r in got] == [w[1:] for w in want]
    assert [r["score"] for r in got] == pytest.approx([-w[0] for w in want], abs=2e-6)
    for nothing in ("", "...", "nowhere"):
        assert postings.bm25(postings.word_postings(chunks), postings.lengths(chunks, F.lit(0)), nothing).count() == 0


def test_grams_take_one_native_pass(spark):
    """No expression is run for each character, and characters are whole."""
    rows = spark.createDataFrame([(1, 0, "aB\n𝄞cab"), (2, 0, "ab"), (3, 0, "aaaa")], "doc_id long, chunk_index int, text string")
    found = postings.gram_postings(rows)
    assert {(r["doc_id"], r["gram"]) for r in found.collect()} == {(1, g) for g in ("ab\n", "b\n𝄞", "\n𝄞c", "𝄞ca", "cab")} | {(3, "aaa")} and found.count() == 6
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_store_for_one_kind_of_search(spark, tmp_path):
    """BM25 needs no trigrams: a store that has the words only ranks as one that has both."""
    chunks, n = chunk_rows(spark), 4
    s, whole = store.Store(spark, f"file://{tmp_path}/s", "search", buckets=n), built(spark, f"file://{tmp_path}/t", chunks, n)
    s.publish(postings.update(s, s.snapshot(), chunks.where(store.bucket_of("doc_id", n) < 2), None, ("words",)))
    base = s.snapshot()
    s.publish(postings.update(s, base, chunks.where(store.bucket_of("doc_id", n) >= 2), [2, 3], ("words",)), base=base)
    s.unstage()
    rank = lambda x: postings.bm25(x.table("words"), x.table("lengths"), "heron zebra é", 15).collect()
    assert rank(s) == rank(whole) and "grams" not in s.state()["tables"]


def test_engine_uses_the_postings(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for i in range(12):
        (tmp_path / "c" / f"{i}.md").write_text(f"heron number {i} " * (i + 1) + "\n")
    e = Engine(spark, f"file://{tmp_path}/stores", {"index": {"sources": [{"name": "c", "root": str(tmp_path / "c"), "kind": "k"}]}})
    e.index()
    rows = lambda df: [tuple(r) for r in df.select("rel_path", "chunk_index").collect()]
    scan, ranked = rows(e.query("number 1", 4)), e.rank("number heron 7", 5).collect()
    assert e.index_search()["buckets_written"] == 16 and e.index_search()["buckets_written"] == 0
    assert rows(e.query("number 1", 4)) == scan and e.rank("number heron 7", 5).collect() == ranked
    (tmp_path / "c" / "3.md").write_text("heron number 1, the first\n")
    e.index()
    stale = rows(e.query("number 1", 4))  # the postings are older than the chunks: a scan
    assert e.index_search()["buckets_written"] == 1
    assert rows(e.query("number 1", 4)) == stale != scan


# ---------------------------------------------------------------- vectors


def brute(rows, questions, k):
    out = set()
    for q, y in questions:
        found = [(-round(float(np.dot(np.array(x), np.array(y))), 6), key) for key, x in rows if x is not None and len(x) == len(y) and all(v is not None and math.isfinite(v) for v in x)]
        out |= {(q, key, i + 1) for i, (_, key) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block, shard", [(512, 16_384), (7, 30)])
def test_many_questions(spark, tmp_path, monkeypatch, block, shard):
    monkeypatch.setattr(vectorindex, "BLOCK_QUESTIONS", block)
    monkeypatch.setattr(vectorindex, "SHARD_ROWS", shard)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(6), 3)]) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(2000, [1.0, 2.0]), (2001, None), (2002, [float("nan")] * 6), (2003, [])]  # ties: one vector has a third of all rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows[:40] if r[0] % 2 == 0] + [(2000, [1.0, 2.0])]
    want = brute(rows, asked, 12)
    questions = spark.createDataFrame(asked, table.schema)
    as_set = lambda df: {(r["qid"], r["key"], r["rank"]) for r in df.collect()}
    assert as_set(vectorindex.topk(questions, table, 12)) == want
    index = vectorindex.CellIndex.build(table, f"file://{tmp_path}/cells", 5)
    assert as_set(index.topk(questions, 12, 5)) == want
    one = index.search(asked[0][1], 12, 5)
    assert {(asked[0][0], r["key"], r["rank"]) for r in one.collect()} == {x for x in want if x[0] == asked[0][0]}
    assert vectorindex.topk(questions.limit(0), table, 3).count() == 0 == vectorindex.topk(questions, table.limit(0), 3).count()


def test_cells_recall_and_pruning(spark, sf):
    exact = {(r["qid"], r["key"]) for r in queries.vector_topk_many(spark, sf).collect()}
    found = {(r["qid"], r["key"]) for r in queries.vector_cells_topk(spark, sf).collect()}
    assert len(exact) == 500 and len(found & exact) >= 0.9 * len(exact)
    index = queries._cells(spark, sf)
    plan = index.rows().where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


# ---------------------------------------------------------------- order, overlap, sessions


def test_as_of(spark):
    rng = random.Random(3)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(i, key(), rng.choice([None, *range(40)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(40)]), rng.randint(0, 99)) for _ in range(120)]
    l, r = spark.createDataFrame(left, "id int, k int, t int").repartition(5), spark.createDataFrame(right, "k int, at int, v int")
    want = {}
    for i, k, t in left:
        found = [(at, v) for kk, at, v in right if None not in (k, t, kk, at) and kk == k and at <= t]
        want[i] = max(found)[1] if found else None
    got = {x["id"]: x["v"] for x in timejoin.as_of(l, r, ["k"], "t", "at", ["v"]).collect()}
    assert got == want
    assert timejoin.as_of(l.limit(0), r, ["k"], "t", "at", ["v"]).count() == 0
    assert {x["v"] for x in timejoin.as_of(l, r.limit(0), ["k"], "t", "at", ["v"]).collect()} == {None}


def test_overlaps(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            a = rng.randint(-50, 300)
            out.append((i, rng.choice([1, 1, 2, None]), a, a + rng.choice([0, 1, 1, 2, 3, 7, 8, 60, 500])))
        return out

    left, right = some(120), some(100)
    want = sorted((i, j) for i, k, a, b in left for j, kk, c, d in right if k is not None and k == kk and a < b and c < d and a < d and c < b)
    l, r = (spark.createDataFrame(x, "i int, k int, start int, end int") for x in (left, right))
    pairs = timejoin.overlaps(l, r, ["k"])
    assert sorted((x["l"]["i"], x["r"]["i"]) for x in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert timejoin.overlaps(l, r.limit(0), ["k"]).count() == 0


def test_sessions(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randint(0, 4000)) for _ in range(500)]
    t = spark.createDataFrame(rows, "u int, s int").select("u", F.timestamp_seconds("s").alias("at")).repartition(6)
    want = []
    for u in (1, 2):
        times = sorted(s for x, s in rows if x == u)
        for i, s in enumerate(times):
            if not i or s - times[i - 1] >= 10:
                want.append([u, s, s, 0])
            want[-1][2:] = [s, want[-1][3] + 1]
    got = timejoin.sessions(t, ["u"], "at", 10.0).select("u", F.unix_seconds("session_start"), F.unix_seconds("session_end"), "events").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_sessions(spark, tmp_path):
    """Late rows are dropped and counted, repeated ones count once, and a restart
    from the checkpoint changes nothing."""
    from millrace.streaming import sessions

    schema = "event_id long, u int, at timestamp"
    t0 = 1_700_000_000

    def send(n, *rows):
        df = spark.createDataFrame([(i, u, t0 + s) for i, u, s in rows], "event_id long, u int, s long")
        df.select("event_id", "u", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        q = sessions.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/ck", "u", "at", "10 seconds", "20 seconds", availableNow=True)
        q.awaitTermination()
        got = spark.read.schema("u int, session_start timestamp, session_end timestamp, events long").parquet(f"{tmp_path}/out")
        rows = sorted(map(tuple, got.select("u", F.unix_seconds("session_start") - t0, F.unix_seconds("session_end") - t0, "events").collect()))
        return rows, sessions.late_rows(q)

    send(1, (1, 1, 0), (2, 1, 5), (2, 1, 5), (3, 2, 3), (4, 1, 100))
    first, late = run()
    assert first == [(1, 0, 15, 2), (2, 3, 13, 1)] and late == 0
    assert run()[0] == first
    send(2, (5, 1, 95), (6, 2, 10), (7, 1, 300))  # 10 is behind the watermark of 80
    second, late = run()
    assert second == [*first[:1], (1, 95, 110, 2), first[1]] and late == 1
    batch = sessions.sessions(spark.read.schema(schema).parquet(f"{tmp_path}/in/*"), "u", "at", "10 seconds", "20 seconds")
    assert {(1, 0, 15, 2), (1, 95, 110, 2)} < {tuple(r) for r in batch.select("u", F.unix_seconds("session_start") - t0, F.unix_seconds("session_end") - t0, "events").collect()}


def test_sketches_merge(spark):
    """Lines of parts add up to the line of the whole, within the stated errors."""
    from millrace.operators import sketches

    rng = np.random.default_rng(2)
    rows = [(int(i % 5), ["a", "b", None][i % 3], f"v{rng.integers(0, 3000)}", float(x)) for i, x in enumerate(rng.lognormal(3, 2, 6000))] + [(0, "a", None, None), (1, "b", "v1", 0.0), (1, "b", "v1", -2.0)]
    t = spark.createDataFrame(rows, "part int, s string, v string, x double")
    whole = sketches.read(sketches.lines(t, ["s"], "v", "x"), 0.1, 0.5, 0.99)
    merged = sketches.read(sketches.merge(sketches.lines(t, ["part", "s"], "v", "x"), ["s"]), 0.1, 0.5, 0.99)
    key = lambda r: str(r["s"])
    assert sorted(whole.collect(), key=key) == sorted(merged.collect(), key=key)
    for r in whole.collect():
        own = [x for x in rows if x[1] == r["s"]]
        values, names = sorted(x[3] for x in own if x[3] is not None), {x[2] for x in own if x[2] is not None}
        assert r["rows"] == len(own) and abs(r["distinct"] - len(names)) <= sketches.distinct_error() * len(names) + 1
        for q in (10, 50, 99):
            exact = values[max(1, math.ceil(q / 100 * len(values))) - 1]
            assert abs(r[f"q{q}"] - exact) <= 1.01 * sketches.QUANTILE_ERROR * abs(exact) + 1e-9
    levels = sketches.roll_up(sketches.lines(t, ["part", "s"], "v", "x"), ["part", "s"])
    assert {r["level"]: r["n"] for r in levels.groupBy("level").agg(F.sum("rows").alias("n")).collect()} == {k: len(rows) for k in range(4)}
    assert sketches.lines(t.limit(0), ["s"], "v", "x").count() == 0 == sketches.merge(sketches.lines(t.limit(0), ["s"], "v", "x"), []).count()


def test_tree_is_the_scan(spark, tmp_path):
    """Tasks list and read what the driver's walk does, errors included."""
    import os
    import shutil

    from millrace.scratch import materialize
    from millrace.sources import catalog, markdown, tree

    root = tmp_path / "corpus"
    for folder in ("a/b/c", "d", ".hid", "_u", "empty"):
        (root / folder).mkdir(parents=True)
    for k, name in enumerate(("x.md", "a/y.MD", "a/b/z.md", "a/b/c/w.md", ".hid/h.md", "_u/_v.md", "d/.q.md", "d/no.txt", "d/bad.md")):
        (root / name).write_bytes(f"text {k}\r\nline\xff\n".encode("latin-1"))
    os.symlink(root / "x.md", root / "d" / "link.md")
    os.symlink(root / "a", root / "d" / "loop")
    os.symlink(root / "none.md", root / "d" / "dead.md")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = rows(markdown.read_markdown(spark, str(root), 3))
    assert len(want) == 9 and {r[6] for r in want} == {None, "PATH_DENIED", "FILE_READ_ERROR: No such file or directory"}
    assert rows(tree.read_tree(spark, f"file://{root}", 3)) == want
    assert rows(tree.read_tree(spark, str(tmp_path / "nothing"))) == rows(markdown.read_markdown(spark, str(tmp_path / "nothing")))

    def stage(df, name):  # a folder that goes after it was found
        out = materialize(df, name)
        shutil.rmtree(root / "a" / "b", ignore_errors=name == "files")
        return out

    lost = rows(tree.read_tree(spark, str(root), 3, stage=lambda df, name: stage(df, name) if (root / "a" / "b").exists() and name == "listed" and df.where("kind = 'folder'").count() and "a/b" in str([r["path"] for r in df.collect()]) else materialize(df, name)))
    assert [(r[1], r[6]) for r in lost if r[6] and "LIST" in r[6]] == [("a/b", "LIST_ERROR: No such file or directory")]
    (tmp_path / "out.md").write_text("x")
    os.symlink(tmp_path / "out.md", root / "out.md")
    with pytest.raises(Exception, match="outside the root"):
        tree.read_tree(spark, str(root)).collect()
    far = catalog.Source("s", "hdfs://h/data/x", "k")
    assert catalog.root_problem(far, None) is None is catalog.root_problem(far, ["hdfs://h/data"])
    assert "denied" in catalog.root_problem(far, ["hdfs://h/dat", "/data"]) and "denied" in catalog.root_problem(catalog.Source("s", "hdfs://h/data/../x", "k"), ["hdfs://h/data"])


def test_engine_lists_by_tasks(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "d" / "a.md").write_text("a heron\n")
    e = Engine(spark, f"file://{tmp_path}/stores", {"index": {"sources": [{"name": "c", "root": str(tmp_path / "c"), "kind": "k"}]}}, list_by_tasks=True)
    assert e.index()["docs_changed"] == 1 and e.index()["docs_unchanged"] == 1


def test_exact_counters_send_no_text(spark):
    """Nulls, copies over sets and one copied text; only digests reach a shuffle."""
    rows = [(1, "s", "x", "a"), (2, "s", "x", "a"), (3, "s", "y", "a"), (4, None, "y", "bb"), (5, None, None, None), (6, "t", "x", "")]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumn("n", F.length("text"))
    made = queries._exact_cube(d)
    want = d.cube("source", "lang").agg(F.grouping_id().alias("level"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("median"), F.countDistinct("text").alias("texts"))
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Expand" in x and "text#" in x]


def test_search_holds_few_scores_at_once():
    """Memory of a unit beyond its vectors: a few times the scores of a block."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    t = lambda n: pa.table({"key": pa.array(np.arange(n)), "v": pa.array(list(rng.standard_normal((n, 8)))), "n": pa.array(np.full(n, 8))})
    questions, rows = t(512), t(16_384)
    tracemalloc.start()
    got = vectorindex.best_of(questions, rows, 20, (pa.int64(), pa.int64()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 512 * 20 and most < 40 << 20
