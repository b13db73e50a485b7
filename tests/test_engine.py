"""The engine's operators on small fixtures."""

import hashlib
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from millrace import config, embedders
from millrace.functions import ids
from millrace.functions import text as tx
from millrace.functions import vectors as vx
from millrace.operators import ask, chunking, citations, doctor, embedstate, evidence, frontmatter, index, memory, protocol, retrieval
from millrace.sources import catalog, markdown, paths, store

TYPED = "---\nuuid: 123\nnote_version: 2\n---\nA body line about herons.\n"


# ---- front-matter and chunking


def test_frontmatter_states():
    assert frontmatter.parse(TYPED)[:4] == (1, 1, None, 1)
    assert frontmatter.parse("just text") == (0, None, None, None, "{}")
    present, ok, error, required, _ = frontmatter.parse('---\ntitle: "open\nuuid: x\n---\nbody')
    assert (present, required) == (1, None) and (ok == 0 and error or frontmatter.yaml is None)
    assert frontmatter.parse("---\nuuid: a\nno end") == (1, 0, frontmatter.NOT_CLOSED, None, '{"uuid": "a"}')
    assert frontmatter.split_body("---\nuuid: a\nno end") == "---\nuuid: a\nno end"
    assert frontmatter.split_body("﻿---\na: 1\n---\n\nbody") == "body" and frontmatter.split_body("﻿x") == "x"


def test_key_values():
    found, other = frontmatter.key_values("a: 1\nb: 'x'\n  c: 2\n# no\nd\ne: -3.5\nf: ~\ng: TRUE\n")
    assert found == {"a": 1, "b": "x", "e": -3.5, "f": None, "g": True} and other == 2


def test_sections():
    body = "# Top\nintro text\n\n## Alpha\nalpha line\n\n### Child\nchild line\n\n## Beta\nbeta line\n"
    rows = chunking.structured(body, 400, 40)
    assert [(r[6], r[3].strip(), r[4], r[5]) for r in rows] == [
        ("H1: Top", "intro text", 0, 0), ("H1: Top > H2: Alpha", "alpha line", 1, 0), ("H1: Top > H2: Alpha > H3: Child", "child line", 1, 1), ("H1: Top > H2: Beta", "beta line", 2, 0),
    ]
    assert all("##" not in r[3] and body[r[1] : r[2]] == r[3] for r in rows)
    assert [r[6] for r in chunking.structured("### Gamma\ng\n\n### Delta\nd\n", 200, 30)] == ["H3: Gamma", "H3: Delta"]


def test_empty_sections_count():
    rows = chunking.structured("\n## A\n## B\nx\n", 100, 10)
    assert [(r[4], r[6]) for r in rows] == [(2, "H2: B")]


def test_paragraphs_pack():
    rows = chunking.structured("one\n\ntwo\n\nthree\n", 12, 2)
    assert [r[3] for r in rows] == ["one\n\n\ntwo\n", "three\n"]


def test_long_paragraph():
    text = " ".join(f"Sentence number {i} ends here." for i in range(30))
    rows = chunking.structured(text, 180, 25)
    assert len(rows) >= 2 and all(len(r[3]) <= 180 for r in rows) and rows == chunking.structured(text, 180, 25)
    assert all(b[1] == a[2] - 25 for a, b in zip(rows, rows[1:])) and rows[-1][2] == len(text)
    assert [b - a for a, b in chunking.split_sentences("x" * 50, 20, 5)] == [20, 20, 20]


def test_fixed_windows_agree(spark):
    for n in (0, 1, 79, 80, 81, 140, 500):
        text = ("abcdefghij" * 60)[:n]
        native = spark.createDataFrame([(text,)], "t string").select(F.inline(chunking.fixed_window(F.col("t"), 80, 20))).collect()
        assert [tuple(r) for r in native] == chunking.windows(text, 80, 20)
    with pytest.raises(config.ConfigError):
        chunking.chunk_markdown("x", 10, 10)


def test_chunk_key():
    sha = hashlib.sha256(b"t").hexdigest()
    want = hashlib.sha256(f"a.md|obsidian_v1||0|0|{sha}".encode()).hexdigest()[:32]
    assert len(want) == 32 and ids.chunker_sig("obsidian_v1", 1200, 120) != ids.chunker_sig("obsidian_v1", 1200, 100)


# ---- index


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    (root / "typed.md").write_text(TYPED)
    (root / "plain.md").write_bytes(b"Only \xff bytes\r\nand lines.\r")
    (root / "_under.MD").write_text("underscore")
    (root / ".hidden.md").write_text("hidden")
    (root / "front.md").write_text("---\nuuid: 1\n---\n")
    (root / "x.txt").write_text("no")
    return root


def run_index(spark, s, root, **how):
    files = markdown.read_markdown(spark, str(root))
    done = index.index_documents(files, s.table("docs"), s.table("chunks"), spark.createDataFrame([(1,)], "source_id long"), config.Chunking(max_chars=80, overlap=20), now=F.lit(1.0), stage=s.stage, **how)
    summary = done["summary"].first().asDict()
    s.commit({"docs": done["docs"], "chunks": done["chunks"]}, {"chunker_sig": ids.chunker_sig("obsidian_v1", 80, 20)})
    s.unstage()
    return summary


def test_index_runs(spark, tree, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store", "index")
    sig = ids.chunker_sig("obsidian_v1", 80, 20)
    first = run_index(spark, s, tree)
    assert first == {"docs_seen": 5, "docs_changed": 3, "docs_unchanged": 0, "docs_pruned": 1, "chunks_written": 3, "errors": 1}
    docs = {r["rel_path"]: r for r in s.table("docs").collect()}
    assert set(docs) == {"typed.md", "plain.md", "_under.MD"} and (docs["typed.md"]["yaml_present"], docs["typed.md"]["required_keys_present"]) == (1, 1)
    assert docs["plain.md"]["yaml_parse_ok"] is None
    text = {r["doc_id"]: r["text"] for r in s.table("chunks").collect()}
    assert text[docs["plain.md"]["id"]] == "Only � bytes\nand lines.\n" and "uuid" not in text[docs["typed.md"]["id"]]
    assert run_index(spark, s, tree, old_sig=sig)["docs_unchanged"] == 3
    (tree / "typed.md").write_text(TYPED.replace("herons", "egrets"))
    (tree / "plain.md").unlink()
    third = run_index(spark, s, tree, old_sig=sig)
    assert (third["docs_seen"], third["docs_changed"], third["docs_unchanged"], third["docs_pruned"]) == (4, 1, 1, 2)
    assert any("egrets" in r["text"] for r in s.table("chunks").collect())
    ids_now = {r["rel_path"]: r["id"] for r in s.table("docs").collect()}
    assert ids_now["typed.md"] == docs["typed.md"]["id"]
    checks = {r["code"]: r["status"] for r in doctor.check(s.table("docs"), s.table("chunks"), "obsidian_v1", sig, s.meta()).collect()}
    assert set(checks.values()) == {"ok"}


def test_files_are_read_once(spark, tree, tmp_path):
    """A file that changes after the scan leaves a document and chunks of one content."""
    s = store.Store(spark, f"file://{tmp_path}/store", "index")
    files = markdown.read_markdown(spark, str(tree))
    done = index.index_documents(files, s.table("docs"), s.table("chunks"), spark.createDataFrame([(1,)], "source_id long"), config.Chunking(), stage=s.stage)
    for f in tree.glob("*.md"):
        f.unlink()
    assert done["summary"].first()["docs_changed"] == 3 and done["docs"].count() == 3 == done["chunks"].count()
    assert {r["error"] for r in done["errors"].collect()} == {"PATH_DENIED"}


def test_a_folder_that_cannot_be_listed_prunes_nothing(spark, tree, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/store", "index")
    sub = tree / "sub"
    sub.mkdir()
    (sub / "in.md").write_text("inside a folder")
    run_index(spark, s, tree)
    before = {r["rel_path"] for r in s.table("docs").collect()}
    assert "sub/in.md" in before
    files = markdown.read_markdown(spark, str(tree)).where("rel_path <> 'sub/in.md'")
    failed = spark.createDataFrame([(1, "sub", str(tree), None, None, None, "LIST_ERROR: Permission denied")], files.schema)
    done = index.index_documents(files.unionByName(failed), s.table("docs"), s.table("chunks"), spark.createDataFrame([(1,)], "source_id long"), config.Chunking(max_chars=80, overlap=20), old_sig=ids.chunker_sig("obsidian_v1", 80, 20), stage=s.stage)
    assert {r["rel_path"] for r in done["docs"].collect()} == before and done["summary"].first()["errors"] == 2
    (tmp_path / "plain").mkdir()
    monkeypatch.setattr(os, "walk", lambda top, onerror=None, **_: onerror(PermissionError(13, "Permission denied", os.path.join(top, "x"))) or iter(()))
    reader = markdown.MarkdownReader({"path": str(tmp_path / "plain")})
    assert [r for p in reader.partitions() for r in reader.read(p)] == [("x", str(tmp_path / "plain"), None, None, None, "LIST_ERROR: Permission denied")]


def test_missing_root_is_an_error_row(spark, tmp_path):
    rows = markdown.read_markdown(spark, str(tmp_path / "none")).collect()
    assert len(rows) == 1 and rows[0]["rel_path"] is None and rows[0]["error"].startswith("LIST_ERROR")


def test_number_in_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k long").repartition(7)
    got = index.number_in_order(rows, F.col("k")).collect()
    assert sorted((r["k"], r["number"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_store_refuses_newer(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", "memory")
    s.commit({"memory": spark.createDataFrame([], memory.MEMORY)})
    (tmp_path / "s" / "POINTER-0000000009.json").write_text(json.dumps({"version": 9, "meta": {}, "tables": {}}))
    with pytest.raises(ValueError):
        s.table("memory")


def test_store_survives_a_crash(spark, tmp_path):
    """Before the pointer, and in the middle of writing it, the old tables hold."""
    s = store.Store(spark, f"file://{tmp_path}/s", "memory", keep_s=0)
    row = lambda n: spark.createDataFrame([(n, "t", "c", "s", 0.0, 0.0)], memory.MEMORY)
    seen = lambda: [r["memory_id"] for r in s.table("memory").collect()]
    s.commit({"memory": row("a")}, {"k": "1"})
    lost = s.write({"memory": row("b")})  # the process ends here
    assert seen() == ["a"] and s.meta("k") == "1"
    (tmp_path / "s" / "POINTER-0000000002.json").write_text('{"version": 1, "tab')  # or here
    assert seen() == ["a"]
    s.commit({"memory": row("c")})
    assert seen() == ["c"] and s.meta("k") == "1" and s.state()["number"] == 3
    s.drop(lost)
    for n in "defg":
        s.commit({"memory": row(n)})
    left = [p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")]
    assert seen() == ["g"] and sum(x.startswith("memory-") for x in left) == store.KEEP == sum(x.startswith("POINTER-") for x in left)


def test_two_writers(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s", "memory")
    s.commit({"memory": spark.createDataFrame([], memory.MEMORY)})
    names = s._pointers()
    s.commit({"memory": spark.createDataFrame([], memory.MEMORY)})
    monkeypatch.setattr(s, "_pointers", lambda: names)  # a writer that began before the other ended
    with pytest.raises(Exception, match="exists"):
        s.commit({"memory": spark.createDataFrame([], memory.MEMORY)})


def memory_row(spark, n):
    return spark.createDataFrame([(n, "t", "c", "s", 0.0, 0.0)], memory.MEMORY)


def test_a_writer_that_was_overtaken_fails(spark, tmp_path):
    """What another writer published since the tables were read is never lost."""
    a, b = (store.Store(spark, f"file://{tmp_path}/s", "memory") for _ in "ab")
    a.commit({"memory": memory_row(spark, "base")})
    mine = a.table("memory").unionByName(memory_row(spark, "a"))
    b.commit({"memory": b.table("memory").unionByName(memory_row(spark, "b"))})
    with pytest.raises(store.Conflict):
        a.commit({"memory": mine})
    names = lambda: sorted(r["memory_id"] for r in a.table("memory").collect())
    assert names() == ["b", "base"]
    assert {p.name.split("-")[0] for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")} == {"memory", "POINTER"}
    assert sum(p.name.startswith("memory-") for p in (tmp_path / "s").iterdir()) == 2  # the loser's folder is gone
    turns = []

    def derive(base):
        rows = base.table("memory").unionByName(memory_row(spark, "again"))
        if not turns:  # another writer is faster, once
            b.commit({"memory": b.table("memory").unionByName(memory_row(spark, "c"))})
        turns.append(base.number)
        return a.write({"memory": rows}), None

    a.retry(derive)
    assert names() == ["again", "b", "base", "c"] and len(turns) == 2


def test_claims(spark, tmp_path, monkeypatch):
    """A claim keeps other writers out; that of a dead writer expires."""
    s = store.Store(spark, f"file://{tmp_path}/s", "memory")
    s.commit({"memory": memory_row(spark, "a")})
    (tmp_path / "s" / "CLAIM-0000000002").write_text("")
    with pytest.raises(store.Conflict, match="claim"):
        s.commit({"memory": memory_row(spark, "b")})
    monkeypatch.setattr(store, "CLAIM_S", 0.0)
    s.commit({"memory": memory_row(spark, "b")})
    assert [r["memory_id"] for r in s.table("memory").collect()] == ["b"] and not (tmp_path / "s" / "CLAIM-0000000002").exists()


def test_a_reader_outlives_writes(spark, tmp_path):
    """Snapshots younger than ``keep_s`` stay readable, older ones go with their buckets."""
    s = store.Store(spark, f"file://{tmp_path}/s", "memory")
    s.commit({"memory": memory_row(spark, "a")})
    old = s.table("memory")
    for n in "bcde":
        s.commit({"memory": memory_row(spark, n)})
    assert [r["memory_id"] for r in old.collect()] == ["a"]


def test_copy_on_write(spark, tmp_path):
    """A run over many files with one change writes one bucket of documents and
    one of chunks, and the store equals one that was built anew."""
    root = tmp_path / "corpus"
    root.mkdir()
    for i in range(60):
        (root / f"f{i}.md").write_text(f"text number {i}\n")
    s = store.Store(spark, f"file://{tmp_path}/s", "index", buckets=8)
    sig = ids.chunker_sig("obsidian_v1", 80, 20)
    visited = spark.createDataFrame([(1,)], "source_id long")

    def run(s, sig):
        done = {}

        def derive(base):
            done.update(index.index_documents(markdown.read_markdown(spark, str(root)), base.table("docs"), base.table("chunks"), visited, config.Chunking(max_chars=80, overlap=20), now=F.lit(1.0), stage=s.stage, old_sig=sig))
            return index.write_changes(s, base, done), {"chunker_sig": "x"}

        s.retry(derive)
        s.unstage()
        return s.state()["tables"]

    first = run(s, None)
    assert first["docs"]["buckets"] == 8 and len(first["docs"]["folders"]) == 8 == len(first["chunks"]["folders"])
    again = run(s, sig)
    assert again == first and len(s._pointers()) == 1  # nothing changed: nothing is written
    (root / "f7.md").write_text("another text\n")
    second = run(s, sig)
    for name in ("docs", "chunks"):
        moved = {k for k in first[name]["folders"] if second[name]["folders"][k] != first[name]["folders"][k]}
        assert len(moved) == 1
    (root / "f9.md").unlink()
    (root / "new.md").write_text("a new one\n")
    run(s, sig)
    other = store.Store(spark, f"file://{tmp_path}/t", "index", buckets=4)
    run(other, None)
    rows = lambda x: sorted((r["rel_path"], r["text"], r["chunk_key"]) for r in x.table("docs").withColumnRenamed("id", "doc_id").drop("sha256").join(x.table("chunks"), "doc_id").collect())
    assert rows(s) == rows(other) and len(rows(s)) == 60
    spread = s.table("docs").select(store.bucket_of("id", 8).alias("b"), F.regexp_extract(F.input_file_name(), r"__bucket=(\d+)", 1).cast("int").alias("f"))
    assert spread.where("b <> f").count() == 0


def test_run_log(spark, tmp_path):
    log = store.RunLog(spark, f"file://{tmp_path}/runs")
    first, second = log.write({"mode": "ask", "ok": True}), log.write({"mode": "chat", "ok": False})
    assert first != second and log.ids() == {first, second} and log.read(second) == {"run_id": second, "mode": "chat", "ok": False}


def test_roots(tmp_path):
    (tmp_path / "configs").mkdir()
    cfg = tmp_path / "configs" / "default.json"
    root = lambda **how: config.resolve_root(str(cfg), how.pop("cfg", {}), cwd="/", **how)
    assert root() == str(tmp_path) == config.resolve_root(str(tmp_path / "x.json"), {})
    assert root(cfg={"workroot": "w"}) == str(tmp_path / "w") and root(cfg={"workroot": "w"}, environment="e") == str(tmp_path / "e")
    assert root(cfg={"workroot": "w"}, environment="e", workroot="/c") == "/c" and config.resolve_root(None, {}, cwd="/tmp") == "/tmp"
    placed = config.under("/r", config.load({"index": {"sources": [{"name": "a", "root": "x", "kind": "k"}, {"name": "b", "root": "/y", "kind": "k"}]}, "security": {"allowed_roots": ["x"]}}))
    assert [x["root"] for x in placed["index"]["sources"]] == ["/r/x", "/y"] and placed["security"]["allowed_roots"] == ["/r/x"]


def test_migration(spark):
    old = spark.createDataFrame([(1, 1, 0, "t", "s"), (2, 1, 1, "u", "r")], "id long, doc_id long, chunk_index int, text string, sha256 string")
    rows = store.migrate_chunks(old, spark.createDataFrame([(1, "a.md")], "id long, rel_path string")).orderBy("id").collect()
    assert rows[1]["chunk_key"] == hashlib.sha256(b"a.md|fixed_window_v1||0|1|r").hexdigest()[:32] and rows[0]["scheme"] == "fixed_window_v1"


def test_sources():
    one = {"name": " a ", "root": "r", "kind": "k"}
    found = catalog.parse_sources([one, {**one, "name": "b"}])
    assert [s.name for s in catalog.select_sources(found, ["b", "a"])] == ["a", "b"]
    for bad in ([], [one, one], [{"name": "x"}], "x"):
        with pytest.raises(config.ConfigError):
            catalog.parse_sources(bad)
    with pytest.raises(config.ConfigError):
        catalog.select_sources(found, ["c"])


def test_streaming_index(spark, tmp_path):
    from millrace.streaming import index_stream

    at, s = tmp_path / "in", store.Store(spark, f"file://{tmp_path}/s", "index")
    schema = "source_id long, rel_path string, abs_path string, text string, mtime double, size long, error string"
    for k, text in enumerate(("first text", "second text")):
        spark.createDataFrame([(1, "a.md", "/a.md", text, float(k), 1, None)], schema).write.mode("append").parquet(str(at))
        q = index_stream.start(spark.readStream.schema(schema).parquet(str(at)), s, str(tmp_path / "ck"), availableNow=True)
        q.awaitTermination()
    assert [r["text"] for r in s.table("chunks").collect()] == ["second text"] and s.table("docs").count() == 1


# ---- retrieval


def vectors(spark, rows):
    return spark.createDataFrame(rows, "chunk_key string, vector array<float>")


def test_vector_order(spark):
    got = retrieval.vector_topk(vectors(spark, [("k3", [1.0, 0.0]), ("k1", [1.0, 0.0]), ("k2", [1.0, 0.0]), ("k0", [0.0, 1.0]), ("bad", [1.0])]), [1.0, 0.0], 2).collect()
    assert [r["chunk_key"] for r in got] == ["k1", "k2"]
    assert retrieval.fetch_size(2, 0, "a.md") == 50 and retrieval.fetch_size(20, 7, "") == 20 and retrieval.fetch_size(20, 7, "x") == 7
    assert vx.unpack_f32(vx.pack_f32([0.25, -1.0, 3.5, 2.0])) == [0.25, -1.0, 3.5, 2.0]


def test_cosine_of_zero(spark):
    got = {r["chunk_key"]: r["score"] for r in retrieval.vector_scores(vectors(spark, [("z", [0.0, 0.0]), ("a", [3.0, 0.0])]), [2.0, 0.0], normalized=False).collect()}
    assert got == {"z": 0.0, "a": 1.0}


def small_index(spark):
    docs = spark.createDataFrame([(1, "a.md"), (2, "b.md"), (3, "c.md")], "id long, rel_path string")
    chunks = spark.createDataFrame([(1, 0, "ka", "grey heron here", None, "s"), (2, 0, "kb", "a grey heron", "H2: B", "s"), (3, 0, "kc", "nothing", None, "s")], "doc_id long, chunk_index int, chunk_key string, text string, heading_path string, sha256 string")
    return docs, chunks


def test_retrieve_fuses(spark):
    docs, chunks = small_index(spark)
    v = vectors(spark, [("ka", [0.0, 1.0]), ("kc", [1.0, 0.0]), ("gone", [1.0, 0.0])])
    rows = retrieval.retrieve(chunks, docs, v, "GREY HERON", [1.0, 0.0]).candidates.collect()
    assert [(r["chunk_key"], r["method"], r["score"]) for r in rows] == [("ka", "both", 0.75), ("kc", "vector", 1.0), ("kb", "lexical", 0.5)]
    only = retrieval.retrieve(chunks, docs, v, "heron", [1.0, 0.0], rel_path_prefix="a.")
    assert {r["chunk_key"] for r in only.candidates.collect()} == {"ka", "kb"} and only.fetch_k == 100
    assert only.warnings == ["rel_path_prefix reduced vector results: 1/20 (fetched 100)", "dropped orphan vector candidates: 1"]
    lost = retrieval.retrieve(chunks, docs, vectors(spark, [("gone", [1.0, 0.0])]), "heron", [1.0, 0.0], rel_path_prefix="a.")
    assert lost.warnings == ["dropped orphan vector candidates: 1"]  # no hit survived, so the prefix took none
    assert retrieval.retrieve(chunks, docs, vectors(spark, [("ka", [1.0, 0.0])]), "heron", [1.0, 0.0], rel_path_prefix="a.", vector_k=1).warnings == []


def test_snippet(spark):
    t = "x" * 100 + "Needle" + "y" * 300
    row = spark.createDataFrame([(t,)], "t string").select(tx.snippet("t", "needle").alias("a"), tx.snippet("t", "none").alias("b"), tx.snippet("t", "").alias("c")).first()
    assert row["a"] == "..." + t[40:226] + "..." and row["b"] == t[:180] + "..." == row["c"]


# ---- embeddings


def test_drift_and_run(spark):
    docs, chunks = small_index(spark)
    todo = embedstate.chunks_to_embed(chunks, docs)
    none = spark.createDataFrame([], store.SCHEMAS["embeddings"])
    sig = ids.preprocess_sig(ids.CHUNK_FRAMING)
    first = embedstate.embed_run(todo, none, "m", 8, sig, now=F.lit(0.0))
    assert first["counts"].first().asDict() == {"missing": 3, "outdated": 0, "ok": 0}
    done = first["embeddings"]
    assert embedstate.unverified(todo, done, "m", 8, sig).count() == 0
    provider = embedders.DigestEmbedder(8)
    other = embedstate.embed_run(todo, none, "m", 8, sig, provider=provider, now=F.lit(0.0))["embeddings"]
    assert sorted(map(str, done.collect())) == sorted(map(str, other.collect()))
    changed = todo.withColumn("chunk_sha", F.when(F.col("chunk_key") == "ka", "new").otherwise(F.col("chunk_sha")))
    assert embedstate.drift_counts(embedstate.drift(changed, done, "m", 8, sig)).first().asDict() == {"missing": 0, "outdated": 1, "ok": 2}
    assert embedstate.drift_counts(embedstate.drift(todo, done, "m2", 8, sig), rebuild=True).first().asDict() == {"missing": 0, "outdated": 3, "ok": 0}
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in done.collect())
    in_workers = embedstate.embed_run(todo, none, "m", 8, sig, provider={"provider": "digest", "dim": 8, "batch_size": 2}, now=F.lit(0.0))["embeddings"]
    assert sorted(map(str, in_workers.collect())) == sorted(map(str, done.collect()))
    wide = todo.select(vx.digest_vector(F.col("text"), 70).alias("v"), "text").collect()
    assert all(r["v"] == pytest.approx(embedders.DigestEmbedder(70).embed_texts([r["text"]])[0]) for r in wide)
    limited = embedstate.chunks_to_embed(chunks, docs, limit=1)
    assert embedstate.embed_run(limited, done, "m", 8, sig)["embeddings"].count() == 1  # a limit prunes the rest


def near_halves(spark):
    """Texts of which a component, in units of 1/10,000, is next to a half (a
    float lies on the other side of it than the double), and the components."""
    texts = [f"text {i}" for i in (709, 4413, 4461, 5140, 5149)]
    rows = spark.createDataFrame([(t, "a.md", None, t, "s") for t in texts], "chunk_key string, rel_path string, heading_path string, text string, chunk_sha string")
    want = {}
    for t in texts:
        v = embedders.DigestEmbedder(64).embed_texts([f"rel_path=a.md\nheading_path=\n\n{t}"])[0]
        n = math.sqrt(math.fsum(x * x for x in v))
        want[t] = [math.floor(x / n * 10000 + 0.5) for x in v]
    return rows, want


def in_units(made):
    return {r["chunk_key"]: [math.floor(x * 10000 + 0.5) for x in r["vector"]] for r in made.collect()}


@pytest.mark.parametrize("provider", [None, {"provider": "digest", "dim": 64, "batch_size": 2}])
def test_digest_components_are_not_rounded_to_floats(spark, provider):
    rows, want = near_halves(spark)
    assert in_units(embedstate.embed_texts(rows, provider, 64)) == want


@pytest.mark.parametrize("provider", [None, {"provider": "digest", "dim": 64, "batch_size": 2}])
def test_run_leaves_components_as_they_were_made(spark, provider):
    rows, want = near_halves(spark)
    none = spark.createDataFrame([], store.SCHEMAS["embeddings"])
    assert in_units(embedstate.embed_run(rows, none, "m", 64, "s", provider=provider)["embeddings"]) == want


def test_http_provider_falls_back():
    calls = []

    def post(path, body):
        calls.append(path)
        return (404, {}) if path == "/api/embed" else (200, {"embedding": [float(len(body["prompt"])), 1.0]})

    e = embedders.HttpEmbedder("http://x/", "m", post=post)
    assert e.embed_texts(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]] and calls == ["/api/embed", "/api/embeddings", "/api/embeddings"] and e.dim == 2
    for bad in ([[True, 1.0]], [[1.0], [1.0, 2.0]], [[]], "x"):
        with pytest.raises(ValueError):
            embedders.check_vectors(bad, len(bad))


def test_config():
    cfg = config.load({"retrieve": {"vector_k": 3}})
    assert cfg["retrieve"]["vector_k"] == 3 and cfg["retrieve"]["lexical_k"] == 20
    assert config.as_int(True, 5) == 5 and config.as_bool("off", True) is False and config.as_bool(3, True) is True
    assert config.select_models({"model": "m", "model_fast": "f", "model_big": "b"}, "a detailed essay") == ("f", "b")
    assert config.select_models({"model": "m"}, "x", force_big=True) == ("m", "m")
    assert config.select_models({"model_fast": "f", "model_big": "b", "big_triggers": []}, "a detailed essay") == ("f", "f")
    for bad in ({"embed": {"batch_size": 0}}, {"index": {"chunking": {"scheme": "x"}}}, {"retrieve": {"fusion": "rrf"}}):
        with pytest.raises(config.ConfigError):
            config.load(bad)
    with pytest.raises(config.ConfigError):
        embedders.create(config.load({"embed": {"chunk_preprocess_sig": "x"}}))


# ---- evidence, citations, answers


def test_budget(spark):
    rows = evidence.budget(spark.createDataFrame([(i, "a" * 20) for i in range(1, 5)], "rank int, text string"), 30, 12)
    assert [len(r["excerpt"]) for r in rows.where("logged").orderBy("rank").collect()] == [12, 12, 6]
    assert evidence.budget_summary(rows).first().asDict() == {"logged": 3, "omitted": 1, "truncated_total": True}


KEY = "0123456789abcdef0123456789abcdef"


def judged(spark, answer, heading="H1: A > H2: B:", **cfg):
    answers = spark.createDataFrame([(1, answer)], "answer_id long, answer_text string")
    chunks = spark.createDataFrame([(KEY, "n.md", heading, "s1")], "chunk_key string, rel_path string, heading_path string, chunk_sha string")
    snap = spark.createDataFrame([(KEY, cfg.pop("snap", "s1"))], "chunk_key string, chunk_sha string")
    return ask.judge(answers, chunks, snap, config.load({"citations": cfg})).first()


def test_citation_rules(spark):
    good = f"x [source: n.md#H1: A > H2: B | {KEY}]"
    assert judged(spark, good)["outcome"] == "ok" and judged(spark, good, heading_match="exact")["valid"]
    assert not judged(spark, good, heading_match="exact", normalize_heading=False)["valid"]
    assert judged(spark, f"[source: n.md#H1: A | {KEY}]")["valid"] and not judged(spark, f"[source: n.md#H1: A | {KEY}]", heading_match="exact")["valid"]
    off = judged(spark, f"[source: n.md#H9: Z | {KEY}]", heading_match="ignore")
    assert off["valid"] and off["path_mismatches"] == 1
    assert judged(spark, good, snap="other")["sha_mismatches"] == 1
    bad = judged(spark, good + " [source: broken] [source: ", strict=True)
    assert (bad["unparseable"], bad["outcome"], bad["error_code"]) == (2, "strict_fail", "ASK_CITATION_INVALID")
    assert bad["footer"] == "(missing=2, path_mismatches=0, sha_mismatches=0, not_in_snapshot=0)"
    none = judged(spark, "[source: x] [source: y]")
    assert none["all_unparseable"] and none["missing"] == 2
    unknown = judged(spark, f"[source: n.md | {'f' * 32}]")
    assert (unknown["missing"], unknown["not_in_snapshot"], unknown["outcome"]) == (1, 1, "non_strict_invalid_returned")
    rows = citations.parse(spark.createDataFrame([(1, f"[source: a.md#root | {KEY}] [source: b.md#H2: Beta | {KEY}] [source: c.md|{KEY}]")], "answer_id long, answer_text string"))
    assert [r["heading_path"] for r in rows.orderBy("pos").collect()] == ["", "H2: Beta", ""]


def test_ground(spark):
    docs, chunks = small_index(spark)
    found = retrieval.retrieve(chunks, docs, vectors(spark, [("kc", [1.0, 0.0])]), "heron", [1.0, 0.0])
    g = ask.ground(found, " why? ", config.load({"evidence": {"top_n": 2}}))
    prompt = g.prompt.first()["prompt"]
    assert prompt.startswith("Question:\nwhy?\n\nEvidence chunks:\n[1] chunk_key=kb") or prompt.startswith("Question:\nwhy?\n\nEvidence chunks:\n[1] chunk_key=k")
    assert g.snapshot.count() == 2 and prompt.endswith("include citations for each claim.") and "score=1.0000" in prompt
    assert ask.fallback_citations(g.evidence).first()["citations"].count("[source:") == 2


def test_table_lines(spark):
    t = spark.createDataFrame([("a|b|c|d\x0be|f|g|h",), ("x\u2028|---|---|",), ("a|b|c|d",)], "t string")
    assert [r[0] for r in t.select(evidence.table_violation(F.col("t"))).collect()] == ["MARKDOWN_TABLE", "MARKDOWN_TABLE", None]


def test_reads(spark):
    assert evidence.clamp_read(100) == 200 and evidence.clamp_read(999_999) == 200_000
    t = spark.createDataFrame([(120_000, 50_000, True), (350_000, 200_000, True), (10, 10, True), (10, 10, False)], "chars_full int, chars_returned int, truncated boolean")
    assert [r[0] for r in t.select(evidence.reread_chars(50_000)).collect()] == [120_000, 200_000, None, None]
    issues = [r[0] for r in t.select(evidence.truncation_issue(200_000)).collect()]
    assert "requested" in issues[0] and "hard cap" in issues[1] and "chars_returned" in issues[2] and issues[3] is None
    with pytest.raises(ValueError):
        evidence.read_text(t, 100)


def test_footer_tail(spark):
    f = "Scope: full evidence from read_text_file (1/1), sha256=abc"
    for text, want in ((f"text\n{f}\n", f"text\n{f}\n"), (f"text\n{f}\n{f}\n\n", f"text\n{f}\n"), ("text", f"text\n{f}\n"), (f"a\n\n  Scope: x\r\n \n", f"a\n\n{f}\n"), ("", f"{f}\n"), (f"{f}", f"{f}\n"), ("Scope: y\nb", f"Scope: y\nb\n{f}\n")):
        assert spark.range(1).select(evidence.with_one_footer(F.lit(text), F.lit(f))).first()[0] == want


def test_footer_columns(spark):
    f = F.lit("Scope: x")
    row = spark.createDataFrame([("a\nScope: x\n\n",)], "t string").select(evidence.has_footer(F.col("t"), f), evidence.has_footer(F.lit("a"), f), evidence.has_footer(F.lit(""), f), evidence.append_footer(F.lit("b \n"), f), evidence.append_footer(F.lit(" "), f)).first()
    assert tuple(row) == (True, False, False, "b\n\nScope: x", "Scope: x")


def test_tool_calls(spark):
    call = '{"type": "tool_call", "name": "read_text_file", "args": {"path": "a}b.md"}}'
    assert protocol.parse_call(call) == ("read_text_file", {"path": "a}b.md"}, "")
    assert protocol.parse_call(f" {call} then text") == ("read_text_file", {"path": "a}b.md"}, "then text")
    assert protocol.parse_call(f"so: {call}") is None and protocol.parse_call('{"type": "x"}') is None and protocol.parse_call("") is None
    t = spark.createDataFrame([(f"| a | b |\n|---|---|",), ("a|b|c|d\ne|f|g|h",), ("one | pipe",)], "t string")
    assert [r[0] for r in t.select(evidence.table_violation(F.col("t"))).collect()] == ["MARKDOWN_TABLE", "MARKDOWN_TABLE", None]
    q = spark.createDataFrame([("Read notes now",), ("what does a.b say",), ("hello",), ("open x.md",)], "q string")
    assert [r[0] for r in q.select(evidence.question_needs_file(F.col("q"))).collect()] == [True, True, False, True]


def test_normalize(spark):
    row = spark.createDataFrame([("hello\r\nworld  \rx\t\n",)], "t string").select(tx.normalize_embedding_text("t"), tx.frame_chunk(F.lit("a.md"), F.lit(None).cast("string"), F.col("t"))).first()
    assert row[0] == "hello\nworld\nx\n" and row[1] == "rel_path=a.md\nheading_path=\n\nhello\nworld\nx\n"


def test_memory(spark):
    m, e = spark.createDataFrame([], memory.MEMORY), spark.createDataFrame([], memory.EVIDENCE)
    m, e, name = memory.add(m, e, " preference ", " likes tea ", "derived_from_evidence", ["k2", "k1", "k1 ", ""], now=5.0)
    m, e, _ = memory.add(m, e, "user_fact", "x", "manual", now=9.0)
    rows = memory.listing(m, e).collect()
    assert [r["content"] for r in rows] == ["x", "likes tea"] and rows[1]["chunk_keys"] == ["k1", "k2"] and rows[0]["chunk_keys"] == []
    for bad in (("other", "x", "manual"), ("preference", " ", "manual"), ("preference", "x", "guess"), ("preference", "x", "derived_from_evidence")):
        with pytest.raises(ValueError):
            memory.add(m, e, *bad)
    assert memory.dangling(e, spark.createDataFrame([("k1",)], "chunk_key string")).first()["chunk_key"] == "k2"
    assert [x["memory_id"] for x in json.loads(memory.export(m, e).first()["json"])["items"]][1] == name
    left, gone, there = memory.delete(m, e, name)
    assert there and left.count() == 1 and gone.count() == 0


def test_paths(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        d.mkdir()
        (d / "twice.md").write_text("x")
    (a / "safe.md").write_text("hello")
    (a / ".env.md").write_text("x")
    (a / "dir.md").mkdir()
    (tmp_path / "out.md").write_text("x")
    os.symlink(tmp_path / "out.md", a / "link.md")
    policy = paths.configure(["a", "b"], str(tmp_path))
    assert paths.resolve("safe.md", policy) == str(a / "safe.md") == paths.resolve("a/safe.md", policy)
    for request, code in (("twice.md", "AMBIGUOUS_PATH"), (".env.md", "PATH_DENIED"), ("../out.md", "PATH_DENIED"), (str(a / "safe.md"), "PATH_DENIED"), ("link.md", "PATH_DENIED"), ("a/x.exe", "PATH_DENIED"), ("none.md", "FILE_NOT_FOUND"), ("a/none.md", "FILE_NOT_FOUND"), ("a/dir.md", "PATH_IS_DIRECTORY")):
        with pytest.raises(paths.PathError) as e:
            paths.resolve(request, policy)
        assert e.value.code == code, request
    with pytest.raises(ValueError):
        paths.configure(["../x"], str(a), within=str(a))


def test_run_ids_and_redaction(spark):
    assert store.run_id({"t", "t_001"}, "t") == "t_002"
    assert len(store.redact(spark.createDataFrame([("x" * 900,)], "text string")).first()["text"]) == 800
    row = spark.createDataFrame([('{"content":"a","thinking":"b"}',)], "m string").select(store.drop_thinking(F.col("m"))).first()
    assert json.loads(row[0]) == {"content": "a"}


def test_chunkers_take_small_batches(spark):
    """A worker holds the chunks of few texts at once, whatever the session's batch is."""
    import pandas as pd

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(0, 500, 1, 1).selectExpr("id AS doc_id", "concat(id, '.md') AS rel_path", "repeat('some words. ', 300) AS text")
        size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
        rows = chunking.chunk_documents(docs.withColumn("batch", size("doc_id")), config.Chunking())
        assert rows.agg(F.max("batch")).first()[0] <= chunking.BATCH_TEXTS and rows.select("doc_id").distinct().count() == 500
    finally:
        spark.conf.set(key, before)
