"""The engine over a workspace, end to end."""

import json

import pytest

from millrace import __main__ as cli
from millrace.engine import Engine, EngineError


@pytest.fixture()
def engine(spark, tmp_path):
    for name, texts in {"corpus": {"a.md": "## Birds\nA grey heron stands.\n", "b.md": "---\nuuid: 1\n---\n## Fish\nThe pike hides.\n"}, "scratch": {"c.md": "a heron note\n"}}.items():
        (tmp_path / name).mkdir()
        for f, t in texts.items():
            (tmp_path / name / f).write_text(t)
    sources = [{"name": n, "root": str(tmp_path / n), "kind": n} for n in ("corpus", "scratch")]
    return Engine(spark, f"file://{tmp_path}/stores", {"index": {"sources": sources}, "embed": {"dim": 8}})


def test_workspace(engine, spark):
    assert engine.index()["docs_changed"] == 3 and engine.index(["corpus"])["docs_unchanged"] == 2
    text = engine.render("HERON")
    assert text.startswith("[1] scratch:c.md\nprovenance: source=scratch kind=scratch") and "[2] corpus:a.md" in text and "heading_path: H2: Birds" in text
    assert engine.render("zebra") == "No matches found in index."
    assert engine.embed(dry_run=True)["missing"] == 3 and engine.stores["embeddings"].table("embeddings").count() == 0
    assert engine.embed()["missing"] == 3 and engine.embed()["ok"] == 3
    engine.remember("constraint", "short answers")
    checks = {r["code"]: r["status"] for r in engine.doctor(require_embeddings=True).collect()}
    assert set(checks.values()) == {"ok"} and "DOCTOR_PHASE3_RETRIEVAL_READY_OK" in checks
    totals = engine.evidence_summary().first()
    assert (totals["docs_total"], totals["chunks_total"], totals["embeddings_total"], totals["vectors_normalized"]) == (3, 3, 3, "1")
    g = engine.ground("heron")
    top = g.evidence.orderBy("rank").first()
    answers = spark.createDataFrame([(1, f"Herons. [source: {top['rel_path']}#{top['heading_path'] or 'root'} | {top['chunk_key']}]"), (2, "No source.")], "answer_id long, answer_text string")
    assert {r["answer_id"]: r["outcome"] for r in engine.judge(answers, g.snapshot).collect()} == {1: "ok", 2: "ok"}
    name = engine.remember("preference", "likes herons", "derived_from_evidence", [top["chunk_key"]])
    assert name in {r["memory_id"] for r in engine.memories().collect()} and json.loads(engine.export_memories())["schema_version"] == 1
    engine.remember("preference", "x", "derived_from_evidence", ["f" * 32])
    bad = {r["code"]: r["samples"] for r in engine.doctor().collect() if r["status"] == "fail"}
    assert bad == {"DOCTOR_MEMORY_DANGLING_EVIDENCE": ["f" * 32]}
    assert engine.forget(name) and not engine.forget(name)


def test_codes(engine, spark, tmp_path):
    for call, code in ((lambda: engine.query("  "), "INVALID_QUERY"), (lambda: engine.index(["none"]), "CONFIG_ERROR"), (lambda: engine.remember("x", "y"), "PHASE3_MEMORY_ERROR")):
        with pytest.raises(EngineError) as e:
            call()
        assert e.value.code == code
    with pytest.raises(EngineError):
        Engine(spark, str(tmp_path), {"embed": {"batch_size": 0}})


def test_cli(engine):
    run = lambda *a: cli.run(engine, cli.parser().parse_args(["--root", "x", *a]))
    assert run("index")["docs_changed"] == 3
    assert run("query", "pike").startswith("[1] corpus:b.md")
    assert "memory_id" in run("memory", "add", "--content", "c") and len(run("memory", "list")) == 1
    assert {r["code"] for r in run("doctor")} >= {"DOCTOR_INDEX_NONEMPTY", "DOCTOR_DOCS_WITHOUT_CHUNKS_OK", "DOCTOR_PHASE3_EMBEDDINGS_DB_MISSING_WARN"}
    assert run("summary")["chunks_total"] == 3
    with pytest.raises(EngineError) as e:
        cli.run(engine, cli.parser().parse_args(["--root", "x", "ask", "heron"]), answer=lambda *a: 1 / 0)
    assert e.value.code == "PHASE3_ASK_ERROR"


def test_missing_source_keeps_its_documents(engine, tmp_path):
    engine.index()
    (tmp_path / "corpus").rename(tmp_path / "elsewhere")
    (tmp_path / "scratch" / "c.md").write_text("another note\n")
    found = engine.index()
    assert found["errors_total"] == 1 and "does not exist" in found["errors"][0] and (found["docs_changed"], found["docs_pruned"], found["total_docs"]) == (1, 0, 3)
    (tmp_path / "scratch").rename(tmp_path / "gone")
    assert engine.index()["total_docs"] == 3


def test_allowed_roots(engine, tmp_path):
    engine.cfg["security"]["allowed_roots"] = [str(tmp_path / "scratch")]
    found = engine.index()
    assert found["denied_sources"] == ["corpus"] and found["total_docs"] == 1 and "denied" in found["errors"][0]


def test_failing_provider_changes_nothing(engine, monkeypatch, tmp_path):
    engine.index()
    engine.embed()
    before = engine.stores["embeddings"].state()
    (tmp_path / "scratch" / "c.md").write_text("another heron\n")
    engine.index()
    from millrace.operators import embedstate

    whole = embedstate.embed_texts
    monkeypatch.setattr(embedstate, "embed_texts", lambda rows, *a: whole(rows.limit(0), *a))  # a provider that returns too little
    with pytest.raises(EngineError) as e:
        engine.embed()
    assert e.value.code == "PHASE3_EMBED_ERROR" and engine.stores["embeddings"].state() == before
    monkeypatch.setattr(embedstate, "embed_texts", lambda rows, *a: 1 / 0)
    with pytest.raises(EngineError):
        engine.embed()
    assert engine.stores["embeddings"].state() == before


def test_ask(engine, spark):
    engine.index()
    engine.embed()
    key = engine.ground("heron").snapshot.first()["chunk_key"]
    line = {r["chunk_key"]: f"[source: {r['rel_path']}#{r['heading_path'] or 'root'} | {r['chunk_key']}]" for r in engine.ground("heron").evidence.collect()}[key]
    calls = []

    def answer(model, system, prompt):
        calls.append((model, prompt))
        return f"Herons stand. {line}"

    good = engine.ask("heron", answer)
    assert good.ok and good.gate == "ok" and good.footer.startswith("(missing=0") and calls[0][1].startswith("Question:\nheron")
    loose = engine.ask("heron", lambda *a: "x [source: none.md | " + "0" * 32 + "]")
    assert loose.ok and loose.gate == "non_strict_invalid_returned" and "missing=1" in loose.footer
    engine.cfg["citations"]["strict"] = True
    strict = engine.ask("heron", lambda *a: "x [source: broken]")
    assert not strict.ok and strict.error_code == "ASK_CITATION_INVALID"
    engine.cfg["citations"] |= {"enabled": False, "strict": False}
    bare = engine.ask("heron", lambda *a: "no citation at all")
    assert bare.ok and bare.footer == "" and bare.text.count("[source:") >= 1
    with pytest.raises(EngineError) as e:
        engine.ask("heron", lambda *a: 1 / 0)
    assert e.value.code == "PHASE3_ASK_ERROR"
    logs = [engine.runs.read(x) for x in sorted(engine.runs.ids())]
    assert len(logs) == 5 and sorted(x["ok"] for x in logs) == [False, False, True, True, True] and all("elapsed_s" in x for x in logs)
    assert {x.get("error_code") for x in logs} == {None, "ASK_CITATION_INVALID", "PHASE3_ASK_ERROR"}


def test_ask_without_evidence(engine, spark):
    answers = []
    engine.stores["index"].commit({})
    out = engine.ask("zebra", lambda *a: answers.append(a) or "never")
    assert out.text.startswith("Insufficient public evidence") and not answers and out.ok


def test_chat(engine):
    from millrace.models import HttpChat

    model = HttpChat("http://x/", post=lambda path, body: {"message": {"content": body["messages"][0]["content"].upper(), "thinking": "hm"}})
    assert engine.chat("hello", model) == "HELLO" and model("m", "s", "p") == "S"
    log = engine.runs.read(next(iter(engine.runs.ids())))
    assert log["assistant_text"] == "HELLO" and "thinking" not in log["raw_response"]["message"]


def test_equal_paths_in_two_sources(engine, tmp_path):
    """Equal chunk keys are embedded and found once, by the smaller document id."""
    for name in ("corpus", "scratch"):
        (tmp_path / name / "same.md").write_text("the heron of both\n")
    engine.index()
    assert engine.index()["chunks_written"] == 0
    found = engine.embed(rebuild=True)
    keys = [r["chunk_key"] for r in engine.stores["embeddings"].table("embeddings").collect()]
    assert found["embedded_written"] == len(keys) == len(set(keys)) == 4 == found["embeddings_total_after"]
    again = engine.embed(rebuild=True)
    assert (again["embedded_written"], again["existing_embeddings"], again["errors"]) == (4, 4, 0)
    assert engine.embed()["skipped_ok"] == 4
    rows = engine.retrieve("heron").candidates.collect()
    assert len({r["chunk_key"] for r in rows}) == len(rows) == 4


def test_embed_writes_the_touched_buckets(engine, tmp_path):
    engine.index()
    engine.embed()
    first = engine.stores["embeddings"].state()["tables"]["embeddings"]["folders"]
    assert engine.embed()["embedded_written"] == 0 and engine.stores["embeddings"].state()["tables"]["embeddings"]["folders"] == first
    (tmp_path / "scratch" / "c.md").write_text("another heron note\n")
    engine.index()
    found = engine.embed()
    assert (found["missing"], found["embedded_written"], found["orphan_embeddings_pruned"]) == (1, 1, 1)
    now = engine.stores["embeddings"].state()["tables"]["embeddings"]["folders"]
    assert 1 <= len(set(first.items()) ^ set(now.items())) <= 4 and engine.stores["embeddings"].table("embeddings").count() == 3


def test_retrieval_is_held(engine):
    """Candidates, notes and the grounding read no table again."""
    engine.index()
    engine.embed()
    g = engine.ground("heron")
    for df in (g.found.candidates, g.found.notes, g.evidence, g.prompt, g.snapshot, g.log):
        assert "Scan parquet" not in df._jdf.queryExecution().executedPlan().toString()
    assert g.evidence.count() and g.warnings == []


def test_http_settings(spark, tmp_path):
    from millrace import config, embedders

    made = embedders.create(config.load({"embed": {"provider": "http", "model_id": "m"}, "timeout_s": 7}))
    assert (made.base_url, made.timeout_s) == ("http://127.0.0.1:11434", 7)
    assert embedders.create(config.load({"embed": {"provider": "http", "model_id": "m", "base_url": "http://x/", "timeout_s": "9"}})).base_url == "http://x"
    for bad in ({"base_url": "", "embed": {"provider": "http"}}, {"embed": {"provider": "http", "model_id": " "}}, {"embed": {"provider": "torch", "model_id": ""}}, {"embed": {"provider": "torch"}}, {"embed": {"provider": "x"}}):
        with pytest.raises(config.ConfigError):
            embedders.create(config.load(bad))


def test_ask_record_and_fallback(engine, tmp_path):
    """The record has signatures, counters, budgets and caps; the fallback names
    five candidates, also where fewer are admitted."""
    for i in range(6):
        (tmp_path / "corpus" / f"h{i}.md").write_text(f"heron number {i} " * 40 + "\n")
    engine.index()
    engine.embed()
    engine.cfg["evidence"] |= {"top_n": 3, "max_total_chars": 500, "max_excerpt_chars": 400}
    engine.cfg["citations"] |= {"enabled": False}
    out = engine.ask("heron", lambda *a: "no citation at all")
    assert out.text.count("[source:") == 5
    log = engine.runs.read(next(iter(engine.runs.ids())))["retrieval"]
    n = log["candidates_count"]
    assert log["evidence_budget"] == {"requested_top_n": 3, "effective_top_n": 3, "total_retrieval_results_available": n} and n == 9 == len(log["chunk_keys"])
    assert (log["evidence_selected_count"], log["evidence_omitted_count"]) == (3, 6)
    assert log["logging_caps"] == {"max_total_chars": 500, "max_excerpt_chars": 400} and log["logging_truncated_total"] is True
    assert (log["results_logged_count"], log["results_omitted_count"]) == (len(log["results"]), 3 - len(log["results"]))
    assert (log["vector_candidates_scored"], log["vector_candidates_prefilter"], log["vector_candidates_postfilter"], log["vector_fetch_k_used"]) == (9, 9, 9, 20)
    assert log["chunk_preprocess_sig"] == engine.sigs()[0] and log["embed_db_schema_version"] == "1" and log["chunker_sig"] and log["query"] == "heron"


def test_doctor_codes(engine, spark):
    engine.index()
    engine.embed()
    engine.stores["embeddings"].commit({"embeddings": engine.stores["embeddings"].table("embeddings").limit(1)})
    codes = lambda **how: {r["code"]: r["status"] for r in engine.doctor(**how).collect()}
    loose, strict = codes(), codes(require_embeddings=True)
    assert not any(c.startswith("DOCTOR_EMBED_MISSING") for c in loose) and strict["DOCTOR_EMBED_MISSING_REQUIRE_PHASE3"] == "fail"
    engine.cfg["base_url"], engine.cfg["timeout_s"] = "http://127.0.0.1:9", 1
    assert codes(check_endpoint=True)["DOCTOR_OLLAMA_UNREACHABLE"] == "fail"
    engine.cfg["embed"] |= {"provider": "ollama", "model_id": "m"}
    found = codes()
    assert found["DOCTOR_PHASE3_RETRIEVAL_SMOKE_SKIPPED_NO_OLLAMA"] == "ok" and "DOCTOR_PHASE3_RETRIEVAL_READY_OK" not in found
    engine.remember("constraint", "x")
    s = engine.stores["memory"]
    s.publish({}, None)
    at = s._path(s._pointers()[0])
    out = s._fs().create(at, True)
    out.write(bytearray(json.dumps(s._state() | {"version": 9}).encode()))
    out.close()
    assert codes()["DOCTOR_MEMORY_SCHEMA_VERSION"] == "fail"


def test_reads_by_policy(engine, tmp_path):
    (tmp_path / "corpus" / "[odd] {x}.md").write_bytes(b"Odd \xff name\r\n" + b"x" * 500)
    engine.cfg["security"] |= {"allowed_roots": [str(tmp_path / "corpus")]}
    engine.cfg["workroot"] = str(tmp_path)
    got = engine.read("[odd] {x}.md", 200)
    assert (got["chars_full"], got["chars_returned"], got["truncated"]) == (511, 200, True) and got["text"].startswith("Odd � name\nx")
    assert cli.run(engine, cli.parser().parse_args(["--root", "x", "read", "a.md"]))["text"].startswith("## Birds")
    for request, code in (("c.md", "FILE_NOT_FOUND"), ("scratch/c.md", "PATH_DENIED"), ("../x.md", "PATH_DENIED"), ("a.exe", "PATH_DENIED")):
        with pytest.raises(EngineError) as e:
            engine.read(request)
        assert e.value.code == code
    with pytest.raises(EngineError) as e:
        engine.read("a.md", 5)
    assert e.value.code == "INVALID_ARGS"
    engine.cfg["security"]["allowed_roots"] = []
    with pytest.raises(EngineError) as e:
        engine.read("a.md")
    assert e.value.code == "CONFIG_ERROR"
