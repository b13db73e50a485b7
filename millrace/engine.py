"""The engine over a workspace folder: index, query, embed, retrieve, ground,
judge, memory and doctor, each a composition of the operators."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, embedders, models
from .functions import ids
from .functions import text as tx
from .functions import vectors as vx
from .operators import ask, citations, doctor, embedstate, evidence, index, memory, postings, retrieval
from .sources import catalog, markdown, paths, store, tree


#: Messages that a run's result carries; all of them are counted.
ERRORS_SHOWN = 100


def chunk_state(base: store.Snapshot) -> str:
    """Which folder holds each bucket of the chunks."""
    return json.dumps(base.state["tables"]["chunks"]["folders"], sort_keys=True) if base.buckets("chunks") else ""


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Engine:
    """``root`` holds the stores and the run log; ``cfg`` overrides the defaults;
    relative roots in it start from ``workroot``, if that is given.  Roots in other
    file systems, and with ``list_by_tasks`` local ones too, are listed by tasks."""

    def __init__(self, spark: SparkSession, root: str, cfg: dict | None = None, workroot: str | None = None, list_by_tasks: bool = False):
        try:
            self.cfg = config.under(workroot, config.load(cfg)) if workroot else config.load(cfg)
        except config.ConfigError as e:
            raise EngineError("CONFIG_ERROR", str(e)) from e
        self.spark = spark
        self.root, self.list_by_tasks = root.rstrip("/"), list_by_tasks
        self.stores = {k: store.Store(spark, f"{self.root}/{k}", k) for k in store.VERSIONS}
        self.runs = store.RunLog(spark, f"{self.root}/runs")

    # ---- index and query

    def chunking(self) -> config.Chunking:
        return config.Chunking(**{k: self.cfg["index"]["chunking"][k] for k in ("scheme", "max_chars", "overlap")})

    def index(self, names: list[str] | None = None, allowed: list[str] | None = None, rebuild: bool = False) -> dict:
        """Scan the sources and merge what changed; counters and errors of the run.

        A source whose root is missing, unreadable or not allowed is an error
        and keeps what the index had of it.  Nothing is visible before all of
        the run is written.
        """
        s, c = self.stores["index"], self.chunking()
        try:
            picked = catalog.select_sources(catalog.parse_sources(self.cfg["index"]["sources"]), names)
        except config.ConfigError as e:
            raise EngineError("CONFIG_ERROR", str(e)) from e
        allowed = allowed if allowed is not None else self.cfg["security"]["allowed_roots"]
        errors, usable = [], []
        for x in picked:
            if problem := catalog.root_problem(x, allowed):
                errors.append(problem)
            else:
                usable.append(x)
        found = {"docs_seen": 0, "docs_changed": 0, "docs_unchanged": 0, "docs_pruned": 0, "chunks_written": 0}
        now = time.time()
        made: dict = {}

        def derive(base: store.Snapshot) -> tuple[dict, dict]:
            made.clear()
            old = base.table("sources")
            new = self.spark.createDataFrame([(None, x.name, x.root, x.kind, now) for x in usable], store.SCHEMAS["sources"])
            catalogue = index.upsert_sources(old, new)
            rows = catalogue.collect()  # the catalogue: a few rows
            if set(rows) != set(old.collect()):
                made.update(s.write({"sources": self.spark.createDataFrame(rows, store.SCHEMAS["sources"])}))
            known = {r["name"]: r["id"] for r in rows}
            files = None
            for x in usable:
                part = markdown.read_markdown(self.spark, x.root, known[x.name]) if tree.is_local(x.root) and not self.list_by_tasks else tree.read_tree(self.spark, x.root, known[x.name], s.stage)
                files = part if files is None else files.unionByName(part)
            visited = self.spark.createDataFrame([(known[x.name],) for x in usable], "source_id long")
            done = index.index_documents(files, base.table("docs"), base.table("chunks"), visited, c, old_sig=base.meta("chunker_sig"), rebuild=rebuild, now=F.lit(now), stage=s.stage)
            made.update(index.write_changes(s, base, done, rebuild))
            found.update(done["summary"].first().asDict())
            names_of = {v: k for k, v in known.items()}
            bad = done["errors"].orderBy("source_id", "rel_path").limit(ERRORS_SHOWN).collect()
            seen = errors + [f"{names_of[r['source_id']]}:{r['rel_path'] or ''}: {r['error']}" for r in bad]
            found.update(errors=seen, errors_total=found.pop("errors") + len(errors))
            return dict(made), {"chunker_sig": ids.chunker_sig(c.scheme, c.max_chars, c.overlap)}

        try:
            if usable:
                s.retry(derive)
        except Exception as e:
            s.drop(made)
            if isinstance(e, EngineError):
                raise
            raise EngineError("PHASE2_INDEX_ERROR", str(e)) from e
        finally:
            s.unstage()
        base = s.snapshot()
        totals = {"total_docs": base.table("docs").count(), "total_chunks": base.table("chunks").count()}
        errors = found.pop("errors", errors)
        return {"sources": len(picked), "denied_sources": [x.name for x in picked if x not in usable], **found, "errors_total": found.get("errors_total", len(errors)), **totals, "errors": errors}

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        s = self.stores["index"].snapshot()
        return s.table("chunks"), s.table("docs"), s.table("sources")

    def query(self, text: str, k: int = 5) -> DataFrame:
        """The best ``k`` substring hits; by the trigram index if it is that of
        the present chunks, else by a scan.  Both give the same rows."""
        base = self._indexed(text)
        chunks, docs, sources = (base.table(x) for x in ("chunks", "docs", "sources"))
        if (search := self._searchable(base)) is not None and (some := postings.candidates(search.table("grams"), text)) is not None:
            chunks = chunks.join(some, ["doc_id", "chunk_index"], "left_semi")
        return retrieval.search_joined(chunks, docs, sources, text, k)

    def _indexed(self, text: str) -> store.Snapshot:
        if not text.strip():
            raise EngineError("INVALID_QUERY", "query text must not be blank")
        if not self.stores["index"].exists():
            raise EngineError("PHASE2_QUERY_ERROR", "there is no index yet: run index first")
        return self.stores["index"].snapshot()

    def _searchable(self, base: store.Snapshot) -> store.Snapshot | None:
        """The search tables, if they hold the chunks of ``base``."""
        found = self.stores["search"].snapshot()
        return found if found.meta("chunks") == chunk_state(base) else None

    def index_search(self) -> dict:
        """Brings the trigram and word postings up to the present chunks: of the
        buckets whose chunks were written since, or all if the number of buckets
        differs."""
        base, s = self.stores["index"].snapshot(), self.stores["search"]
        entry = base.state["tables"].get("chunks")
        if not isinstance(entry, dict):
            raise EngineError("PHASE2_QUERY_ERROR", "there is no index yet: run index first")
        s.buckets = entry["buckets"]
        found = {"buckets": entry["buckets"], "buckets_written": 0}

        def derive(old: store.Snapshot) -> tuple[dict, dict]:
            before = json.loads(old.meta("chunks") or "{}")
            touched = None
            if old.buckets("grams") == entry["buckets"] == old.buckets("words"):
                touched = sorted(int(b) for b in {*before, *entry["folders"]} if before.get(b) != entry["folders"].get(b))
            found["buckets_written"] = entry["buckets"] if touched is None else len(touched)
            made = {} if touched == [] else postings.update(s, old, base.table("chunks", only=touched), touched)
            return made, {"chunks": chunk_state(base)}

        try:
            s.retry(derive)
        finally:
            s.unstage()
        return found

    def rank(self, text: str, k: int = 20) -> DataFrame:
        """The best ``k`` chunks by BM25: doc_id, chunk_index, score.  Without
        postings of the present chunks they are made from them on the fly."""
        base = self._indexed(text)
        if (search := self._searchable(base)) is not None:
            return postings.bm25(search.table("words"), search.table("lengths"), text, k)
        chunks = base.table("chunks")
        return postings.bm25(postings.word_postings(chunks), postings.lengths(chunks, F.lit(0)), text, k)

    def render(self, text: str, k: int = 5) -> str:
        rows = self.query(text, k)
        ranked = rows.select("hit_pos", F.length("text").alias("n"), "doc_id", "chunk_index", tx.render_hit(F.lit(0), text).alias("r")).collect()  # k rows
        ranked.sort(key=lambda r: (r["hit_pos"], r["n"], r["doc_id"], r["chunk_index"]))
        return "\n\n".join(f"[{i}]{r['r'][3:]}" for i, r in enumerate(ranked, 1)) or "No matches found in index."

    # ---- files on request

    def policy(self) -> paths.Policy:
        """Which files a request may read, by the settings."""
        c = self.cfg["security"]
        flag = lambda k, default: config.as_bool(c.get(k), default)
        workspace = self.cfg.get("workroot") or "."
        within = c.get("security_root") if flag("roots_must_be_within_security_root", True) else None
        try:
            return paths.configure(
                list(c.get("allowed_roots") or []), workspace, within, flag("auto_create_allowed_roots", False), exts=tuple(x.lower() for x in c.get("allowed_exts") or ()),
                deny_absolute=flag("deny_absolute_paths", True), deny_hidden=flag("deny_hidden_paths", True), allow_any=flag("allow_any_path", False),
            )
        except ValueError as x:
            raise EngineError("CONFIG_ERROR", str(x)) from x

    def read(self, request: str, max_chars: int = config.READ_DEFAULT) -> dict:
        """One file that the policy allows, as a bounded read record; a request
        that it denies is an error with the policy's code."""
        try:
            path = paths.resolve(request, self.policy())
        except paths.PathError as x:
            raise EngineError(x.code, str(x)) from x
        text = markdown.decode(F.col("content"))
        rows = self.spark.read.format("binaryFile").load("file://" + path.replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?"))
        try:
            return evidence.read_text(rows.select(F.lit(path).alias("path"), text.alias("text")), max_chars).first().asDict()
        except ValueError as x:
            raise EngineError("INVALID_ARGS", str(x)) from x

    # ---- embeddings

    def sigs(self) -> tuple[str, str]:
        name = self.cfg["embed"]["preprocess"]
        return ids.preprocess_sig(ids.CHUNK_FRAMING, name), ids.preprocess_sig(ids.QUERY_FRAMING, name)

    def _settings(self) -> dict:
        """What a worker needs to make the provider."""
        return {"embed": self.cfg["embed"], **{k: self.cfg.get(k) for k in embedders.ENDPOINT}}

    def _provider(self) -> embedders.Embedder:
        try:
            return embedders.create(self.cfg)
        except config.ConfigError as e:
            raise EngineError("CONFIG_ERROR", str(e)) from e

    def embed(self, rebuild: bool = False, limit: int | None = None, dry_run: bool = False, prune: bool = True) -> dict:
        """Embed what is missing or out of date.  What is written is verified
        before any reader sees it; a run that fails leaves the store as it was."""
        provider = self._provider()
        s, e = self.stores["embeddings"], self.cfg["embed"]
        chunks, docs, _ = self.tables()
        base = s.snapshot()
        rows, old, meta, print_ = embedstate.chunks_to_embed(chunks, docs, limit), base.table("embeddings"), base.meta(), provider.runtime_fingerprint()
        sig, query_sig = self.sigs()
        before = old.count()
        found = {
            "total_chunks": 0, "existing_embeddings": before, "embeddings_total_before": before, "orphan_embeddings_before": 0, "orphan_embeddings_pruned": 0, "missing": 0, "outdated": 0, "ok": 0, "skipped_ok": 0, "embedded_written": 0, "errors": 0,
            "provider": e["provider"], "model_id": e["model_id"], "embed_runtime_fingerprint": print_, "chunk_preprocess_sig": sig, "query_preprocess_sig": query_sig, "vectors_normalized": True, "dim": None, "dry_run": dry_run,
        }
        made: dict = {}
        try:
            some = rows.limit(1).count()
            if before and not rebuild:
                stored = {k: meta.get(k) for k in ("embed_provider", "embed_runtime_fingerprint")}
                if (stored["embed_provider"] or e["provider"]) != e["provider"] or (some and stored["embed_runtime_fingerprint"] and print_ and stored["embed_runtime_fingerprint"] != print_):
                    raise EngineError("PHASE3_EMBED_ERROR", "provider or runtime differs from the stored one; rebuild to replace it")
            found["dim"] = dim = len(provider.embed_texts(["probe"])[0]) if some else None
            planned = s.stage(embedstate.plan(rows, old, e["model_id"], dim or 0, sig, rebuild, prune), "embed-plan")
            n = embedstate.plan_counts(planned, rebuild).first()
            found |= {"total_chunks": n["total"], "orphan_embeddings_before": n["orphans"], "missing": n["missing"], "outdated": n["outdated"], "ok": n["ok"], "skipped_ok": n["ok"]}
            if not dry_run and (n["to_write"] or n["orphans"] and prune):
                new = rows.join(planned.where("write").select("chunk_key", "expected_sig"), "chunk_key") if n["to_write"] else None
                new = None if new is None else embedstate.embed_texts(new.select("chunk_key", "rel_path", "heading_path", "text", "expected_sig"), None if e["provider"] == "digest" else self._settings(), dim, e["batch_size"])
                new = self.spark.createDataFrame([], store.SCHEMAS["embeddings"]) if new is None else new.select("chunk_key", F.col("expected_sig").alias("embed_sig"), F.lit(e["model_id"]).alias("model_id"), F.lit(dim).alias("dim"), F.lit(sig).alias("preprocess_sig"), F.col("vector").cast("array<float>").alias("vector"), F.lit(time.time()).alias("embedded_at"))
                gone = planned.where("write OR drop").select("chunk_key")
                if buckets := 0 if rebuild else base.buckets("embeddings"):
                    touched = [r[0] for r in gone.select(store.bucket_of("chunk_key", buckets)).distinct().collect()]
                    made |= s.write({"embeddings": base.table("embeddings", only=touched).join(gone, "chunk_key", "left_anti").unionByName(new)}, {"embeddings": touched}, base)
                else:
                    made |= s.write({"embeddings": old.join(gone, "chunk_key", "left_anti").unionByName(new)})
                if bad := embedstate.unsigned(planned, s.read(made["embeddings"], "embeddings"), e["model_id"], dim or 0, sig).count():
                    raise EngineError("PHASE3_EMBED_ERROR", f"{bad} embeddings do not carry their signature; nothing was changed")
                signed = {
                    "schema_version": str(store.VERSIONS["embeddings"]), "embed_provider": e["provider"], "embed_model_id": e["model_id"], "embed_dim": str(dim), "embed_runtime_fingerprint": print_,
                    "chunk_preprocess_sig": sig, "query_preprocess_sig": query_sig, "vectors_normalized": "1", "updated_at": str(time.time()),
                }
                s.publish(made, signed if some else None, base)
                found |= {"embedded_written": n["to_write"], "orphan_embeddings_pruned": n["orphans"] if prune else 0}
        except Exception as x:
            s.drop(made)
            if isinstance(x, EngineError):
                raise
            raise EngineError("PHASE3_EMBED_ERROR", str(x)) from x
        finally:
            s.unstage()
        return found | {"embeddings_total_after": s.table("embeddings").count()}

    def retrieve(self, text: str, vector_k: int | None = None) -> retrieval.Retrieval:
        s, r, e = self.stores["embeddings"], self.cfg["retrieve"], self.cfg["embed"]
        chunks, docs, _ = self.tables()
        framed = self.spark.range(1).select(tx.frame_query(F.lit(text)).alias("q")).first()["q"]
        vector = vx.unit(self._provider().embed_texts([framed])[0])
        rows = s.table("embeddings").where((F.col("model_id") == e["model_id"]) & (F.col("preprocess_sig") == self.sigs()[0]) & (F.col("dim") == len(vector)))
        return retrieval.retrieve(chunks, docs, rows, text, vector, r["lexical_k"], vector_k or r["vector_k"], r["vector_fetch_k"], r["rel_path_prefix"], s.meta("vectors_normalized") == "1")

    # ---- answers

    def ground(self, question: str) -> ask.Grounding:
        return ask.ground(self.retrieve(question), question, self.cfg)

    def judge(self, answers: DataFrame, snapshot: DataFrame) -> DataFrame:
        """Only the chunks that are cited, and of them no text, reach the audit."""
        chunks, docs, _ = self.tables()
        cited = citations.parse(answers).select("chunk_key").distinct()
        rows = retrieval.places(chunks.join(cited, "chunk_key", "left_semi"), docs).withColumnRenamed("sha256", "chunk_sha")
        return ask.judge(answers, rows, snapshot, self.cfg)

    def ask(self, question: str, answer: Callable[[str, str, str], str], force_big: bool = False, force_fast: bool = False) -> ask.Outcome:
        """One grounded answer.  ``answer(model, system prompt, user prompt)`` is
        the model call; without candidates it is not made.  Every run, also one
        that fails, is written to the run log."""
        started = time.time()
        record = {"mode": "ask", "question": question, "started_unix": started}
        try:
            if not question.strip():
                raise EngineError("PHASE3_ASK_ERROR", "the question must not be blank")
            model = config.select_models(self.cfg, question, force_big, force_fast)[1]
            record |= {"raw_second_model": model}
            grounding = self.ground(question)
            record["retrieval"] = ask.retrieval_record(question, grounding, self.cfg, self.stores["index"].meta(), self.stores["embeddings"].meta(), self.sigs())
            keys = [r["chunk_key"] for r in grounding.snapshot.select("chunk_key").collect()]  # top_n rows
            if keys:
                raw = answer(model, evidence.GROUNDED_RULES, grounding.prompt.first()["prompt"])
            else:
                raw = evidence.insufficient_text(question)
            answers = self.spark.createDataFrame([(0, raw)], "answer_id long, answer_text string")
            row = self.judge(answers, grounding.snapshot).first()
            out = ask.decide(raw, row, grounding, self.cfg)
            record |= {
                "ok": out.ok, "error_code": out.error_code, "assistant_text": out.text, "grounding_gate": {"reason": out.gate, "strict": config.as_bool(self.cfg["citations"]["strict"], False)}, "citation_validation_footer": out.footer,
                "citation_validation": row.asDict(recursive=True),
            }
            return out
        except Exception as x:
            record |= {"ok": False, "error_code": getattr(x, "code", "PHASE3_ASK_ERROR"), "error_message": str(x)}
            if isinstance(x, EngineError):
                raise
            raise EngineError("PHASE3_ASK_ERROR", str(x)) from x
        finally:
            self.log_run(record | {"ended_unix": time.time(), "elapsed_s": round(time.time() - started, 3)})

    def chat(self, prompt: str, model: models.HttpChat) -> str:
        """One prompt to the model as it is, logged."""
        started, record = time.time(), {"mode": "chat", "prompt": prompt, "model": self.cfg["model"]}
        try:
            found = model.reply(self.cfg["model"], [{"role": "user", "content": prompt}])
            text = str((found.get("message") or {}).get("content") or "")
            record |= {"ok": True, "assistant_text": text, "raw_response": models.without_thinking(found)}
            return text
        except Exception as x:
            record |= {"ok": False, "error": str(x)}
            raise EngineError("CHAT_ERROR", str(x)) from x
        finally:
            self.log_run(record | {"started_unix": started, "ended_unix": time.time(), "elapsed_s": round(time.time() - started, 3)})

    def log_run(self, record: dict) -> str:
        """Writes ``runs/<run id>/run.json``; the id of the run."""
        return self.runs.write(record)

    # ---- memory and doctor

    def _memory(self) -> tuple[DataFrame, DataFrame]:
        if not config.as_bool(self.cfg["memory"]["enabled"], True):
            raise EngineError("PHASE3_MEMORY_DISABLED", "memory is disabled")
        s = self.stores["memory"].snapshot()
        return s.table("memory"), s.table("memory_evidence")

    def remember(self, kind: str, content: str, source: str = "manual", chunk_keys=()) -> str:
        self._memory()
        s, names = self.stores["memory"], []

        def derive(base: store.Snapshot) -> tuple[dict, None]:
            m, e, name = memory.add(base.table("memory"), base.table("memory_evidence"), kind, content, source, chunk_keys, now=time.time())
            names.append(name)
            return s.write({"memory": m, "memory_evidence": e}), None

        try:
            s.retry(derive)
        except ValueError as x:
            raise EngineError("PHASE3_MEMORY_ERROR", str(x)) from x
        return names[-1]

    def forget(self, memory_id: str) -> bool:
        self._memory()
        s, found = self.stores["memory"], []

        def derive(base: store.Snapshot) -> tuple[dict, None]:
            m, e, there = memory.delete(base.table("memory"), base.table("memory_evidence"), memory_id)
            found.append(there)
            return (s.write({"memory": m, "memory_evidence": e}) if there else {}), None

        s.retry(derive)
        return found[-1]

    def memories(self) -> DataFrame:
        return memory.listing(*self._memory())

    def export_memories(self) -> str:
        return memory.export(*self._memory(), now=time.time()).first()["json"]

    def doctor(self, require_embeddings: bool = False, smoke: bool = True, check_endpoint: bool = False) -> DataFrame:
        """All checks: settings, roots, the model endpoint (if asked), index,
        embeddings, a retrieval that must find a vector, memory.  A provider over
        HTTP is not asked to embed unless its endpoint was checked."""
        c = self.chunking()
        index_store, embed_store = self.stores["index"], self.stores["embeddings"]
        chunks, docs, _ = self.tables()
        rows = doctor.check_settings(self.cfg)
        remote, ready = self.cfg["embed"]["provider"] in ("http", "ollama"), True
        if check_endpoint:
            problem = models.unreachable(self.cfg["base_url"], self.cfg["timeout_s"])
            ready = problem is None
            rows.append(doctor.row("DOCTOR_OLLAMA_OK", "ok") if ready else doctor.row("DOCTOR_OLLAMA_UNREACHABLE", "fail", 0, [problem]))
        if not index_store.exists():
            rows.append(doctor.row("DOCTOR_INDEX_DB_MISSING", "fail"))
        else:
            rows += doctor.check_index(docs, chunks, c.scheme, ids.chunker_sig(c.scheme, c.max_chars, c.overlap), index_store.meta(), index_store.state()["version"])
        sig, query_sig = self.sigs()
        e = self.cfg["embed"]
        if not embed_store.exists():
            rows.append(doctor.row("DOCTOR_PHASE3_EMBEDDINGS_DB_MISSING" + ("" if require_embeddings else "_WARN"), "fail" if require_embeddings else "warn"))
        else:
            try:
                print_ = embedders.create(self.cfg).runtime_fingerprint()
            except Exception:
                print_ = None
            want = {"embed_provider": e["provider"], "embed_model_id": e["model_id"], "chunk_preprocess_sig": sig, "query_preprocess_sig": query_sig, "embed_runtime_fingerprint": print_}
            rows += doctor.check_embeddings(chunks, embed_store.table("embeddings"), embed_store.meta(), want, embed_store.state()["version"], require_embeddings)
            if remote and not check_endpoint:
                rows.append(doctor.row("DOCTOR_PHASE3_RETRIEVAL_SMOKE_SKIPPED_NO_OLLAMA", "ok"))
            elif smoke and (ready or not remote) and embed_store.table("embeddings").limit(1).count():
                rows.append(self._smoke())
        if not config.as_bool(self.cfg["memory"]["enabled"], True):
            rows.append(doctor.row("DOCTOR_MEMORY_DISABLED_WARN", "warn"))
        elif not self.stores["memory"].exists():
            rows.append(doctor.row("DOCTOR_MEMORY_DB_MISSING_WARN", "warn"))
        else:
            try:
                rows += doctor.check_memory(self._memory()[1], chunks)
            except ValueError as x:  # a newer schema version is refused
                rows.append(doctor.row("DOCTOR_MEMORY_SCHEMA_VERSION", "fail", 0, [str(x)]))
            except Exception as x:
                rows.append(doctor.row("DOCTOR_MEMORY_DB_ERROR", "fail", 0, [str(x)[:200]]))
        return self.spark.createDataFrame(rows, doctor.CHECK)

    def _smoke(self) -> tuple:
        """Retrieval for a fixed word must give a finite vector hit that is indexed."""
        try:
            hits = self.retrieve("test", vector_k=1).candidates.where(F.col("method").isin("vector", "both")).collect()  # one row
            good = [r for r in hits if r["text"] is not None and abs(r["score"]) != float("inf") and r["score"] == r["score"]]
            return doctor.row("DOCTOR_PHASE3_RETRIEVAL_READY_OK", "ok", len(good)) if good else doctor.row("DOCTOR_PHASE3_RETRIEVAL_NOT_READY", "fail", 0, ["no vector candidate"])
        except Exception as x:
            return doctor.row("DOCTOR_PHASE3_RETRIEVAL_NOT_READY", "fail", 0, [str(x)[:200]])

    def evidence_summary(self) -> DataFrame:
        """Totals and settings of the embedding store and the index, one row."""
        chunks, docs, _ = self.tables()
        return doctor.summary(docs, chunks, self.stores["embeddings"].table("embeddings"), self.stores["embeddings"].meta(), self.stores["index"].meta())
