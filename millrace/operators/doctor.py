"""Integrity checks of settings and stores: (code, status, count, samples) rows.

Status is ok, warn or fail.  The counters of one table come from one pass over
it; samples are a few names, smallest first, and are fetched only for a check
that fails.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import ids
from ..functions import text as tx
from ..sources import catalog
from . import embedstate, index
from . import memory as notes

# Versions, meta keys, providers and the codes in the checks below.
INDEX_VERSION, EMBED_VERSION = 3, 1
META_KEYS = ("schema_version", "embed_provider", "embed_model_id", "embed_dim", "embed_runtime_fingerprint", "chunk_preprocess_sig", "query_preprocess_sig", "vectors_normalized")
PROVIDERS = ("ollama", "http", "torch", "digest")
CHECK = "code string, status string, count long, samples array<string>"
DOC_SAMPLES, CHUNK_SAMPLES, KEY_SAMPLES = 10, 5, 5


def row(code: str, status: str, count: int = 0, samples=()) -> tuple:
    return code, status, int(count), [str(x) for x in samples]


def verdict(bad_code: str, good_code: str, bad, count: int = 0, samples=()) -> tuple:
    return row(bad_code, "fail", count, samples) if bad else row(good_code, "ok", count)


def chunk_counters(chunks: DataFrame, scheme: str) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(tx.is_blank("chunk_key")).alias("no_key"), F.count_if(tx.is_blank("scheme") | (F.col("scheme") != scheme)).alias("other_scheme"))


def schemes(chunks: DataFrame) -> DataFrame:
    return chunks.select(tx.or_token("scheme").alias("scheme")).distinct().orderBy("scheme")


def docs_without_chunks(docs: DataFrame, chunks: DataFrame, most: int = DOC_SAMPLES) -> DataFrame:
    """The paths a failed check names."""
    return index.without_chunks(docs, chunks).select("rel_path").orderBy("rel_path").limit(most)


def chunks_without_docs(chunks: DataFrame, docs: DataFrame, most: int = CHUNK_SAMPLES) -> DataFrame:
    return index.without_doc(chunks, docs).select("id", "doc_id").orderBy("id").limit(most)


def check_settings(cfg: dict) -> list[tuple]:
    """Allowed roots, sources and embedding settings."""
    rows = []
    allowed = cfg["security"]["allowed_roots"]
    missing = [a for a in allowed or [] if not Path(a).is_dir()]
    within = cfg["security"].get("security_root")
    outside = [a for a in allowed or [] if within and config.as_bool(cfg["security"]["roots_must_be_within_security_root"], True) and not catalog.root_allowed(a, [within])]
    if allowed is not None and not allowed:
        rows.append(row("DOCTOR_ALLOWED_ROOTS_EMPTY", "fail"))
    elif missing:
        rows.append(row("DOCTOR_ALLOWED_ROOT_MISSING", "fail", len(missing), missing))
    else:
        rows.append(verdict("DOCTOR_ALLOWED_ROOT_OUTSIDE_SECURITY_ROOT", "DOCTOR_SECURITY_POLICY_OK", outside, len(outside or allowed or []), outside))
    try:
        sources = catalog.parse_sources(cfg["index"]["sources"])
        gone = [f"{s.name}:{s.root}" for s in sources if not Path(s.root.removeprefix("file://")).expanduser().is_dir()]
        rows.append(verdict("DOCTOR_SOURCE_ROOT_MISSING", "DOCTOR_PHASE2_CONFIG_OK", gone, len(gone or sources), gone))
    except config.ConfigError as e:
        rows.append(row("DOCTOR_PHASE2_CONFIG_INVALID", "fail", 0, [e]))
    e = cfg["embed"]
    if e["provider"] not in PROVIDERS:
        rows.append(row("DOCTOR_EMBED_PROVIDER_UNSUPPORTED", "fail", 0, [e["provider"]]))
    try:
        for key, framing in (("chunk_preprocess_sig", ids.CHUNK_FRAMING), ("query_preprocess_sig", ids.QUERY_FRAMING)):
            if e.get(key) and e[key] != ids.preprocess_sig(framing, e["preprocess"]):
                raise ValueError(f"embed.{key} does not match the preprocessing")
        ids.preprocess_sig(ids.CHUNK_FRAMING, e["preprocess"])
    except ValueError as x:
        rows.append(row("DOCTOR_PHASE3_CONFIG_INVALID", "fail", 0, [x]))
    return rows


def check_index(docs: DataFrame, chunks: DataFrame, scheme: str, expected_sig: str, meta: dict[str, str], version: int = INDEX_VERSION) -> list[tuple]:
    rows = [verdict("DOCTOR_INDEX_SCHEMA_VERSION", "DOCTOR_INDEX_SCHEMA_OK", version != INDEX_VERSION, version)]
    n = chunk_counters(chunks, scheme).first()
    rows.append(verdict("DOCTOR_INDEX_EMPTY", "DOCTOR_INDEX_NONEMPTY", n["chunks"] == 0, n["chunks"]))
    bare, lost = index.without_chunks(docs, chunks).count(), index.without_doc(chunks, docs).count()
    named = [r[0] for r in docs_without_chunks(docs, chunks).collect()] if bare and "rel_path" in docs.columns else []
    rows.append(verdict("DOCTOR_DOCS_WITHOUT_CHUNKS", "DOCTOR_DOCS_WITHOUT_CHUNKS_OK", bare, bare, named))
    named = [f"{r['id']}:{r['doc_id']}" for r in chunks_without_docs(chunks, docs).collect()] if lost and "id" in chunks.columns else []
    rows.append(verdict("DOCTOR_CHUNKS_WITHOUT_DOCS", "DOCTOR_CHUNKS_WITHOUT_DOCS_OK", lost, lost, named))
    if n["chunks"]:
        rows.append(verdict("DOCTOR_CHUNK_KEY_MISSING", "DOCTOR_CHUNK_KEY_OK", n["no_key"], n["no_key"]))
        found = [r[0] for r in schemes(chunks).limit(KEY_SAMPLES).collect()] if n["other_scheme"] else []
        rows.append(verdict("DOCTOR_CHUNK_SCHEME_MISMATCH", "DOCTOR_CHUNK_SCHEME_OK", n["other_scheme"], n["other_scheme"], found))
        sig = meta.get("chunker_sig")
        rows.append(verdict("DOCTOR_CHUNKER_SIG_MISSING", "DOCTOR_CHUNKER_SIG_OK", not sig))
        if sig:
            rows.append(verdict("DOCTOR_CHUNKER_SIG_MISMATCH", "DOCTOR_CHUNKER_SIG_MATCH", sig != expected_sig))
    return rows


#: Meta key -> code if what is stored differs from what is wanted.
MISMATCH = {
    "embed_provider": "DOCTOR_EMBED_PROVIDER_MISMATCH", "embed_model_id": "DOCTOR_EMBED_MODEL_MISMATCH", "chunk_preprocess_sig": "DOCTOR_EMBED_CHUNK_PREPROCESS_SIG_MISMATCH",
    "query_preprocess_sig": "DOCTOR_EMBED_QUERY_PREPROCESS_SIG_MISMATCH", "embed_runtime_fingerprint": "DOCTOR_EMBED_RUNTIME_FINGERPRINT_MISMATCH",
}


def check_embeddings(chunks: DataFrame, embeddings: DataFrame, meta: dict[str, str], want: dict[str, str | None], version: int = EMBED_VERSION, required: bool = False) -> list[tuple]:
    """Counts that are not zero fail only if embeddings are ``required``, and
    warn otherwise."""
    rows = [row("DOCTOR_EMBED_SCHEMA_VERSION", "fail", version)] if version != EMBED_VERSION else []
    gone = [k for k in META_KEYS if not meta.get(k)]
    if gone:
        rows.append(row("DOCTOR_EMBED_META_MISSING", "fail", len(gone), gone))
    if "embed_runtime_fingerprint" in want and want["embed_runtime_fingerprint"] is None:
        rows.append(row("DOCTOR_EMBED_RUNTIME_FINGERPRINT_ERROR", "fail"))
    for key, code in MISMATCH.items():
        if want.get(key) and meta.get(key) and meta[key] != want[key]:
            rows.append(row(code, "fail", 0, [meta[key], want[key]]))
    if meta.get("vectors_normalized") != "1":
        rows.append(row("DOCTOR_EMBED_VECTORS_NORMALIZED_INVALID", "fail", 0, [meta.get("vectors_normalized") or ""]))
    if not gone:
        keyed = chunks.where(~tx.is_blank("chunk_key")).select("chunk_key", F.col("sha256").alias("chunk_sha"))
        dim = int(meta["embed_dim"])
        n = embedstate.plan_counts(embedstate.plan(keyed, embeddings, want.get("embed_model_id") or meta["embed_model_id"], dim, want.get("chunk_preprocess_sig") or meta["chunk_preprocess_sig"])).first()
        wrong = embeddings.where((F.size("vector") != F.col("dim")) | (F.col("dim") != dim)).count()
        for kind, k in (("MISSING", n["missing"]), ("OUTDATED", n["outdated"]), ("DIM_MISMATCH", wrong), ("ORPHANS", n["orphans"])):
            if not k:
                rows.append(row(f"DOCTOR_EMBED_{kind}_OK", "ok"))
            elif required:  # else drift is no finding
                rows.append(row(f"DOCTOR_EMBED_{kind}_REQUIRE_PHASE3", "fail", k))
    return rows


def check_memory(evidence: DataFrame, chunks: DataFrame) -> list[tuple]:
    keys = notes.dangling(evidence, chunks).select("chunk_key").distinct()
    n = keys.count()
    named = [r[0] for r in keys.orderBy("chunk_key").limit(KEY_SAMPLES).collect()] if n else []
    return [verdict("DOCTOR_MEMORY_DANGLING_EVIDENCE", "DOCTOR_MEMORY_DANGLING_EVIDENCE_OK", n, n, named)]


def check(docs: DataFrame, chunks: DataFrame, scheme: str, expected_sig: str, meta: dict[str, str], schema_version: int = INDEX_VERSION, embeddings: DataFrame | None = None, embed_meta: dict[str, str] | None = None, expected_embed: dict[str, str] | None = None, evidence: DataFrame | None = None, require_embeddings: bool = False) -> DataFrame:
    """All checks of the stores' tables."""
    rows = check_index(docs, chunks, scheme, expected_sig, meta, schema_version)
    if embeddings is not None and embed_meta is not None:
        rows += check_embeddings(chunks, embeddings, embed_meta, expected_embed or {}, required=require_embeddings)
    if evidence is not None:
        rows += check_memory(evidence, chunks)
    return docs.sparkSession.createDataFrame(rows, CHECK)


def summary(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame, embed_meta: dict[str, str], index_meta: dict[str, str]) -> DataFrame:
    """One row: totals of the stores and the settings their meta tables hold."""
    counts = docs.agg(F.count("*").alias("docs_total")).crossJoin(chunks.agg(F.count("*").alias("chunks_total"))).crossJoin(embeddings.agg(F.count("*").alias("embeddings_total")))  # one row each
    meta = {"chunker_sig": index_meta.get("chunker_sig"), **{k: embed_meta.get(k) for k in META_KEYS}}
    return counts.select("*", *[F.lit(v).cast("string").alias(k) for k, v in meta.items()])
