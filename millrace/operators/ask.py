"""Grounded answers, all but the model call: evidence, snapshot, prompt, gate,
and what becomes of an answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from . import citations, evidence, retrieval


@dataclass
class Grounding:
    evidence: DataFrame  # ranked rows admitted
    prompt: DataFrame  # one row
    snapshot: DataFrame  # chunk_key, chunk_sha of what was admitted
    log: DataFrame  # excerpts within the budget
    found: retrieval.Retrieval

    @property
    def warnings(self) -> list[str]:
        return self.found.warnings


@dataclass
class Outcome:
    """What a question came to; ``text`` is what the user gets."""

    ok: bool
    text: str
    footer: str
    gate: str
    error_code: str | None = None


def ground(found: retrieval.Retrieval, question: str, cfg: dict) -> Grounding:
    n = max(1, int(cfg["evidence"]["top_n"]))
    order = retrieval.fusion_order()
    top = evidence.top_n(found.candidates, n, *order).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows
    log = evidence.budget(top, cfg["evidence"]["max_total_chars"], cfg["evidence"]["max_excerpt_chars"])
    return Grounding(top, evidence.evidence_prompt(top, question, n), top.select("chunk_key", F.col("sha256").alias("chunk_sha")), log, found)


#: Candidates whose keys the run record names.
KEYS_LOGGED = 20


def retrieval_record(question: str, grounding: Grounding, cfg: dict, index_meta: dict, embed_meta: dict, sigs: tuple[str, str]) -> dict:
    """What the run record says of the evidence: signatures, counters, budgets
    and caps; all of it from held rows."""
    found, asked = grounding.found, cfg["evidence"]["top_n"]
    note = found.notes.first()
    keys = [r["chunk_key"] for r in found.candidates.select("chunk_key").collect()]  # in order
    admitted = min(max(1, int(asked)), len(keys))
    log = cfg["runs"]["log_evidence_excerpts"]
    rows = grounding.log.where("logged").orderBy("rank").select("rank", "chunk_key", "rel_path", "heading_path", "method", "score", "excerpt", "excerpt_sha", "excerpt_truncated").collect() if log else []
    total = evidence.budget_summary(grounding.log).first() if log else {"omitted": 0, "truncated_total": False}
    # The names of the record's fields.
    return {
        "query": question, "chunker_sig": index_meta.get("chunker_sig"), "embed_model_id": cfg["embed"]["model_id"], "chunk_preprocess_sig": sigs[0], "query_preprocess_sig": sigs[1], "embed_db_schema_version": embed_meta.get("schema_version"),
        "vector_fetch_k_used": found.fetch_k, "vector_candidates_scored": found.scored, "vector_candidates_prefilter": note["prefilter"], "vector_candidates_postfilter": note["postfilter"],
        "rel_path_prefix_applied": found.prefix, "vector_filter_warning": "; ".join(note["warnings"]), "candidates_count": len(keys), "chunk_keys": keys[:KEYS_LOGGED],
        "evidence_budget": {"requested_top_n": asked, "effective_top_n": admitted, "total_retrieval_results_available": len(keys)},
        "evidence_selected_count": admitted, "evidence_omitted_count": len(keys) - admitted, "results": [r.asDict() for r in rows],
        "logging_caps": {"max_total_chars": cfg["evidence"]["max_total_chars"], "max_excerpt_chars": cfg["evidence"]["max_excerpt_chars"]},
        "logging_truncated_total": total["truncated_total"], "results_logged_count": len(rows), "results_omitted_count": total["omitted"],
    }


def judge(answers: DataFrame, chunks: DataFrame, snapshot: DataFrame, cfg: dict) -> DataFrame:
    """The citation report of each answer with outcome, error code and footer."""
    c = cfg["citations"]
    cited = citations.parse(answers)
    audited = citations.audit(cited, chunks, snapshot, c["heading_match"], c["normalize_heading"])
    rows = citations.report(answers, audited, c["require_in_snapshot"])
    rows = rows.withColumn("outcome", citations.gate(c["enabled"], c["strict"])).withColumn("footer", citations.footer())
    return rows.withColumn("error_code", F.when(F.col("outcome") == "strict_fail", "ASK_CITATION_INVALID"))


# The lines over the citations of an answer that has none.
FALLBACK = ("Insufficient citation-grounded answer from model output.", "Evidence excerpt references:")


def outcomes(answers: DataFrame, cited: DataFrame, cfg: dict, fallback: Column | None = None) -> DataFrame:
    """answer_id, ok, text, footer, outcome, error_code of each answer.

    ``cited`` is what ``judge`` says of it.  With checking off an answer without
    a citation is replaced by ``fallback``; a strict failure keeps its text and
    is an error; any other answer goes out with its footer.
    """
    rows = answers.join(cited.select("answer_id", "outcome", F.col("footer").alias("__footer"), "error_code"), "answer_id")
    off = F.col("outcome") == "disabled"
    bare = off & ~F.coalesce(citations.has_citation(F.col("answer_text")), F.lit(False))
    text = F.col("answer_text") if fallback is None else F.when(bare, fallback).otherwise(F.col("answer_text"))
    return rows.select("answer_id", F.col("error_code").isNull().alias("ok"), text.alias("text"), F.when(off, "").otherwise(F.col("__footer")).alias("footer"), F.when(off, "ok").otherwise(F.col("outcome")).alias("outcome"), "error_code")


def decide(raw: str, judged, grounding: Grounding, cfg: dict) -> Outcome:
    """The outcome of one answer, from its judged row."""
    spark = grounding.evidence.sparkSession
    off = judged["outcome"] == "disabled"
    order = retrieval.fusion_order()
    ranked = grounding.found.candidates.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # lexical_k + vector_k rows at most
    fallback = "\n".join([*FALLBACK, fallback_citations(ranked).first()["citations"] or ""]) if off and grounding.snapshot.limit(1).count() else None
    answers = spark.createDataFrame([(judged["answer_id"], raw)], "answer_id long, answer_text string")
    cited = spark.createDataFrame([(judged["answer_id"], judged["outcome"], judged["footer"], judged["error_code"])], "answer_id long, outcome string, footer string, error_code string")
    r = outcomes(answers, cited, cfg, None if fallback is None else F.lit(fallback)).first()
    return Outcome(r["ok"], r["text"], r["footer"], r["outcome"], r["error_code"])


def fallback_citations(top: DataFrame, n: int = 5) -> DataFrame:
    """Citations put under an answer that has none when checking is off."""
    line = citations.render(F.col("rel_path"), F.col("heading_path"), F.col("chunk_key"))
    rows = top.where(F.col("rank") <= n).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("c")))).alias("all"))  # n rows
    return rows.select(F.array_join(F.transform("all", lambda x: x["c"]), "\n").alias("citations"))


def model_columns(cfg: dict, question: Column, force_big: bool = False, force_fast: bool = False) -> Column:
    """struct<first, second>: :func:`millrace.config.select_models` for a column
    of questions.  Only whether a trigger occurs depends on the question."""
    pick = lambda q: F.struct(*[F.lit(m).alias(n) for n, m in zip(("first", "second"), config.select_models(cfg, q, force_big, force_fast))])
    found = F.lit(False)
    triggers = config.trigger_words(cfg)
    for t in triggers:
        found = found | F.coalesce(F.contains(F.lower(question), F.lit(t)), F.lit(False))
    return F.when(found, pick(triggers[0])).otherwise(pick("")) if triggers else pick("")
