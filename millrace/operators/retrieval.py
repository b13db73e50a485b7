"""Lexical and vector top-k, and their fusion.

Retrieval fetches text late: top-k works on keys and scores, text is looked up
for the few rows that are left, and these are held.  Scores are compared after rounding to ``DIGITS``, then
by key, so that every engine cuts ties alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx

DIGITS = 6


def search(chunks: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Substring search in total order: hit position, chunk length, doc id,
    chunk index.  ``chunks`` has doc_id, chunk_index, text and may have more."""
    hits = chunks.withColumn("hit_pos", tx.hit_position("text", query)).where("hit_pos > 0")
    return hits.orderBy("hit_pos", F.length("text"), "doc_id", "chunk_index").limit(max(1, k))


def search_joined(chunks: DataFrame, docs: DataFrame, sources: DataFrame, query: str, k: int = 5) -> DataFrame:
    """``search`` over the index tables, with document and source columns."""
    top = search(chunks.drop("id"), query, k)
    d = docs.withColumnRenamed("id", "doc_id").select("doc_id", "source_id", "rel_path", "abs_path", "yaml_present", "yaml_parse_ok", "yaml_error", "required_keys_present")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
    return top.join(d, "doc_id").join(s, "source_id").orderBy("hit_pos", F.length("text"), "doc_id", "chunk_index")


def rank_scores(hits: DataFrame, *order: Column, key: str = "chunk_key") -> DataFrame:
    """(key, lexical_score): 1 - (rank - 1) / n over the rows returned, the best
    of a key.  ``hits`` is a top-k result, so one task holds k rows."""
    place = Window.orderBy(*order)
    ranked = hits.select(key, F.row_number().over(place).alias("rank"), F.count("*").over(Window.partitionBy()).alias("n"))
    return ranked.groupBy(key).agg(F.max(1.0 - (F.col("rank") - 1) / F.col("n")).alias("lexical_score"))


def vector_scores(vectors: DataFrame, query: list[float], normalized: bool = True, key: str = "chunk_key", vector: str = "vector") -> DataFrame:
    """(key, score) of the rows of the query's dimension with a finite score."""
    q = vx.literal(query)
    length = sum(x * x for x in query) ** 0.5
    score = vx.dot(vector, q) if normalized else vx.cosine(vector, q, length)
    rows = vectors.where(F.size(vector) == len(query)).select(key, score.alias("score"))
    return rows.where(vx.is_finite("score")).withColumn("score", F.round("score", DIGITS))


def vector_topk(vectors: DataFrame, query: list[float], k: int, **how) -> DataFrame:
    key = how.get("key", "chunk_key")
    return vector_scores(vectors, query, **how).orderBy(F.desc("score"), F.asc(key)).limit(max(1, k))


def fetch_size(k: int, fetch_k: int, prefix: str) -> int:
    """With a path prefix more rows are fetched before the filter."""
    if not prefix:
        return k
    return max(1, fetch_k) if fetch_k > 0 else max(50, 5 * k)


def clean_prefix(prefix: str) -> str:
    return (prefix or "").replace("\\", "/").strip()


def fuse(lexical: DataFrame, vector: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Full outer join of (key, lexical_score) and (key, vector_score)."""
    both = lexical.join(vector, key, "full_outer").select(key, F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"))
    lex, vec = F.col("lexical_score") > 0, F.col("vector_score") > 0
    method = F.when(lex & vec, "both").when(lex, "lexical").otherwise("vector")
    score = F.when(lex & vec, (F.col("lexical_score") + F.col("vector_score")) / 2).when(lex, F.col("lexical_score")).otherwise(F.col("vector_score"))
    return both.withColumn("method", method).withColumn("score", score)


def fusion_order(key: str = "chunk_key") -> list[Column]:
    return [F.when(F.col("method") == "both", 0).otherwise(1).asc(), F.desc("score"), F.asc(key)]


@dataclass
class Retrieval:
    """Candidates in order.  ``notes`` is one row of counters; the warnings are
    read from it on demand, so that asking for none costs nothing."""

    candidates: DataFrame
    fetch_k: int
    notes: DataFrame
    #: Vectors with a score, counted by the scan that ranked them.
    scored: int = 0
    prefix: str = ""

    @property
    def warnings(self) -> list[str]:
        return list(self.notes.select("warnings").first()["warnings"])


def places(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_key, rel_path, heading_path, sha256: one row for each chunk key, of
    equal keys in two sources that with the smallest doc id.  No text."""
    first = chunks.groupBy("chunk_key").agg(F.min(F.struct("doc_id", "chunk_index", "heading_path", "sha256")).alias("m")).select("chunk_key", "m.*")
    paths = docs.select(F.col("id").alias("doc_id"), "rel_path")
    return first.join(paths, "doc_id").select("chunk_key", "rel_path", F.coalesce("heading_path", F.lit("")).alias("heading_path"), "sha256")


def lookup(chunks: DataFrame, docs: DataFrame, keys: list[str]) -> list[tuple]:
    """(chunk_key, rel_path, heading_path, text, sha256) of a few chunks, of
    equal keys that with the smallest doc id: one scan of either table, with the
    keys pushed down.  ``keys`` and so the rows are bounded by the caller."""
    rows = chunks.where(F.col("chunk_key").isin(keys)).groupBy("chunk_key").agg(F.min(F.struct("doc_id", "chunk_index", "text", "heading_path", "sha256")).alias("m")).select("chunk_key", "m.*").collect() if keys else []
    paths = dict(docs.where(F.col("id").isin([r["doc_id"] for r in rows])).select("id", "rel_path").collect()) if rows else {}
    return [(r["chunk_key"], paths[r["doc_id"]], r["heading_path"] or "", r["text"], r["sha256"]) for r in rows if r["doc_id"] in paths]


def retrieve(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], lexical_k: int = 20, vector_k: int = 20, vector_fetch_k: int = 0, rel_path_prefix: str = "", normalized: bool = True) -> Retrieval:
    """Fused candidates in order.  The prefix limits the vector side only and
    comes after its top-k; vector hits without a chunk are dropped.

    Three jobs run here: a scan of the chunk texts for the best ``lexical_k``
    keys, a scan of the vectors for the best ``fetch_k``, and a lookup of what
    both found.  Those rows are held, so candidates, notes and all that follows
    read no table again."""
    spark = chunks.sparkSession
    prefix = clean_prefix(rel_path_prefix)
    fetch = fetch_size(vector_k, vector_fetch_k, prefix)
    slim = chunks.select("chunk_key", "doc_id", "chunk_index", tx.hit_position("text", query).alias("hit_pos"), F.length("text").alias("n"))
    one = slim.where("hit_pos > 0").groupBy("chunk_key").agg(F.min(F.struct("hit_pos", "n", "doc_id", "chunk_index")).alias("m")).select("chunk_key", "m.*")
    hits = spark.createDataFrame(one.orderBy("hit_pos", "n", "doc_id", "chunk_index").limit(max(1, lexical_k)).collect(), one.schema)
    lexical = rank_scores(hits, F.col("hit_pos"), F.col("n"), F.col("doc_id"), F.col("chunk_index")).where(~tx.is_blank(F.col("chunk_key").cast("string")))
    seen = Observation("scored")
    best = vector_scores(vectors, query_vector, normalized=normalized).observe(seen, F.count("*").alias("n"))
    best = best.orderBy(F.desc("score"), "chunk_key").limit(max(1, fetch))
    top = spark.createDataFrame(best.collect(), best.schema).groupBy("chunk_key").agg(F.max("score").alias("score"))
    keys = sorted({r["chunk_key"] for r in [*hits.select("chunk_key").collect(), *top.select("chunk_key").collect()] if r["chunk_key"] is not None})
    meta = spark.createDataFrame(lookup(chunks, docs, keys), "chunk_key string, rel_path string, heading_path string, text string, sha256 string")
    known = top.join(meta.select("chunk_key", "rel_path"), "chunk_key", "left")
    fits = F.col("rel_path").isNotNull() & F.replace("rel_path", F.lit("\\"), F.lit("/")).startswith(prefix)
    vector = known.where(fits).orderBy(F.desc("score"), "chunk_key").limit(max(1, vector_k)).select("chunk_key", vx.rescale("score").alias("vector_score"))
    fused = fuse(lexical, vector).join(meta, "chunk_key", "left").where((F.col("lexical_score") > 0) | F.col("rel_path").isNotNull()).orderBy(*fusion_order())
    out = spark.createDataFrame(fused.collect(), fused.schema).orderBy(*fusion_order())  # lexical_k + vector_k rows at most
    notes = known.agg(F.count("*").alias("prefilter"), F.count_if(F.col("rel_path").isNull()).alias("orphans"), F.count_if(fits).alias("postfilter"))
    few_left = F.lit(bool(prefix)) & (F.col("prefilter") > F.col("orphans")) & (F.col("postfilter") < vector_k)
    said = F.array_compact(F.array(
        F.when(few_left, F.format_string(f"rel_path_prefix reduced vector results: %d/{vector_k} (fetched {fetch})", "postfilter")),
        F.when(F.col("orphans") > 0, F.concat(F.lit("dropped orphan vector candidates: "), F.col("orphans").cast("string"))),
    ))
    return Retrieval(out, fetch, notes.withColumn("warnings", said), seen.get["n"], prefix)
