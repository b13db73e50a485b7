"""Embedding state: drift, upsert, orphans, verification."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import embedders
from ..functions import ids
from ..functions import text as tx
from ..functions import vectors as vx


def chunks_to_embed(chunks: DataFrame, docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks with a key, their path and framed text, one for each key; the first
    ``limit`` by key.

    The limited list is also what pruning keeps: with a limit, embeddings of
    all other chunks count as orphans.
    """
    paths = docs.select(F.col("id").alias("doc_id"), "rel_path")
    rows = one_for_each_key(chunks.where(~tx.is_blank("chunk_key"))).join(paths, "doc_id")
    rows = rows.select("chunk_key", "rel_path", F.coalesce("heading_path", F.lit("")).alias("heading_path"), "text", F.col("sha256").alias("chunk_sha"))
    return rows if limit is None else rows.orderBy("chunk_key").limit(max(0, limit))


def one_for_each_key(chunks: DataFrame) -> DataFrame:
    """Of chunks with equal keys (one path in two sources) that of the smallest
    document id.  Only keys and places are shuffled; the rows that go are few."""
    places = chunks.select("chunk_key", "doc_id", "chunk_index")
    again = places.groupBy("chunk_key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "chunk_index")).alias("first")).where("n > 1").drop("n")
    extra = places.join(again, "chunk_key").where(F.struct("doc_id", "chunk_index") != F.col("first")).select("doc_id", "chunk_index").distinct()
    return chunks.join(extra, ["doc_id", "chunk_index"], "left_anti")


def drift(chunks: DataFrame, embeddings: DataFrame, model_id: str, dim: int, preprocess_sig: str) -> DataFrame:
    """chunk_key, chunk_sha, expected sig, status missing | outdated | ok."""
    want = chunks.withColumn("expected_sig", ids.embed_sig("chunk_key", "chunk_sha", model_id, dim, preprocess_sig))
    have = embeddings.select("chunk_key", F.col("embed_sig"), F.col("model_id"), F.col("dim"), F.col("preprocess_sig"))
    same = (F.col("embed_sig") == F.col("expected_sig")) & (F.col("model_id") == model_id) & (F.col("dim") == dim) & (F.col("preprocess_sig") == preprocess_sig)
    status = F.when(F.col("embed_sig").isNull(), "missing").when(same, "ok").otherwise("outdated")
    return want.join(have, "chunk_key", "left").withColumn("status", status)


def drift_counts(drifted: DataFrame, rebuild: bool = False) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return drifted.agg(count("missing").alias("missing"), count("outdated").alias("outdated"), (F.lit(0).cast("long") if rebuild else count("ok")).alias("ok"))


def orphans(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select("chunk_key"), "chunk_key", "left_anti")


def without_orphans(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    return embeddings.join(chunks.select("chunk_key"), "chunk_key", "left_semi")


def lookup(embeddings: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``embeddings`` whose key is in ``keys``."""
    return embeddings.join(keys.select("chunk_key").distinct(), "chunk_key", "left_semi")


def embed_texts(rows: DataFrame, provider: dict | Callable[[list[str]], list[list[float]]] | None, dim: int, batch_size: int = 64) -> DataFrame:
    """``rows`` plus ``vector``, of length one, in double precision (a store
    keeps floats; who compares or rounds components does so before that).

    Without a provider the digest embedding, which needs no Python.  Settings
    (a mapping) go to the workers, and each makes its provider from them once;
    a function is sent as it is.  Either is called once for each batch of texts.
    """
    framed = tx.frame_chunk("rel_path", "heading_path", "text")
    if provider is None:
        return rows.withColumn("vector", vx.normalize(vx.digest_vector(framed, dim)))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = embedders.in_worker(provider) if isinstance(provider, dict) else provider
        for s in batches:
            out: list = []
            texts = s.tolist()
            for i in range(0, len(texts), batch_size):
                got = call(texts[i : i + batch_size])
                if len(got) != len(texts[i : i + batch_size]) or any(len(v) != dim for v in got):
                    raise ValueError("the provider returned vectors of another number or dimension")
                out += map(vx.unit, got)
            yield pd.Series(out)

    return rows.withColumn("vector", run(framed))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with their key; ``new`` has a key once."""
    return old.join(new.select("chunk_key"), "chunk_key", "left_anti").unionByName(new)


def embed_run(chunks: DataFrame, embeddings: DataFrame, model_id: str, dim: int, preprocess_sig: str, provider=None, rebuild: bool = False, prune: bool = True, now=None, batch_size: int = 64) -> dict[str, DataFrame]:
    """One embedding run: drift, embed what is missing or outdated, merge."""
    kept = without_orphans(embeddings, chunks) if prune else embeddings
    kept = kept.withColumn("vector", F.col("vector").cast("array<double>"))
    drifted = drift(chunks, kept, model_id, dim, preprocess_sig)
    todo = drifted if rebuild else drifted.where("status <> 'ok'")
    made = embed_texts(todo.select("chunk_key", "rel_path", "heading_path", "text", "expected_sig"), provider, dim, batch_size)
    made = made.select("chunk_key", F.col("expected_sig").alias("embed_sig"), F.lit(model_id).alias("model_id"), F.lit(dim).alias("dim"), F.lit(preprocess_sig).alias("preprocess_sig"), "vector", (F.current_timestamp().cast("double") if now is None else now).alias("embedded_at"))
    return {"embeddings": upsert(kept, made), "counts": drift_counts(drifted, rebuild), "orphans": orphans(embeddings, chunks).agg(F.count("*").alias("orphans"))}


def unverified(chunks: DataFrame, embeddings: DataFrame, model_id: str, dim: int, preprocess_sig: str) -> DataFrame:
    """Chunks whose stored row does not carry the signature it must: none after a good run."""
    return drift(chunks, embeddings, model_id, dim, preprocess_sig).where("status <> 'ok'").select("chunk_key", "status")


def plan(chunks: DataFrame, embeddings: DataFrame, model_id: str, dim: int, preprocess_sig: str, rebuild: bool = False, prune: bool = True) -> DataFrame:
    """chunk_key, expected_sig, status (missing | outdated | ok | orphan), write,
    drop of every key on either side, without text or vectors: one full join."""
    want = chunks.select("chunk_key", ids.embed_sig("chunk_key", "chunk_sha", model_id, dim, preprocess_sig).alias("expected_sig"))
    same = (F.col("model_id") == model_id) & (F.col("dim") == dim) & (F.col("preprocess_sig") == preprocess_sig)
    have = embeddings.select("chunk_key", "embed_sig", same.alias("same"))
    status = (
        F.when(F.col("expected_sig").isNull(), "orphan").when(F.col("embed_sig").isNull(), "missing")
        .when((F.col("embed_sig") == F.col("expected_sig")) & F.col("same"), "ok").otherwise("outdated")
    )
    rows = want.join(have, "chunk_key", "full_outer").select("chunk_key", "expected_sig", status.alias("status"))
    write = F.col("status") != "orphan" if rebuild else F.col("status").isin("missing", "outdated")
    return rows.withColumns({"write": write, "drop": (F.col("status") == "orphan") & F.lit(prune)})


def plan_counts(planned: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row: total, missing, outdated, ok, orphans, to_write."""
    count = lambda s: F.count_if(F.col("status") == s)
    return planned.agg(
        F.count_if(F.col("status") != "orphan").alias("total"), count("missing").alias("missing"), count("outdated").alias("outdated"),
        (F.lit(0).cast("long") if rebuild else count("ok")).alias("ok"), count("orphan").alias("orphans"), F.count_if("write").alias("to_write"),
    )


def unsigned(planned: DataFrame, embeddings: DataFrame, model_id: str, dim: int, preprocess_sig: str) -> DataFrame:
    """Written keys whose stored row is not there once, with its signature: none after a good run."""
    good = embeddings.where((F.col("model_id") == model_id) & (F.col("dim") == dim) & (F.col("preprocess_sig") == preprocess_sig)).groupBy("chunk_key").agg(F.count("*").alias("n"), F.max("embed_sig").alias("sig"))
    return planned.where("write").join(good, "chunk_key", "left").where("sig IS NULL OR n <> 1 OR sig <> expected_sig").select("chunk_key")
