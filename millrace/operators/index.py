"""Incremental index as change-set joins over document and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import ids
from ..functions import text as tx
from ..scratch import materialize
from ..sources.markdown import LIST_ERROR
from ..sources.store import bucket_of
from .chunking import chunk_column
from .frontmatter import parse_column

DOC_KEY = ["source_id", "rel_path"]


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """By name; root and kind from ``new``, id and created_at stay."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    n, o = new.alias("n"), old.alias("o")
    merged = o.join(n, F.col("o.name") == F.col("n.name"), "full_outer").crossJoin(F.broadcast(top))  # one row
    fresh = F.sum(F.when(F.col("o.id").isNull(), 1).otherwise(0)).over(Window.orderBy(F.col("o.id").isNotNull(), "n.name"))  # the source catalogue: a few rows
    return merged.select(
        F.coalesce("o.id", F.col("top") + fresh).cast("long").alias("id"), F.coalesce("n.name", "o.name").alias("name"),
        F.coalesce("n.root", "o.root").alias("root"), F.coalesce("n.kind", "o.kind").alias("kind"), F.coalesce("o.created_at", "n.created_at").alias("created_at"),
    )


def change_set(old: DataFrame, new: DataFrame, keys: list[str] = DOC_KEY) -> DataFrame:
    """new | changed | unchanged | vanished for every key of either side."""
    o = old.select(*keys, F.col("sha256").alias("old_sha"))
    n = new.select(*keys, F.col("sha256").alias("new_sha"))
    status = (
        F.when(F.col("old_sha").isNull(), "new").when(F.col("new_sha").isNull(), "vanished")
        .when(F.col("old_sha") != F.col("new_sha"), "changed").otherwise("unchanged")
    )
    return o.join(n, keys, "full_outer").withColumn("status", status)


def prune(docs: DataFrame, keep: DataFrame, visited: DataFrame | None = None, keys: list[str] = DOC_KEY) -> DataFrame:
    """Documents that stay: in ``keep``, or of a source that was not visited."""
    gone = docs.join(keep.select(*keys), keys, "left_anti")
    if visited is not None:
        gone = gone.join(visited.select("source_id"), "source_id", "left_semi")
    return docs.join(gone.select(*keys), keys, "left_anti")


def rechunk_needed(docs: DataFrame, chunks: DataFrame, scheme: str) -> DataFrame:
    """(id, needed): no chunks, a blank key, a blank scheme or another scheme."""
    per = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(tx.is_blank("chunk_key")).alias("no_key"),
        F.count_if(tx.is_blank("scheme")).alias("no_scheme"), F.count_if(~tx.is_blank("scheme") & (F.col("scheme") != scheme)).alias("other"),
    )
    found = docs.select("id").join(per, docs["id"] == per["doc_id"], "left")
    return found.select("id", (F.coalesce("n", F.lit(0)) == 0).alias("__none"), (F.coalesce(F.col("no_key") + F.col("no_scheme") + F.col("other"), F.lit(0)) > 0).alias("__bad")).select("id", (F.col("__none") | F.col("__bad")).alias("needed"))


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.join(chunks.select(F.col("doc_id").alias("id")), "id", "left_anti")


def without_doc(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def number_in_order(rows: DataFrame, *order: Column, stage=materialize) -> DataFrame:
    """``rows`` plus ``number``, 1 to n in ``order``: sorted by range, numbered
    inside each partition and shifted by the partitions before it, so no task
    sees more than its range.  ``stage`` holds the ranges still for both uses."""
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("__part", part).join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn("number", F.col("__before") + inside + 1).drop("__part", "__before", "__at")


def is_list_error() -> Column:
    return F.coalesce(F.col("error").startswith(LIST_ERROR), F.lit(False))


def index_documents(files: DataFrame, old_docs: DataFrame, old_chunks: DataFrame, visited: DataFrame, chunking: Chunking = Chunking(), old_sig: str | None = None, rebuild: bool = False, now: Column | None = None, stage=materialize) -> dict[str, DataFrame]:
    """One index run.

    ``files``: source_id, rel_path, abs_path, text, mtime, size, error.  A row
    with an error keeps what the index had; a source with a ``LIST_ERROR`` is
    not pruned.  Returns ``docs``, ``chunks``, ``actions`` (a row for each
    document touched), ``errors``, ``summary`` (one row), and what differs from
    before: ``new_docs``, ``new_chunks`` and ``touched`` (the ids of documents
    that are new, changed or gone).

    ``files`` are read once: what the run decided about each, and the chunks of
    those that need them, are put down by ``stage`` and all results come from
    that.  Only documents that must be chunked again reach the chunker.
    """
    now = F.current_timestamp().cast("double") if now is None else now
    force = rebuild or old_sig != ids.chunker_sig(chunking.scheme, chunking.max_chars, chunking.overlap)
    need = rechunk_needed(old_docs, old_chunks, chunking.scheme)
    had = old_docs.join(need, "id").select(*DOC_KEY, F.col("id").alias("old_id"), F.col("sha256").alias("old_sha"), F.col("discovered_at").alias("old_seen"), "needed")
    redo = F.col("error").isNull() & (F.lit(force) | F.col("old_id").isNull() | (F.col("old_sha") != F.col("sha256")) | F.col("needed"))
    scan = files.withColumn("sha256", ids.sha256("text")).join(had, DOC_KEY, "left").withColumn("redo", redo)
    body = F.when(F.col("redo"), F.col("text"))  # no other text reaches the parser or the chunker
    scan = scan.withColumns({"fm": parse_column(body), "pieces": F.when(F.col("redo"), chunk_column(body, chunking))})
    scan = stage(scan.drop("text", "old_sha", "needed"), "index-scan")

    top = old_docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = scan.where("redo AND old_id IS NULL AND size(pieces) > 0").select(*DOC_KEY)
    # ids follow (source, lower-cased path), from the largest id so far on
    numbered = number_in_order(fresh, F.col("source_id"), F.lower("rel_path"), F.col("rel_path"), stage=stage).crossJoin(F.broadcast(top)).select(*DOC_KEY, (F.col("top") + F.col("number")).alias("new_id"))
    kept = scan.where("redo AND size(pieces) > 0").join(numbered, DOC_KEY, "left").withColumn("id", F.coalesce("old_id", "new_id").cast("long"))
    fields = {
        "is_markdown": F.lit(1), "discovered_at": F.coalesce("old_seen", now), "updated_at": now,
        **{c: F.col(f"fm.{c}") for c in ("yaml_present", "yaml_parse_ok", "yaml_error", "required_keys_present", "frontmatter_json")},
    }
    new_docs = kept.select(*[(fields[c] if c in fields else F.col(c)).alias(c) for c in old_docs.columns])
    exploded = kept.select(F.col("id").alias("doc_id"), "rel_path", F.explode("pieces").alias("c")).select("doc_id", "rel_path", "c.*")
    exploded = exploded.withColumn("sha256", ids.sha256("text")).withColumn("scheme", F.lit(chunking.scheme))
    exploded = exploded.withColumn("chunk_key", ids.chunk_key("rel_path", "scheme", "heading_path", "section_ordinal", "chunk_ordinal", "sha256"))
    named = {"id": F.xxhash64("doc_id", "chunk_index"), "created_at": now}
    new_chunks = exploded.select(*[(named[c] if c in named else F.col(c)).alias(c) for c in old_chunks.columns])

    # one change-set join: stay | redo | vanished for every document of before
    whole = visited.join(scan.where(is_list_error()).select("source_id").distinct(), "source_id", "left_anti").withColumn("__visited", F.lit(True))
    found = scan.where(~is_list_error()).select(*DOC_KEY, F.col("redo").alias("__redo"))
    fate = F.when(F.col("__redo"), "redo").when(F.col("__redo").isNull() & F.col("__visited"), "vanished").otherwise("stay")
    before = old_docs.join(found, DOC_KEY, "left").join(F.broadcast(whole), "source_id", "left").withColumn("__fate", fate)  # a row for each source
    stay = before.where("__fate = 'stay'").select(*old_docs.columns)
    docs = stay.unionByName(new_docs)
    chunks = old_chunks.join(stay.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(*old_chunks.columns).unionByName(new_chunks)

    failed = scan.where("error IS NOT NULL").select(*DOC_KEY, "error")
    action = F.when(F.col("error").isNotNull(), "error").when(~F.col("redo"), "unchanged").when(F.size("pieces") > 0, "changed").otherwise("pruned")
    touched = scan.select(*DOC_KEY, action.alias("action"), (~is_list_error()).alias("seen"), F.when(F.col("redo"), F.size("pieces")).otherwise(0).alias("written"))
    vanished = before.where("__fate = 'vanished'").select(*DOC_KEY, F.lit("pruned").alias("action"), F.lit(False).alias("seen"), F.lit(0).alias("written"))
    actions = touched.unionByName(vanished)
    count = lambda a: F.count_if(F.col("action") == a)
    summary = actions.agg(
        F.count_if("seen").alias("docs_seen"), count("changed").alias("docs_changed"), count("unchanged").alias("docs_unchanged"), count("pruned").alias("docs_pruned"),
        F.coalesce(F.sum("written"), F.lit(0)).cast("long").alias("chunks_written"), count("error").alias("errors"),
    )
    gone = before.where("__fate <> 'stay'").select("id")
    changes = {"new_docs": new_docs, "new_chunks": new_chunks, "touched": gone.union(new_docs.select("id")).distinct()}
    return changes | {"docs": docs, "chunks": chunks, "actions": actions.select(*DOC_KEY, "action"), "errors": failed, "summary": summary}


def write_changes(store, base, done: dict[str, DataFrame], whole: bool = False) -> dict:
    """Writes what a run changed: the buckets that hold a touched document, or
    both tables if they are to be ``whole`` or have no buckets yet."""
    if whole or not base.buckets("docs") or not base.buckets("chunks"):
        return store.write({"docs": done["docs"], "chunks": done["chunks"]})
    n = {name: base.buckets(name) for name in ("docs", "chunks")}
    ids_ = store.stage(done["touched"], "touched")
    touched = {name: [r[0] for r in ids_.select(bucket_of("id", k)).distinct().collect()] for name, k in n.items()}  # bucket numbers
    if not touched["docs"]:
        return {}
    docs = base.table("docs", only=touched["docs"]).join(ids_, "id", "left_anti").unionByName(done["new_docs"])
    chunks = without_doc(base.table("chunks", only=touched["chunks"]), ids_).unionByName(done["new_chunks"])
    return store.write({"docs": docs, "chunks": chunks}, touched, base)
