"""Index as a stream: every micro-batch of files is one index run.

An addition to the batch engine: ``foreachBatch`` hands each batch to the
change-set merge of ``operators.index`` and writes the buckets it touches, again
on the newer tables if another writer was first, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Chunking
from ..functions import ids
from ..operators import index
from ..sources.store import Store


def index_batch(files: DataFrame, store: Store, chunking: Chunking) -> None:
    """Merge one batch; documents that are not in it stay."""
    newest = files.groupBy("source_id", "rel_path").agg(F.max_by(F.struct(*[c for c in files.columns if c not in ("source_id", "rel_path")]), "mtime").alias("v")).select("source_id", "rel_path", "v.*")
    visited = files.sparkSession.createDataFrame([], "source_id long")
    sig = ids.chunker_sig(chunking.scheme, chunking.max_chars, chunking.overlap)

    def derive(base):
        done = index.index_documents(newest, base.table("docs"), base.table("chunks"), visited, chunking, old_sig=sig, stage=store.stage)
        return index.write_changes(store, base, done), {"chunker_sig": sig}

    try:
        store.retry(derive)
    finally:
        store.unstage()


def start(files: DataFrame, store: Store, checkpoint: str, chunking: Chunking = Chunking(), **trigger) -> StreamingQuery:
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: index_batch(df, store, chunking))
    return (writer.trigger(**trigger) if trigger else writer).start()
