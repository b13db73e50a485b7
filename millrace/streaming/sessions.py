"""Sessions of an event stream, with late data.

Events repeated within the watermark count once (by ``event_id``), sessions are
windows that end after a gap without events, and state older than the watermark
expires.  A finished session is written once, in append mode.  Events later than
the watermark go to no session; they are counted against the high-water mark of
the batches before, which is kept beside the output, so a restart from the
checkpoint goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, by: str, time: str, gap: str, lateness: str, key: str = "event_id") -> DataFrame:
    """by, session_start, session_end (the last event plus the gap), events.
    ``events`` is a stream, or a table, for which the result is the same but for
    late rows."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.withColumn(time, F.col(time).cast("timestamp")).dropDuplicates([key])
    found = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(by)).agg(F.count("*").alias("events"))
    return found.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def start(events: DataFrame, out: str, checkpoint: str, by: str, time: str, gap: str, lateness: str, key: str = "event_id", **trigger) -> StreamingQuery:
    """Writes finished sessions as Parquet under ``out``."""
    writer = sessions(events, by, time, gap, lateness, key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped as late, over the query's batches."""
    return sum(int(s.get("numRowsDroppedByWatermark") or 0) for p in query.recentProgress for s in p["stateOperators"])
