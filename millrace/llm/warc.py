"""WARC archives: a native writer and a Python data source that reads them.

Writing is one expression per record and Spark's text sink, so archives go to
any store Spark can write, with its commit protocol.  Reading is a Python data
source, ``spark.read.format("warc")``: whole files are planned into partitions
of about ``split_bytes``; equality and IN predicates on ``record_type`` and on
header columns are pushed into the reader; headers are parsed first, and the
block of a record that a predicate refuses, or whose payload the requested
schema leaves out, is skipped by its Content-Length and never decoded.

Records with equal payloads of at least ``min_revisit`` bytes are stored once,
under the smallest id; the others become revisit records.  Digests that occur
more than once are set in a bitmap of ``FILTER_BITS`` bits; only rows that hit
it are joined with their response, all others are written where they are read.
That join goes without bodies; those of responses follow by digest and id.

Defined results: a null payload is empty; payloads of any length are written and
read whole; rows that share the smallest id of a
payload are all responses; a null id sorts last; an empty table gives an
archive without records; columns other than those named are left out of it.
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .common import materialize, scratch_path, table

MIN_REVISIT = 100
SPLIT_BYTES = 64 << 20
#: Bits of the filter of repeated digests (2 MB, whatever the input).
FILTER_BITS = 1 << 24
_BITS_PER_BUCKET = 1 << 15  # of Spark's bitmap functions
SCHEMA = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("content_length", T.LongType()), T.StructField("refers_to", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to_page", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])
#: Result column -> header field.
FIELDS = {
    "record_type": b"warc-type", "record_id": b"warc-record-id", "target_uri": b"warc-target-uri", "payload_digest": b"warc-payload-digest",
    "content_length": b"content-length", "refers_to": b"warc-refers-to", "page_id": b"x-page-id", "payload_bytes": b"x-payload-length", "refers_to_page": b"x-refers-to-page-id",
}
LONGS = {"content_length", "page_id", "payload_bytes", "refers_to_page"}


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def warc_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the record text of each row, without the last CRLF."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("__id"), F.regexp_replace(F.coalesce(F.col(uri).cast("string"), F.lit("")), "[\\r\\n]", "").alias("__uri"), body.alias("__body"))
    rows = rows.withColumns({"__digest": F.sha2(F.col("__body").cast("binary"), 256), "__bytes": F.octet_length("__body").cast("long")})
    shared = repeated_digests(rows, min_revisit)
    place = F.pmod(F.xxhash64("__digest"), F.lit(FILTER_BITS))
    bucket, bit = F.floor(place / _BITS_PER_BUCKET).cast("int"), (place % _BITS_PER_BUCKET).cast("int")
    filled = shared.select(bucket.alias("__bucket"), bit.cast("long").alias("bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__map"))
    marked = rows.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(filled), "__bucket", "left")  # FILTER_BITS at most
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col("__bit") % 8) == 1, F.lit(False)) & (F.col("__bytes") >= min_revisit)
    marked = marked.withColumn("__hit", hit).drop("__bucket", "__bit", "__map")
    alone = marked.where(~F.col("__hit")).drop("__hit").withColumn("__first", F.lit(None).cast(shared.schema["__first"].dataType))
    met = marked.where("__hit").drop("__hit")
    # which of these are revisits is found without their bodies; only the others' bodies are joined, by digest and id
    roles = met.drop("__body").join(shared, "__digest", "left")
    again = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    revisits = roles.where(again).withColumn("__body", F.lit(""))
    firsts = roles.where(~again).select(F.col("__digest").alias("__d"), F.col("__id").alias("__i"), "__first").distinct()
    bodies = met.join(firsts, (F.col("__digest") == F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i"))).drop("__d", "__i")
    rows = alone.unionByName(bodies).unionByName(revisits)
    revisit = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    crlf = "\r\n"
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(crlf))
    http = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("__bytes").cast("string"), F.lit(crlf * 2)))
    kept = F.when(revisit, F.lit("")).otherwise(F.col("__body"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _uuid(F.col("__id"), F.col("__digest"))), field("WARC-Target-URI", F.col("__uri")), field("WARC-Date", F.lit(date)),
        F.lit(f"Content-Type: application/http; msgtype=response{crlf}"), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
        F.coalesce(field("X-Page-ID", F.col("__id")), F.lit("")), field("X-Payload-Length", F.col("__bytes")),
        F.when(revisit, F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}"),
            field("WARC-Refers-To", _uuid(F.col("__first"), F.col("__digest"))), field("X-Refers-To-Page-ID", F.col("__first")),
        )).otherwise(F.lit("")),
        field("Content-Length", F.octet_length(http) + F.octet_length(kept)),
    )
    return rows.select(F.concat(head, F.lit(crlf), http, kept, F.lit(crlf)).alias("value"))


def repeated_digests(rows: DataFrame, min_revisit: int) -> DataFrame:
    """(__digest, __first): a row for each payload that occurs more than once;
    partial counts come before the shuffle."""
    counts = rows.where(F.col("__bytes") >= min_revisit).groupBy("__digest").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    return materialize(counts.where("__n > 1").drop("__n"), "repeated-digests")


def write_warc(pages: DataFrame, path: str, records_per_file: int = 100_000, **names) -> None:
    warc_records(pages, **names).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def open_store(path: str):
    """(pyarrow file system, path in it) of any URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_records(f, columns: list[str], tests: dict[str, set]) -> Iterator[tuple]:
    """Records of an open archive; ``tests`` maps columns to allowed values."""
    want = "payload" in columns
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not at a WARC record: {line[:60]!r}")
        head = {}
        while (line := f.readline()).strip():
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        size = int(head.get(b"content-length", "0"))
        row = {c: head.get(h) for c, h in FIELDS.items()}
        row = {c: int(v) if c in LONGS and v is not None else v for c, v in row.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
        if any(row[c] not in allowed for c, allowed in tests.items()):
            f.seek(size + 2, io.SEEK_CUR)
            continue
        if want and row["record_type"] != "revisit":
            block = f.read(size)
            row["payload"] = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
            f.seek(2, io.SEEK_CUR)
        else:
            row["payload"] = None
            f.seek(size + 2, io.SEEK_CUR)
        yield tuple(row[c] for c in columns)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
                at = f.attribute[0]
                self.tests[at] = self.tests.get(at, allowed) & allowed
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, largest first, packed up to ``split_bytes``."""
        from pyarrow import fs

        store, root = open_store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(((x.size, x.path) for x in found if x.type == fs.FileType.File and x.size and posixpath.basename(x.path)[0] not in "._"), reverse=True)
        plan: list[list[str]] = []
        room = 0
        for size, path in files:
            if not plan or size > room:
                plan.append([])
                room = self.split_bytes
            plan[-1].append(path)
            room -= size
        return [Files(p) for p in plan] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = open_store(self.path)
        for path in partition.paths:
            if path.endswith(".gz"):
                import gzip

                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    yield from read_records(f, self.columns, self.tests)
            else:
                with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as f:
                    yield from read_records(f, self.columns, self.tests)


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(columns).load(path)``; options: path, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        unknown = set(schema.fieldNames()) - set(SCHEMA.fieldNames())
        if unknown:
            raise ValueError(f"no such WARC columns: {sorted(unknown)}")
        return WarcReader(schema, dict(self.options))


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    asked = T.StructType([SCHEMA[c] for c in columns or SCHEMA.fieldNames()])
    return spark.read.format("warc").schema(asked).option("split_bytes", split_bytes).load(path)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)
    full = read_warc(spark, path, ["record_type", "page_id", "payload"]).where("record_type = 'response'")
    bare = read_warc(spark, path, ["record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_page"]).where("record_type = 'revisit'")
    responses = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = bare.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))
    return responses.unionByName(revisits)


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
  q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest, body FROM p),
  r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM q)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to FROM r"""
