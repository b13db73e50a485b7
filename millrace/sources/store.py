"""Versioned table store: snapshot folders of Parquet and numbered pointers.

A write makes new folders, then the next pointer; the newest complete pointer
counts.  Nothing is changed or replaced, so readers see the old tables or the
new ones, and a crash at any point leaves the old ones.

*Copy on write.*  Documents, chunks and embeddings are cut into buckets by the
hash of their key, and a pointer lists a folder for each bucket.  A run that
touches few keys writes the buckets that hold them and lists the old folders of
all others.  Documents and their chunks share the number of their bucket.

*Writers.*  A publication names the pointer that its tables were derived from.
If there is a newer one by then, or another writer holds the claim to the next
number, it fails with :class:`Conflict` and nothing is published; ``retry`` runs
the whole derivation again on the new tables.  A claim that outlived
``CLAIM_S`` seconds is taken for that of a writer that died.

Pointers younger than ``KEEP_S`` seconds stay, and at least the last ``KEEP``,
with the folders they name, so a reader that began before a write can finish.
Newer schema versions are refused.  Inside a bucket embeddings are partitioned
by model, preprocessing and dimension, so scans of one prune.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

VERSIONS = {"index": 3, "embeddings": 1, "memory": 1, "search": 1}
SCHEMAS = {
    "sources": "id long, name string, root string, kind string, created_at double",
    "docs": "id long, source_id long, rel_path string, abs_path string, sha256 string, mtime double, size long, is_markdown int, yaml_present int, yaml_parse_ok int, yaml_error string, required_keys_present int, frontmatter_json string, discovered_at double, updated_at double",
    "chunks": "id long, doc_id long, chunk_index int, start_char int, end_char int, text string, sha256 string, created_at double, scheme string, heading_path string, chunk_key string",
    "embeddings": "chunk_key string, embed_sig string, model_id string, dim int, preprocess_sig string, vector array<float>, embedded_at double",
    "memory": "memory_id string, type string, content string, source string, created_at double, updated_at double",
    "memory_evidence": "memory_id string, chunk_key string",
    "grams": "gram string, doc_id long, chunk_index int, part int",
    "words": "word string, doc_id long, chunk_index int, tf int, n_words int, part int",
    "lengths": "bucket int, texts long, words long",
}
#: Pointers that stay in any case, and how long all others do, in seconds.
KEEP, KEEP_S = 2, 3600.0
#: Seconds after which the claim to a number is taken for that of a dead writer.
CLAIM_S = 60.0
PARTITIONS = {"embeddings": ["model_id", "preprocess_sig", "dim"], "grams": ["part"], "words": ["part"]}
#: Inside a part, rows in this order, so that scans skip row groups.
SORTED = {"grams": "gram", "words": "word"}
#: Bucketed tables, and the column whose hash names the bucket.
BUCKETED = {"docs": "id", "chunks": "doc_id", "embeddings": "chunk_key", "grams": "doc_id", "words": "doc_id"}
BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer was first."""


def bucket_of(key: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def folders_of(entry) -> set[str]:
    """Folders that a table's entry in a pointer names."""
    return {entry} if isinstance(entry, str) else set(entry["folders"].values())


class Snapshot:
    """The tables that one pointer names."""

    def __init__(self, store: "Store", state: dict):
        self.store, self.state, self.number = store, state, state["number"]

    def exists(self) -> bool:
        return self.number > 0

    def meta(self, key: str | None = None):
        return self.state["meta"] if key is None else self.state["meta"].get(key)

    def buckets(self, name: str) -> int:
        """Number of buckets of a table, 0 if it has none."""
        entry = self.state["tables"].get(name)
        return entry["buckets"] if isinstance(entry, dict) else 0

    def table(self, name: str, only: Iterable[int] | None = None, but: Iterable[int] = ()) -> DataFrame:
        """A table, or the buckets ``only``, or all ``but`` some."""
        entry = self.state["tables"].get(name)
        if isinstance(entry, dict):
            return self.store.read(entry, name, only, but)
        if only is not None or but:
            raise ValueError(f"{name} has no buckets yet")
        if entry is None:
            return self.store.spark.createDataFrame([], SCHEMAS[name])
        df = self.store.spark.read.parquet(f"{self.store.root}/{entry}")
        return migrate_chunks(df, self.table("docs")) if name == "chunks" and "chunk_key" not in df.columns else df


class Store:
    """Tables of one kind (index, embeddings, memory or search) under one folder.

    ``buckets`` holds for tables that are written whole; partial writes keep the
    number that is there."""

    def __init__(self, spark: SparkSession, root: str, kind: str, buckets: int = BUCKETS, keep_s: float = KEEP_S):
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind
        self.buckets, self.keep_s = buckets, keep_s
        self._stage = f".stage-{uuid.uuid4().hex}"  # of this writer alone
        self._seen: int | None = None  # the pointer that this store's user read last

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _pointers(self) -> list[str]:
        """Names of the pointer files, newest first."""
        fs, at = self._fs(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((n for n in names if n.startswith("POINTER-")), reverse=True)

    def _pointer(self, name: str) -> dict | None:
        """What a pointer says; None if its writer did not finish it."""
        source = self._fs().open(self._path(name))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            source.close()

    def _state(self) -> dict:
        for name in self._pointers():
            if state := self._pointer(name):
                return state | {"number": number_of(name)}
        return {"version": 0, "meta": {}, "tables": {}, "number": 0}

    def exists(self) -> bool:
        return bool(self._pointers())

    def state(self) -> dict:
        """{version, meta, tables, number}; empty if nothing was written."""
        state = self._state()
        if state["version"] > VERSIONS[self.kind]:
            raise ValueError(f"{self.kind} store has schema version {state['version']}; this engine knows {VERSIONS[self.kind]}")
        self._seen = state["number"]
        return state

    def snapshot(self) -> Snapshot:
        """The tables of now; they stay the same whatever is published."""
        return Snapshot(self, self.state())

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def meta(self, key: str | None = None):
        return self.snapshot().meta(key)

    def write(self, tables: dict[str, DataFrame], touched: dict[str, Iterable[int]] | None = None, base: Snapshot | None = None) -> dict:
        """New folders that no pointer names yet: {table: entry}.  A table in
        ``touched`` has the whole new content of those buckets of ``base`` and no
        other row; any other is written whole."""
        made = {}
        for name, df in tables.items():
            if name not in BUCKETED:
                made[name] = f"{name}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.root}/{made[name]}")
                continue
            folder = f"{name}/__run={uuid.uuid4().hex}"  # a partition of the table's folder, so that buckets of several runs are one scan
            parts = PARTITIONS.get(name, [])
            only = sorted(set(touched[name])) if touched and name in touched else None
            n = self.buckets if only is None else base.buckets(name)
            rows = df.withColumn("__bucket", bucket_of(BUCKETED[name], n))
            # few files for each bucket, however large it is: adaptive execution splits and joins partitions
            rows = rows.hint("rebalance", "__bucket")
            if name in SORTED:
                rows = rows.sortWithinPartitions("__bucket", *parts, SORTED[name])
            rows.write.partitionBy("__bucket", *parts).parquet(f"{self.root}/{folder}")
            found = [f.getPath().getName() for f in self._fs().listStatus(self._path(folder)) if f.isDirectory()]
            made[name] = {"buckets": n, "touched": only, "folders": {x.split("=")[1]: f"{folder}/{x}" for x in found if x.startswith("__bucket=")}}
        return made

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written beside the snapshots and read back, until ``unstage``."""
        path = f"{self.root}/{self._stage}/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def unstage(self) -> None:
        self._fs().delete(self._path(self._stage), True)

    def read(self, entry, name: str, only: Iterable[int] | None = None, but: Iterable[int] = ()) -> DataFrame:
        """What an entry names, whether or not a pointer has it."""
        columns = [c.strip().split()[0] for c in SCHEMAS[name].split(",")]
        if isinstance(entry, str):
            paths = [entry]
        else:
            but = {str(x) for x in but}
            wanted = None if only is None else {str(x) for x in only}
            paths = [f for k, f in sorted(entry["folders"].items()) if k not in but and (wanted is None or k in wanted)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        reader = self.spark.read.schema(SCHEMAS[name])
        reader = reader if isinstance(entry, str) else reader.option("basePath", f"{self.root}/{name}")
        return reader.parquet(*[f"{self.root}/{p}" for p in paths]).select(*columns)

    def publish(self, made: dict, meta: dict[str, str] | None = None, base: int | Snapshot | None = None) -> None:
        """Make written folders the tables that readers see; other tables, and
        buckets that were not touched, stay.  ``base`` is the snapshot that they
        were derived from (default: the one that was read last)."""
        base = base.number if isinstance(base, Snapshot) else self._seen if base is None else base
        names = self._pointers()
        taken = number_of(names[0]) if names else 0
        claim = self._claim(taken + 1)
        try:
            state = self._state()
            if base is not None and state["number"] != base:
                raise Conflict(f"a pointer after {base} exists: {state['number']}")
            for name, entry in made.items():
                old = state["tables"].get(name)
                if isinstance(entry, dict):
                    kept = {} if entry["touched"] is None else {k: f for k, f in old["folders"].items() if int(k) not in set(entry["touched"])}
                    entry = {"buckets": entry["buckets"], "folders": kept | entry["folders"]}
                state["tables"][name] = entry
            state["meta"] |= meta or {}
            state |= {"version": VERSIONS[self.kind], "number": taken + 1}
            fs, at, draft = self._fs(), self._path(f"POINTER-{taken + 1:010d}.json"), self._path(f".POINTER-{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(bytearray(json.dumps(state, indent=2).encode()))
            out.close()
            if fs.exists(at) or not fs.rename(draft, at):
                fs.delete(draft, False)
                raise Conflict(f"pointer {taken + 1} exists")
            self._seen = taken + 1
        finally:
            self._fs().delete(claim, False)
        self._clean()

    def _claim(self, number: int):
        """The right to make one pointer, of one writer at a time."""
        fs, at = self._fs(), self._path(f"CLAIM-{number:010d}")
        for last in (False, True):
            try:
                fs.create(at, False).close()
                return at
            except Exception as e:
                if not fs.exists(at):
                    if last:
                        raise
                elif last or time.time() - fs.getFileStatus(at).getModificationTime() / 1000 < CLAIM_S:
                    raise Conflict(f"a claim to pointer {number} exists") from e
                else:
                    fs.delete(at, False)

    def retry(self, derive: Callable[[Snapshot], tuple[dict, dict | None]], times: int = 5) -> None:
        """Publishes what ``derive`` makes of the tables of now, again on the new
        tables if another writer was first; nothing if nothing is made and the
        settings are as they were."""
        for left in reversed(range(times)):
            base = self.snapshot()
            made, meta = derive(base)
            if not made and all(base.meta(k) == v for k, v in (meta or {}).items()):
                return None
            try:
                return self.publish(made, meta, base)
            except Conflict:
                self.drop(made)
                if not left:
                    raise

    def drop(self, made: dict) -> None:
        """Remove folders that were written and not published."""
        for entry in made.values():
            for folder in folders_of(entry):
                self._fs().delete(self._path(run_of(folder)), True)

    def commit(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> None:
        """Whole tables, derived from what this store read last."""
        base = self._seen
        made = self.write(tables)
        try:
            self.publish(made, meta, base)
        except Conflict:
            self.drop(made)
            raise

    def _clean(self) -> None:
        """Remove old pointers and the folders that only they name."""
        fs, names, now = self._fs(), self._pointers(), time.time()
        old = [n for n in names[KEEP:] if now - fs.getFileStatus(self._path(n)).getModificationTime() / 1000 >= self.keep_s]
        if not old:
            return
        named = lambda n: {f for e in (self._pointer(n) or {"tables": {}})["tables"].values() for f in folders_of(e)}
        kept = set().union(*(named(n) for n in names if n not in old))
        for n in old:
            for folder in named(n) - kept:
                fs.delete(self._path(folder), True)
                if not any(run_of(f) == run_of(folder) for f in kept):
                    fs.delete(self._path(run_of(folder)), True)
            fs.delete(self._path(n), False)


def run_of(folder: str) -> str:
    """What one write made: a bucket's parent, or the folder itself."""
    return folder.rpartition("/")[0] if "/__bucket=" in folder else folder


def number_of(pointer: str) -> int:
    return int(pointer.split("-")[1].split(".")[0])


def migrate_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Back-fill scheme, heading_path and chunk_key of tables that lack them:
    section ordinal 0, and the chunk index for the chunk ordinal."""
    have = set(chunks.columns)
    scheme = F.col("scheme") if "scheme" in have else F.lit("fixed_window_v1")
    heading = F.col("heading_path") if "heading_path" in have else F.lit(None).cast("string")
    rows = chunks.withColumn("scheme", scheme).withColumn("heading_path", heading)
    paths = docs.select(F.col("id").alias("doc_id"), "rel_path")
    rows = rows.join(paths, "doc_id", "left")
    key = ids.chunk_key("rel_path", "scheme", "heading_path", F.lit(0), "chunk_index", "sha256")
    old = F.nullif(F.trim(F.col("chunk_key")), F.lit("")) if "chunk_key" in have else F.lit(None).cast("string")
    return rows.withColumn("chunk_key", F.coalesce(old, key)).drop("rel_path")


class RunLog:
    """``runs/<run id>/run.json`` in any file system Hadoop knows; an id is a
    time stamp with the first free suffix."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def ids(self) -> set[str]:
        fs, at = self._at(".")
        return {f.getPath().getName() for f in fs.listStatus(at)} if fs.exists(at) else set()

    def write(self, record: dict) -> str:
        name = run_id(self.ids(), time.strftime("%Y%m%d_%H%M%S"))
        fs, at = self._at(f"{name}/run.json")
        out = fs.create(at, False)  # a run that took the id meanwhile is not overwritten
        out.write(bytearray(json.dumps({"run_id": name, **record}, indent=2, ensure_ascii=False, default=str).encode()))
        out.close()
        return name

    def read(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}/run.json", wholetext=True).first()[0])


def write_json(df: DataFrame, path: str) -> None:
    """Run logs and exports: one JSON object a line."""
    df.write.mode("errorifexists").json(path)


def run_id(taken: set[str], stamp: str) -> str:
    """``stamp``, or the first free ``stamp_001`` ... ``stamp_999``."""
    for name in (stamp, *(f"{stamp}_{i:03d}" for i in range(1, 1000))):
        if name not in taken:
            return name
    raise RuntimeError(f"no free run id for {stamp}")


def redact(result: DataFrame, text: str = "text", size: int = 800) -> DataFrame:
    """A tool result for the log: the text cut to its first characters."""
    return result.withColumn(text, F.substring(text, 1, size))


def drop_thinking(message_json) -> "F.Column":
    """A chat message (JSON) without its ``thinking`` field."""
    m = F.from_json(message_json, "map<string,string>")
    return F.to_json(F.map_filter(m, lambda k, _: k != "thinking"))
