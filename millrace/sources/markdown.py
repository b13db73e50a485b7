"""Markdown scan: a Python data source with its own lister.

Spark's file sources skip names that begin with ``_`` or ``.``; here ``_x.md``
is a document and a hidden path is a row with an error.  Listing is planned
into partitions of paths, reading is done by the executors.

A root that is missing or cannot be listed gives one row with a ``LIST_ERROR``
and no path; a folder below it that cannot be listed gives one with its path.
Either way what was found is incomplete, so nothing may be pruned on it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_TASK = 500
LIST_ERROR = "LIST_ERROR"
SCHEMA = "rel_path string, abs_path string, mtime double, size long, content binary, error string"


class Paths(InputPartition):
    def __init__(self, paths, failed=()):
        super().__init__((paths, failed))
        self.paths, self.failed = paths, failed


class MarkdownReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["path"].removeprefix("file://"))
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))

    def partitions(self):
        found, failed = [], []
        note = lambda e: failed.append((os.path.relpath(e.filename or self.root, self.root), f"{LIST_ERROR}: {e.strerror}"))
        if not os.path.isdir(self.root):
            failed.append((".", f"{LIST_ERROR}: the root does not exist or is not a directory"))
        for at, _, names in () if failed else os.walk(self.root, onerror=note, followlinks=False):
            for name in names:
                if name.lower().endswith(".md"):
                    found.append(os.path.realpath(os.path.join(at, name)))
        outside = [p for p in found if not p.startswith(self.root + os.sep)]
        if outside:
            raise ValueError(f"files resolve outside the root: {outside[:3]}")
        found = sorted(set(found), key=str.lower)
        plan = [Paths(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)]
        return [*plan, Paths([], failed)] if failed or not plan else plan

    def read(self, partition: Paths) -> Iterator[tuple]:
        for rel, problem in partition.failed:
            yield (None if rel == "." else rel.replace(os.sep, "/")), self.root, None, None, None, problem
        for path in partition.paths:
            rel = os.path.relpath(path, self.root).replace(os.sep, "/")
            if any(p.startswith(".") for p in rel.split("/")):
                yield rel, path, None, None, None, "PATH_DENIED"
                continue
            try:
                info = os.stat(path)
                with open(path, "rb") as f:
                    yield rel, path, info.st_mtime, info.st_size, f.read(), None
            except OSError as e:
                yield rel, path, None, None, None, f"FILE_READ_ERROR: {e.strerror}"


class MarkdownSource(DataSource):
    @classmethod
    def name(cls):
        return "markdown"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MarkdownReader(dict(self.options))


def decode(content: Column) -> Column:
    """UTF-8 with replacement, line ends to LF."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\\r\\n?", "\n")


def read_markdown(spark: SparkSession, root: str, source_id: int = 1) -> DataFrame:
    """source_id, rel_path, abs_path, text, mtime, size, error of every file."""
    spark.dataSource.register(MarkdownSource)
    rows = spark.read.format("markdown").load(root)
    return rows.select(F.lit(source_id).cast("long").alias("source_id"), "rel_path", "abs_path", decode(F.col("content")).alias("text"), "mtime", "size", "error")
