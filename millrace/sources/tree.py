"""Markdown files of a folder tree in any file system, listed by tasks.

Folders are expanded in rounds: each round's folders are dealt to tasks, which
list them and send back files and folders; the rounds are written, so the driver
holds counts, never names.  Then the files are dealt to as many tasks as their
bytes ask for and read there.  Rows are those of ``markdown.read_markdown``:
hidden paths, files that cannot be read and folders that cannot be listed are
rows with an error, symbolic links to folders are not followed.

Paths without a scheme, and ``file:``, are read as local ones (on a cluster: as
mounted everywhere); others by pyarrow's file system of their scheme.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize
from .markdown import LIST_ERROR, decode

#: Bytes that one task reads, folders that one task lists, bytes of one batch.
READ_BYTES, LIST_FOLDERS, BATCH_BYTES = 64 << 20, 64, 8 << 20
LISTED = "kind string, path string, size long, mtime double, error string"
READ = "rel_path string, abs_path string, mtime double, size long, content binary, error string"


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file://")


def opened(root: str) -> tuple[pafs.FileSystem | None, str]:
    """The file system (None: the local one) and the root's path in it."""
    if is_local(root):
        return None, os.path.realpath(root.removeprefix("file://"))
    found, path = pafs.FileSystem.from_uri(root)
    return found, path.rstrip("/")


def reason(e: OSError) -> str:
    return os.strerror(e.errno) if e.errno else str(e).splitlines()[0]


def entries(system: pafs.FileSystem | None, folder: str):
    """(kind, path, size, mtime) of what a folder holds."""
    if system is not None:
        for x in system.get_file_info(pafs.FileSelector(folder)):
            kind = {pafs.FileType.Directory: "folder", pafs.FileType.File: "file"}.get(x.type)
            yield kind, x.path, x.size, x.mtime_ns / 1e9 if x.mtime_ns else None
        return
    with os.scandir(folder) as found:
        for x in found:
            if x.is_dir(follow_symlinks=False):
                yield "folder", x.path, None, None
            elif x.name.lower().endswith(".md") and not x.is_dir():
                path = os.path.realpath(x.path)
                try:
                    info = os.stat(path)
                    yield "file", path, info.st_size, info.st_mtime
                except OSError:
                    yield "file", path, 0, None  # reading will say why


def listed(spark: SparkSession, root: str, stage=materialize) -> DataFrame:
    """``LISTED`` rows of all markdown files under ``root`` and of all folders
    that could not be listed."""

    def run(batches):
        for b in batches:
            system, top = opened(root)
            out = []
            for folder in b.column("path").to_pylist():
                try:
                    for kind, path, size, mtime in entries(system, folder or top):
                        if kind == "file" and path.lower().endswith(".md"):
                            if not path.startswith(top + "/"):
                                raise ValueError(f"a file resolves outside the root: {path}")
                            out.append((kind, path, size, mtime, None))
                        elif kind == "folder":
                            out.append((kind, path, None, None, None))
                except OSError as e:
                    gone = not folder and not isinstance(e, PermissionError)
                    out.append(("error", folder, None, None, f"{LIST_ERROR}: " + ("the root does not exist or is not a directory" if gone else reason(e))))
            types = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["kind", "path", "size", "mtime", "error"])

    todo, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        rounds.append(stage(todo.mapInArrow(run, LISTED), "listed"))
        folders = rounds[-1].where("kind = 'folder'").select("path")
        n = folders.count()
        if not n:
            break
        todo = folders.repartition(-(-n // LIST_FOLDERS))
    found = rounds[0]
    for r in rounds[1:]:
        found = found.unionByName(r)
    return found.where("kind <> 'folder'")


def read_tree(spark: SparkSession, root: str, source_id: int = 1, stage=materialize) -> DataFrame:
    """source_id, rel_path, abs_path, text, mtime, size, error of every file."""
    found = stage(listed(spark, root, stage).dropDuplicates(["kind", "path"]), "files")
    total = found.agg(F.sum("size")).first()[0] or 0

    def run(batches):
        system, top = opened(root)
        types = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.binary(), pa.string())
        out, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["rel_path", "abs_path", "mtime", "size", "content", "error"])

        for b in batches:
            for r in b.to_pylist():
                path = r["path"]
                rel = path[len(top) + 1 :] if path else None
                if r["kind"] == "error":
                    out.append((rel, top, None, None, None, r["error"]))
                elif any(p.startswith(".") for p in rel.split("/")):
                    out.append((rel, path, None, None, None, "PATH_DENIED"))
                else:
                    try:
                        if system is None:
                            with open(path, "rb") as f:
                                content = f.read()
                        else:
                            with system.open_input_stream(path) as f:
                                content = f.read()
                        out.append((rel, path, r["mtime"], r["size"], content, None))
                        held += len(content)
                    except OSError as e:
                        out.append((rel, path, None, None, None, f"FILE_READ_ERROR: {reason(e)}"))
                if held > BATCH_BYTES:
                    yield batch()
                    out, held = [], 0
        yield batch()

    rows = found.repartition(max(1, -(-total // READ_BYTES)), "path").mapInArrow(run, READ)
    return rows.select(F.lit(source_id).cast("long").alias("source_id"), "rel_path", "abs_path", decode(F.col("content")).alias("text"), "mtime", "size", "error")
