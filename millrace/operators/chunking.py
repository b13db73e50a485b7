"""Chunkers: fixed windows as expressions, structure-aware as an Arrow UDF."""

import re
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking, check_window
from ..functions import ids
from .frontmatter import split_body

#: Texts of an Arrow batch, whose chunks a worker holds together.
BATCH_TEXTS = 64
# Fixed patterns.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
BOUNDARY = re.compile(r"""(?<=[.!?])(?:['")\]]+)?\s+|[;:]\s+|\n""")
PIECE = "array<struct<chunk_index:int,start_char:int,end_char:int,text:string,section_ordinal:int,chunk_ordinal:int,heading_path:string>>"


def fixed_window(body: Column, max_chars: int = 1200, overlap: int = 120) -> Column:
    """array of PIECE structs: windows of ``max_chars`` every ``max_chars - overlap``."""
    check_window(max_chars, overlap)
    n = F.length(body)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(max_chars - overlap))
    piece = F.transform(starts, lambda s, i: F.struct(
        i.alias("chunk_index"), s.alias("start_char"), F.least(n, s + max_chars).alias("end_char"), F.substring(body, s + 1, F.lit(max_chars)).alias("text"),
        F.lit(0).alias("section_ordinal"), i.alias("chunk_ordinal"), F.lit(None).cast("string").alias("heading_path"),
    ))
    return F.when(n > 0, piece).otherwise(F.array().cast(PIECE))


def split_sentences(text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``max_chars``: cut behind the last sentence-like
    boundary in the second half of a window, else behind its last space, else
    hard; each span starts ``overlap`` before the last one's end."""
    at, n, least = 0, len(text), max(1, int(max_chars * 0.5))
    while n - at > max_chars:
        window = text[at : at + max_chars]
        size = max((m.end() for m in BOUNDARY.finditer(window) if m.end() >= least), default=0)
        if not size:
            space = window.rfind(" ")
            size = space + 1 if space >= least else max_chars
        yield at, at + size
        at += size - overlap if size > overlap else size
    if at < n:
        yield at, n


def heading_path(stack: dict[int, str]) -> str | None:
    return " > ".join(f"H{k}: {stack[k].strip()}" for k in sorted(stack) if stack[k].strip()) or None


def paragraphs(body: str) -> Iterator[tuple[int, str | None, int, int]]:
    """(section, heading path, start, end) of each run of lines that are neither
    blank nor headings.  Sections start at headings of level 2, or of the least
    level if there is no level 2; lines before the first are a section too."""
    lines = body.splitlines(keepends=True)
    starts = [0, *accumulate(map(len, lines))]
    heads = [HEADING.match(line.rstrip("\r\n")) for line in lines]
    levels = {len(h[1]) for h in heads if h}
    split = 2 if 2 in levels else min(levels, default=0)
    opens = bool(heads and heads[0] and len(heads[0][1]) == split)
    section = -1 if opens else 0  # lines before the first split heading are section 0
    stack: dict[int, str] = {}
    begun: int | None = None
    for i, (line, head) in enumerate(zip(lines, heads)):
        if head or not line.strip():
            if begun is not None:
                yield section, heading_path(stack), starts[begun], starts[i]
                begun = None
            if head:
                level = len(head[1])
                if level == split:
                    section += 1
                stack = {k: v for k, v in stack.items() if k < level} | {level: head[2]}
        elif begun is None:
            begun = i
    if begun is not None:
        yield section, heading_path(stack), starts[begun], starts[len(lines)]


def structured(body: str, max_chars: int, overlap: int) -> list[tuple]:
    """Rows of PIECE: paragraphs, long ones split, neighbours of one heading
    path packed while they fit, two newlines between them."""
    def fragments():
        for section, path, a, z in paragraphs(body):
            if z - a <= max_chars:
                yield section, path, a, z, body[a:z]
            else:
                for b, e in split_sentences(body[a:z], max_chars, overlap):
                    yield section, path, a + b, a + e, body[a + b : a + e]

    rows: list[tuple] = []
    for section, group in groupby(fragments(), key=lambda f: f[0]):
        packed: list[list] = []
        for _, path, a, z, text in group:
            if packed and packed[-1][3] == path and len(packed[-1][2]) + 2 + len(text) <= max_chars:
                packed[-1][1:3] = z, f"{packed[-1][2]}\n\n{text}"
            else:
                packed.append([a, z, text, path])
        rows += [(len(rows) + k, a, z, text, section, k, path) for k, (a, z, text, path) in enumerate(packed)]
    return rows


def chunk_column(text: Column, chunking: Chunking = Chunking(), strip_frontmatter: bool = True) -> Column:
    """array of PIECE structs of a text column."""
    scheme, most, over = chunking.scheme, chunking.max_chars, chunking.overlap
    names = [x.split(":")[0] for x in PIECE[len("array<struct<") : -2].split(",")]
    body_of = split_body if strip_frontmatter else (lambda t: t)
    cut = windows if scheme == "fixed_window_v1" else structured

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(names, r)) for r in cut(body_of(t or ""), most, over)])

    in_python = F.pandas_udf(run, PIECE)(text)
    if scheme != "fixed_window_v1":
        return in_python
    if not strip_frontmatter:
        return fixed_window(text, most, over)
    bare = F.regexp_replace(text, "^﻿", "")
    return F.when(F.ltrim(bare).startswith("---"), in_python).otherwise(fixed_window(bare, most, over))


def chunk_documents(docs: DataFrame, chunking: Chunking = Chunking(), strip_frontmatter: bool = True, text: str = "text") -> DataFrame:
    """One row for each chunk: the columns of ``docs`` but the text, the fields
    of PIECE, sha256, scheme and chunk_key (``docs`` needs ``rel_path``)."""
    if strip_frontmatter or chunking.scheme != "fixed_window_v1":  # by a worker, whose memory grows with the batch
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_TEXTS))
    rows = docs.withColumn("__c", F.explode(chunk_column(F.col(text), chunking, strip_frontmatter)))
    keep = [c for c in docs.columns if c != text]
    rows = rows.select(*keep, "__c.*").withColumn("sha256", ids.sha256("text")).withColumn("scheme", F.lit(chunking.scheme))
    return rows.withColumn("chunk_key", ids.chunk_key("rel_path", "scheme", "heading_path", "section_ordinal", "chunk_ordinal", "sha256"))


def windows(body: str, max_chars: int, overlap: int) -> list[tuple]:
    """``fixed_window`` of one text, in Python: rows of PIECE."""
    starts = range(0, max(1, len(body) - overlap), max_chars - overlap) if body else ()
    return [(i, s, min(len(body), s + max_chars), body[s : s + max_chars], 0, i, None) for i, s in enumerate(starts)]


def chunk_markdown(text: str, max_chars: int, overlap: int) -> list[tuple]:
    """Front-matter off, then fixed windows: rows of PIECE."""
    check_window(max_chars, overlap)
    return windows(split_body(text), max_chars, overlap)
