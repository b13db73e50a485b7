"""Benchmark decontamination: pigeonhole edit matching.

Texts are normalised (lower case, words joined by one space).  A test item of
length L with error budget k = floor(rate * L) is split into k + 1 pieces; an
occurrence with at most k edits holds one piece unchanged.  All pieces of a
block of items stand in one automaton that passes over each document once.  A
piece hit is checked first with its neighbours in the tree of pieces, then, in
a window for the whole item, by a trigram count (each edit breaks at most
three); Myers' bit-parallel distance decides.

Items are taken in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS``
characters, whatever their number: one block is what a task holds.

Defined results: items and documents that are null or hold no word match
nothing; an occurrence is one of characters and may begin or end inside a word
(an item under 10 characters, whose budget is 0, is found inside words as well);
documents of any length are searched whole; of several occurrences of an item in a
document the closest, then the first, is reported; repeated rows are reported
each; with no items the result is empty; extra columns are ignored by
``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, table

#: Edits allowed for each character of a normalised item.
RATE = 0.1
BLOCK_ITEMS, BLOCK_CHARS = 5000, 1_000_000
_WORD = re.compile(r"\w+")


def normalise(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def split_pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def bit_rows(pattern: str) -> dict[str, int]:
    """For each character the places of the pattern where it stands, as bits."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers(pattern: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a substring of ``text``, first end of one)."""
    m = len(pattern)
    at = (bit_rows(pattern) if peq is None else peq).get
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph, mh = ph << 1, mh << 1  # a match may start anywhere: row 0 stays 0
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


def parents(n: int) -> list[tuple[int, int]]:
    """For each of n pieces the smallest node of two or more pieces over it, in
    the tree that halves the pieces.  A node of r pieces allows r - 1 edits; of
    two halves that make up an allowed node at least one is allowed, so some
    path from the whole item to an unchanged piece is allowed all the way."""
    found = [(0, n)] * n
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a >= 2:
            found[a:b] = [(a, b)] * (b - a)
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return found


class Matcher:
    """Pieces of one block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.trigrams = [[t[a : a + 3] for a in range(len(t) - 2)] for _, t in items]
        found: dict[str, list[tuple]] = {}
        for at, (_, text, budget) in enumerate(self.items):
            cut = split_pieces(text, budget)
            for (off, piece), (a, b) in zip(cut, parents(len(cut))):
                start, end = cut[a][0], cut[b - 1][0] + len(cut[b - 1][1])
                node = (start, text[start:end], b - a - 1, bit_rows(text[start:end]))
                found.setdefault(piece, []).append((at, off, node))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, distance, budget, start, end) in the normalised text."""
        if not self.items or not text:
            return
        diagonals: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for at, off, (first, node, edits, peq) in where:
                start = end + 1 - size - off
                if edits and at not in diagonals:
                    a = start + first
                    if myers(node, text[max(0, a - edits) : a + len(node) + edits], peq)[0] > edits:
                        continue
                diagonals.setdefault(at, set()).add(start)
        for at, starts in sorted(diagonals.items()):
            name, item, budget = self.items[at]
            best = None
            for lo, hi in _windows(starts, len(item), budget, len(text)):
                part = text[lo:hi]
                if budget:
                    have = {part[a : a + 3] for a in range(len(part) - 2)}
                    if sum(map(have.__contains__, self.trigrams[at])) < len(item) - 2 - 3 * budget:
                        continue
                distance, end = myers(item, part)
                if distance <= budget and (best is None or distance < best[1]):
                    _, back = myers(item[::-1], part[:end][::-1])
                    best = (name, distance, budget, lo + end - back, lo + end)
            if best:
                yield best


def _windows(starts: set[int], length: int, budget: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that hold every occurrence the piece hits allow."""
    lo = hi = None
    for s in sorted(starts):
        a, b = max(0, s - budget), min(n, s + length + budget)
        if hi is not None and a <= hi - length:
            hi = max(hi, b)
        else:
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
    if hi is not None:
        yield lo, hi


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for row in items.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        if item := normalise(row[text]):
            if block and (len(block) >= BLOCK_ITEMS or chars + len(item) > BLOCK_CHARS):
                yield block
                block, chars = [], 0
            block.append((row[key], item))
            chars += len(item)
    if block:
        yield block


LEAK = "item_id long, distance int, budget int, start_char long, end_char long"


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", rate: float = RATE) -> DataFrame:
    """key, item_id, distance, budget and the code-point span in the original
    text, for every pair of a document and an item that occurs in it."""
    spark = docs.sparkSession
    arrow_ready(spark)
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(key, "text").where(F.col("text").isNotNull())
    found = None
    for block in item_blocks(items, item_key, "text"):

        def run(batches, block=block):
            matcher = Matcher(block, rate)
            for b in batches:
                out: list[list] = [[] for _ in range(6)]
                ids = b.column(key)
                for i, text in enumerate(b.column("text").to_pylist()):
                    norm = normalise(text)
                    for item, distance, budget, start, end in matcher.matches(norm):
                        a, z = original_span(text, start, end)
                        for col, v in zip(out, (i, item, distance, budget, a, z)):
                            col.append(v)
                if out[0]:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0])), *[pa.array(c, t) for c, t in zip(out[1:], kinds)]], [key, *[x.split()[0] for x in LEAK.split(", ")]])

        hits = texts.mapInArrow(run, f"{key} {kind}, {LEAK}")
        found = hits if found is None else found.union(hits)
    return spark.createDataFrame([], f"{key} {kind}, {LEAK}") if found is None else found


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Normalised offsets -> offsets in the text (lower-casing may lengthen it:
    words are then aligned by their order)."""
    at, first, last = 0, None, 0
    for m in _WORD.finditer(text):
        size = len(m[0].lower())
        if first is None and at + size > start:
            first = m.start() + max(0, min(start - at, len(m[0])))
        if at < end:
            last = m.start() + min(end - at, len(m[0]))
        else:
            break
        at += size + 1
    return (first or 0), last


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows in which an item occurs: one pass for each block of items."""
    arrow_ready(docs.sparkSession)
    schema = docs.schema
    for block in item_blocks(items, "item_id", "text"):

        def run(batches, block=block):
            matcher = Matcher(block, rate)
            for b in batches:
                clean = [t is None or next(matcher.matches(normalise(t)), None) is None for t in b.column("text").to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op5_decontamination_edit(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
