"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

*Pre-tokenisation.*  A batch of texts becomes one array of code points and one
of their classes (letter, number, other, space, other white space; white space
before a visible character and apostrophes that open a contraction are classes
of their own, from the next two code points).  Where a token starts follows from
a small automaton; a code point is a function from state to state, and such
functions compose associatively: blocks of code points are composed side by
side, the blocks' functions are scanned, and every block is then run from its
own first state.  The first code point of a text is a constant function, so a
batch is one scan and no text sees another.  No pattern is matched.

*Merging.*  Slices are grouped by their exact bytes; each distinct one is merged
once and kept in a cache of the worker.  The pair of the lowest rank merges
first, the leftmost of equal ones; a slice that is a token itself stays whole.

*Decoding* puts the bytes of each token at its offset, which ``encode`` returns.

Defined results: a null text counts as empty and has no token; a null id is an
id like any other; texts are read whole, long ones in windows that end where a
token starts; repeated rows are encoded each; an empty table gives no rows;
extra columns are ignored.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, arrow_ready, mix, pieces, table, text_buffer

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct slices that a worker remembers; beyond, it starts anew.
MOST_CACHED = 1 << 20
#: Slices of at most so many bytes are grouped as two numbers, longer ones one by one.
SHORT = 16
#: Bytes from which pairs to merge wait in a heap.
LONG_SLICE = 96
#: Code points of a block that is composed at once.
SCAN = 256

# Letters and numbers that Unicode 16.0 added (the interpreter's own table is older).
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Classes of code points.  Of white space: a space, or another, before a visible character; any other.
LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACE_LAST, WHITE_LAST, WHITE_IN = range(8)
# States: what the token so far is.  JOIN: a space that the next character joins; LEFT_n: n letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOIN, LEFT_1, LEFT_2 = range(8)
CLASSES, STATES = 8, 8


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_IN of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for runs, what in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for lo, hi in runs:
            out[lo : hi + 1] = what
    out[list(WHITE)] = WHITE_IN
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts) by class and state; classes from ``CLASSES``
    on are those of a text's first code point."""
    first = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE_1: LEFT_1, QUOTE_2: LEFT_2, SPACE_LAST: JOIN, WHITE_LAST: FRESH, WHITE_IN: IN_WHITE}
    visible = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE_1: IN_OTHERS, QUOTE_2: IN_OTHERS}
    goes_on = {
        IN_LETTERS: {LETTER: IN_LETTERS}, IN_NUMBERS: {NUMBER: IN_NUMBERS},
        IN_OTHERS: {c: IN_OTHERS for c in (OTHER, QUOTE_1, QUOTE_2)},
        IN_WHITE: {WHITE_IN: IN_WHITE}, JOIN: visible,
        LEFT_2: {LETTER: LEFT_1}, LEFT_1: {LETTER: FRESH},
    }
    to, starts = np.zeros((2 * CLASSES, STATES), np.uint8), np.ones((2 * CLASSES, STATES), bool)
    for c in range(CLASSES):
        to[c], to[c + CLASSES] = first[c], first[c]
        for s, follows in goes_on.items():
            if c in follows:
                to[c, s], starts[c, s] = follows[c], False
    return to, starts


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point; ``firsts`` are the places
    where texts begin."""
    n = len(points)
    begins = np.zeros(n + 2, bool)
    begins[firsts] = True
    begins[n:] = True
    kind = np.append(classes()[points], np.uint8([OTHER, OTHER]))
    near = ~begins[1 : n + 1]  # the next code point is of the same text
    last = near & (kind[1 : n + 1] != WHITE_IN)
    white = kind[:n] == WHITE_IN
    of = kind[:n].copy()
    of[white & last] = WHITE_LAST
    of[white & last & (points == 0x20)] = SPACE_LAST
    at = np.flatnonzero((points == 0x27) & near)
    if len(at):
        wide = np.append(points, np.uint32([0, 0]))
        a, b = wide[at + 1], wide[at + 2]
        two = ~begins[at + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        of[at[two]] = QUOTE_2
        of[at[np.isin(a, [ord(c) for c in "stmd"])]] = QUOTE_1
    of += (CLASSES * begins[:n]).astype(np.uint8)
    to, starts = automaton()
    blocks = -(-n // SCAN)
    lines = np.full(blocks * SCAN, LETTER, np.uint8)
    lines[:n] = of
    lines = np.ascontiguousarray(lines.reshape(blocks, SCAN).T)  # a line holds one code point of each block
    # compose each block's functions, then scan the blocks
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    flat = to.ravel()
    for line in lines:
        whole = flat[(line[:, None].astype(np.intp) * STATES) + whole]
    state = np.zeros(blocks, np.uint8)
    now = FRESH
    for k, row in enumerate(whole.tolist()):
        state[k] = now
        now = row[now]
    out = np.empty((SCAN, blocks), bool)
    opens = starts.ravel()
    for k, line in enumerate(lines):
        at = line.astype(np.intp) * STATES + state
        out[k] = opens[at]
        state = flat[at]
    return out.T.ravel()[:n]


def slices(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each pre-token in bytes, and the end; first pre-token of each text)."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # a code point's first byte
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    filled = np.diff(offs) > 0
    firsts = np.searchsorted(heads, offs[:-1][filled])
    starts = heads[np.flatnonzero(token_starts(points, firsts))]
    return np.append(starts, len(data)), np.searchsorted(starts, offs)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Vocabulary:
    """Tokens by rank, merging with a cache, and decoding."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = [self.ranks[bytes([c])] for c in range(256)]
        #: Two tokens, as one number, that make a third: its rank, which is its id.
        self.joins: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    self.joins[a << 32 | b] = rank
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self.merge_long(piece) if len(piece) >= LONG_SLICE else self.merge_short(piece)

    def merge_short(self, piece: bytes) -> tuple[int, ...]:
        joins, none = self.joins.get, len(self.lengths)
        ids = [self.single[c] for c in piece]
        pairs = [joins(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            ids[i] = best
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = joins(ids[i - 1] << 32 | best, none)
            if i < len(pairs):
                pairs[i] = joins(best << 32 | ids[i + 1], none)
        return tuple(ids)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        joins, n = self.joins.get, len(piece)
        ids = [self.single[c] for c in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the next part; 0: merged away
        waiting = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := joins(a << 32 | b)) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if not j or j >= n or ids[i] != a or ids[j] != b:  # one of the two has changed since
                continue
            ids[i], after[i], after[j] = rank, after[j], 0
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (new := joins(ids[x] << 32 | ids[after[x]])) is not None:
                    heapq.heappush(waiting, (new, x, ids[x], ids[after[x]]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def known(self, piece: bytes) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = self.merge(piece)
            if len(piece) <= 1 << 10:  # what is longer hardly comes again
                if len(self.cache) >= MOST_CACHED:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the first of each text and the end)."""
        cuts, first = slices(data, offs)
        start, length = cuts[:-1], np.diff(cuts)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        raw = data.tobytes()
        slot = np.empty(len(start), np.int64)
        short = np.flatnonzero(length <= SHORT)
        padded = np.append(data, np.zeros(SHORT, np.uint8))
        low_high = np.lib.stride_tricks.sliding_window_view(padded, SHORT)[start[short]]
        low_high = (low_high * (np.arange(SHORT) < length[short][:, None])).view("<u8").reshape(-1, 2)
        name = mix(low_high[:, 0] + np.uint64(0x9E3779B97F4A7C15) * mix(low_high[:, 1] + length[short].astype(np.uint64)))
        _, one, slot[short] = np.unique(name, return_index=True, return_inverse=True)
        same = (low_high == low_high[one][slot[short]]).all(1) & (length[short] == length[short[one]][slot[short]])
        alone = np.concatenate((short[~same], np.flatnonzero(length > SHORT)))  # long, or of one name with another
        slot[alone] = len(one) + np.arange(len(alone))
        needed = np.concatenate((short[one], alone))
        found = [self.known(raw[a:b]) for a, b in zip(cuts[needed].tolist(), cuts[needed + 1].tolist())]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        ids = flat[spread((np.cumsum(counts) - counts)[slot], counts[slot])]
        return ids, np.concatenate(([0], np.cumsum(counts[slot])))[first]

    def encode_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long text, window by window."""
        out, at, size = [], 0, PIECE_BYTES
        while at < len(data):
            end = min(len(data), at + size)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            window = data[at:end]
            if end < len(data):
                cuts, _ = slices(window, np.array([0, len(window)]))
                # what starts near the end may still change with what follows
                cuts = cuts[cuts <= len(window) - 16]
                if cuts[-1] == 0:
                    size *= 2
                    continue
                window, size = window[: cuts[-1]], PIECE_BYTES
            out.append(self.encode(window, np.array([0, len(window)]))[0])
            at += len(window)
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offset of each token and the end)."""
        lengths = self.lengths[ids]
        return self.bytes[spread(self.starts[ids], lengths)], np.concatenate(([0], np.cumsum(lengths)))


_loaded: dict[int, Vocabulary] = {}


def loaded(lines) -> Vocabulary:
    """The vocabulary of a broadcast file, parsed once in a worker."""
    if lines.id not in _loaded:
        _loaded.clear()
        _loaded[lines.id] = Vocabulary(lines.value)
    return _loaded[lines.id]


def vocabulary_file(spark, path: str):
    """The rank file, sent to every worker: its size is the vocabulary's."""
    with open(path, "rb") as f:
        return Sent(spark.sparkContext.broadcast(f.read()))


class Sent:
    def __init__(self, sent):
        self.sent, self.id = sent, sent._jbroadcast.id()

    @property
    def value(self) -> bytes:
        return self.sent.value


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of ints) and ends (array of longs: the byte at which each
    token ends) of every row; ``path`` is a rank file."""
    arrow_ready(docs.sparkSession)
    lines = vocabulary_file(docs.sparkSession, path)

    def run(batches):
        v = loaded(lines)
        for b in batches:
            data, offs = text_buffer(b.column(text))
            for lo, hi, part, at in pieces(data, offs):
                if len(part) > 2 * PIECE_BYTES and hi == lo + 1:
                    ids = v.encode_long(part)
                    first = np.array([0, len(ids)])
                else:
                    ids, first = v.encode(part, at)
                ends = np.cumsum(v.lengths[ids])
                ends -= np.repeat(np.append(0, ends)[first[:-1]], np.diff(first))
                cut = pa.array(first.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(key).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(ids)), pa.ListArray.from_arrays(cut, pa.array(ends))], [key, "ids", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, ends array<bigint>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, ids, ends and decoded (binary): each token's bytes at its offset.
    An offset that is not where the tokens before it end is an error."""
    arrow_ready(encoded.sparkSession)
    lines = vocabulary_file(encoded.sparkSession, path)

    def run(batches):
        v = loaded(lines)
        for b in batches:
            if not len(b):
                continue
            lists = b.column("ids")
            first = lists.offsets.to_numpy().astype(np.int64)
            raw, at = v.decode(lists.flatten().to_numpy())
            first -= first[0]
            ends = b.column("ends").flatten().to_numpy()
            if (at[1:] - np.repeat(at[first[:-1]], np.diff(first)) != ends).any():
                raise ValueError("offsets that do not fit the tokens")
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(at[first]), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(key), lists, b.column("ends"), decoded], [key, "ids", "ends", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids", "ends").mapInArrow(run, f"{key} {kind}, ids array<int>, ends array<bigint>, decoded binary")


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
