"""Secret scans with DataFrame functions only.

Base patterns give assignments, access keys and long hex runs.  Positions come
from the text between the matches: the pieces of ``split`` and the matches of
``regexp_extract_all`` alternate, so their lengths add up to offsets.

The entropy scan takes every candidate string (20 or more key characters), sorts
them by character class (hex, base64, alnum) and slides a window over each: one
character leaves, one enters, their two counts change (all are carried, packed
in a few longs), and with them the sum of c * log2(c).  A candidate with a window at or above its
class's threshold adds the span from the first such window to the last, unless
the allow-list names it.  Base spans neither suppress candidates nor are changed
by them.  A long candidate is scanned in overlapping pieces, so the work is in
proportion to its length.

Defined results: null and empty texts have no spans; texts and candidates of any
length are scanned whole; spans are code points, end exclusive; equal starts go
by kind (assign, access, hex, entropy); repeated rows are scanned each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits for each character of a window, by class.
THRESHOLDS = {"hex": 3.0, "base64": 3.9, "alnum": 3.7}
#: Not secrets: words of one case or capitalised, joined or not; numbers; UUIDs;
#: documented examples.
ALLOW = ("^[a-z+/_=-]*$", "^[A-Z+/_=-]*$", "^(?:[A-Z]?[a-z]+[+/_=-]*)*$", "^[0-9+/_=-]*$", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "EXAMPLE|example")
_CHUNK = 256
#: Window starts in one piece of a candidate.
_PIECE = 256
_SPAN = "struct<s:int,e:int>"
#: Key characters lie from ``+`` to ``z``; bits that hold a count of a window.
_FIRST, _CODES, _BITS = ord("+"), ord("z") - ord("+") + 1, WINDOW.bit_length()


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e>> of the leftmost non-overlapping matches."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len")))
    empty = F.array().cast(f"array<{_SPAN}>")

    def add(acc, x):
        start = acc["pos"] + x["gap"]
        return F.struct((start + x["len"]).alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), (start + x["len"]).alias("e")))).alias("out"))

    def chunk(acc, at):  # appending one by one only inside a chunk keeps long lists cheap
        part = F.aggregate(F.slice(steps, at + 1, F.lit(_CHUNK)), F.struct(acc["pos"].alias("pos"), empty.alias("out")), add)
        return F.transform(F.array(part), lambda p: F.struct(p["pos"].alias("pos"), F.concat(acc["out"], p["out"]).alias("out")))[0]

    chunks = F.sequence(F.lit(0), F.size(found) - 1, F.lit(_CHUNK))
    spans = F.aggregate(chunks, F.struct(F.lit(0).alias("pos"), empty.alias("out")), chunk)["out"]
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def entropy_span(value: Column, threshold: Column, window: int = WINDOW) -> Column:
    """struct<s, e>: first to last window of ``value`` at the threshold or
    above (0-based, end exclusive), s = -1 if there is none."""
    cut = F.split(value, f"(?<=\\G.{{{_PIECE}}})")
    pieces = F.transform(cut, lambda p, k: F.concat(p, F.coalesce(F.substring(F.get(cut, k + 1), 1, window - 1), F.lit(""))))

    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])  # n * log2(n)
    packed, mask = 63 // _BITS, (1 << _BITS) - 1

    def scan(v):
        """The counts of the window's characters are carried, several in a long;
        a step changes that of the character that leaves and that which enters."""
        place = lambda c: F.struct(F.floor(c / packed).cast("int").alias("j"), (c % packed * _BITS).alias("k"))
        count = lambda counts, p: F.call_function("shiftright", F.get(counts, p["j"]), p["k"]).bitwiseAND(F.lit(mask)).cast("int")
        unit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p["k"])
        code = lambda i: F.ascii(F.substring(v, i, F.lit(1))) - _FIRST

        def step(acc, i):
            leaves, enters = place(F.when(i > window, code(i - window)).otherwise(F.lit(-1))), place(code(i))
            gone = i > window
            out = F.when(gone, count(acc["c"], leaves)).otherwise(F.lit(0))
            into = count(acc["c"], enters) - (gone & (leaves == enters)).cast("int")
            total = acc["t"] + F.when(gone, F.get(terms, out - 1) - F.get(terms, out)).otherwise(F.lit(0.0)) + F.get(terms, into + 1) - F.get(terms, into)
            counts = F.transform(acc["c"], lambda x, j: x + F.when(j == enters["j"], unit(enters)).otherwise(F.lit(0).cast("long")) - F.when(gone & (j == leaves["j"]), unit(leaves)).otherwise(F.lit(0).cast("long")))
            hit = (i >= window) & (F.round(F.log2(F.lit(float(window))) - total / window, 9) >= threshold)
            return F.struct(counts.alias("c"), total.alias("t"), F.when(hit & (acc["s"] < 0), i - window).otherwise(acc["s"]).alias("s"), F.when(hit, i).otherwise(acc["e"]).alias("e"))

        none = F.array_repeat(F.lit(0).cast("long"), -(-_CODES // packed))
        start = F.struct(none.alias("c"), F.lit(0.0).alias("t"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
        return F.aggregate(F.sequence(F.lit(1), F.length(v)), start, step, lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e")))

    at = lambda x, k: F.when(x >= 0, x + k * _PIECE)
    hits = F.transform(pieces, lambda p: F.when(F.length(p) >= window, scan(p)))
    first, last = F.array_min(F.transform(hits, lambda h, k: at(h["s"], k))), F.array_max(F.transform(hits, lambda h, k: at(h["e"], k)))
    return F.struct(F.coalesce(first, F.lit(-1)).alias("s"), F.coalesce(last, F.lit(-1)).alias("e"))


def char_class(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]+$"), "hex").when(value.rlike("[+/_=-]"), "base64").otherwise("alnum")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``__base`` and ``__entropy``: arrays of struct<s, k, e>
    (start, kind number, end), each sorted."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = lambda spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    values = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(match_spans(body, ASSIGN), values, lambda x, v: F.struct(x["s"].alias("s"), F.when(F.length(v) >= 6, 0).alias("k"), x["e"].alias("e")))
    assign = F.when(body.rlike("[:=]"), F.filter(assign, lambda x: x["k"].isNotNull())).otherwise(none)
    access = F.when(F.instr(body, "AKIA") > 0, named(match_spans(body, ACCESS), 1)).otherwise(none)
    hexes = F.when(body.rlike(HEX), named(match_spans(body, HEX), 2)).otherwise(none)
    rows = docs.withColumn("__base", F.array_sort(F.concat(assign, access, hexes)))

    allowed = lambda v: v.rlike("|".join(f"(?:{a})" for a in ALLOW))
    found = F.zip_with(match_spans(body, CANDIDATE), F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)), lambda x, v: F.struct(x["s"].alias("s"), x["e"].alias("e"), v.alias("v")))
    rows = rows.withColumn("__open", F.when(body.rlike(CANDIDATE), F.filter(found, lambda x: ~allowed(x["v"]))))
    limit = lambda v: F.when(char_class(v) == "hex", THRESHOLDS["hex"]).when(char_class(v) == "base64", THRESHOLDS["base64"]).otherwise(THRESHOLDS["alnum"])
    scanned = F.transform("__open", lambda x: F.transform(F.array(entropy_span(x["v"], limit(x["v"]))), lambda h: F.struct((x["s"] + h["s"]).alias("s"), F.when(h["s"] >= 0, 3).alias("k"), (x["s"] + h["e"]).alias("e")))[0])
    return rows.withColumn("__entropy", F.coalesce(F.filter(scanned, lambda x: x["k"].isNotNull()), none)).drop("__open")


def span_text(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_secrets_entropy(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda k: F.size(F.filter("__base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(span_text(F.col("__base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("__base", "__entropy"))).alias("spans"),
    )


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def spans(name: str, pattern: str, k: str, keep: str = "true") -> str:
        m, p = f"regexp_extract_all(t, {q(pattern)})", f"string_split_regex(t, {q(pattern)})"
        return f"""{name}m AS (SELECT doc_id, t, rid, {m} AS m, {p} AS p, {f'regexp_extract_all(t, {q(pattern)}, 2)' if k == "0" else m} AS v FROM d),
        {name}i AS (SELECT doc_id, rid, m, p, v, unnest(range(1, len(m) + 1)) AS i FROM {name}m),
        {name}s AS (SELECT doc_id, rid, v[i] AS v, list_sum([length(x) for x in p[1:i]])::BIGINT + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0)::BIGINT AS s, length(m[i])::BIGINT AS n FROM {name}i),
        {name} AS (SELECT rid, s, {k} AS k, s + n AS e, v FROM {name}s WHERE {keep})"""

    allowed = "|".join(f"(?:{a})" for a in ALLOW)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
    {spans('xa', ASSIGN, '0', 'length(v) >= 6')}, {spans('xb', ACCESS, '1')}, {spans('xc', HEX, '2')}, {spans('xf', CANDIDATE, '3')},
    base AS (SELECT rid, s, k, e FROM xa UNION ALL SELECT rid, s, k, e FROM xb UNION ALL SELECT rid, s, k, e FROM xc),
    open AS (SELECT f.rid, f.s, f.v, CASE WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN {THRESHOLDS['hex']} WHEN regexp_matches(v, '[+/_=-]') THEN {THRESHOLDS['base64']} ELSE {THRESHOLDS['alnum']} END AS h
      FROM xf AS f WHERE NOT regexp_matches(v, {q(allowed)})),
    win AS (SELECT rid, s, v, h, unnest(range(1, length(v) - {WINDOW} + 2)) AS i FROM open),
    hit AS (SELECT rid, s, v, min(i) AS lo, max(i) AS hi FROM win WHERE round(list_aggregate(string_split(substr(v, i, {WINDOW}), ''), 'entropy'), 9) >= h GROUP BY rid, s, v),
    every AS (SELECT * FROM base UNION ALL SELECT rid, s + lo - 1, 3, s + hi - 1 + {WINDOW} FROM hit),
    joined AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS b,
      string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM every GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN joined USING (rid)"""


ORACLE = _oracle()
