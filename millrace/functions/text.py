"""Scalar text expressions.

Case folding is ASCII only where results must not depend on the engine;
positions and lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), _UPPER, _LOWER)


def hit_position(text: Column | str, needle: str) -> Column:
    """1-based position of the first ASCII-case-blind hit, 0 if there is none."""
    folded = needle.translate(str.maketrans(_UPPER, _LOWER))
    return F.instr(ascii_lower(text), F.lit(folded))


def is_blank(c: Column | str) -> Column:
    """Null or spaces only."""
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))


def or_token(c: Column | str, token: str = "<blank>") -> Column:
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit(token))


def metadata_state(present: Column | str, parse_ok: Column | str) -> Column:
    """absent (no front-matter), present (parsed) or unknown."""
    return F.when(col(present) == 0, "absent").when((col(present) == 1) & (col(parse_ok) == 1), "present").otherwise("unknown")


def flag_text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("unknown"))


def snippet(text: Column | str, query: str, before: int = 60, after: int = 120, fallback: int = 180) -> Column:
    """Text around the first hit of ``query``, with ``...`` where it is cut."""
    t = F.coalesce(col(text), F.lit(""))
    low = F.lower(t)
    at = F.instr(low, F.lit(query.lower())) - 1 if query else F.lit(-1)
    start = F.greatest(at - before, F.lit(0))
    end = F.least(F.length(t), at + max(len(query), 1) + after)
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < F.length(t), "...").otherwise(""))
    head = F.concat(F.substring(t, F.lit(1), F.lit(fallback)), F.when(F.length(t) > fallback, "...").otherwise(""))
    return F.when(at < 0, head).otherwise(around)


def normalize_embedding_text(c: Column | str) -> Column:
    """Line ends to LF, white space at line ends off."""
    lf = F.regexp_replace(col(c), "\\r\\n?", "\n")
    return F.regexp_replace(lf, "(?U)[\\s\\x{1c}-\\x{1f}&&[^\\n]]+(?=\\n|\\z)", "")


def frame_chunk(rel_path: Column | str, heading_path: Column | str, text: Column | str) -> Column:
    n = normalize_embedding_text
    return F.concat(F.lit("rel_path="), n(rel_path), F.lit("\nheading_path="), n(F.coalesce(col(heading_path), F.lit(""))), F.lit("\n\n"), n(text))


def frame_query(c: Column | str) -> Column:
    return normalize_embedding_text(c)


def render_hit(rank: Column | str, query: str) -> Column:
    """One rendered search result from the columns of ``lexical.search``."""
    state = metadata_state("yaml_present", "yaml_parse_ok")
    line = F.lit("\n")
    heading = F.trim(F.coalesce(F.col("heading_path"), F.lit("")))
    error = F.trim(F.coalesce(F.col("yaml_error"), F.lit("")))
    return F.concat(
        F.lit("["), col(rank).cast("string"), F.lit("] "), F.col("source_name"), F.lit(":"), F.col("rel_path"), line,
        F.lit("provenance: source="), F.col("source_name"), F.lit(" kind="), F.col("source_kind"), line,
        F.lit("chunk: scheme="), F.col("scheme"), line,
        F.when(heading != "", F.concat(F.lit("heading_path: "), heading, line)).otherwise(""),
        F.lit("typed: metadata="), state, F.lit("; yaml_present="), flag_text("yaml_present"), F.lit("; yaml_parse_ok="), flag_text("yaml_parse_ok"),
        F.lit("; required_keys_present="), flag_text("required_keys_present"), line,
        F.when((state == "unknown") & (error != ""), F.concat(F.lit("yaml_error: "), error, line)).otherwise(""),
        F.lit("snippet: "), snippet("text", query),
    )
