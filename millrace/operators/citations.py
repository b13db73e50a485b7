"""Citations in answers: parse, check against chunks and snapshot, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pattern: path (with heading) and key of a citation.
CITATION = r"\[source:\s*([^|\]]+?)\s*\|\s*([0-9a-f]{32})\s*\]"
MARKER = "[source:"


def root_blank(heading: Column) -> Column:
    h = F.trim(F.coalesce(heading, F.lit("")))
    return F.when(F.lower(h) == "root", "").otherwise(h)


def segment(s: Column, normalize: bool) -> Column:
    t = F.trim(s)
    if not normalize:
        return t
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    end = lambda c: F.regexp_replace(c, r"[:;,.!?]+\z", "")
    level = F.trim(F.substring_index(t, ":", 1))
    title = F.trim(end(F.trim(F.substring(t, F.instr(t, ":") + 1, F.length(t)))))
    return F.when(F.instr(t, ":") > 0, F.when(title != "", F.concat(level, F.lit(": "), title)).otherwise(end(level))).otherwise(F.trim(end(t)))


def segments(path: Column, normalize: bool) -> Column:
    return F.filter(F.transform(F.split(root_blank(path), ">"), lambda s: segment(s, normalize)), lambda s: s != "")


def canonical(path: Column, normalize: bool) -> Column:
    return F.array_join(segments(path, normalize), " > ")


def markers(answer: Column) -> Column:
    return ((F.length(answer) - F.length(F.replace(answer, F.lit(MARKER)))) / len(MARKER)).cast("long")


def parse(answers: DataFrame, answer: str = "answer_text") -> DataFrame:
    """One row for each citation: the key columns, pos, chunk_key, rel_path, heading_path."""
    text = F.coalesce(F.col(answer), F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)).alias("p"), F.regexp_extract_all(text, F.lit(CITATION), F.lit(2)).alias("k"))
    rows = answers.select(*[c for c in answers.columns if c != answer], F.posexplode(both).alias("pos", "c"))
    path = F.trim(F.col("c.p"))
    at = F.instr(path, "#")
    rel = F.when(at > 0, F.trim(F.substring(path, F.lit(1), at - 1))).otherwise(path)
    head = F.when(at > 0, F.trim(F.substring(path, at + 1, F.length(path)))).otherwise("")
    return rows.where(path != "").select(*[c for c in answers.columns if c != answer], "pos", F.col("c.k").alias("chunk_key"), rel.alias("rel_path"), root_blank(head).alias("heading_path"))


def render(rel_path: Column, heading_path: Column, chunk_key: Column) -> Column:
    h = F.trim(F.coalesce(heading_path, F.lit("")))
    return F.concat(F.lit("[source: "), rel_path, F.lit("#"), F.when(h == "", "root").otherwise(h), F.lit(" | "), chunk_key, F.lit("]"))


def has_citation(answer: Column) -> Column:
    return answer.rlike(r"\[source:\s+[^\]|]+\|\s*[0-9a-f]{32}\]")


def audit(cited: DataFrame, chunks: DataFrame, snapshot: DataFrame, heading_match: str = "prefix", normalize: bool = True) -> DataFrame:
    """``cited`` plus what each citation runs into.

    ``chunks``: chunk_key, rel_path, heading_path, chunk_sha; ``snapshot``:
    [answer key,] chunk_key, chunk_sha as retrieved.
    """
    have = chunks.select("chunk_key", F.col("rel_path").alias("want_rel"), F.col("heading_path").alias("want_head"), F.col("chunk_sha").alias("want_sha"), F.lit(True).alias("known"))
    on = [c for c in cited.columns if c in snapshot.columns and c not in ("rel_path", "heading_path", "pos")]
    seen = snapshot.select(*on, F.col("chunk_sha").alias("snap_sha"), F.lit(True).alias("in_snapshot"))
    rows = cited.join(have, "chunk_key", "left").join(seen, on, "left")
    known = F.coalesce("known", F.lit(False))
    want, got = segments(F.col("want_head"), normalize), segments(F.col("heading_path"), normalize)
    raw_differs = root_blank(F.col("want_head")) != root_blank(F.col("heading_path"))
    leading = F.slice(want, F.lit(1), F.size(got)) == got
    if heading_match == "ignore":
        invalid, shown, reason = F.lit(False), raw_differs, F.lit("ignored")
    elif heading_match == "exact":
        invalid = want != got
        shown = invalid
        same = canonical(F.col("want_head"), True) == canonical(F.col("heading_path"), True)
        raw = canonical(F.col("want_head"), False) != canonical(F.col("heading_path"), False)
        reason = F.when((F.size(got) > 0) & (F.size(got) < F.size(want)) & leading, "prefix").when(same & raw, "punctuation").otherwise("other")
    else:
        invalid = F.when(F.size(got) == 0, F.size(want) > 0).when(F.size(got) > F.size(want), True).otherwise(~leading)
        shown, reason = invalid, F.lit("prefix")
    rel_bad = known & (F.col("rel_path") != F.col("want_rel"))
    head_bad, head_shown = known & invalid, known & shown
    snap = F.coalesce("snap_sha", F.lit(""))
    return rows.withColumns({
        "missing": ~known, "not_in_snapshot": ~F.coalesce("in_snapshot", F.lit(False)), "path_invalid": rel_bad | head_bad,
        "mismatch_kind": F.when(rel_bad & head_shown, "both").when(rel_bad, "rel_path").when(head_shown, "heading").otherwise("none"),
        "mismatch_reason": F.when(head_shown, reason).otherwise(""),
        "want_canonical": canonical(F.col("want_head"), normalize), "got_canonical": canonical(F.col("heading_path"), normalize),
        "sha_unchecked": known & (snap == ""), "sha_mismatch": known & (snap != "") & (snap != F.col("want_sha")),
    })


def report(answers: DataFrame, audited: DataFrame, require_in_snapshot: bool = False, key: str = "answer_id", answer: str = "answer_text") -> DataFrame:
    """One row for each answer: counts, key lists, valid."""
    keys = lambda flag: F.array_sort(F.collect_set(F.when(F.col(flag), F.col("chunk_key"))))
    mismatch = F.when(F.col("mismatch_kind") != "none", F.struct("chunk_key", "want_rel", "rel_path", "want_canonical", "got_canonical", "mismatch_kind"))
    per = audited.groupBy(key).agg(
        F.count("*").alias("parsed"), keys("missing").alias("missing_keys"), keys("not_in_snapshot").alias("outside_keys"), keys("sha_mismatch").alias("sha_keys"),
        keys("sha_unchecked").alias("unchecked_keys"), F.size(F.collect_set(mismatch)).alias("path_mismatches"), F.bool_or("path_invalid").alias("path_invalid"),
    )
    none = F.array().cast("array<string>")
    rows = answers.select(key, F.coalesce(markers(F.coalesce(F.col(answer), F.lit(""))), F.lit(0)).alias("markers")).join(per, key, "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("missing_keys", "outside_keys", "sha_keys", "unchecked_keys")})
    rows = rows.withColumns({"parsed": F.coalesce("parsed", F.lit(0)), "path_mismatches": F.coalesce("path_mismatches", F.lit(0)), "path_invalid": F.coalesce("path_invalid", F.lit(False))})
    rows = rows.withColumn("unparseable", F.greatest(F.lit(0), F.col("markers") - F.col("parsed")))
    ok = (F.size("missing_keys") == 0) & (F.size("sha_keys") == 0) & ~F.col("path_invalid") & (F.col("unparseable") == 0)
    if require_in_snapshot:
        ok = ok & (F.size("outside_keys") == 0)
    return rows.withColumns({
        "valid": ok, "all_unparseable": (F.col("markers") > 0) & (F.col("parsed") == 0), "missing": F.size("missing_keys") + F.col("unparseable"),
        "sha_mismatches": F.size("sha_keys"), "not_in_snapshot": F.size("outside_keys"),
    })


def footer() -> Column:
    return F.format_string("(missing=%d, path_mismatches=%d, sha_mismatches=%d, not_in_snapshot=%d)", *[F.col(c).cast("long") for c in ("missing", "path_mismatches", "sha_mismatches", "not_in_snapshot")])


def gate(enabled: bool, strict: bool) -> Column:
    """Outcome of an answer given ``valid``."""
    if not enabled:
        return F.lit("disabled")
    return F.when(F.col("valid"), "ok").otherwise("strict_fail" if strict else "non_strict_invalid_returned")
