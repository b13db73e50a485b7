"""Mixing sources to target weights: iterative proportional fitting.

Token weights are summed once into cells (source, language, topic).  The cell
table is raked to the three target marginals in turn: an aggregation by the
margin's value and a join back for each step, so no task holds more cells than
its share, however many sources there are (up to ``FEW_CELLS`` cells, window sums
do the same in fewer stages).  Rounds go on until every marginal
is within ``TOLERANCE`` of its target.  Targets that contradict the empty cells
(given ones, or shares of a few rows) never get there; ``MOST_ROUNDS`` ends
those, and a warning names the residual.

A document is kept with a probability proportional to its cell's raked weight
over the weight it has; the factor is calibrated so that the kept tokens are
expected to be ``rate`` of all, cells that would need more than they have being
kept whole.  The draw is a hash of the id, so every run keeps the same rows.

Everything is DataFrame operations; the driver sees single rows of sums.  The
default targets soften the marginals of the input: each share to the power
``soften``, renormalised.

There is no topic column, so a topic is a hashed cluster of the vocabulary:
words of six or more letters fall into ``TOPICS`` classes by hash, and the class
that most of a text's words fall into is its topic.

Defined results: null source or language is the value ``unknown``; a text
without such a word (null and empty ones too) has the topic ``none``, equal
counts go to the first class; texts of any length are counted whole; tokens are
runs of characters other than 0x20 and 0x09-0x0D; a cell without tokens keeps
its documents; rows with equal ids share one draw; a target of 0 drops its rows;
empty input gives no rows; extra columns are kept, a clash with a result column
is resolved in favour of the result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

MARGINS = ("source", "lang", "topic")
#: Largest relative deviation of a marginal that ends the raking (a rate has six
#: places), and a bound of its rounds that only contradicting targets come to
#: (the test tables take 12 to 26).
TOLERANCE, MOST_ROUNDS = 1e-9, 200
#: Rounds between two looks at the residual; cells that one task may hold, as it
#: does when a margin has a single value (of more, sums are joined to the cells).
LOOK, FEW_CELLS = 4, 200_000
SOFTEN = 0.8
#: Share of the tokens to keep.
RATE = 0.75
#: Resolution of the draw.
GRAIN = 1_000_000
#: Topics: one for each hexadecimal digit that begins the hash of a word.
TOPICS = "0123456789abcdef"
TOPIC_WORD = "[a-z]{6,}"


def token_count(text: Column) -> Column:
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\f\r", "")).cast("long")


def topic_of(text: Column) -> Column:
    """``t0`` to ``tf``, or ``none``."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digits = F.array_join(F.transform(F.regexp_extract_all(low, F.lit(TOPIC_WORD), F.lit(0)), lambda w: F.substring(F.md5(w.cast("binary")), 1, 1)), "")

    def most(d):  # count and place in one number: the first class wins a tie
        return F.array_max(F.transform(F.array(*map(F.lit, TOPICS)), lambda c, k: (F.length(d) - F.length(F.replace(d, c))) * len(TOPICS) + (len(TOPICS) - 1 - k)))

    best = F.transform(F.array(digits), most)[0]
    place = len(TOPICS) - 1 - best % len(TOPICS)
    return F.when(best < len(TOPICS), "none").otherwise(F.concat(F.lit("t"), F.substring(F.lit(TOPICS), place + 1, F.lit(1))))


def mix_columns(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep as one struct, so that no name can clash, and what
    mixing reads of the row."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.coalesce(F.col("source"), F.lit("unknown")).alias("__source"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("__lang"),
        topic_of(F.col("text")).alias("__topic"), token_count(F.col("text")).alias("__tokens"), F.col("doc_id").alias("__id"),
    )


def rake(cells: DataFrame, soften: float = SOFTEN, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Raked weight ``w`` and natural weight ``tokens`` of each cell.

    ``targets`` may give the shares of a margin's values; values not named, and
    margins not given, take the softened share of the input.
    """
    both = cells.where("tokens > 0")
    whole = both.agg(F.sum("tokens")).first()[0] or 0
    few = both.count() <= FEW_CELLS
    for m in MARGINS:
        goal = both.groupBy(m).agg(F.sum("tokens").alias("__n")).select(m, F.pow(F.col("__n") / F.lit(float(whole or 1)), F.lit(soften)).alias(f"__t_{m}"))
        if targets and targets.get(m):
            named = cells.sparkSession.createDataFrame(sorted((k, float(v)) for k, v in targets[m].items()), f"{m} string, __g double")
            goal = goal.join(named, m, "left").select(m, F.coalesce("__g", f"__t_{m}").alias(f"__t_{m}"))
        goal = materialize(goal, "goal")  # a row for each value
        norm = goal.agg(F.sum(f"__t_{m}")).first()[0] or 0.0
        scaled = F.col(f"__t_{m}") / F.lit(norm) if norm else F.lit(0.0)
        both = both.join(goal.withColumn(f"__t_{m}", scaled), m)
    now = both.withColumn("w", F.col("tokens") / F.lit(float(whole or 1)))
    now = kept = materialize(now, "rake")
    residual = float("inf")
    for r in range(1, most_rounds + 1):
        for m in MARGINS:
            if few:
                now = now.withColumn("__own", F.sum("w").over(Window.partitionBy(m)))
            else:
                now = now.join(now.groupBy(m).agg(F.sum("w").alias("__own")), m)
            now = now.withColumn("w", F.when(F.col("__own") > 0, F.col("w") * F.col(f"__t_{m}") / F.col("__own")).otherwise(F.lit(0.0))).drop("__own")
        look = r % LOOK == 0 or r == most_rounds
        if look or not few:  # a join doubles the plan, a window does not
            before, kept = kept, materialize(now, "rake")
            discard(before)
            now = kept
        if not look:
            continue
        # the last margin fits by construction; how far are the others?
        off = [kept.groupBy(m, F.col(f"__t_{m}").alias("goal")).agg(F.sum("w").alias("s")).select("goal", "s") for m in MARGINS[:-1]]
        residual = off[0].union(off[1]).where("goal > 0").agg(F.max(F.abs(F.col("s") - F.col("goal")) / F.col("goal"))).first()[0] or 0.0
        if residual <= tolerance:
            break
    else:
        warnings.warn(f"raking ended after {most_rounds} rounds with marginals up to {residual:.2g} of their targets away", stacklevel=2)
    return kept.select(*MARGINS, "tokens", (F.col("w") * F.lit(float(whole))).alias("w"))


def keep_rates(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """The probability of each cell, in steps of 1 / GRAIN: min(1, factor * w / tokens).

    The factor starts as if no cell were kept whole; the cells that it would
    take beyond that are kept whole and the rest of the budget goes to the
    others, until no more are.  Each pass only adds to them, so it ends.
    """
    sums = cells.agg(F.sum("tokens"), F.sum("w")).first()
    budget = rate * float(sums[0] or 0)
    factor, full = (budget / sums[1] if sums[1] else 0.0), -1
    while True:
        over = F.col("w") * F.lit(factor) >= F.col("tokens")
        n, held, rest = cells.agg(F.count_if(over), F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(~over, F.col("w")))).first()
        if n == full or not rest:
            break
        factor, full = (budget - float(held or 0)) / rest, n
    share = F.least(F.lit(1.0), F.lit(factor) * F.col("w") / F.col("tokens"))
    return cells.withColumn("keep_ppm", F.floor(F.round(share * GRAIN, 3)).cast("long"))


def draw(doc_id: Column) -> Column:
    """0 to GRAIN - 1 by the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % GRAIN


def _mixed(docs: DataFrame, soften: float, rate: float, targets: dict[str, dict[str, float]] | None, keep: list[str], most_rounds: int) -> DataFrame:
    """__row, __topic, __tokens, __ppm and __kept of every row.  Texts are parsed
    once; the rows are written with what came of it."""
    rows = materialize(mix_columns(docs, keep), "mix-rows")
    cells = materialize(
        rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens")), "cells",
    )
    rates = materialize(keep_rates(rake(cells, soften, targets, most_rounds=most_rounds), rate), "rates")
    rates = rates.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("keep_ppm").alias("__ppm"))
    found = rows.join(rates, [f"__{m}" for m in MARGINS], "left").withColumn("__ppm", F.coalesce(F.col("__ppm"), F.lit(GRAIN).cast("long")))
    return found.withColumn("__kept", draw(F.col("__id")) < F.col("__ppm"))


def mix_documents(docs: DataFrame, soften: float = SOFTEN, rate: float = RATE, targets: dict[str, dict[str, float]] | None = None, keep: list[str] | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``docs`` (of its columns those in ``keep``) plus topic, tokens, keep_ppm
    and kept, for every row."""
    names = {"__topic": "topic", "__tokens": "tokens", "__ppm": "keep_ppm", "__kept": "kept"}
    keep = docs.columns if keep is None else keep
    own = [F.col(f"__row.`{c}`").alias(c) for c in keep if c not in names.values()]
    return _mixed(docs, soften, rate, targets, keep, most_rounds).select(*own, *[F.col(k).alias(v) for k, v in names.items()])


def sample_documents(docs: DataFrame, soften: float = SOFTEN, rate: float = RATE, targets: dict[str, dict[str, float]] | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with their columns as they are."""
    return _mixed(docs, soften, rate, targets, docs.columns, most_rounds).where("__kept").select("__row.*")


def op8_mixing_ipf(spark, sf_dir: str) -> DataFrame:
    found = mix_documents(table(spark, sf_dir, "documents"), keep=["doc_id", "source", "lang"])
    return found.select("doc_id", "source", "lang", "topic", "tokens", "keep_ppm", "kept")


def _oracle(rounds: int = MOST_ROUNDS, soften: float = SOFTEN, rate: float = RATE) -> str:
    m, LOWER = MARGINS, "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""base AS (SELECT *, {', '.join(f'pow(sum(tokens) OVER (PARTITION BY {x}) / a, {soften}::DOUBLE) AS s_{x}' for x in m)} FROM (SELECT *, sum(tokens) OVER ()::DOUBLE AS a FROM cells WHERE tokens > 0))""",
             f"""evened AS (SELECT *, {', '.join(f's_{x} / count(*) OVER (PARTITION BY {x}) AS e_{x}' for x in m)} FROM base)""",
             f"""w0 AS (SELECT source, lang, topic, tokens, a, {', '.join(f's_{x} / sum(e_{x}) OVER () AS t_{x}' for x in m)}, tokens / a AS w FROM evened)"""]
    keys = "source, lang, topic, tokens, a, t_source, t_lang, t_topic"
    inner = f"SELECT r, {keys}, w FROM it WHERE off > {TOLERANCE}::DOUBLE AND r < {rounds}"
    for _ in range(LOOK):  # as many rounds as lie between two looks at the residual
        for x in m:
            inner = f"SELECT r, {keys}, w * t_{x} / sum(w) OVER (PARTITION BY {x}) AS w FROM ({inner})"
    sums = ", ".join(f"sum(w) OVER (PARTITION BY {x}) AS o_{x}" for x in m[:-1])
    steps.append(f"""it AS (SELECT 0 AS r, {keys}, w, 1.0::DOUBLE AS off FROM w0
      UNION ALL SELECT r + {LOOK}, {keys}, w, max(greatest({', '.join(f'abs(o_{x} - t_{x}) / t_{x}' for x in m[:-1])})) OVER () FROM (SELECT *, {sums} FROM ({inner})))""")
    steps.append("last AS (SELECT * FROM it WHERE r = (SELECT max(r) FROM it))")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
      CASE WHEN digits = '' THEN 'none' ELSE 't' || substr('{TOPICS}', {len(TOPICS)} - (list_max(list_transform(range(0, {len(TOPICS)}), lambda k: (length(digits) - length(replace(digits, substr('{TOPICS}', k::INT + 1, 1), ''))) * {len(TOPICS)} + {len(TOPICS) - 1} - k)) % {len(TOPICS)})::INT, 1) END AS topic,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM (SELECT *, array_to_string(list_transform(regexp_extract_all({LOWER}, '{TOPIC_WORD}'), lambda w: substr(md5(w), 1, 1)), '') AS digits FROM documents)),
    cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL), {', '.join(steps)},
    r1 AS (SELECT source, lang, topic, tokens, w * a AS w, w * a / tokens AS ratio FROM last),
    r2 AS (SELECT *, ({rate}::DOUBLE * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM r1),
    r3 AS (SELECT *, max(CASE WHEN factor * ratio <= 1 + 1e-9 THEN factor END) OVER () AS f FROM r2),
    rates AS (SELECT source, lang, topic, floor(round(least(1.0::DOUBLE, coalesce(f, 1) * ratio) * {GRAIN}, 3))::BIGINT AS keep_ppm FROM r3)
    SELECT doc_id, source, lang, topic, tokens, coalesce(keep_ppm, {GRAIN})::BIGINT AS keep_ppm,
      ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {GRAIN} < coalesce(keep_ppm, {GRAIN}) AS kept
    FROM d LEFT JOIN rates USING (source, lang, topic)"""


ORACLE = _oracle()
