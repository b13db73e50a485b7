"""Inverted indexes over chunks: trigrams for substring search, words for BM25.

Postings stand in the buckets of their documents (see ``sources.store``), so a
run that changes one document writes one bucket of each index; inside a bucket
they are cut by the hash of the gram or word, so a search reads those parts of
the buckets that can hold what it asks for, and of these the row groups.

*Substring search.*  A text that contains the needle contains its trigrams (both
folded as the predicate folds them).  The ``RAREST`` of them are intersected,
what is left is looked up and goes through the predicate itself, so the result
is that of a full scan.  A needle under three characters scans all chunks.

*BM25.*  A posting carries the word's count and the length of the text; how many
texts a bucket holds and how long they are together is one row for each bucket,
written with it.  How many texts have a word is counted over its postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Parts of a bucket, by the hash of the gram or the word.
PARTS = 16
#: Trigrams of a needle that are intersected.
RAREST = 3
#: BM25's parameters, and the places its scores are rounded to before they are ordered.
K1, B, DIGITS = 1.2, 0.75, 6
WORD = r"[\p{L}\p{N}]+"


def part_of(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, by one native pass: each match looks
    three characters ahead and takes one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), F.lit(1)))


def needle_grams(needle: str) -> list[str]:
    """The distinct trigrams of a constant, folded."""
    folded = needle.translate(str.maketrans(tx._UPPER, tx._LOWER))
    return sorted({folded[i : i + 3] for i in range(len(folded) - 2)})


def gram_postings(chunks: DataFrame) -> DataFrame:
    """gram, doc_id, chunk_index, part."""
    rows = chunks.where(F.length("text") >= 3).select("doc_id", "chunk_index", F.explode(trigrams(tx.ascii_lower("text"))).alias("gram"))
    return rows.select("gram", "doc_id", "chunk_index", part_of("gram").alias("part"))


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(tx.ascii_lower(text), F.lit(WORD), F.lit(0))


def word_postings(texts: DataFrame) -> DataFrame:
    """word, doc_id, chunk_index, tf, n_words, part of texts (doc_id,
    chunk_index, text).  Words are counted text by text, without a shuffle."""
    rows = texts.select("doc_id", "chunk_index", F.sort_array(words_of("text")).alias("w")).withColumn("n", F.size("w"))
    runs = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.where("n > 0").withColumn("first", runs)
    counted = F.transform("first", lambda at, k: F.struct(F.get("w", at).alias("word"), (F.coalesce(F.get("first", k + 1), F.col("n")) - at).alias("tf")))
    rows = rows.select("doc_id", "chunk_index", "n", F.explode(counted).alias("c"))
    return rows.select("c.word", "doc_id", "chunk_index", "c.tf", F.col("n").alias("n_words"), part_of("c.word").alias("part"))


def lengths(texts: DataFrame, bucket: Column) -> DataFrame:
    """bucket, texts, words: one row for each bucket."""
    return texts.select(bucket.alias("bucket"), F.size(words_of("text")).alias("n")).groupBy("bucket").agg(F.count("*").alias("texts"), F.sum("n").alias("words"))


def update(store, base, chunks: DataFrame, touched: list[int] | None, kinds: tuple[str, ...] = ("grams", "words")) -> dict:
    """Writes the postings of ``chunks``: the whole content of the buckets
    ``touched`` of the chunk table, or of all (None).  A store that is for one
    kind of search has only its ``kinds``, from its first update on."""
    from ..sources.store import bucket_of

    rows = store.stage(chunks.select("doc_id", "chunk_index", "text"), "texts")
    n = base.buckets(kinds[0]) if touched is not None else store.buckets
    tables = {k: {"grams": gram_postings, "words": word_postings}[k](rows) for k in kinds}
    made = store.write(tables, None if touched is None else {t: touched for t in tables}, base)
    if "words" not in kinds:
        return made
    new = lengths(rows, bucket_of("doc_id", n))
    kept = base.table("lengths").where(~F.col("bucket").isin(touched)) if touched is not None else None
    return made | store.write({"lengths": new if kept is None else kept.unionByName(new)})


def candidates(grams: DataFrame, needle: str) -> DataFrame | None:
    """doc_id, chunk_index of the chunks that hold the needle's rarest trigrams;
    None if it has none.  ``grams`` is read for these parts and grams only."""
    wanted = needle_grams(needle)
    if not wanted:
        return None
    spark = grams.sparkSession
    parts = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(part_of("gram")).distinct().collect()]
    rows = grams.where(F.col("part").isin(parts) & F.col("gram").isin(wanted))
    sizes = dict(rows.groupBy("gram").agg(F.count("*")).collect())  # a row for each trigram of the needle
    if len(sizes) < len(wanted):
        return rows.limit(0).select("doc_id", "chunk_index")
    few = sorted(wanted, key=lambda g: (sizes[g], g))[:RAREST]
    return rows.where(F.col("gram").isin(few)).groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n")).where(F.col("n") == len(few)).select("doc_id", "chunk_index")


def search(chunks: DataFrame, grams: DataFrame, needle: str, k: int = 5) -> DataFrame:
    """``retrieval.search`` over the chunks that can hold the needle."""
    from . import retrieval

    some = candidates(grams, needle)
    return retrieval.search(chunks if some is None else chunks.join(some, ["doc_id", "chunk_index"], "left_semi"), needle, k)


def bm25(words: DataFrame, sizes: DataFrame, query: str, k: int = 20) -> DataFrame:
    """doc_id, chunk_index, score: the best ``k`` texts for the query's words,
    by score (rounded), document and chunk.  A word counts once, however often
    the query has it; texts without any of them have no row."""
    spark = words.sparkSession
    asked = [r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(words_of("q")))).collect()]
    total = sizes.agg(F.sum("texts").alias("n"), F.sum("words").alias("w")).first()
    none = spark.createDataFrame([], "doc_id long, chunk_index int, score double")
    if not asked or not total["n"] or not total["w"]:
        return none
    parts = [r[0] for r in spark.createDataFrame([(w,) for w in asked], "w string").select(part_of("w")).distinct().collect()]
    rows = words.where(F.col("part").isin(parts) & F.col("word").isin(asked))
    have = dict(rows.groupBy("word").agg(F.count("*")).collect())  # a row for each word of the query
    if not have:
        return none
    n, mean = total["n"], total["w"] / total["n"]
    weight = F.create_map(*[x for w, df in sorted(have.items()) for x in (F.lit(w), F.ln(F.lit(1 + (n - df + 0.5) / (df + 0.5))))])
    gain = F.element_at(weight, F.col("word")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / mean))
    scored = rows.groupBy("doc_id", "chunk_index").agg(F.round(F.sum(gain), DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id", "chunk_index").limit(max(1, k))
