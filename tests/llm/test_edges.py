"""Nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import binascii
import importlib
import os

import pytest
from pyspark.sql import functions as F

from millrace.llm import bytecnn, ctph, editmatch, mixing, nbsvm, secrets, sharding, simhash, toxcnn, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten " * 20_000
ROWS = [
    (0, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (2, None, None, None, None), (3, "", "fr", "s", 0),
    (4, "   \n\t", "de", None, 5), (5, LONG, "en", "t", 1), (6, LONG, None, "t", 1), (None, "nothing has an id here", "en", "t", 3), (None, None, None, None, None), (7, "é", "fr", "u", 1),
    (8, "12345 !!", "en", "u", 8), (9, "nüll \U0001f600 byte", "de", "u", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    return df.withColumns({n: F.lit("mine") for n in names})


def test_quality_and_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (5, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for train, score in ((nbsvm.train_quality, nbsvm.score_quality), (toxcnn.train_toxicity, toxcnn.score_toxicity)):
        model = train(docs, labels)
        got = score(clash(docs, "score", "held_out", "y"), model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
        held = {r["doc_id"]: r["held_out"] for r in got}
        assert all(v == (k is not None and binascii.crc32(str(k).encode()) % 4 == 2) for k, v in held.items())
        assert score(none, model).count() == 0
        blank = train(docs, labels.limit(0))
        assert len(score(docs, blank).collect()) == len(ROWS)


def test_language(spark, docs, none):
    model = bytecnn.train_language(docs)
    got = bytecnn.predict_language(clash(docs, "score", "y"), model).collect()
    assert len(got) == len(ROWS)
    und = [r for r in got if r["lang_pred"] == "und"]
    assert len(und) == 5 and all(r["score"] == 0 for r in und)  # two nulls, empty, blanks, no letter
    assert bytecnn.predict_language(none, model).count() == 0
    assert bytecnn.train_language(none) is None
    assert {r["lang_pred"] for r in bytecnn.predict_language(docs, None).collect()} == {"und"}
    kept = bytecnn.keep_identified(clash(docs, "score", "langs"), model, least=0.0)
    assert kept.count() == len(ROWS) - 5 and kept.columns[-2:] == ["score", "langs"]


def test_sharding(spark, docs, none):
    got = sharding.shard_frame(clash(docs, "size", "shard", "slot"), 3).collect()
    assert len(got) == len(ROWS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    empty = [r for r in got if r["size"] == 16]
    assert len(empty) == 3 and len({r["shard"] for r in empty}) == 1 and all(r["text_crc32"] == 0 for r in empty)
    assert sharding.shard_frame(none, 3).count() == 0
    out = sharding.shard_documents(clash(docs, "size", "__own"), 3)
    assert out.count() == len(ROWS) and out.columns == [*SCHEMA.replace(",", "").split()[::2], "size", "__own", "shard"]


def test_mixing(spark, docs, none):
    got = mixing.mix_documents(clash(docs, "tokens", "topic", "w"), most_rounds=2)
    assert got.count() == len(ROWS) and got.columns.count("topic") == 1
    assert {r["kept"] for r in got.where("tokens = 0").collect()} == {True}
    kept = mixing.sample_documents(clash(docs, "topic", "kept"), most_rounds=2)
    assert kept.columns[-2:] == ["topic", "kept"] and {r["topic"] for r in kept.collect()} == {"mine"}
    assert mixing.mix_documents(none).count() == 0
    low = mixing.mix_documents(docs, targets={"source": {"s": 0.0}}, most_rounds=2)
    assert not [r for r in low.where("source = 's' AND tokens > 0").collect() if r["kept"]]


def test_secrets(spark, docs, none):
    got = secrets.find_secrets(clash(docs, "s", "k", "e")).collect()
    assert len(got) == len(ROWS) and all(r["__base"] == [] and r["__entropy"] == [] for r in got)
    assert secrets.find_secrets(none).count() == 0
    many = spark.createDataFrame([("token=abcdef " * 2000,)], "text string")
    spans = secrets.find_secrets(many).first()["__base"]
    assert [(x["s"], x["e"]) for x in spans] == [(13 * i, 13 * i + 12) for i in range(2000)]


def test_fingerprints(spark, docs, none):
    got = ctph.compare_with_next(clash(docs, "edge", "fingerprint")).collect()
    assert len(got) == len(ROWS) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {"3::"}
    assert ctph.compare_with_next(none).count() == 0
    one = ctph.compare_with_next(docs.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len(LONG)


def test_simhash(spark, docs, none):
    got = {r["doc_id"]: r for r in simhash.simhash_components(clash(docs, "fp", "rep", "g")).collect()}
    assert got[2]["fingerprint"] == got[3]["fingerprint"] == got[4]["fingerprint"] == "0" * 16
    assert {got[k]["component_id"] for k in (2, 3, 4)} == {2} and got[1]["component_id"] == 0 and got[6]["component_id"] == 5
    assert simhash.simhash_components(none).count() == 0
    lone = spark.createDataFrame([(None, "only null ids")], "doc_id long, text string")
    assert simhash.simhash_components(lone).first()["component_id"] is None
    kept = simhash.drop_near_duplicates(clash(docs, "fp", "s0", "count"))
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [0, 2, 5, 7, 8, 9] and kept.where("doc_id IS NULL").count() == 2 and kept.columns[-3:] == ["fp", "s0", "count"]
    twice = spark.createDataFrame([(1, "same row twice"), (1, "same row twice"), (2, "other words stand here")], "doc_id long, text string")
    assert sorted(r[0] for r in simhash.drop_near_duplicates(twice).collect()) == [1, 2]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_edit_matching(spark, docs, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, " !! "), (4, "nothing has an id here"), (4, "nothing has an id here"), (5, "six seven eight nine ten one two three")], "item_id long, text string")
    got = editmatch.find_leaks(clash(docs, "item_id", "distance"), items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, 4), (-1, 4), (5, 5), (6, 5)]
    assert editmatch.find_leaks(none, items).count() == 0 and editmatch.find_leaks(docs, items.limit(0)).count() == 0
    left = editmatch.drop_leaks(clash(docs, "item_id"), items)
    assert left.count() == len(ROWS) - 3 and left.columns[-1] == "item_id"


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 150), (1, "u", "x" * 150), (2, None, "x" * 150), (3, "a\r\nb", None), (4, "w", ""), (5, "w", LONG), (None, "q", LONG), (6, "w", "short"), (7, "w", "short")], "page_id long, url string, html string")
    warc.write_warc(clash(pages, "value", "__id2"), f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == 9
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to_page"]) for r in got)
    assert kinds == [(-1, "revisit", 5), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_hot_payload(spark, tmp_path):
    """One payload on most pages, ties of the smallest id, null ids."""
    rows = [(i, "u", "hot " * 50) for i in range(3, 400)] + [(2, "a", "hot " * 50), (2, "b", "hot " * 50), (None, "n", "hot " * 50), (1, "o", "alone " * 30)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows) and sorted(r["page_id"] for r in got if r["record_type"] == "response") == [1, 2, 2]
    assert {r["refers_to_page"] for r in got if r["record_type"] == "revisit"} == {2} and {r["payload"] is None for r in got if r["record_type"] == "revisit"} == {True}


def test_pipeline_stages(spark, docs, sf):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "../../corpus_pipeline.py")):
        pytest.skip("no pipeline")
    pipeline = importlib.import_module("corpus_pipeline")
    extra = clash(docs, "topic", "fp", "unit", "score")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns + ["shard"] * (k == len(pipeline.STAGES) - 1)
        assert out.count() <= len(ROWS)
        assert stage(spark, extra.limit(0), sf).count() == 0


def test_long_labelled_texts_are_not_drawn(spark):
    """A sample is drawn among texts that may be learnt from; a class that has
    none is said to have none."""
    rows = [(i, ("good plain words " if i % 2 else "junk junk spam ") * (3 if i < 40 else 4000)) for i in range(1000) if binascii.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    for train, score in ((nbsvm.train_quality, nbsvm.score_quality), (toxcnn.train_toxicity, toxcnn.score_toxicity)):
        model = train(docs, labels, per_class=10)
        got = {r["doc_id"]: r["score"] for r in score(docs.where("doc_id < 40"), model).collect()}
        odd, even = ([v for k, v in got.items() if k % 2 == p] for p in (1, 0))
        assert min(odd) > max(even) if train is nbsvm.train_quality else max(odd) < min(even)
        with pytest.warns(UserWarning, match="no labelled text"):
            train(docs.where("doc_id >= 40"), labels, per_class=10)
