"""Operators against brute force, held-out labels and round trips."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import connect, differ
from pyspark.sql import functions as F

from millrace.llm import bytecnn, ctph, editmatch, mixing, nbsvm, queries, secrets, sharding, simhash, toxcnn, warc
from millrace.llm.common import Words, text_buffer
from millrace.llm.graph import components, stars

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert differ(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf) is None


def test_word_hashes_equal_for_equal_words():
    texts = ["ab c ab", "", "c  ab\nc", "é ab"]
    data, offs = text_buffer(pa.array(texts))
    w = Words(data, offs)
    h, seen = w.word_hashes(), {}
    words = [x for t in texts for x in t.encode().split()]
    assert len(h) == len(words)
    for k, v in zip(words, h):
        assert seen.setdefault(k, v) == v
    assert len(set(seen.values())) == len(seen)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = nbsvm.op1_quality_nbsvm(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in got if r["quality"] == 1]
    bad = [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.8
    assert nbsvm.score_quality(docs, nbsvm.train_quality(docs, labels)).count() == docs.count()


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([1, 2]), np.array([0]), np.array([1])]
    y = np.array([1.0, -1.0, 1.0, -1.0])
    w, b = nbsvm.dual_descent(rows, [1.0] * 4, np.ones(3), y, np.ones(4), 50)
    assert all(np.sign(w[x].sum() + b) == t for x, t in zip(rows, y))


def test_language_held_out(spark):
    got = bytecnn.op4_langid_bytecnn(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_pair_tables_are_the_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (6, bytecnn.WINDOW), np.uint8)
    m = bytecnn.train(x, np.array([0, 1] * 3), ["a", "b"], epochs=1)
    e = m.embed[x]
    direct = []
    for w in bytecnn.WIDTHS:
        c = np.concatenate([e[:, j : bytecnn.WINDOW - w + 1 + j] for j in range(w)], 2)
        direct.append((c @ m.filters[w]).max(1))
    assert np.allclose(np.concatenate(direct, 1), m.tables().pooled(x), atol=1e-4)


def test_toxicity_learns_words():
    rng = random.Random(1)
    clean = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(40)) for _ in range(400)]
    texts = [t if i % 2 else t.replace("beta", "vile", 1) + " vile" for i, t in enumerate(clean)]
    rows = list(toxcnn.word_rows(*text_buffer(pa.array(texts))))
    y = np.array([1 - i % 2 for i in range(400)])
    m = toxcnn.fit(rows[:300], y[:300], ["en"] * 300, 0.5)
    assert ((m.scores(rows[300:]) >= toxcnn.THRESHOLD) == y[300:]).mean() > 0.97


def test_scores_do_not_depend_on_the_batch():
    """One text in twenty batches and places, for each classifier."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts, y = [draw(rng.randint(1, 300)) for _ in range(120)], np.arange(120) % 2
    data = text_buffer(pa.array(texts))
    quality = nbsvm.fit(list(nbsvm.indicator_sets(*data)), y, 0.5)
    toxic = toxcnn.fit(list(toxcnn.word_rows(*data)), y, ["a", "b"] * 60, 0.4)
    windows = [w for ws in bytecnn.sample_windows(*data, list(range(120))) for w in ws]
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, bytecnn.WINDOW)
    language = bytecnn.train(x, np.arange(len(x)) % 3, ["a", "b", "c"], epochs=1)
    tables = language.tables()
    for one in (draw(1), draw(40), draw(3000), "", "x"):
        seen = set()
        for k in range(20):
            others = [draw(rng.choice((0, 1, 7, 90, 600))) for _ in range(rng.randint(0, 40))]
            at = rng.randint(0, len(others))
            batch = pa.array([*others[:at], one, *others[at:]])
            buffer = text_buffer(batch)
            names, score = bytecnn.label_batch(language, tables, batch)
            seen.add((quality.scores(*buffer)[at], toxic.scores(list(toxcnn.word_rows(*buffer)))[at], names[at], score[at]))
        assert len(seen) == 1


def forward(model, rows):
    """Toxicity logit of one text by plain loops over windows and filters."""
    rows = [*map(tuple, rows)] or [(1 << toxcnn.BITS,) * 2]
    embed = [model.embed[a].astype(float) + model.embed[b] for a, b in rows] + [np.zeros(toxcnn.DIM)] * 2
    z, col = model.out_bias, 0
    for k, w in enumerate(toxcnn.WIDTHS):
        for f in range(toxcnn.FILTERS):
            top = max(sum(embed[i + j] @ model.filters[:, col + j * toxcnn.FILTERS + f] for j in range(w)) for i in range(len(rows)))
            z += max(top + model.bias[k * toxcnn.FILTERS + f], 0) * model.out[k * toxcnn.FILTERS + f] * model.unit
        col += w * toxcnn.FILTERS
    return z


def test_toxicity_table_by_plain_forward_pass(spark, sf):
    """The query's scores, word by word, window by window."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxcnn.train_toxicity(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = toxcnn.op6_toxicity_cnn(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    fold = {c: 32 for c in range(128) if not chr(c).isalnum()} | {c: c + 32 for c in range(65, 91)}
    for r in got:
        words = [w.encode() for w in text[r["doc_id"]].translate(fold).split(" ") if w]
        rows = np.array([[plain_hash(w) >> 64 - toxcnn.BITS, (plain_hash(w[: toxcnn.PREFIX]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - toxcnn.BITS] for w in words], np.int64).reshape(-1, 2)
        lang = int(np.argmax([sum(model.langs[a, k] for a in rows[:, 0]) for k in range(model.langs.shape[1])])) if len(rows) else 0
        z = model.slope * forward(model, rows) + model.shift + model.lang_shift[lang]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def plain_hash(raw):
    """The word hash by its definition."""
    mask = (1 << 64) - 1
    h = (sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(raw)) + len(raw)) & mask
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & mask
    return h ^ h >> 29


def test_quality_table_by_plain_sums(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = nbsvm.train_quality(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    mask, shift = (1 << 64) - 1, 64 - nbsvm.BITS

    def mixed(h):
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 & mask
        return h ^ h >> 29

    for r in nbsvm.op1_quality_nbsvm(spark, sf).collect():
        raw = text[r["doc_id"]].encode()
        uni = [plain_hash(w) for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
        held = {h >> shift for h in uni} | {mixed((3 * a + b) & mask) >> shift for a, b in zip(uni, uni[1:])}
        held |= {mixed((int.from_bytes(raw[i : i + 3], "big") + 1) * 0x9E3779B97F4A7C15 & mask) >> shift for i in range(len(raw) - 2)}
        margin = sum(float(model.table[k]) for k in held) / max(1, len(held)) ** 0.5 + model.offset
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-6) and r["predicted"] == int(r["score"] >= 0.7)


def test_language_table_by_plain_windows(spark, sf):
    """The query's labels and scores, window by window, by direct convolution."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = bytecnn.train_language(docs)
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in bytecnn.op4_langid_bytecnn(spark, sf).collect():
        raw, total = text[r["doc_id"]].encode(), 0.0
        for at in range(0, len(raw), bytecnn.WINDOW):
            own = raw[at : at + bytecnn.WINDOW]
            e = model.embed[np.frombuffer(own.ljust(bytecnn.WINDOW, b"\0"), np.uint8)].astype(float)
            top = [max_windows(e, model.filters[w], w) for w in bytecnn.WIDTHS]
            z = (np.maximum(np.concatenate(top) + model.bias, 0) @ model.out) * model.unit + model.out_bias
            p = np.exp(z - z.max())
            total = total + p / p.sum() * len(own) / len(raw)
        if any(map(str.isalpha, text[r["doc_id"]])):
            assert (r["lang_pred"], r["score"]) == (model.langs[int(np.argmax(total))], pytest.approx(max(total), abs=1e-6))
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def max_windows(e, filters, width):
    return np.array([e[i : i + width].ravel() @ filters for i in range(len(e) - width + 1)]).max(0)


def test_thresholds_stand_between_scores():
    p = np.array([0.4] * 6 + [0.7, 0.2])
    y = np.array([1, 0, 1, 0, 1, 0, 1, 0])
    t = toxcnn.best_threshold(p, y, np.ones(8))
    assert t not in p and len({v >= t for v in p[:6]}) == 1


@pytest.mark.parametrize("text, letter", [("½ ² ①", False), ("٣٤", False), ("_-", False), ("ª", True), ("日", True), ("ǅ 1", True), ("ʰ", True)])
def test_letters_are_category_l(text, letter):
    model = bytecnn.ByteCnn(["x"], np.zeros((256, bytecnn.DIM), np.float32), {w: np.zeros((w * bytecnn.DIM, bytecnn.FILTERS), np.float32) for w in bytecnn.WIDTHS}, np.zeros(48), np.zeros((48, 1)), np.zeros(1))
    assert (bytecnn.label_batch(model, model.tables(), pa.array([text]))[0] == ["x"]) == letter


def test_lpt_and_slots(spark):
    assert sharding.lpt([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    got = sharding.op2_sharding_lpt(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()
    want = {r.doc_id: (len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in docs.itertuples()}
    assert {r.doc_id: (r.size_, r.text_crc32) for r in got.rename(columns={"size": "size_"}).itertuples()} == want
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(40)) and load.max() <= load.mean() + max(v[0] for v in want.values())
    assert got.merge(docs, on="doc_id").groupby("text").shard.nunique().max() == 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)


def test_lpt_placement_by_plain_search(spark):
    """Every document where a search over all shards for the least load puts it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS g", f"pmod(xxhash64(xxhash64(coalesce(text, '')), 17), {40 * 512}) AS b").collect()
    size = {}
    for r in docs:
        size[r["g"]] = size.get(r["g"], 0) + len(r["text"].encode()) + 16
    least = -(-sum(size.values()) // (40 * 512))
    unit = {r["g"]: f"g{r['g']}" if size[r["g"]] >= least else f"b{r['b']}" for r in docs}
    total = {}
    for g, u in unit.items():
        total[u] = total.get(u, 0) + size[g]
    load, place = [0] * 40, {}
    for u in sorted(total, key=lambda u: (-total[u], u)):
        place[u] = load.index(min(load))
        load[place[u]] += total[u]
    got = sharding.op2_sharding_lpt(spark, DATA).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == {r["doc_id"]: place[unit[r["g"]]] for r in docs}
    assert max(load) <= 1.01 * sum(load) / 40


def test_short_items_match_inside_words(spark):
    docs = spark.createDataFrame([(1, "to concatenate"), (2, "a dog")], "doc_id long, text string")
    got = editmatch.find_leaks(docs, spark.createDataFrame([(1, "cat")], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["distance"], r["budget"], r["start_char"], r["end_char"]) for r in got] == [(1, 0, 0, 6, 9)]


def test_ipf_meets_margins(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 300), ("b", "x", "q", 50), ("b", "y", "p", 550)], "source string, lang string, topic string, tokens long")
    out = mixing.rake(cells, 0.5, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}, "topic": {"p": 0.6, "q": 0.4}}).toPandas()
    total = out.w.sum()
    assert abs(out[out.source == "a"].w.sum() / total - 0.5) < 1e-3 and abs(out[out.lang == "x"].w.sum() / total - 0.3) < 1e-3 and abs(out[out.topic == "p"].w.sum() / total - 0.6) < 1e-3
    rates = mixing.keep_rates(spark.createDataFrame(out), 0.6).toPandas()
    assert abs((rates.tokens * rates.keep_ppm / mixing.GRAIN).sum() - 0.6 * 1000) < 1 and rates.keep_ppm.max() <= mixing.GRAIN
    with pytest.warns(UserWarning, match="marginals"):  # the only cell of b is of q: the targets contradict each other
        mixing.rake(cells.where("source = 'a' OR topic = 'q'"), 0.5, {"source": {"a": 0.5, "b": 0.5}, "topic": {"p": 0.9, "q": 0.1}}, most_rounds=10)


@pytest.mark.parametrize("few", [True, False])
def test_ipf_against_plain_loops(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    rng = np.random.default_rng(3)
    names = [(f"s{a}", f"l{b}", f"t{c}") for a in range(9) for b in range(3) for c in range(4) if rng.random() < 0.8]
    tokens = dict(zip(names, rng.integers(1, 10**6, len(names)).tolist()))
    total = sum(tokens.values())
    goal = []
    for k in range(3):
        share = {v: (sum(n for x, n in tokens.items() if x[k] == v) / total) ** 0.8 for v in {x[k] for x in names}}
        goal.append({v: g / sum(share.values()) for v, g in share.items()})
    w = {x: n / total for x, n in tokens.items()}
    for _ in range(300):
        for k in range(3):
            own = {v: sum(y for x, y in w.items() if x[k] == v) for v in goal[k]}
            w = {x: y * goal[k][x[k]] / own[x[k]] for x, y in w.items()}
    got = {(r["source"], r["lang"], r["topic"]): r["w"] for r in mixing.rake(spark.createDataFrame([(*x, n) for x, n in tokens.items()], "source string, lang string, topic string, tokens long")).collect()}
    assert got.keys() == w.keys() and all(got[x] == pytest.approx(w[x] * total, rel=1e-7) for x in w)
    raked = spark.createDataFrame([(*x, tokens[x], got[x]) for x in got], "source string, lang string, topic string, tokens long, w double")
    lo, hi = 0.0, 1e6
    for _ in range(200):  # the factor by halving
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(tokens[x], mid * got[x]) for x in got) < 0.97 * total else (lo, mid)
    ppm = {(r["source"], r["lang"], r["topic"]): r["keep_ppm"] for r in mixing.keep_rates(raked, 0.97).collect()}
    assert max(ppm.values()) == mixing.GRAIN and all(abs(ppm[x] - min(1, lo * got[x] / tokens[x]) * mixing.GRAIN) <= 1 for x in got)


def test_secret_spans(spark):
    hexa = hashlib.sha256(b"x").hexdigest()[:40]
    key = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0z"
    text = f"é password: 'hunter22' token=ab, AKIA{'Q' * 16} {hexa} say {key} and justalongwordwithoutdigitsatall"
    got = secrets.find_secrets(spark.createDataFrame([(text,)], "text string")).first()
    spans = [(secrets.KINDS[x["k"]], text[x["s"] : x["e"]]) for x in got["__base"]]
    assert spans == [("assign", "password: 'hunter22"), ("access", "AKIA" + "Q" * 16), ("hex", hexa)]
    assert [text[x["s"] : x["e"]] for x in got["__entropy"]] == [hexa[3:], key]


def test_secrets_table_with_keys_of_every_class(spark, sf, tmp_path):
    """The documents' own words with keys that no base pattern knows, under SQL."""
    rng = random.Random(17)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, alnum, base = "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    rows = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        words = r["text"].split(" ")
        for made in (key(hexa, 32), key(alnum, 24), key(base, 40) + "=", "aaaaaaaaaaaaaaaaaaaa1111", "ThisIsOnlyALongNameOfAClass", "token=" + key(alnum, 30), key("ab", 700) + key(alnum, 600), "EXAMPLE" + key(alnum, 20)):
            words.insert(rng.randrange(len(words) + 1), made)
        rows.append((r["doc_id"], " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differ(spark, con, queries.QUERIES["op7_secrets_entropy"], queries.ORACLES["op7_secrets_entropy"], str(tmp_path)) is None
    spans = [x.split(":")[0] for r in secrets.op7_secrets_entropy(spark, str(tmp_path)).collect() for x in r["spans"].split(",") if x]
    assert spans.count("entropy") >= 4 * len(rows)


def test_entropy_is_shannon(spark):
    rng = random.Random(3)
    mixed = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(n))
    words = ["aB3dE5gH7jK9mN1pQ2rS4tU6", "a1a1a1a1a1a1a1a1a1a1a1a1", "zzzzzzzzzzzzzzzzzzzz9876543210abcdefghij", "a" * 19, "a" * 300 + mixed(30) + "b" * 300, mixed(256), mixed(257), "x" * 250 + mixed(20), mixed(1100)]

    def direct(v, limit):
        hits = []
        for i in range(len(v) - 19):
            c = np.array([v[i : i + 20].count(x) for x in set(v[i : i + 20])]) / 20
            if round(float(-(c * np.log2(c)).sum()), 9) >= limit:
                hits.append(i)
        return (hits[0], hits[-1] + 20) if hits else (-1, -1)

    rows = spark.createDataFrame([(w,) for w in words], "v string").select("v", secrets.entropy_span(F.col("v"), F.lit(3.7)).alias("h")).collect()
    assert [(r["h"]["s"], r["h"]["e"]) for r in rows] == [direct(w, 3.7) for w in words]


def plain_likeness(x, y):
    """Signatures at equal block sizes, by a table of insert-delete distances."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = ((int(a), b, c) for a, b, c in (v.split(":") for v in (x, y)))
    best = 0.0
    for a, b in {(bx, by): [(x1, y1), (x2, y2)], (2 * by, by): [(x1, y2)], (bx, 2 * bx): [(x2, y1)]}.get((bx, by), []):
        a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", v) for v in (a, b))
        k = min(5, len(a), len(b))
        if not k or not any(a[i : i + k] in b for i in range(len(a) - k + 1)):
            continue
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(row[j - 1] if c == d else min(row[j], new[-1]) + 1)
            row = new
        best = max(best, 1 - row[-1] / (len(a) + len(b)))
    return best


def test_ctph_equal_ids_and_ranges(spark):
    """Equal and null ids in many ranges follow one another as one list does."""
    rng = random.Random(8)
    rows = [(rng.choice([7, 7, 7, None, i]), " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, hashlib.sha256(ctph.edited(r["text"], order[(i + 1) % len(order)]["text"]).encode()).hexdigest()) for i, r in enumerate(order))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["edited_sha256"]) for r in ctph.compare_with_next(docs).collect())
    assert got == want


def test_ctph_brute(spark, sf):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in ctph.op9_fingerprints_ctph(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after, n = docs[(k + 1) % len(docs)][1], len(text)
        changed = text[: n - n // 2] + after[: n // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == ctph.fingerprint(text.encode()) and r["edited_fingerprint"] == ctph.fingerprint(changed.encode())
        for near, other in ((r["near_next"], ctph.fingerprint(after.encode())), (r["near_edited"], r["edited_fingerprint"])):
            assert near == pytest.approx(plain_likeness(r["fingerprint"], other))
    long = [r for r in got.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in long])


def test_ctph_rolls():
    """The vectorised hashes are those of a byte-by-byte definition."""
    mult, inv, mask = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), (1 << 64) - 1

    def mixed(h):
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 & mask
        return h ^ h >> 29

    def ranged(b, s, e):
        total = sum((c + 1) * pow(mult, i, 1 << 64) for i, c in enumerate(b[s:e])) & mask
        return total

    text = ("the quick brown fox jumps over the lazy dog " * 9).encode()
    got = ctph.fingerprint(text)
    block = int(got.split(":")[0])
    ends = [i + 1 for i in range(len(text)) if (mixed(ranged(text, max(0, i - 6), i + 1)) >> 33) % block == block - 1]
    ends = ends[: ctph.LENGTH - 1] if len(ends) >= ctph.LENGTH else ends
    ends = ends if ends and ends[-1] == len(text) else [*ends, len(text)]
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    sig = "".join(chars[mixed(ranged(text, s, e) + (e - s) & mask) >> 58] for s, e in zip([0, *ends], ends))
    assert got.split(":")[1] == sig and inv * mult & mask == 1


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_brute(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    ids = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    node, root = stars(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = {i: i for i in ids} | dict(zip(node.tolist(), root.tolist()))
    got = simhash.op10_simhash_neardup(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("radius", [3, 7])
def test_links_lose_nothing(spark, radius, monkeypatch):
    """Chains, a dense hot group (over one block) and sign bits."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << np.uint64(63))
    core = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    hot = core ^ np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(400)], np.uint64)
    fps = np.unique(np.concatenate((base, near, hot)))
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "rep long, fp long")
    got = dict(map(tuple, components(simhash.links(nodes, radius)).collect()))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)
    a, b = stars(i[i < j], j[i < j])
    assert got == dict(zip(a.tolist(), b.tolist()))


def test_plan_is_a_pigeonhole():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64)
    for n in (10, 10_000, 10**7, 10**10):
        both = np.full((64, 64), n / 4)
        np.fill_diagonal(both, n / 2)
        for radius in (0, 3, 11):
            groups = simhash.plan(n, both, radius, sample)
            assert len({b for p in groups for b in p.bits}) == sum(len(p.bits) for p in groups)
            # a pair that is over the threshold in every partition is over the radius
            assert sum(p.threshold + 1 for p in groups) >= radius + 1


def test_plan_follows_the_data():
    """Bits that rarely vary together get another threshold than free ones."""
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 3000, np.uint64)
    fps[::2] &= ~np.uint64((1 << 20) - 1)  # half of the values share 20 bits
    bits = (fps[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(float)
    parts = simhash.plan(10**7, bits.T @ bits * (10**7 / len(fps)), 3, fps)
    assert len({p.threshold for p in parts}) > 1 or len(parts) < 4
    share = simhash.within(fps, 0xFFFFF, 0)[0]
    assert abs(share - 0.25) < 0.01


def test_null_id_links_others(spark):
    """Two fingerprints that only a row without an id connects."""
    found = [i for i in range(4000)]
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [" ".join([*base, f"q{i}"]) for i in found]
    fps = [brute_fingerprint(t) for t in texts]
    far = lambda a, b: (fps[a] ^ fps[b]).bit_count()
    a, b, c = next((a, b, c) for b in found for a in found[:200] for c in found[:200] if 0 < far(a, b) <= 3 and 0 < far(b, c) <= 3 and far(a, c) > 3)
    rows = spark.createDataFrame([(5, texts[a]), (None, texts[b]), (9, texts[c])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(rows).collect()} == {5: 5, 9: 5, None: 5}


def test_near_copies_go_and_clean_stay(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows, n = [], 0
    for g in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((n, " ".join(words)))
        for _ in range(2):
            copy = list(words)
            for p in rng.sample(range(300), 3):
                copy[p] = rng.choice(vocabulary)
            n += 1
            rows.append((n, " ".join(copy)))
        n += 1
    kept = {r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert {i for i in range(n) if i % 3 == 0} <= kept and len(kept) <= 66


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {x: 1000 for x in range(1001, 1400)}


def edit_distance_to_substring(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_brute():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        assert editmatch.myers(p, t)[0] == edit_distance_to_substring(p, t)


def test_matcher_finds_all_within_budget():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 25)))) for i in range(40)]
    m = editmatch.Matcher(items)
    for _ in range(150):
        text = list(" ".join(rng.choice(words) for _ in range(60)) + " " + rng.choice(items)[1] + " " + " ".join(rng.choice(words) for _ in range(20)))
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
        text = editmatch.normalise("".join(text))
        got = {x[0]: x[1] for x in m.matches(text)}
        want = {i: d for i, t in items if (d := edit_distance_to_substring(t, text)) <= int(editmatch.RATE * len(t))}
        assert got == want


def test_leak_spans(spark):
    docs = spark.createDataFrame([(1, "Intro! The  QUICK brown-fox jumps over the lazy dog; end."), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dig")], "item_id long, text string")
    r = editmatch.find_leaks(docs, items).collect()
    assert [(x["doc_id"], x["item_id"], x["distance"]) for x in r] == [(1, 7, 1)]
    assert "Intro! The  QUICK brown-fox jumps over the lazy dog; end."[r[0]["start_char"] : r[0]["end_char"]] == "The  QUICK brown-fox jumps over the lazy dog"


def test_warc_pushdown_and_skip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"{i % 5} WARC/1.1\r\n\r\n" * 30) for i in range(50)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    df = warc.read_warc(spark, f"file://{tmp_path}/w", ["record_type", "page_id", "target_uri"]).where("record_type = 'revisit' AND target_uri IN ('http://x/7', 'http://x/9')")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan.split("BatchScan")[0]  # the reader took the filter
    assert sorted(r["page_id"] for r in df.collect()) == [7, 9]
    full = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(spark, f"file://{tmp_path}/w").where("record_type = 'response'").collect()}
    assert full == {i: f"{i} WARC/1.1\r\n\r\n" * 30 for i in range(5)}

    class Counting(io.BytesIO):
        taken = 0

        def read(self, *a):
            got = super().read(*a)
            Counting.taken += len(got)
            return got

    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part*"))
    assert len(list(warc.read_records(Counting(raw), ["page_id"], {}))) == 50 and Counting.taken == 0


def test_warc_gzip_members(spark, tmp_path):
    import gzip

    warc.write_warc(spark.createDataFrame([(1, "u", "a" * 200), (2, "v", "b" * 200)], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part*"))
    cut = [i for i in range(len(raw)) if raw.startswith(b"WARC/1.1", i)] + [len(raw)]
    (tmp_path / "z.warc.gz").write_bytes(b"".join(gzip.compress(raw[a:b]) for a, b in zip(cut, cut[1:])))
    assert sorted(bytes(r["payload"]) for r in warc.read_warc(spark, f"file://{tmp_path}/z.warc.gz").collect()) == [b"a" * 200, b"b" * 200]


def test_near_copies_are_decided_by_exact_similarity(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for g in range(40):
        base = word(204)  # 200 shingles
        rows.append((len(rows), " ".join(base)))
        for changed in (2, 4, 7, 8, 9, 12):  # each changed word, far from the others, breaks five shingles
            text = list(base)
            for k in range(changed):
                text[10 + 16 * k] = f"new{g}x{changed}x{k}"
            rows.append((len(rows), " ".join(text)))
    rows += [(None, rows[0][1]), (500, ""), (501, None), (502, " ".join(word(3)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 2 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j])):
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    got = simhash.drop_near_duplicates(docs, similarity=0.8)
    assert sorted(r[0] for r in got.select("doc_id").where("doc_id IS NOT NULL").collect()) == [i for i in sorted(sets) if label[i] == i]
    assert got.where("doc_id IS NULL").count() == 1


def similar_components(texts, least=0.8):
    """Smallest index that each text reaches by pairs of five-word shingle sets."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] == sets[j] or 2 * len(sets[i] & sets[j]) >= least * (len(sets[i]) + len(sets[j]))]
    node, root = stars(np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64))
    return dict(zip(node.tolist(), root.tolist()))


@pytest.mark.parametrize("blocks", [None, 64])
def test_template_family_is_compared_whole(spark, blocks, monkeypatch):
    """Texts on one template, all pairs at 0.775 but for one partner each at 0.8."""
    if blocks:
        monkeypatch.setattr(simhash, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(simhash, "BLOCK_SETS", blocks)
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
    texts = []
    for g in range(300):
        text = list(base)
        for p in range(10, 190, 20):  # nine own words, of which the partner has the first
            text[p] = f"own{g % 150 if p == 10 else g}x{p}"
        texts.append(text)
    texts = [" ".join(t) for t in texts]
    lost = similar_components(texts)
    assert len(lost) == 150
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), similarity=0.8)
    assert {r[0] for r in got.select("doc_id").collect()} == set(range(len(texts))) - set(lost)


def test_sieve_share_is_exact():
    """The share of differing bits against sets of random hashes."""
    rng = np.random.default_rng(4)
    for a, b, shared in ((5, 5, 4), (8, 12, 8), (30, 40, 28), (64, 96, 64)):
        pool = rng.integers(0, 1 << 63, (400, a + b - shared), np.uint64) * np.uint64(2) + rng.integers(0, 2, (400, a + b - shared), np.uint64)
        off = [np.bitwise_count(simhash.sketch(h[:a]) ^ simhash.sketch(h[a - shared :])).sum() for h in pool]
        assert abs(np.mean(off) / simhash.BITS - simhash.differing_share(a, b, shared)) < 0.01
        assert max(off) <= simhash.bit_limits()[min(a, b, 64)]


@pytest.mark.parametrize("blocks", [2048, 16])
def test_far_rows_meet_all_rows(spark, blocks, monkeypatch):
    """Each far row of a value meets every other row of it, near rows among themselves need not."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(blocks)
    rows = [(g, r, bool(rng.random() < share)) for g, (n, share) in enumerate(((1, 1.0), (40, 0.3), (90, 0.02), (60, 1.0), (30, 0.0))) for r in range(n)]
    units = simhash.far_and_all(spark.createDataFrame(rows, "g long, rep long, far boolean").withColumn("v", F.col("g")), "v").collect()
    met, by = set(), {}
    for r in units:
        by.setdefault(r["u"], []).append(r)
    for members in by.values():
        assert len({r["v"] for r in members}) == 1 and len(members) <= 2 * blocks + 40
        met |= {(r["v"], r["rep"], q["rep"]) for r in members for q in members if r["rep"] < q["rep"] and r["side"] * q["side"] not in (1, 4)}
    want = {(g, r, q) for g, r, a in rows for h, q, b in rows if g == h and r < q and (a or b)}
    assert want <= met


def test_group_links_connects_what_passes():
    """Any side, any size: the components of all passing pairs."""
    rng = np.random.default_rng(6)
    for n, spread in ((1, 5), (30, 40), (300, 900), (300, 30), (900, 5000)):
        c = {"rep": rng.permutation(n).astype(np.int64), "v": rng.integers(0, spread, n), "side": rng.integers(1, 3, n) if n % 2 == 0 and spread > 30 else np.zeros(n, np.int64)}
        passes = lambda c, i, j: np.abs(c["v"][i] - c["v"][j]) <= 1
        got = dict(zip(*simhash.group_links(np.zeros(n, np.int64), c, passes)))
        i, j = np.triu_indices(n, 1)
        s = c["side"][i] * c["side"][j]
        ok = passes(c, i, j) & (s != 1) & (s != 4)
        assert got == dict(zip(*stars(c["rep"][i[ok]], c["rep"][j[ok]])))


@pytest.mark.parametrize("least", [0.8, simhash.SIMILARITY])
def test_near_dedup_recall_beyond_the_radius(spark, least):
    """Words added at the end, single lines repeated and short texts, with the
    shipped parameters: all pairs count, however far their fingerprints are."""
    rng = np.random.default_rng(8)
    texts = []
    for words, more in ((8, 1), (8, 2), (8, 3), (24, 11), (24, 10), (24, 5), (24, 3), (104, 51), (104, 50), (104, 20), (104, 15), (404, 200), (404, 201), (404, 60), (404, 101)):
        for _ in range(12):
            base = [f"w{x}" for x in rng.integers(0, 10**6, words + more)]
            texts += [" ".join(base[:words]), " ".join(base)]
    for _ in range(10):  # a set as good as equal, counts that differ
        one, two = ([f"w{x}" for x in rng.integers(0, 10**6, 40)] for _ in range(2))
        texts += [" ".join(one * 9 + two), " ".join(one + two * 9)]
    lost = similar_components(texts, least)
    far = [i for i in lost if (simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[i - 1].encode())).bit_count() > 11]
    assert len(lost) > 120 and len(far) > 10
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=least)
    assert {r[0] for r in got.select("doc_id").collect()} == set(range(len(texts))) - set(lost)


def jaccard_pairs(texts):
    """(i, j, index) of all pairs of texts whose five-word shingle sets meet."""
    holders, sizes = {}, []
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
        sizes.append(len(own))
        for x in own:
            holders.setdefault(x, []).append(i)
    shared = {}
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[b], own[a]] = shared.get((own[b], own[a]), 0) + 1
    return [(i, j, n / (sizes[i] + sizes[j] - n)) for (i, j), n in shared.items()]


def test_near_dedup_recall_against_an_independent_truth(spark):
    """With the shipped limit, on a whole table: of the texts that have an
    earlier near copy, taken at a Jaccard index of 0.4 over all pairs, nine of
    ten go; no text whose index with every other is under 0.3 does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    pairs = jaccard_pairs([t for _, t in rows])
    i, j = (np.array([p[k] for p in pairs if p[2] >= 0.4], np.int64) for k in (0, 1))
    copies = set(stars(i, j)[0].tolist())
    equal = [(p[0], p[1]) for p in pairs if p[2] == 1]
    exact = set(stars(*(np.array([p[k] for p in equal], np.int64) for k in (0, 1)))[0].tolist())
    most = np.zeros(len(rows))
    for a, b, x in pairs:
        most[[a, b]] = np.maximum(most[[a, b]], x)
    kept = {r[0] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    gone = {k for k, (d, _) in enumerate(rows) if d not in kept}
    assert len(copies - exact) >= 20
    assert len(gone & copies) >= 0.9 * len(copies) and len(gone & (copies - exact)) >= 0.9 * len(copies - exact)
    assert not gone & set(np.flatnonzero(most < 0.3).tolist())


def test_near_dedup_finds_candidates_by_fingerprint(spark, monkeypatch):
    """Near copies within the radius are found by their fingerprints alone, the
    exact comparison has the last word."""
    rng = np.random.default_rng(31)
    texts = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 1500)]
        texts += [" ".join(base), " ".join([*base, "more"])]
    near = [i for i in range(0, 60, 2) if np.bitwise_count(simhash.sketch(simhash.shingle_set(texts[i].encode()))[0] ^ simhash.sketch(simhash.shingle_set(texts[i + 1].encode()))[0]) <= simhash.RADIUS]
    assert len(near) > 20
    monkeypatch.setattr(simhash, "may_belong_together", lambda nodes, *_: nodes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()} == set(range(60)) - {i + 1 for i in near}
    monkeypatch.setattr(simhash, "links", lambda nodes, *_: nodes.select(F.col("rep").alias("a"), (F.col("rep") - F.col("rep") % 4).alias("b")))  # false candidates
    assert {r[0] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()} == {i for i in range(60) if i % 4 != 1 and i % 4 != 3}


def met_truth(rows):
    """The rows (repeats included) of each shingle that several have; equal ones once."""
    by = {}
    for i, text in rows:
        for h in simhash.shingle_set(text.encode()).tolist():
            by.setdefault(h, []).append(i)
    return {tuple(sorted(x)) for x in by.values() if len(x) > 1}


@pytest.mark.parametrize(("most", "length"), [(1 << 23, 4096), (1 << 23, 3), (40, 4096), (40, 3)])
def test_packed_shingles_meet_as_rows_do(spark, most, length):
    """Also in lists of three, and of buckets that are told in several goes."""
    rng = np.random.default_rng(3)
    rows = [(int(i) - (1 << 62), " ".join(f"w{k}" for k in rng.integers(0, 3, rng.integers(0, 12)))) for i in rng.integers(0, 1 << 63, 120, dtype=np.int64)]
    texts = list({t: i for i, t in rows}.items())
    docs = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string").repartition(5)
    found = {}
    for r in simhash.met_groups(docs, "doc_id", lambda h: h, 3, most, length).dropDuplicates(["x1", "x2", "part"]).collect():
        assert len(r["ids"]) <= length
        found.setdefault((r["x1"], r["x2"]), []).extend(r["ids"])
    want = met_truth([(i, t) for t, i in texts])
    assert want and {tuple(sorted(x)) for x in found.values()} == want
    assert most < 1 << 23 or len(found) == len(want)


def test_ids_not_among_others_are_told(spark):
    ids = spark.range(-500, 500).select((F.col("id") * 7919).alias("doc_id"))
    docs = spark.createDataFrame([(None,)], "doc_id long").union(ids).union(spark.range(1 << 40, (1 << 40) + 20_000).toDF("doc_id"))
    kept = [r[0] for r in docs.where(simhash.maybe_among(ids, "doc_id")).collect()]
    assert {r[0] for r in ids.collect()} <= set(kept) and None not in kept and len(kept) < 4000
    assert docs.where(simhash.maybe_among(ids.limit(0), "doc_id")).count() == 0


def test_near_dedup_shuffles_less_than_the_texts(spark, monkeypatch):
    """Texts that have no near copy stay where they are, and shingles go packed."""
    monkeypatch.setattr(simhash, "SAMPLE_TEXTS", 5)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 10_000, 600)) for _ in range(1000)]
    texts += [t + " end" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in (lambda e: [e.apply(i) for i in range(e.size())])(sc.statusStore().executorList(False)))

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert {r[0] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()} == set(range(1000))
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert moved < sum(map(len, texts)), moved
