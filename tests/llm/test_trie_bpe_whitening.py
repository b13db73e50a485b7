"""Operators 11 to 13 against brute force, the reference tokeniser and numpy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import bpe, prefixtrie, whitening


# ---------------------------------------------------------------- prefix trie


def brute_trie(rows):
    """{(conv_id, depth): (parent, n_convs, children, leaves, saved, digest)}"""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    for c in own:
        own[c] = [x[3:] for x in sorted(own[c])]
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out, sums = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved = (len(nodes[p]) - 1) * words + sum(sums[k][0] for k in kids[p])
        leaves = sum(sums[k][1] for k in kids[p]) or 1
        sums[p] = saved, leaves
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(made[c]) == len(p))
        out[(min(nodes[p]), len(p))] = (min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def run_trie(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefixtrie.prefix_trie(df.repartition(3), **how).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): tuple(r[2:]) for r in got}


@pytest.mark.parametrize("block, group, seed", [(64, 1 << 16, 0), (2, 4, 1), (3, 2, 2)])
def test_trie_brute(spark, block, group, seed):
    """Deep, shared, equal and nested conversations; small blocks take several
    levels of names, small groups take their intervals from each other."""
    rng, rows = random.Random(seed), []
    lines = [("user", "a b"), ("user", "c"), ("assistant", "d  e f"), (None, "é x")]
    for c in rng.sample(range(-30, 400), 90):
        kind = rng.random()
        n = rng.choice([1, 2, 3, 4, 6, 9, 23 if seed else 70])
        same = rng.choice([0, 1]) if kind < 0.6 else None
        for t in range(n):
            line = lines[same] if same is not None and t < n - rng.randint(0, 2) else rng.choice(lines)
            rows.append((c, t, *line))
    assert run_trie(spark, rows, block=block, group=group) == brute_trie(rows)


def test_trie_edges(spark):
    assert run_trie(spark, []) == {}
    rows = [(None, 0, "user", "x"), (3, None, None, None), (3, 1, "user", "long " * 50_000), (3, 1, "user", "b"), (3, 1, "user", "b"), (7, 0, "", ""), (47, 5, "user", "")]
    assert run_trie(spark, rows, block=2, group=2) == brute_trie(rows)
    lone = [(c, 0, "user", "x") for c in range(40, 60) if zlib.crc32(str(c).encode()) % 4][:1]
    got = run_trie(spark, [(c + 1000 * 20, *r) for c, *r in lone])
    assert got == brute_trie([(c + 1000 * 20, *r) for c, *r in lone])


def test_trie_clashing_columns(spark):
    rows = [(1, 0, "user", "x", 5, "y"), (2, 0, "user", "x", 6, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rank long, c string")
    got = {(r.conv_id, r.depth): tuple(r[2:]) for r in prefixtrie.prefix_trie(df).collect()}
    assert got == brute_trie([r[:4] for r in rows])


def test_trie_hot_conversation(spark):
    """One conversation with most rows is split; many equal ones are one leaf."""
    rows = [(11, t, "user", str(t)) for t in range(3000)] + [(c, t, "user", "same") for c in range(100, 400) for t in range(2)]
    assert run_trie(spark, rows, block=16, group=32) == brute_trie(rows)


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def tokeniser():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    with open(path, "rb") as f:
        v = bpe.Vocabulary(f.read())
    return path, v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def encoded(v, texts):
    raw = [t.encode() for t in texts]
    ids, first = v.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


ODD = ["", "a", "it's", "I'll've 'tis ' s", "  x", " \n x", "\n\nx", "x  ", "''s", "!'s a's 1's", "a'", "a're'r", "日本語テキスト 12३", "  ", "\t a", "é's", "x'll", "x'l", "x’s", "a b　 c", "'re", " 's", "<|endoftext|>", "🙂👍🏽 é", "\x1c\x1d a"]


def test_bpe_texts(tokeniser):
    _, v, known = tokeniser
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aA sdtmrevl'’ \n\t1२é!.　日") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    assert encoded(v, texts) == [known.encode_ordinary(t) for t in texts]


def test_bpe_code_points(tokeniser):
    """Every code point has the class that the library gives it."""
    _, v, known = tokeniser
    points = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x20000), *range(0x10FFF0, 0x110000)]]
    for lead in "a1!":
        text = "".join(lead + c for c in points)
        assert encoded(v, [text]) == [known.encode_ordinary(text)]


def test_bpe_long(tokeniser):
    """Long slices by the heap, long texts by windows."""
    _, v, known = tokeniser
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 3000, " " * 1000 + "x", "日本" * 500, "".join(rng.choice("abcde") for _ in range(20000))]
    assert encoded(v, texts) == [known.encode_ordinary(t) for t in texts]
    for text in ("".join(rng.choice("ab 'sé\n1.") for _ in range(1_500_000)), "xy" * 700_000):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert v.encode_long(raw).tolist() == known.encode_ordinary(text)


def test_bpe_query(spark, sf, tokeniser):
    _, _, known = tokeniser
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = known.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_byte_bpe(spark, sf).collect()}
    assert got == want


def test_bpe_rows(spark, tokeniser):
    """Nulls, repeats, clashing columns; offsets cut a text where its tokens end."""
    path, v, known = tokeniser
    rows = [(None, "it's", "x"), (1, None, "x"), (1, "héllo wörld", "y"), (1, "héllo wörld", "y"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == sorted((a or 0, b or "") for a, b, _ in rows)
    for r in out:
        cuts = [0, *r.ends]
        assert [bytes(r.decoded)[a:b] for a, b in zip(cuts, cuts[1:])] == [known.decode_single_token_bytes(i) for i in r.ids]
    assert bpe.encode(docs.limit(0), path).count() == 0
    broken = bpe.encode(docs, path).selectExpr("doc_id", "ids", "transform(ends, x -> x + 1) AS ends")
    with pytest.raises(Exception, match="offsets that do not fit"):
        bpe.decode(broken, path).collect()


def test_bpe_cache_bound(tokeniser, monkeypatch):
    _, v, known = tokeniser
    monkeypatch.setattr(bpe, "MOST_CACHED", 10)
    text = " ".join(f"word{i}q" for i in range(200))
    assert encoded(v, [text]) == [known.encode_ordinary(text)]


# ---------------------------------------------------------------- whitening


def test_whitening_table(spark, sf):
    rows = whitening.op13_embedding_whitening(spark, sf).collect()
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    keys = sorted(table)
    x = np.floor(1024 * np.array([table[k] for k in keys], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    got = np.zeros((n, 8))
    at = {k: i for i, k in enumerate(keys)}
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-10
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    assert len(rows) == 8 * n
    want = y @ v[:, :8] / np.sqrt(e[:8])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    dev = ((n * x - s) ** 2).sum(1)
    assert all(r.deviation == dev[at[r.vec_id]] for r in rows)


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, 0.25, 0.0]), (2, None), (3, [0.1, None, 0.2]), (4, [nan, 0.1, 0.2]), (5, [inf, 0.1, 0.2]), (6, [0.1, 0.2]), (7, []), (None, [0.125, 0.5, 0.0]), (1, [0.5, 0.25, 0.0]), (8, [-0.5, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n string")
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {1, None, 8} and {r.n for r in got} == {4}
    assert sorted({r.component for r in got}) == [1, 2] and len(got) == 8  # rank 2: the third entry never changes
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1)
    assert all(r.identity_error < 1e-9 for r in got)
    for few in (rows[:1], [rows[0]] * 3, rows[1:5], []):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("most", [512, 48])
@pytest.mark.parametrize("values", [1.0 / np.arange(1, 301), np.ones(200), np.r_[5.0, 5, 5, 3, np.zeros(60)], 0.9 ** np.arange(120), np.ones(1)])
def test_lanczos(values, most):
    """Spectra with gaps, one value, low rank (breakdown) and restarts."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    work = whitening.Lanczos(lambda x: a @ x, len(values), 8, most=most)
    e, v = work.solve()
    assert np.abs(e - np.sort(values)[::-1][:8]).max() < 1e-12 * values.max() * 10
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12
    assert np.linalg.norm(a @ v - v * e, axis=0).max() < 1e-11 * values.max()
    assert work.q.shape[1] <= max(most, 64)
