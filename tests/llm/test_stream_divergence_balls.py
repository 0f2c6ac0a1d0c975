"""The BPE transducer beside the library, the audit and the clusters beside their SQL and a brute force, on whole tables and hard rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from oracle import both
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import ball_kmeans, divergence, registry, stream_bpe

PATH = P.path("byte_bpe_50k.json")
HARD = [
    None, "", " ", "   ", "a", "a  b", "a\n b\n\n  c", "tab\t x", "x\x1c y", "\r", "\r\n \r\n x", "don't we'll  '", "ñandú über 日本語のテキスト 🎉🎉 x", "é" * 900, "word " * 5000, "nospace" * 3000, " " * 3000 + "a",
    "!" * 700 + "'s", "<|endoftext|> a  <|endoftext|>b<|end", "\U0001E5D0 Ᲊa ࢏1", "12 345  6 ٣", "a" + " " * 999 + "\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return stream_bpe.Model(PATH)


def check_op11(got, texts, library):
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op11_hard_rows_as_the_library(spark, folder_of, library):
    check_op11(registry.op11_stream_bpe(spark, folder_of([(i, t, None, None, None) for i, t in enumerate(HARD)])).collect(), HARD, library)


def test_op11_whole_table_as_the_library(spark, sf_dir, library):
    check_op11(registry.op11_stream_bpe(spark, sf_dir).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}, library)


def test_op11_no_rows_and_general_forms(spark, folder_of, library):
    assert registry.op11_stream_bpe(spark, folder_of([])).collect() == []
    df = spark.createDataFrame([("<|endoftext|>é",), (None,)], "text string")
    with_, plain = (df.select(stream_bpe.encode(F.col("text"), PATH, specials=x).alias("i")).collect() for x in (True, False))
    assert list(with_[0].i) == library.encode("<|endoftext|>é").ids and 50256 not in plain[0].i and list(with_[1].i) == []
    # half a character, and null
    cut = spark.createDataFrame([(bytearray(np.array(library.encode("🎉").ids[:1], "<u4").tobytes()),), (None,)], "i binary").select(stream_bpe.decode(F.col("i"), PATH).alias("t")).collect()
    assert [r.t for r in cut] == [library.decode(library.encode("🎉").ids[:1]), None]


def test_streamed_store_is_bounded_as_its_base(library, model):
    texts = [t or "" for t in HARD]
    for given in ({}, {"kept": 2}):
        made, sizes = stream_bpe.Streamed(model, **given), []
        for text in texts + texts:
            ids, ends = made.encode(pa.array([text]))
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]
            sizes.append(len(made.made.ends))
        assert (sizes == sorted(sizes)) == (not given)


def test_transducer_in_parts_within_its_bounds(library, model):
    rng = random.Random(1)
    letters = list("aaabcdeé ñ  \n\n\t\r'sltreve'd!?.,;12٣　\x1c\u0085日本🎉") + ["<|endoftext|>", "<|end", "'ll", " the", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [t for t in HARD if t]
    for text in texts:
        encoder, decoder, out, back, a = stream_bpe.Encoder(model), stream_bpe.Decoder(model), [], "", 0
        while a < len(text):
            n = rng.choice([1, 2, 3, 7, 50, 400])
            out += encoder.feed(text[a : a + n])
            a += n
            assert len(encoder.window) < model.merges.lookahead + stream_bpe.BLOCK and len(encoder.held) <= stream_bpe.HELD + n
        out += encoder.finish()
        assert out == library.encode(text, add_special_tokens=False).ids, text
        for i in out:
            back += decoder.feed([i])
        assert back + decoder.finish() == text


def by_the_book(merges, word):
    """Each merge of the list in its turn, from the left."""
    parts = [bytes([b]) for b in word]
    for u, v in merges:
        at, joined = 0, []
        while at < len(parts):
            two = parts[at : at + 2] == [u, v]
            joined.append(u + v if two else parts[at])
            at += 1 + two
        parts = joined
    return parts


def test_lookahead_is_enough_for_random_merge_lists():
    rng = random.Random(7)
    for _ in range(60):
        tokens, pairs = [b"a", b"b", b"c"][: rng.choice([1, 2, 3])], []
        for _ in range(rng.randint(1, 14)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                pairs.append((u, v))
                tokens.append(u + v)
        merges = stream_bpe.Merges(pairs, {x: i for i, x in enumerate(tokens)})
        for _ in range(30):
            word = bytes(rng.choice(tokens[0:3])[0] for _ in range(rng.randint(1, 40)))
            word += b"".join(rng.choice(tokens) for _ in range(4))
            want = by_the_book(pairs, word)
            assert [tokens[i] for i in merges.one(word)] == want
            assert [tokens[i] for i in np.frombuffer(merges.many([word], np.dtype("<u4"))[0], "<u4")] == want
            n = rng.randint(1, len(word))
            settled, end = [], 0
            for x in by_the_book(pairs, word[:n]):
                end += len(x)
                if end <= n - merges.lookahead:
                    settled.append(x)
            assert want[: len(settled)] == settled


def test_lists_that_are_no_trained_ones_are_refused():
    with pytest.raises(ValueError):
        stream_bpe.Merges([(b"ab", b"c")], {b"ab": 0, b"c": 1, b"abc": 2})
    with pytest.raises(ValueError):
        stream_bpe.Model(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_ball_kmeans"])
def test_same_rows_as_sql(spark, sf_dir, name):
    mine, sql = both(spark, sf_dir, registry.QUERIES[name], registry.ORACLES[name])
    assert mine == sql and mine[1]


def test_op12_by_hand(spark):
    """One kept term in two sources, a source without terms, a language without a vocabulary, and shares beyond 64 bits."""
    rows = [("Aä1b", "x", "s1")] * 9 + [("aä b a", "x", "s2"), ("B", "x", "s2"), (None, "x", None), ("rare", None, "s1"), ("", None, "s2")]
    got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()}
    # kept: aä in 10 documents, b in 11
    count = {"s1": Counter({"aä": 9, "b": 9}), "s2": Counter({"aä": 1, "b": 2}), "": Counter()}
    p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 4) for t in ("aä", "b")} for s, c in count.items()}
    q = {t: 1 + 10**9 * (n + 2) // 25 for t, n in (("aä", 10), ("b", 11))}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    want = {}
    for s in p:
        other = sorted((-sum(f(p[s][t], p[o][t]) for t in q), o) for o in p if o != s)
        want |= {("x", s, "pair", o): (-v, i + 1) for i, (v, o) in enumerate(other)}
        over = sorted((-f(p[s][t], q[t]), t) for t in q if count[s][t] and p[s][t] > q[t])
        want |= {("x", s, "term", t): (-v, i + 1) for i, (v, t) in enumerate(over)}
    want |= {("", "s1", "pair", "s2"): (0, 1), ("", "s2", "pair", "s1"): (0, 1)}
    assert got == want
    big = spark.range(1).select(divergence.share(F.lit(10**13), F.lit(3 * 10**13)).alias("p")).first().p
    assert big == 1 + 10**9 * (10**13 + 2) // (3 * 10**13)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_op12_terms_of_odd_texts(spark, monkeypatch):
    """As by the pattern: every ASCII character between terms, NUL, letters of other scripts, in runs of any length, with the same term again in a document."""
    monkeypatch.setattr(divergence.bpe, "AT_ONCE", 30)
    odd = ["".join(f"x{chr(b)}Y" for b in range(128)), "É é\u00a0É\x00a", "日本 日本語 a", "", " ", "🎉A a🎉", "Ab" * 50, "a a a A", "\u0130 \u212a K", None]
    rows = [(t, lang, source) for k in range(3) for t in odd for lang, source in (("x", "s"), ("", "a|b"), ("y", f"s{k}"))]
    want_n, want_docs = Counter(), Counter()
    for t, lang, source in rows:
        found = re.findall(divergence.TERM, (t or "").translate(str.maketrans(divergence.UPPER, divergence.LOWER)))
        want_n.update((lang, source, x) for x in found)
        want_docs.update((lang, source, x) for x in set(found))
    docs = spark.createDataFrame([(t or "", lang, source) for t, lang, source in rows], "text string, lang string, source string").coalesce(2)
    made = divergence.term_counts(docs)
    got = made.collect()
    assert {(r.lang, r.source, r.term): r.n for r in got} == want_n and {(r.lang, r.source, r.term): r.n_docs for r in got} == want_docs and len(got) == len(want_n)
    # terms are counted in the worker, not exploded into a row for each occurrence
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()


def brute(vectors, k=16, rounds=3):
    """vectors: (id, components). Every vector with every centroid, in Python's integers."""
    v = [(i, tuple(math.floor(64 * float(np.float32(c))) for c in x)) for i, x in vectors]
    order = sorted(v, key=lambda t: (hashlib.sha256(f"1:{'' if t[0] is None else t[0]}".encode()).hexdigest(), t[1]))
    centers = [list(x) for _, x in order[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        of = [min((d2(x, c), j) for j, c in enumerate(centers)) for _, x in v]
        if turn < rounds:
            for j in range(len(centers)):
                if mine := [x for (_, x), (_, c) in zip(v, of, strict=True) if c == j]:
                    centers[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    inertia = Counter()
    for d, j in of:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(v, of, strict=True)), key=repr)


@pytest.mark.parametrize("shape", ["spread", "ties", "few"])
def test_op13_as_brute_force(spark, tmp_path, shape):
    rng = np.random.default_rng(3)
    if shape == "spread":
        rows = [(i, (rng.normal(size=64) * 0.05 + rng.integers(0, 5) * 0.3).tolist()) for i in range(400)]
    elif shape == "ties":  # repeated rows and ids, centroids that start equal, components on the grid
        rows = [(i % 60, [float(rng.integers(-1, 2)) / 64] * 32 + [0.0] * 32) for i in range(300)] + [(None, [0.0] * 64)] * 3
    else:
        rows = [(i, [float(i)] * 64) for i in range(3)]
    left_out = [(900, None), (901, [1.0] * 63), (902, [float("nan")] + [0.0] * 63), (903, [None] + [0.0] * 63), (904, [float("inf")] + [0.0] * 63)]
    spark.createDataFrame([(i, x, 1) for i, x in rows + left_out], "vec_id long, embedding array<float>, cluster int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in registry.op13_ball_kmeans(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)


def test_op13_no_rows_and_far_components(spark, tmp_path):
    for name, rows in (("none", []), ("far", [(1, [3e38] * 64), (2, [0.0] * 64)])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    assert registry.op13_ball_kmeans(spark, f"{tmp_path}/none").collect() == []
    assert [r.distance for r in registry.op13_ball_kmeans(spark, f"{tmp_path}/far").collect()] == [0, 0]


def test_cores_and_annuli_save_distances():
    """Far balls are never compared once radii are known, and nothing changes by it."""
    rng = np.random.default_rng(5)
    centers = np.arange(16)[:, None] * np.full(8, 1000)
    x = (centers[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 8))).astype(np.int64)
    first = ball_kmeans.nearest(x, np.zeros(2000, np.int64), centers, ball_kmeans.neighbours(centers, np.full(16, np.inf)))
    radius = np.array([np.sqrt(first[1][first[0] == i].max(initial=0)) for i in range(16)])
    again = ball_kmeans.nearest(x, first[0], centers, ball_kmeans.neighbours(centers, radius))
    assert (again[0] == first[0]).all() and (again[1] == first[1]).all() and again[2] == 2000 < first[2]
