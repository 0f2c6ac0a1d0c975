import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, common, registry, token_files

HARD = [
    None, "", " ", "   ", "a", "a  b", "a\n b\n\n  c", "tab\t x", "x\x1c y", "!\x1c !", "don't we'll  ", "  lead", "ñandú über 日本語のテキスト 🎉🎉 x", "é" * 300,
    "word " * 5000, "nospace" * 3000, "<|endoftext|> a<|endoftext|>", "a  b 　 c", "12 345  6", "\r\n \r\n x",
]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(texts):
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


def test_encoding_as_by_ranks_and_back(spark, folder_of, reference):
    got = {r.doc_id: r for r in registry.op10_byte_bpe(spark, folder_of(rows(HARD))).collect()}
    assert len(got) == len(HARD)
    for i, t in enumerate(HARD):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_whole_table_as_by_ranks(spark, sf_dir, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.op10_byte_bpe(spark, sf_dir).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, reference.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest()


def test_encoding_with_check_encodes_once(spark, reference):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = spark.createDataFrame(rows(HARD), "id long, text string, lang string, source string, n long").coalesce(1)
    coded = texts.withColumn("c", bpe.encode_checked(F.col("text"), path)).select("text", "c.ids", "c.same_text", F.size("c.ids").alias("n"))
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"run\(text#\d+\)", re.search(r"ArrowEvalPython \[(.*)\], \[", plan)[1])) == 1
    got = coded.collect()
    assert len(got) == len(HARD)
    assert all(r.same_text and r.n == len(r.ids) and r.ids == reference.encode_ordinary(r.text or "") for r in got)


def test_pipeline_encodes_once(spark):
    docs = spark.createDataFrame(rows(HARD), "doc_id long, text string, lang string, source string, n_chars long")
    plan = corpus_pipeline.tokens(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"run\(text#\d+\)", re.search(r"ArrowEvalPython \[(.*)\], \[", plan)[1])) == 1


def test_bytes_that_differ_are_told(monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids, ends = bpe.pieces(path).encode(pa.array(["one two", None, "ñ"]))
    assert bpe._bytes_of(ids, ends, path).to_pylist() == [b"one two", b"", "ñ".encode()]
    run = []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: run.append(f) or (lambda c: c))
    bpe.encode_checked(None, path)
    monkeypatch.setattr(bpe.Pieces, "encode", lambda self, texts: (ids, ends))
    assert [r["same_text"] for made in run[0](iter([pa.array(["one twO", "", "ñ"])])) for r in made.to_pylist()] == [False, True, True]
    assert list(run[0](iter([pa.array([], pa.string())]))) == []


def test_tidy_gives_memory_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    made = common.tidy(lambda batches: (2 * x for x in batches))(iter([1, 2]))
    assert next(made) == 2 and not given and list(made) == [4] and given == [1]


def test_workers_keep_no_pieces_of_a_task(monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    run = []
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: run.append(f) or (lambda c: c))
    monkeypatch.setattr(bpe, "LITTLE", 20)
    bpe.encode_checked(None, path)
    made = run[0](iter([pa.array(HARD[:-6]), pa.array(HARD[-6:])]))
    next(made)
    sizes = [len(x) for x in made]
    assert len(sizes) > 5 and 0 < sum(sizes) < len(HARD)
    kept = bpe.pieces(path, kept=bpe.FEW_PIECES)
    assert not kept.open and not kept.words.keys() - {""}


def test_offsets_and_text(spark):
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("ñandú 🎉 x",)], "text string").withColumn("ids", bpe.encode(F.col("text"), path))
    r = df.select("text", "ids", bpe.offsets(F.col("ids"), path).alias("at"), bpe.decode(F.col("ids"), path).alias("back")).first()
    assert r.back == r.text
    assert r["at"][0]["start"] == 0 and r["at"][-1]["end"] == len(r.text)
    known = bpe.token_bytes(bpe.load_tokenizer(path))
    for i, at in zip(r.ids, r["at"], strict=True):
        assert known[i] in r.text[at["start"] : at["end"]].encode()
    assert "".join(bpe.decode_stream(r.ids, known)) == r.text


def test_token_files(spark, folder_of):
    t = bpe.load_tokenizer(P.path("byte_bpe_50k.json"))
    folder = folder_of(rows(HARD)[::-1])
    got = sorted(registry.op7_token_files(spark, folder).collect())
    start = 0
    for i, text in enumerate(HARD):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_nothing_and_of_ties(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, start long")
    token_files.write(none, f"{tmp_path}/none", P.path("byte_bpe_50k.json"))
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0
    ties = spark.createDataFrame([(None, "b", 1), (7, "a", 1), (7, "a", 2), (7, None, 3)], "doc_id long, text string, start long")
    token_files.write(ties, f"{tmp_path}/ties", P.path("byte_bpe_50k.json"))
    got = token_files.read(spark, f"{tmp_path}/ties").orderBy("start").collect()
    assert [(r.id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (7, 2, 1), (7, 3, 2), (7, 5, 2)]


def test_one_id_in_many_files(spark, tmp_path):
    """Very many rows of one id, or of null ids, are dealt to many tasks, and stay in order."""
    rows = [(None, f"{i * 7919 % 3000:04d} text") for i in range(3000)] + [(5, f"{i * 31 % 500:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = token_files.write(df, f"{tmp_path}/hot", P.path("byte_bpe_50k.json"), partitions=8)
    assert len(manifest["shards"]) == 8 and max(s["n_docs"] for s in manifest["shards"]) < 1200
    t, start, want = bpe.load_tokenizer(P.path("byte_bpe_50k.json")), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((i, start, n := len(t.encode(text, add_special_tokens=False).ids) + 1))
        start += n
    assert [tuple(r) for r in token_files.read(spark, f"{tmp_path}/hot").select("id", "start", "n_tokens").orderBy("start").collect()] == want


def test_rank_file_line(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"ab") + b" 3\n")
    assert bpe.read_ranks(str(tmp_path / "r")) == {b"ab": 3}
