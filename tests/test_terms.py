"""Glossaries and memories: cases by hand, and every pattern tried on every text."""

import random
import re

import pytest

from quillspark.operators import term_index as ti
from quillspark.operators import terms

ENTRY = "source string, target string, level string, match_mode string, context string"


def found(spark, entries, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = ti.matched_entries(df, spark.createDataFrame(entries, ENTRY), "text", **kw).collect()
    return {i: [(r.source, r.level) for r in sorted((r for r in rows if r.id == i), key=lambda r: r.place)] for i in range(len(texts))}


def test_modes_levels_and_order(spark):
    entries = [("SCF", "自洽场", "preferred", "exact", None), ("self-consistent field", "自洽场", "CANONICAL", "case_insensitive", None), (r"band\s+gap", "带隙", "canonical", "regex", None), ("(", "x", "preserve", "regex", None), (" DFT ", "DFT", None, "odd", None), ("empty", "", "preferred", "exact", None)]
    got = found(spark, entries, ["SCF cycle", "scf SCFX _SCF", "A Self-Consistent Field; band   gap.", "DFT/SCF", None, "", "密SCF度"])
    assert got[0] == [("SCF", "preferred")] and got[1] == [] and got[4] == [] and got[5] == []
    assert got[2] == [("self-consistent field", "canonical"), (r"band\s+gap", "canonical")]
    assert got[3] == [("DFT", "preferred"), ("SCF", "preferred")]
    assert got[6] == [("SCF", "preferred")]  # only letters of ASCII touch a term
    assert found(spark, entries, ["SCF and a self-consistent field"], levels=("canonical",))[0] == [("self-consistent field", "canonical")]


def test_context_within_160_characters_and_equal_entries(spark):
    entries = [("model", "模型", "preferred", "exact", "Neural"), ("Model", "模型", "preferred", "case_insensitive", "neural")]
    near, far = "model" + " " * 153 + "NEURAL", "model" + " " * 155 + "NEURAL"
    got = found(spark, entries, [near, far, far + " model"])
    assert got == {0: [("Model", "preferred")], 1: [], 2: [("Model", "preferred")]}  # the two count as one entry


def test_too_many_entries(spark):
    many = spark.createDataFrame([(f"w{i}", "x", "preferred", "exact", None) for i in range(201)], ENTRY)
    df = spark.createDataFrame([("w1",)], "text string")
    with pytest.raises(ValueError):
        ti.matched_entries(df, many, "text")
    with pytest.raises(ValueError):
        terms.matches(df, many, "text", "source")


def test_every_place_as_by_patterns():
    """Against one pattern an entry: overlaps, letters without a partner in the other case, contexts."""
    rng = random.Random(2)
    letters = list("aAbBſsSKkKÉéßµμ _-.İıiI") + ["σ", "ς", "Σ", "日"]
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    for _ in range(400):
        entries = [(w.strip() or "a", "t", "preferred", rng.choice(["exact", "case_insensitive"]), rng.choice([None, None, "k"])) for w in (word(3) for _ in range(6))]
        text = word(60)
        edge = "A-Za-z0-9_"
        want = []
        for i, (source, _, _, mode, context) in enumerate(entries):
            p = re.compile(rf"(?<![{edge}]){re.escape(source)}(?![{edge}])", re.IGNORECASE if mode == "case_insensitive" else 0)
            if any(not context or context in text[max(0, m.start() - 160) : m.end() + 160].casefold() for m in p.finditer(text)):
                want.append(i)
        assert ti.Glossary(entries).found(text) == want, (entries, text)


def test_memory_by_hand(spark):
    memory = [("density functional theory", "密度泛函", 3), ("SCF", "SCF", 3), ("basis set", "基组", 5), ("the", "这", 9), ("long phrase of five words", "长", 9), ("DFTB", "这是一个很长的翻译文本句子", 9), ("泛函", "泛函", 1), ("unused", "未用", 0)]
    hints = [("$ run --all\nType: NUMBER", 2), ("$ run --all", 2), ("x = 1", 7)]
    texts = ["Density  Functional\nTheory with SCF and a BASIS SET", "scfx basis sets", "say:\n$ run --all", "泛函数", None, " \n", "run"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in ti.recalled(df, spark.createDataFrame(memory, "key string, value string, hits int"), spark.createDataFrame(hints, "key string, hits int"), "text").collect()}
    assert got[0].term_keys == ["basis set", "density functional theory", "SCF"] and got[0].hint_keys == []
    assert got[0].summary == "\n".join([ti.TERMS_HEAD, "- basis set => 基组", "- density functional theory => 密度泛函", "- SCF => SCF"])
    assert got[1].term_keys == [] and got[1].summary == ""
    assert got[2].hint_keys == ["$ run --all", "$ run --all\nType: NUMBER"] and got[2].summary.startswith(ti.HINTS_HEAD)
    assert got[3].term_keys == ["泛函"]
    assert got[4].summary == "" and got[5].summary == ""
    assert got[6].hint_keys == ["$ run --all", "$ run --all\nType: NUMBER"]


def test_matches_in_any_case(spark):
    df = spark.createDataFrame([(1, "A Foo-bar."), (2, "foobar"), (3, None)], "id int, text string")
    got = terms.matches(df, spark.createDataFrame([("FOO",), ("bar",), ("",)], "term string"), "text", "term").collect()
    assert sorted((r.id, r.term) for r in got) == [(1, "FOO"), (1, "bar")]
