"""Nested blocks and JSON columns: cases by hand."""

import json
import random

from pyspark.sql import functions as F

from quillspark.operators import block_tree, json_rows

BODY = {"content": {"kind": "text", "text": "words"}, "layout_role": "paragraph", "semantic_role": "body", "structure_role": "body"}


def items(spark, blocks):
    df = spark.createDataFrame([(0, json.dumps({"blocks": blocks}))], "page int, j string")
    return {r.item_id: r for r in block_tree.blocks(df, "j", "page").withColumn("admitted", block_tree.admitted()).withColumn("keeps", block_tree.keeps_origin()).withColumn("seed", block_tree.seeded_structure()).select("*", *block_tree.role_profile()).collect()}


def test_walk_takes_the_algorithm_along_and_skips_what_has_no_text(spark):
    inner = BODY | {"blocks": [BODY, {"blocks": [BODY]}]}
    got = items(spark, [BODY, inner | {"derived": {"role": "Algorithm"}}, 7, BODY | {"blocks": {"no": "list"}}])
    assert [r.item_id for r in sorted(got.values(), key=lambda r: r.pos)] == ["p001-b000", "p001-b001", "p001-b001-i000", "p001-b001-i001-i000", "p001-b003"]
    assert [k for k, r in got.items() if r.inside_algorithm] == ["p001-b001", "p001-b001-i000", "p001-b001-i001-i000"]
    assert {k for k, r in got.items() if r.admitted} == {"p001-b000", "p001-b003"}


def test_any_depth(spark):
    deep = BODY
    for _ in range(150):
        deep = BODY | {"blocks": [deep]}
    assert max(r.depth for r in items(spark, [deep]).values()) == 150


def test_admission(spark):
    cases = [
        (BODY, True), (BODY | {"policy": {"translate": False}}, False), (BODY | {"semantic_role": "metadata", "policy": {"translate": True}}, True), (BODY | {"semantic_role": "metadata", "policy": {"translate": "yes"}}, False),
        (BODY | {"tags": [" Skip_Translation "]}, False), (BODY | {"tags": ["skip_translation"], "policy": {"translate": True}}, True), (BODY | {"policy": {"translate": True}, "sub_type": "algorithm"}, False),
        (BODY | {"semantic_role": "abstract", "structure_role": "x", "layout_role": "y"}, True), (BODY | {"semantic_role": "", "structure_role": "table_of_contents"}, True), (BODY | {"layout_role": "footnote"}, False), (BODY | {"content": {"kind": "table", "text": "t"}}, False),
    ]
    got = items(spark, [b for b, _ in cases])
    assert [got[f"p001-b{i:03d}"].admitted for i in range(len(cases))] == [want for _, want in cases]
    kept = items(spark, [{"content": {"kind": "formula", "text": "x"}}, {"text": "y", "sub_type": "display_formula"}, {"text": "y", "sub_type": "formula", "tags": ["skip_translation"]}])
    assert [r.keeps for r in kept.values()] == [True, True, False]


def test_roles(spark):
    got = list(items(spark, [BODY, BODY | {"layout_role": "caption", "structure_role": ""}, {"text": "t", "semantic_role": "reference"}, {"text": "t", "layout_role": "heading", "content": {"kind": "text"}}, {"text": "t", "tags": ["vision_footnote"]}]).values())
    assert [r.seed for r in got] == ["body", "caption", "body", "heading", "body"]
    assert [(r.is_caption_like, r.is_footnote_like, r.is_reference_entry, r.is_title_like, r.is_plain_text) for r in got] == [(False, False, False, False, True), (True, False, False, False, False), (False, False, True, False, False), (False, False, False, True, False), (False, True, False, False, False)]
    assert got[0].is_plain_bodylike and got[0].is_bodylike and got[0].is_textual and not got[0].is_metadata


def test_text_of_lines_and_control_characters(spark):
    assert block_tree.source_text(" a  b \n\n c\td ") == "a b\nc d" and block_tree.source_text(" one  line \n") == "one line"
    assert block_tree.source_text("the torsion angle \x12 varies") == r"the torsion angle \theta varies" and block_tree.source_text("a\x01b") == "a b"
    got = items(spark, [{"lines": [{"spans": [{"content": " x "}, {"content": " "}, {"text": "y  z"}]}, {"segments": [{"text": "end"}]}, None]}])
    assert got["p001-b000"].text == "x y z end"
    bad = spark.createDataFrame([(0, "{"), (1, None), (2, "[]"), (3, '"x"'), (4, '[{"text": "top list"}]')], "page int, j string")
    assert [(r.page, r.text) for r in block_tree.blocks(bad, "j", "page").collect()] == [(4, "top list")]


def test_strict_and_lenient(spark):
    raw = ['{"k": 1, "more": [1]}', '{"k": 1} x', '{"k": 1}],[', '{"k":1},"z":0} x', "", None, '{"k": "1"}', "{}", '{"k": null}', "3", '{"k": 2}']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, j string")
    good, bad = json_rows.split_rows(df, "j", "k bigint", ("k",))
    assert {r.i: r.j.k for r in good.collect()} == {0: 1, 10: 2}
    why = {r.i: r.error.removeprefix("failed to decode j: ") for r in bad.collect()}
    assert why == {1: "malformed JSON", 2: "malformed JSON", 3: "malformed JSON", 4: "malformed JSON", 5: "null", 6: "a field of another type", 7: "missing field `k`", 8: "missing field `k`", 9: "not an object"}
    assert [r.k for r in df.orderBy("i").select(json_rows.lenient(F.col("j"), "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))["k"].alias("k")).collect()] == [1, -1, -1, -1, -1, -1, -1, None, None, -1, 2]


def test_redaction_keeps_everything_else():
    assert json_rows.redacted_json('{"api_key": [1], "b": ["key-1", {"paddle_token": null, "c": "xkey-1y"}], "n": 1.50, "big": 12345678901234567890, "e": 1e400, "t": [true, null, {}, []]}', ["key-1"]) == (
        '{"api_key":"","b":["[REDACTED]",{"paddle_token":"","c":"x[REDACTED]y"}],"n":1.50,"big":12345678901234567890,"e":1e400,"t":[true,null,{},[]]}'
    )
    assert json_rows.redacted_json("no json key-1", ["key-1", ""]) == "no json [REDACTED]" and json_rows.redacted_json(None, ["x"]) is None
    rng = random.Random(3)

    def some(depth):
        kind = rng.randint(0, 6 if depth else 3)
        return {0: None, 1: rng.random() < 0.5, 2: rng.randint(-9, 9), 3: rng.choice(["a", "ké\"y", "\n \\"])}.get(kind) if kind < 4 else [some(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {rng.choice("abcde"): some(depth - 1) for _ in range(rng.randint(0, 3))}

    for _ in range(300):
        x = some(5)
        assert json.loads(json_rows.redacted_json(json.dumps(x), [])) == x
