"""Reviews of translations: cases by hand."""

from pyspark.sql import functions as F

from quillspark.operators import quality

ITEM, RESULT = "item_id string, source string, direct_math boolean, after string", "item_id string, decision string, translated string"


def review(spark, items, results, glossary=None):
    g = spark.createDataFrame(glossary, "source string, target string, level string, match_mode string, context string") if glossary else None
    issues = quality.review(spark.createDataFrame(items, ITEM), spark.createDataFrame(results, RESULT), g)
    return sorted((r.item_id, r.kind, r.severity, r.retryable, list(r.details)) for r in issues.collect())


def test_results_missing_and_unexpected(spark):
    got = review(spark, [("a", "x", None, None), ("", "x", None, None), ("b", "x", None, None)], [("b", None, "y"), ("c", None, "y"), (None, None, "y")])
    assert got == [("a", "missing_result", "error", True, []), ("c", "unexpected_result", "error", True, [])]


def test_texts(spark):
    cases = [
        ("1", "a <f1-abc/> b <t2-0f0/>", False, None, "<t2-0f0/> <f1-abc/>", [("placeholder_order_changed", ["<t2-0f0/>", "<f1-abc/>"])]),
        ("2", "a <f1-abc/>", False, None, "<f1-abc/> <f1-abc/> @@P1@@", [("placeholder_inventory_mismatch", ["<f1-abc/>", "<f1-abc/>", "@@P1@@"]), ("unexpected_placeholder", ["@@P1@@"])]),
        ("3", "energy $E$ and", True, "at $x_1$ and $E$", "能量 $E$ 在 $x_1$", [("context_bleed", ["$x_1$"])]), ("4", "energy $E$.", True, "at $x_1$", "能量 $E$ 在 $x_1$", []), ("5", "energy $E$", True, None, "能量 $E", [("math_delimiter_unbalanced", [])]),
        ("6", "a", False, None, ' {"translations": []}', [("protocol_shell_output", [])]), ("7", "a", False, None, "请提供待翻译的原文。", [("protocol_shell_output", [])]), ("8", "a", False, None, "Please provide the source text to translate.", [("protocol_shell_output", [])]),
        ("9", "a", None, None, " \n", [("empty_translation", [])]), ("10", "[[FORMULA_1]]", True, None, "no placeholder", []), ("11", None, None, None, None, [("empty_translation", [])]), ("12", "a", None, None, "fine {", []),
    ]
    got = review(spark, [c[:4] for c in cases], [(c[0], None, c[4]) for c in cases])
    want = [(c[0], kind, *quality.KINDS[kind], details) for c in cases for kind, details in c[5]]
    assert got == sorted(want)
    assert review(spark, [("a", "x <f1-abc/>", None, None)], [("a", " Keep_Origin ", "")]) == []


def test_terms(spark):
    glossary = [("SCF", "自洽场", "preferred", "exact", None), ("DFT", "密度泛函", "preserve", "exact", None), ("MO", "分子轨道", "canonical", "exact", None)]
    got = review(spark, [("a", "SCF with DFT and MO", None, None)], [("a", None, "自洽场与 dft")], glossary)
    assert got == [("a", "glossary_term_missing", "warning", False, ["分子轨道"])]


def test_summary(spark):
    issues = quality.review(spark.createDataFrame([("a", "x", None, None)], ITEM), spark.createDataFrame([], RESULT))
    got = {r.kind: (r.severity, r.n, r.has_errors) for r in quality.summary(issues).collect()}
    assert got["missing_result"] == ("error", 1, True) and got["placeholder_order_changed"] == ("warning", 0, True) and len(got) == len(quality.KINDS)


def test_repeated_placeholders(spark):
    a, b, c = "<f1-0aa/>", "<t2-0bb/>", "[[FORMULA_3]]"
    cases = [
        (f"{a} {b}", f"x {a} y  {a} , {b} {b}!", f"x {a} y, {b}!"), (f"{a} {b} {a}", f"{a}{b}{b}{a}", f"{a}{b}{a}"), (f"{a} {b}", f"{a} {b}", None), (f"{a} {b}", f"{b} {a} {a}", None), (f"{a}", f"{a} {b}", None), (f"{a} {b}", f"{a} {a} {a}", None),
        ("none", f"{a}", None), (f"{a}", None, None), (None, f"{a}", None), (f"{c}", f" {c} {c} ", f"{c}"), (f"{b} {a}", f"{a} {b} {a}", f"{b} {a}"),
    ]
    df = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(cases)], "i int, s string, t string")
    assert [r.r for r in df.orderBy("i").select(quality.without_repeated_placeholders(F.col("s"), F.col("t")).alias("r")).collect()] == [x[2] for x in cases]
