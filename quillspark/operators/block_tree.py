"""Nested blocks of a page's JSON, read depth first to any depth, and which of them are translated.

A page is parsed once and walked with a stack of its own; what a block takes over from those around it (being inside an algorithm) goes along. The rules over
the rows that come out are column expressions. Malformed or null JSON gives no rows; entries that aren't objects are passed over, and so are blocks
without text, but not their children.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.package import ship

# Roles, kinds and tags that decide.
ALGORITHM, SKIP = "algorithm", "skip_translation"
SEMANTIC, STRUCTURE, LAYOUT = ("body", "abstract", "table_of_contents"), ("body", "table_of_contents"), ("paragraph", "unknown", "")
FORMULA_KINDS, FORMULA_TYPES = ("formula",), ("display_formula", "formula")
KEPT_ROLES = ("body", "abstract", "title", "heading", "caption", "figure_caption", "footnote", "image_footnote", "table_footnote", "option_header", "option_description", "example_intro", "example_line", "table_of_contents")
CAPTION_TAGS = ("caption", "figure_caption", "image_caption", "table_caption", "table_footnote", "image_footnote")
FOOTNOTE_TAGS = ("footnote", "image_footnote", "table_footnote", "vision_footnote")
CAPTION_TYPES, FOOTNOTE_TYPES = ("figure_caption", "image_caption", "table_caption", "table_footnote"), ("footnote", "image_footnote", "table_footnote", "vision_footnote")
BODY_LAYOUT, BODY_SEMANTIC = ("paragraph", "list_item"), ("body", "abstract")
BODY_STRUCTURE = ("", "body", "abstract", "example_line", "option_header", "option_description", "example_intro")
TITLE_LAYOUT, TITLE_STRUCTURE, TEXT_LAYOUT = ("title", "heading"), ("title", "heading", "section_heading"), ("title", "heading", "paragraph", "list_item", "caption")
CONTROL, AROUND = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), 48
BEFORE_THETA = re.compile(r"(fixing|rotation angle|torsion angle|dihedral angle|angle|angles|function of)\s*$")
AFTER_THETA = re.compile(r"^\s*(as a dihedral angle|of the methyl group|varying|represents|=|and|or|\))")

FIELDS = [
    ("block_idx", T.IntegerType()), ("suffix", T.StringType()), ("depth", T.IntegerType()), ("inside_algorithm", T.BooleanType()), ("block_kind", T.StringType()), ("sub_type", T.StringType()), ("block_type", T.StringType()), ("layout_role", T.StringType()),
    ("semantic_role", T.StringType()), ("structure_role", T.StringType()), ("derived_role", T.StringType()), ("policy_translate", T.BooleanType()), ("tags", T.ArrayType(T.StringType())), ("text", T.StringType()), ("n_lines", T.IntegerType()),
]


def without_control(text: str, after: str = "") -> str:
    """Control characters as spaces, or as \\theta where the words around them speak of an angle."""
    if not text or not CONTROL.search(text):
        return text

    def put(m: re.Match) -> str:
        left, right = text[max(0, m.start() - AROUND) : m.start()].lower(), (text[m.end() : m.end() + AROUND] + " " + after[:AROUND]).lower()
        return r"\theta" if BEFORE_THETA.search(left) or AFTER_THETA.search(right) else " "

    return CONTROL.sub(put, text)


def source_text(text: str) -> str:
    """White space collapsed, line by line where two lines or more aren't blank."""
    lines = [" ".join(x.split()) for x in without_control(text).splitlines() if x.strip()]
    return "\n".join(lines) if len(lines) >= 2 else " ".join(without_control(text).split())


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x: object) -> list:
    return x if isinstance(x, list) else []


def _name(x: object) -> str:
    return str(x or "").strip().lower()


def span_texts(block: dict) -> list[str]:
    out = []
    for line in map(_dict, _list(block.get("lines"))):
        spans = [str(_dict(s).get("content", _dict(s).get("text", "")) or "") for s in _list(line.get("spans")) or _list(line.get("segments"))]
        out += [" ".join(without_control(s, after).split()) for s, after in zip(spans, [*spans[1:], ""], strict=False) if s.strip()]
    return out


def read_block(block: dict) -> dict:
    """A block's own fields, in lower case and trimmed."""
    content, tags = _dict(block.get("content")), sorted({_name(x) for x in _list(block.get("tags"))} - {""})
    given = str(content.get("text") or block.get("text") or "")
    translate = _dict(block.get("policy")).get("translate")
    sub_type = str(block.get("normalized_sub_type", block.get("sub_type", "")) or "").strip()
    return {
        "block_kind": _name(content.get("kind")) or "unknown", "sub_type": sub_type, "block_type": _name(block.get("raw_block_type", block.get("block_type", block.get("type", "")))), "layout_role": _name(block.get("layout_role")),
        "semantic_role": _name(block.get("semantic_role")), "structure_role": _name(block.get("structure_role")), "derived_role": _name(_dict(block.get("derived")).get("role")), "policy_translate": translate if isinstance(translate, bool) else None,
        "tags": tags, "text": source_text(given) if given.strip() else " ".join(x for x in span_texts(block) if x), "n_lines": len(_list(block.get("lines"))),
    }


def walked(page: str | None) -> list[dict]:
    """The blocks of a page, each before its children."""
    try:
        top = json.loads(page) if page else []
    except ValueError:
        return []
    stack = [(b, i, "", 0, False) for i, b in enumerate(_list(top.get("blocks") if isinstance(top, dict) else top))][::-1]
    out = []
    while stack:
        block, i, suffix, depth, inside = stack.pop()
        if not isinstance(block, dict):
            continue
        row = read_block(block)
        inside = inside or ALGORITHM in (row["sub_type"].lower(), row["block_type"], row["derived_role"], *row["tags"])
        if row["text"]:
            out.append(row | {"block_idx": i, "suffix": suffix, "depth": depth, "inside_algorithm": inside})
        stack += [(b, i, f"{suffix}-i{k:03d}", depth + 1, inside) for k, b in enumerate(_list(block.get("blocks")))][::-1]
    return out


def blocks(pages: DataFrame, json_col: str, page_idx: str) -> DataFrame:
    """The pages' other columns with item_id, pos (from 0 on a page, in reading order) and FIELDS, a row for each block with text at any depth."""
    ship(pages.sparkSession)
    kind = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in FIELDS]))
    arrow = pa.list_(pa.struct([(n, {"integer": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array": pa.list_(pa.string())}[k.typeName()]) for n, k in FIELDS]))
    read = F.arrow_udf(lambda batch: pa.array([walked(x.as_py()) for x in batch], arrow), kind)
    rest = [c for c in pages.columns if c != json_col]
    item = F.format_string("p%03d-b%03d%s", (F.col(page_idx) + 1).cast("int"), F.col("b.block_idx"), F.col("b.suffix"))
    return pages.select(*rest, F.posexplode(read(json_col)).alias("pos", "b")).select(*rest, item.alias("item_id"), "pos", "b.*")


def has_tag(*tags: str) -> Column:
    return F.arrays_overlap("tags", F.array(*map(F.lit, tags)))


def seeded_structure() -> Column:
    """The structure role, or one by the semantic and layout role; body where these say nothing."""
    by_layout = F.when(F.col("layout_role").isin("title", "heading", "caption"), F.col("layout_role")).otherwise("body")
    return F.when(F.col("structure_role") != "", F.col("structure_role")).when(F.col("semantic_role") == "abstract", "abstract").otherwise(by_layout)


def admitted() -> Column:
    """Whether a block is translated: by its own policy, if it has one; else text of the body, an abstract or contents. Never inside an algorithm."""
    contents = "table_of_contents"
    body = F.col("semantic_role").isin(*SEMANTIC) & F.col("structure_role").isin(*STRUCTURE) & F.col("layout_role").isin(*LAYOUT)
    primary = (F.col("semantic_role") == "abstract") | (F.col("semantic_role") == contents) | (F.col("structure_role") == contents) | body
    return ~F.col("inside_algorithm") & F.coalesce("policy_translate", ~F.array_contains("tags", SKIP) & (F.col("block_kind") == "text") & primary)


def keeps_origin() -> Column:
    """Formulas, which are shown as they are."""
    return ~F.array_contains("tags", SKIP) & (F.col("block_kind").isin(*FORMULA_KINDS) | F.col("sub_type").isin(*FORMULA_TYPES))


def items(pages: DataFrame, json_col: str, page_idx: str) -> DataFrame:
    """The blocks that become items: admitted or kept as they are, and of a structure that items have."""
    b = blocks(pages, json_col, page_idx).withColumn("admitted", admitted()).withColumn("keep_origin", keeps_origin()).where("admitted or keep_origin")
    return b.withColumn("structure_role", seeded_structure()).where(F.col("structure_role").isin(*KEPT_ROLES))


def role_profile() -> list[Column]:
    """is_caption_like, is_footnote_like, is_reference_heading, is_reference_entry, is_algorithm, is_metadata, is_title_like, is_bodylike, is_textual, is_plain_text, is_plain_bodylike."""
    layout, semantic, structure, derived, kind = (F.col(c) for c in ("layout_role", "semantic_role", "structure_role", "derived_role", "block_kind"))
    sub = F.lower("sub_type")
    caption = (structure == "figure_caption") | (layout == "caption") | derived.isin("caption", "figure_caption") | has_tag(*CAPTION_TAGS) | F.col("block_type").isin(*CAPTION_TYPES)
    footnote = (layout == "footnote") | structure.isin(*FOOTNOTE_TAGS) | derived.isin(*FOOTNOTE_TAGS) | has_tag(*FOOTNOTE_TAGS) | F.col("block_type").isin(*FOOTNOTE_TYPES)
    heading = (structure == "reference_heading") | (derived == "reference_heading") | has_tag("reference_heading")
    entry = (semantic == "reference") | (structure == "reference_entry") | (derived == "reference_entry") | has_tag("reference_entry", "reference_zone")
    algorithm = (sub == ALGORITHM) | (F.col("block_type") == ALGORITHM) | (derived == ALGORITHM) | has_tag(ALGORITHM)
    title = layout.isin(*TITLE_LAYOUT) | structure.isin(*TITLE_STRUCTURE)
    bodylike = semantic.isin(*BODY_SEMANTIC) | structure.isin(*BODY_STRUCTURE) | layout.isin(*BODY_LAYOUT)
    plain = (kind == "text") & ~(caption | footnote | entry | title)
    named = {
        "is_caption_like": caption, "is_footnote_like": footnote, "is_reference_heading": heading, "is_reference_entry": entry, "is_algorithm": algorithm, "is_metadata": (sub == "metadata") | (semantic == "metadata"),
        "is_title_like": title, "is_bodylike": bodylike, "is_textual": (kind == "text") | layout.isin(*TEXT_LAYOUT), "is_plain_text": plain, "is_plain_bodylike": plain & bodylike,
    }
    return [c.alias(n) for n, c in named.items()]
