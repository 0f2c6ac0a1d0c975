"""OCR documents as one flat table of blocks.

`read_any` reads JSON files of the providers in REGISTRY, chosen by name or by the first detector that
holds. Blocks have document_id, page_index, ord, block_id, kind, sub_type, text, x0..y1, layout_role, semantic_role,
structure_role, policy_translate and policy_reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "type: string, sub_type: string, bbox: array<double>, text: string, tags: array<string>, derived: struct<role: string, by: string, confidence: double>"
DOCUMENT = f"provider string, pages array<struct<width: double, height: double, unit: string, blocks: array<struct<{BLOCK}>>>>"

# Roles by sub-type and by layout role.
LAYOUT = {"title": "title", "heading": "heading", "abstract": "paragraph", "body": "paragraph", "header": "header", "footer": "footer", "page_number": "page_number", "footnote": "footnote"}
STRUCTURE = {"title": "title", "heading": "heading", "abstract": "body", "body": "body", "reference_entry": "reference_entry", "footnote": "footnote"}
ANCILLARY = ("header", "footer", "page_number", "footnote")
ASIDE = ("reference", "metadata", "affiliation", "acknowledgement", "unknown")
KINDS = ("text", "image", "table", "formula", "code", "unknown")


def lookup(values: dict[str, str], key: Column, otherwise: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(otherwise))


def clean(c: Column, otherwise: str) -> Column:
    """Trimmed and in lower case; otherwise where that is empty."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low == "", otherwise).otherwise(low)


def flat_ocr(raw: DataFrame) -> DataFrame:
    """Blocks of documents (document_id and the columns of DOCUMENT)."""
    pages = raw.select("document_id", F.posexplode("pages").alias("page_index", "p"))
    blocks = pages.select("document_id", "page_index", F.posexplode("p.blocks").alias("ord", "b"))
    named = blocks.select(
        "document_id", "page_index", "ord", F.concat(F.lit("p"), F.lpad((F.col("page_index") + 1).cast("string"), 3, "0"), F.lit("-b"), F.lpad(F.col("ord").cast("string"), 4, "0")).alias("block_id"),
        clean(F.col("b.type"), "text").alias("kind"), clean(F.col("b.sub_type"), "body").alias("sub_type"), F.coalesce("b.text", F.lit("")).alias("text"),
        *[F.when(F.size("b.bbox") == 4, F.get("b.bbox", F.lit(i))).otherwise(0.0).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))],
        clean(F.col("b.derived.role"), "").alias("__derived"),
    )
    is_text, sub = F.col("kind") == "text", F.col("sub_type")
    semantic = F.when(sub == "abstract", "abstract").when(sub.isin(*ANCILLARY, "metadata"), "metadata").when(sub == "reference_entry", "reference").when(sub == "body", "body").otherwise("unknown")
    # Body text between a title and an abstract or heading is a list of authors.
    explicit = F.when(F.col("__derived") != "", F.col("__derived")).otherwise(sub)
    order = Window.partitionBy("document_id", "page_index").orderBy("ord")
    gap = is_text & (sub == "body") & (F.lag(explicit).over(order) == "title") & F.lead(explicit).over(order).isin("abstract", "heading")
    roles = named.withColumns({
        "__gap": F.coalesce(gap, F.lit(False)), "layout_role": F.when(is_text, lookup(LAYOUT, sub, "unknown")).otherwise("unknown"),
        "semantic_role": F.when(~is_text, "unknown").when(F.coalesce(gap, F.lit(False)), "metadata").otherwise(semantic), "structure_role": F.when(is_text, lookup(STRUCTURE, sub, "")).otherwise(""),
    })
    goes = sub.isin("abstract", "body", "heading")
    reason = F.when(F.col("__gap"), "provider_front_matter:title_abstract_gap").when(~is_text, F.concat(F.lit("provider_non_text:"), "kind")).when(goes, F.concat(F.lit("provider_body_whitelist:"), sub)).otherwise(F.concat(F.lit("provider_non_body:"), sub))
    return roles.withColumn("policy_translate", is_text & goes & ~F.col("__gap")).withColumn("policy_reason", reason).drop("__gap", "__derived")


def derived_roles(blocks: DataFrame) -> DataFrame:
    """Blocks whose roles and policy are filled in where they are empty or unknown. Optional columns: tags, derived_role, explicit_translate."""
    has = lambda c, kind: F.col(c) if c in blocks.columns else F.lit(None).cast(kind)
    sub, role, tags = F.lower(F.trim(F.coalesce("sub_type", F.lit("")))), F.lower(F.trim(F.coalesce(has("derived_role", "string"), F.lit("")))), F.coalesce(has("tags", "array<string>"), F.array().cast("array<string>"))
    given = lambda c: F.when(~F.coalesce(F.lower(F.trim(F.col(c))), F.lit("")).isin("", "unknown"), F.lower(F.trim(F.col(c))))
    is_text = F.col("kind") == "text"
    caption = sub.isin("caption", "figure_caption", "image_caption", "table_caption", "code_caption") | F.array_contains(tags, "caption")
    layout = F.coalesce(given("layout_role"), F.when(~is_text, "unknown").when(sub.isin(*LAYOUT), lookup(LAYOUT, sub, "paragraph")).when(caption, "caption").otherwise("paragraph"))
    semantic = (
        F.when((role == "abstract") | F.array_contains(tags, "abstract"), "abstract").when((role == "formula_number") | (sub == "formula_number"), "metadata").when((role == "reference_entry") | (sub == "reference_entry"), "reference")
        .when((sub == "metadata") | (role == "metadata"), "metadata").when(role.isin("acknowledgments", "acknowledgements", "acknowledgement"), "acknowledgement").when(role == "affiliation", "affiliation")
        .when(F.col("layout_role").isin(*ANCILLARY), "metadata").when(is_text & F.col("layout_role").isin("paragraph", "list_item"), "body").otherwise("unknown")
    )
    structure = F.when((sub == "reference_entry") | (F.col("semantic_role") == "reference"), "reference_entry").when(F.col("semantic_role") == "abstract", "body").when(F.col("semantic_role") == "metadata", "metadata").otherwise(lookup({"title": "title", "heading": "heading", "paragraph": "body", "caption": "caption", "footnote": "footnote"}, F.col("layout_role"), ""))
    bodylike = F.col("layout_role").isin("paragraph", "list_item", "heading", "title") & F.col("semantic_role").isin("body", "abstract")
    why = (
        F.when(~is_text, "non_text").when(F.col("layout_role").isin(*ANCILLARY), F.concat(F.lit("layout_role="), "layout_role")).when(F.col("semantic_role").isin(*ASIDE), F.concat(F.lit("semantic_role="), "semantic_role"))
        .when(bodylike & (F.col("semantic_role") == "abstract"), "semantic_role=abstract").when(bodylike, "main_text").otherwise("conservative_skip")
    )
    explicit = has("explicit_translate", "boolean")
    out = blocks.withColumn("layout_role", layout).withColumn("semantic_role", F.coalesce(given("semantic_role"), semantic)).withColumn("structure_role", F.coalesce(given("structure_role"), structure))
    return out.withColumn("policy_reason", F.when(explicit.isNotNull(), "explicit_policy").otherwise(why)).withColumn("policy_translate", F.coalesce(explicit, F.col("policy_reason").isin("semantic_role=abstract", "main_text")))


def violations(blocks: DataFrame) -> DataFrame:
    """block_id, path, problem: a row for each broken rule of the block contract."""
    bad = lambda c, path, what: F.when(c, F.struct(F.lit(path).alias("path"), F.lit(what).alias("problem")))
    found = F.array(
        bad(F.coalesce("block_id", F.lit("")) == "", "block_id", "empty"), bad(~F.coalesce(F.col("kind"), F.lit("")).isin(*KINDS), "content.kind", "not a known kind"),
        bad((F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0")), "geometry.bbox", "not ordered"), bad(F.col("policy_translate").isNull(), "policy.translate", "missing"),
    )
    return blocks.select("document_id", "block_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("document_id", "block_id", "v.*")


# Kind and sub-type of what other providers call a block.
CONTENT_LIST = {
    "title": ("text", "title"), "paragraph": ("text", "body"), "page_aside_text": ("text", "body"), "list": ("text", "body"), "page_header": ("text", "header"), "page_footer": ("text", "footer"),
    "page_number": ("text", "page_number"), "image": ("image", "figure"),
}
LAYOUT_TREE = {
    "title": ("text", "title"), "interline_equation": ("formula", "display_formula"), "image": ("image", "figure"), "image_body": ("image", "figure"), "table": ("table", "table_body"), "table_body": ("table", "table_body"),
    "code": ("code", "code_block"), "code_body": ("code", "code_block"), "page_header": ("text", "header"), "page_footer": ("text", "footer"), "page_number": ("text", "page_number"), "image_footnote": ("text", "footnote"),
    "table_footnote": ("text", "footnote"), "text": ("text", "body"), "list": ("text", "body"),
}
LAYOUT_LABELS = {
    "doc_title": ("text", "title"), "abstract": ("text", "body"), "text": ("text", "body"), "paragraph_title": ("text", "heading"), "content": ("text", "table_of_contents"), "reference_content": ("text", "reference_entry"),
    "formula_number": ("text", "formula_number"), "header": ("text", "header"), "footer": ("text", "footer"), "footnote": ("text", "footnote"), "aside_text": ("text", "metadata"), "number": ("text", "page_number"),
    "figure_title": ("text", "figure_caption"), "table": ("table", "table_html"), "chart": ("image", "image_body"), "header_image": ("image", "image_body"), "footer_image": ("image", "image_body"), "image": ("image", "image_body"),
    "algorithm": ("code", "code_block"), "display_formula": ("formula", "display_formula"), "formula": ("formula", "display_formula"), "vision_footnote": ("text", "footnote"),
}
SEGMENT = "array<struct<type: string, content: string>>"
CONTENT_BLOCK = f"type: string, bbox: array<double>, content: struct<title_content: {SEGMENT}, paragraph_content: {SEGMENT}, page_header_content: {SEGMENT}, page_footer_content: {SEGMENT}, page_number_content: {SEGMENT}, page_aside_text_content: {SEGMENT}, list_items: array<struct<item_content: {SEGMENT}>>>"
LINE = "lines: array<struct<bbox: array<double>, spans: array<struct<type: string, content: string, bbox: array<double>>>>>"
TREE_LEAF = f"type: string, sub_type: string, index: int, bbox: array<double>, {LINE}"
TREE_NODE = f"{TREE_LEAF}, blocks: array<struct<{TREE_LEAF}>>"
TREE = f"struct<pdf_info: array<struct<page_size: array<double>, para_blocks: array<struct<{TREE_LEAF}, blocks: array<struct<{TREE_NODE}>>>>>>>"
LABELLED = "struct<layoutParsingResults: array<struct<prunedResult: struct<parsing_res_list: array<struct<block_id: int, block_label: string, block_content: string, block_bbox: array<double>, block_order: int, group_id: int>>>>>>"


def _kinds(values: dict[str, tuple[str, str]], key: Column) -> tuple[Column, Column]:
    return tuple(lookup({k: v[i] for k, v in values.items()}, key, ("unknown", "")[i]) for i in (0, 1))


def _text(segments: Column) -> Column:
    """Segments' trimmed texts, empty ones left out, joined by spaces."""
    return F.array_join(F.filter(F.transform(F.coalesce(segments, F.array().cast(SEGMENT)), lambda x: F.trim(F.coalesce(x["content"], F.lit("")))), lambda x: x != ""), " ")


def _placed(df: DataFrame) -> DataFrame:
    """document_id, page_index, ord, kind, sub_type, text and bbox as blocks with roles."""
    block_id = F.concat(F.lit("p"), F.lpad((F.col("page_index") + 1).cast("string"), 3, "0"), F.lit("-b"), F.lpad(F.col("ord").cast("string"), 4, "0"))
    corners = [F.when(F.size("bbox") == 4, F.get("bbox", F.lit(i))).otherwise(0.0).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    none = [F.lit("").alias(c) for c in ("layout_role", "semantic_role", "structure_role")]
    return derived_roles(df.select("document_id", "page_index", "ord", block_id.alias("block_id"), "kind", "sub_type", "text", *corners, *none, "tags"))


def content_list(raw: DataFrame) -> DataFrame:
    """Blocks of documents (document_id, json): a list of pages, each a list of typed blocks with content by type."""
    pages = raw.select("document_id", F.posexplode(F.from_json("json", f"array<array<struct<{CONTENT_BLOCK}>>>")).alias("page_index", "p"))
    b = pages.select("document_id", "page_index", F.posexplode("p").alias("ord", "b"))
    segments = F.coalesce(*[F.when(F.col("b.type") == k, F.col(f"b.content.{k}_content")) for k in ("title", "paragraph", "page_header", "page_footer", "page_number", "page_aside_text")], F.when(F.col("b.type") == "list", F.flatten(F.col("b.content.list_items.item_content"))))
    kind, sub = _kinds(CONTENT_LIST, F.coalesce("b.type", F.lit("")))
    return _placed(b.select("document_id", "page_index", "ord", kind.alias("kind"), sub.alias("sub_type"), _text(segments).alias("text"), F.col("b.bbox").alias("bbox"), F.array().cast("array<string>").alias("tags")))


def layout_tree(raw: DataFrame) -> DataFrame:
    """Blocks of documents (document_id, json) with nested blocks, a parent before its children, three levels deep."""
    pages = raw.select("document_id", F.posexplode(F.from_json("json", TREE)["pdf_info"]).alias("page_index", "p"))
    leaf = lambda b: F.struct(b["type"].alias("type"), b["sub_type"].alias("sub_type"), b["bbox"].alias("bbox"), b["lines"].alias("lines"))
    under = lambda b, below: F.concat(F.array(leaf(b)), F.flatten(F.coalesce(F.transform(b["blocks"], below), F.array())))
    flat = F.flatten(F.transform("p.para_blocks", lambda b: under(b, lambda c: under(c, lambda d: F.array(leaf(d))))))
    b = pages.select("document_id", "page_index", F.posexplode(flat).alias("ord", "b"))
    spans = F.flatten(F.transform(F.coalesce("b.lines", F.array().cast(LINE.removeprefix("lines: "))), lambda x: F.transform(x["spans"], lambda s: F.struct(s["type"].alias("type"), F.trim(F.regexp_replace(F.coalesce(s["content"], F.lit("")), r"\s+", " ")).alias("content")))))
    text = _text(spans)
    kind, sub = _kinds(LAYOUT_TREE, F.coalesce("b.type", F.lit("")))
    code, other = F.lower(F.trim(F.coalesce("b.sub_type", F.lit("")))) == "algorithm", (kind == "unknown") & (text != "")
    tags = F.when(F.col("b.type").isin("image_caption", "table_caption", "table_footnote", "image_footnote"), F.array(F.lit("caption"), F.col("b.type"))).otherwise(F.array().cast("array<string>"))
    return _placed(b.select("document_id", "page_index", "ord", F.when(code, "code").when(other, "text").otherwise(kind).alias("kind"), F.when(code, "code_block").when(other, "metadata").otherwise(sub).alias("sub_type"), text.alias("text"), F.col("b.bbox").alias("bbox"), tags.alias("tags")))


def layout_labels(raw: DataFrame) -> DataFrame:
    """Blocks of documents (document_id, json) whose layout model labels each box."""
    pages = raw.select("document_id", F.posexplode(F.from_json("json", LABELLED)["layoutParsingResults"]).alias("page_index", "p"))
    b = pages.select("document_id", "page_index", F.posexplode("p.prunedResult.parsing_res_list").alias("ord", "b"))
    label = F.lower(F.trim(F.coalesce("b.block_label", F.lit(""))))
    kind, sub = _kinds(LAYOUT_LABELS, label)
    tags = F.when(label == "abstract", F.array(F.lit("abstract"))).when(label == "figure_title", F.array(F.lit("caption"), F.lit("figure_caption"))).otherwise(F.array().cast("array<string>"))
    return _placed(b.select("document_id", "page_index", "ord", kind.alias("kind"), sub.alias("sub_type"), F.coalesce("b.block_content", F.lit("")).alias("text"), F.col("b.block_bbox").alias("bbox"), tags.alias("tags")))


def _flat_of_json(raw: DataFrame) -> DataFrame:
    return flat_ocr(raw.select("document_id", F.from_json("json", DOCUMENT).alias("d")).select("document_id", "d.*"))


#: Adapters by provider: what tells that a document (document_id, json) is theirs, and how its blocks are made.
REGISTRY: dict[str, tuple[Callable[[], Column], Callable[[DataFrame], DataFrame]]] = {
    "generic_flat_ocr": (lambda: (F.get_json_object("json", "$.provider") == "generic_flat_ocr") & F.get_json_object("json", "$.pages").isNotNull(), _flat_of_json),
    "layout_labels": (lambda: F.get_json_object("json", "$.layoutParsingResults").isNotNull(), layout_labels),
    "layout_tree": (lambda: F.get_json_object("json", "$.pdf_info").isNotNull(), layout_tree),
    "content_list": (lambda: F.ltrim("json").startswith("["), content_list),
}


def register(name: str, holds: Callable[[], Column], build: Callable[[DataFrame], DataFrame]) -> None:
    """Another adapter, tried after those there are."""
    REGISTRY[name] = (holds, build)


def adapt(raw: DataFrame, provider: str | None = None) -> DataFrame:
    """Blocks of documents (document_id, json) of any providers, with the provider's name. A named provider overrides detection."""
    known = detect(raw).withColumn("provider", F.lit(provider) if provider else F.col("detected"))
    parts = [build(known.where(F.col("provider") == name)).withColumn("provider", F.lit(name)) for name, (_, build) in REGISTRY.items() if provider in (None, name)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_any(spark: SparkSession, path: str, provider: str | None = None) -> DataFrame:
    """Blocks of JSON files of any known provider; document_id is the file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1).alias("document_id"), F.col("value").alias("json"))
    return adapt(raw, provider)


def detect(raw: DataFrame) -> DataFrame:
    """The documents with detected, the first provider whose detector holds, and attempts, what each one said."""
    tries = F.array(*[F.struct(F.lit(name).alias("provider"), F.coalesce(holds(), F.lit(False)).alias("matched")) for name, (holds, _) in REGISTRY.items()])
    return raw.withColumn("attempts", tries).withColumn("detected", F.get(F.filter("attempts", lambda a: a["matched"]), F.lit(0))["provider"])


def read_flat_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of JSON files, one document each; document_id is the file's name."""
    raw = spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("document_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1))
    return flat_ocr(raw)
