"""Layout: merged and cut rectangles of order lines, and pages of conversations set in two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import columns, fit, rectangles
from quillspark.package import ship
from quillspark.plans.catalog import query, rects, t


def page_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of order lines, four orders a page."""
    return rects(spark, sf_dir, "l_returnflag").withColumn("page", F.floor(F.col("l_orderkey") / 4).cast("long"))


@query()
def merged_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's rectangles, merged until nothing more merges."""
    return rectangles.merge(page_rects(spark, sf_dir), ["page"], ["l_orderkey", "l_linenumber"])


_PAGE = "SELECT l_orderkey // 4 AS page, l_returnflag, CAST(l_linenumber * 10 AS DOUBLE) AS x0, floor(l_discount * 1000) AS y0, CAST(l_linenumber * 10 AS DOUBLE) + l_quantity AS x1, floor(l_discount * 1000) + 1 + floor(l_tax * 500) AS y1 FROM lineitem"
_HIT = "(least(f.x1, m.x1) - greatest(f.x0, m.x0)) * (least(f.y1, m.y1) - greatest(f.y0, m.y0)) > 0.5"


# Each cut is a step of the recursion: a rectangle's pieces meet the next protected one that overlaps the rectangle.
@query(f"""WITH RECURSIVE l AS ({_PAGE}), r AS (SELECT DISTINCT page, x0, y0, x1, y1 FROM l), p AS (SELECT DISTINCT page, (x0 + x1) / 2 AS x0, y0, x1, y1 FROM l WHERE l_returnflag = 'R'),
 m AS (SELECT f.page, f.x0 AS a, f.y0 AS b, f.x1 AS c, f.y1 AS d, m.x0, m.y0, m.x1, m.y1, row_number() OVER (PARTITION BY f.page, f.x0, f.y0, f.x1, f.y1 ORDER BY m.y0, m.x0, m.x1, m.y1) AS step FROM r f JOIN p m ON f.page = m.page AND m.x0 < f.x1 AND f.x0 < m.x1 AND m.y0 < f.y1 AND f.y0 < m.y1 AND {_HIT}),
 g AS (SELECT page, x0 AS a, y0 AS b, x1 AS c, y1 AS d, x0, y0, x1, y1, CAST(0 AS BIGINT) AS step FROM r UNION ALL
  SELECT page, a, b, c, d, q.x0, q.y0, q.x1, q.y1, step FROM (SELECT f.page, f.a, f.b, f.c, f.d, m.step, unnest(CASE WHEN f.x0 < m.x1 AND m.x0 < f.x1 AND f.y0 < m.y1 AND m.y0 < f.y1 AND {_HIT} THEN
   list_filter([{{'x0': f.x0, 'y0': f.y0, 'x1': greatest(f.x0, m.x0), 'y1': f.y1}}, {{'x0': least(f.x1, m.x1), 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}}, {{'x0': greatest(f.x0, m.x0), 'y0': f.y0, 'x1': least(f.x1, m.x1), 'y1': greatest(f.y0, m.y0)}}, {{'x0': greatest(f.x0, m.x0), 'y0': least(f.y1, m.y1), 'x1': least(f.x1, m.x1), 'y1': f.y1}}],
    lambda s: s.x1 > s.x0 AND s.y1 > s.y0 AND (s.x1 - s.x0) * (s.y1 - s.y0) > 0.5) ELSE [{{'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}}] END) AS q FROM g f JOIN m ON m.page = f.page AND m.a = f.a AND m.b = f.b AND m.c = f.c AND m.d = f.d AND m.step = f.step + 1)),
 n AS (SELECT page, a, b, c, d, max(step) AS n FROM m GROUP BY ALL) SELECT g.page, g.a AS of_x0, g.b AS of_y0, g.c AS of_x1, g.d AS of_y1, x0, y0, x1, y1 FROM g LEFT JOIN n ON n.page = g.page AND n.a = g.a AND n.b = g.b AND n.c = g.c AND n.d = g.d WHERE g.step = coalesce(n.n, 0)""")
def cut_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each page's rectangles once the right halves of returned lines' are cut out, from top to bottom."""
    r, sides = page_rects(spark, sf_dir), rectangles.SIDES
    cuts = r.where("l_returnflag = 'R'").select("page", ((F.col("x0") + F.col("x1")) / 2).alias("x0"), "y0", "x1", "y1").distinct()
    return rectangles.cut_out(r.select("page", *sides, *[F.col(c).alias(f"of_{c}") for c in sides]).distinct(), cuts, ["page"], [f"of_{c}" for c in sides], ["y0", "x0", "x1", "y1"]).drop("piece")


# Turns as blocks of a page 600 wide: the user's on the left, answers on the right, two a row; some wide, some empty, some notes.
_BLOCKS = """SELECT conv_id, CAST(turn AS INT) AS ord, CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN 'doc_title' WHEN length(text) % 11 = 0 THEN 'footnote' WHEN length(text) % 7 = 0 THEN 'abstract' ELSE 'text' END AS label,
 CASE WHEN length(text) % 4 = 1 THEN '' ELSE text END AS text, 600.0::DOUBLE AS page_width, (CASE WHEN length(text) % 13 = 0 THEN 40 WHEN role = 'user' THEN 50 + conv_id % 10 ELSE 310 + conv_id % 10 END)::DOUBLE AS x0,
 (60 + (turn // 2) * 150 + length(text) % 40)::DOUBLE AS y0, (CASE WHEN length(text) % 13 = 0 THEN 560 WHEN role = 'user' THEN 280 + conv_id % 10 ELSE 540 + conv_id % 10 END)::DOUBLE AS x1, (120 + (turn // 2) * 150 + length(text) % 40 + length(text) % 90)::DOUBLE AS y1 FROM conversations"""


def column_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = t(spark, sf_dir, "conversations"), F.length("text")
    wide, left, shift = n % 13 == 0, F.col("role") == "user", F.col("conv_id") % 10
    label = F.when((F.col("turn") == 0) & (F.col("conv_id") % 5 == 0), "doc_title").when(n % 11 == 0, "footnote").when(n % 7 == 0, "abstract").otherwise("text")
    top = 60 + F.floor(F.col("turn") / 2) * 150 + n % 40
    box = (F.when(wide, 40).when(left, 50 + shift).otherwise(310 + shift), top, F.when(wide, 560).when(left, 280 + shift).otherwise(540 + shift), top + 60 + n % 90)
    return c.select("conv_id", F.col("turn").cast("int").alias("ord"), label.alias("label"), F.when(n % 4 == 1, "").otherwise(F.col("text")).alias("text"), F.lit(600.0).alias("page_width"), *[x.cast("double").alias(s) for s, x in zip(rectangles.SIDES, box, strict=True)])


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"""WITH b AS (SELECT *, trim(text, chr(9) || chr(10) || chr(13) || chr(32)) AS tx, CASE WHEN x1 - x0 >= page_width * 0.62 THEN 'full' WHEN (x0 + x1) / 2 <= page_width / 2 THEN 'left' ELSE 'right' END AS col FROM ({_BLOCKS})),
 c AS (SELECT *, length(tx) < 2 AS empty_text, label IN {_in(columns.TEXT_LABELS)} AND (x1 - x0) / page_width BETWEEN 0.18 AND 0.48 AS slot FROM b),
 g AS (SELECT conv_id, count(*) FILTER (slot AND tx <> '' AND col = 'left') AS ln, count(*) FILTER (slot AND tx <> '' AND col = 'right') AS rn, count(*) FILTER (slot AND col = 'left') AS ls, count(*) FILTER (slot AND col = 'right') AS rs,
  median((x0 + x1) / 2) FILTER (slot AND tx <> '' AND col = 'left') AS lx, median((x0 + x1) / 2) FILTER (slot AND tx <> '' AND col = 'right') AS rx, coalesce(bool_or(empty_text AND col <> 'full'), false) AS any_empty FROM c GROUP BY conv_id),
 m AS (SELECT *, CASE WHEN ln >= 2 AND rn >= 2 OR ls >= 2 AND rs >= 2 OR ls >= 1 AND rs >= 1 AND any_empty THEN 'double' ELSE 'single' END AS mode FROM g),
 w AS (SELECT c.*, mode, round(CASE WHEN mode = 'double' AND ln > 0 AND rn > 0 THEN (lx + rx) / 2 ELSE 300 END, 3) AS split_x, mode = 'double' AND col <> 'full' AND label NOT IN {_in(columns.NOT_BODY)} AS fit FROM c JOIN m ON m.conv_id = c.conv_id),
 n AS (SELECT *, lead({{'o': ord, 'e': empty_text, 'f': fit, 'c': col, 'a': y0, 'b': y1}}) OVER v AS nx, lag({{'o': ord, 'e': empty_text, 'f': fit, 'c': col, 'a': y0, 'b': y1}}) OVER v AS pv FROM w WINDOW v AS (PARTITION BY conv_id ORDER BY ord)),
 q AS (SELECT *, coalesce(fit AND nx.f AND nx.o = ord + 1 AND nx.c <> col AND nx.e <> empty_text AND least(y1, nx.b) - greatest(y0, nx.a) >= 0.25 * least(greatest(1, y1 - y0), greatest(1, nx.b - nx.a)), false) AS hn,
  coalesce(fit AND pv.f AND pv.o = ord - 1 AND pv.c <> col AND pv.e <> empty_text AND least(y1, pv.b) - greatest(y0, pv.a) >= 0.25 * least(greatest(1, y1 - y0), greatest(1, pv.b - pv.a)), false) AS hp FROM n)
 SELECT conv_id, ord, col AS "column", mode, split_x, empty_text, CASE WHEN hn THEN nx.o WHEN hp THEN pv.o END AS peer, (hn OR hp) AND NOT empty_text AS absorbed, (hn OR hp) AND empty_text AS missing FROM q""")
def column_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's column, and which blocks hold a text that belongs to an empty neighbour."""
    return columns.signals(column_blocks(spark, sf_dir), ["conv_id"]).select("conv_id", "ord", "column", "mode", "split_x", "empty_text", "peer", "absorbed", "missing")


@query()
def column_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts given back to the empty slots of two-column pages."""
    return columns.repaired(column_blocks(spark, sf_dir), ["conv_id"])


@query()
def fitted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest font size at which each block's text fits its box."""
    ship(spark)
    b = column_blocks(spark, sf_dir)
    got = fit.fitted(F.col("text"), F.create_map().cast("map<string,string>"), F.col("x1") - F.col("x0"), (F.col("y1") - F.col("y0")) * 3, F.lit(0.3), F.lit(8.0), F.lit(14.0))
    return b.select("conv_id", "ord", got.alias("r")).select("conv_id", "ord", "r.*")


_EM = """CAST(list_sum(list_transform(regexp_extract_all(text, '(\\s+|[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*|[一-鿿]|.)', 1), lambda x: CASE WHEN regexp_full_match(x, '\\s+') THEN greatest(0.2, length(x) * 0.25) WHEN regexp_full_match(x, '[一-鿿]') THEN 1.0 WHEN regexp_matches(x, '^[A-Za-z0-9]') THEN greatest(1.0, length(x) * 0.55) ELSE 0.45 END)) AS DOUBLE)"""


@query(f"""WITH b AS (SELECT conv_id, ord, (y1 - y0) * 3 AS h, coalesce({_EM}, 0) AS demand, greatest(4.0::DOUBLE, (x1 - x0) / (10.0::DOUBLE * 0.92::DOUBLE)) AS chars FROM ({_BLOCKS}))
 SELECT conv_id, ord, round(demand, 4) AS demand, round(greatest(1, floor(h / 13.0::DOUBLE)) * chars * 0.98::DOUBLE, 4) AS capacity, CAST(greatest(1, ceil(round(demand, 9) / (chars * 0.98::DOUBLE))) AS BIGINT) AS required FROM b""")
def text_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each block's text takes against what its box holds, at ten points."""
    w, h, size = F.col("x1") - F.col("x0"), (F.col("y1") - F.col("y0")) * 3, F.lit(10.0)
    b = column_blocks(spark, sf_dir).withColumn("demand", fit.demand(F.col("text")))
    return b.select("conv_id", "ord", F.round("demand", 4).alias("demand"), F.round(fit.capacity(w, h, size, F.lit(0.3)), 4).alias("capacity"), fit.required_lines(w, size, F.round("demand", 9)).cast("long").alias("required"))


_DISTINCT = f"SELECT DISTINCT page, l_returnflag = 'R' AS flagged, x0, y0, x1, y1 FROM ({_PAGE})"
_SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


def flagged_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rects(spark, sf_dir).select("page", (F.col("l_returnflag") == "R").alias("flagged"), *rectangles.SIDES).distinct()


@query(f"WITH d AS ({_DISTINCT}) SELECT page, x0, y0, x1, y1 FROM d a WHERE NOT flagged AND EXISTS (SELECT 1 FROM d b WHERE b.flagged AND b.page = a.page AND {_SHARED} > 0.5)")
def covered_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that a returned line's covers by more than half a point."""
    d, sides = flagged_rects(spark, sf_dir), list(rectangles.SIDES)
    key = [f"of_{c}" for c in sides]
    plain = d.where("not flagged").select("page", *sides, *[F.col(c).alias(f"of_{c}") for c in sides])
    return rectangles.overlapping(plain, d.where("flagged"), ["page"], key, 0.5).select("page", *sides)


@query(f"""WITH d AS ({_DISTINCT}), t AS (SELECT page, x0, y0, x1, y1 FROM d WHERE NOT flagged), x AS (SELECT page, x0, CASE WHEN page % 2 = 0 THEN y0 ELSE 150 - y1 END AS y0, x1, CASE WHEN page % 2 = 0 THEN y1 ELSE 150 - y0 END AS y1 FROM d WHERE flagged),
 a AS (SELECT 'pdf_matrix' AS system, 0 AS r, page, x0, 150 - y1 AS y0, x1, 150 - y0 AS y1 FROM x UNION ALL SELECT 'raw_top_left', -1, * FROM x), s AS (SELECT a.page, a.system, a.r, count(*) AS n, sum({_SHARED}) AS area FROM a JOIN t b ON a.page = b.page AND {_SHARED} > 0 GROUP BY ALL),
 u AS (SELECT * FROM s UNION ALL SELECT DISTINCT page, 'pdf_matrix', 0, 0, 0 FROM x) SELECT page, arg_max(system, (n, area, r)) AS system, arg_max(n, (n, area, r)) AS n, round(arg_max(area, (n, area, r)), 3) AS area FROM u GROUP BY page""")
def coordinate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's boxes count y from the top or from the bottom, by the text that they meet. Odd pages' are turned over first."""
    d = flagged_rects(spark, sf_dir).withColumn("height", F.lit(150.0))
    turned = F.col("page") % 2 != 0
    x0, y0, x1, y1 = rectangles.flipped("height")
    boxes = d.where("flagged").select("page", "height", "x0", F.when(turned, y0).otherwise(F.col("y0")).alias("y0"), "x1", F.when(turned, y1).otherwise(F.col("y1")).alias("y1"))
    got = rectangles.coordinate_system(boxes, d.where("not flagged"), ["page"], {"pdf_matrix": rectangles.flipped("height"), "raw_top_left": tuple(F.col(c) for c in rectangles.SIDES)})
    return got.select("page", "system", "n", F.round("area", 3).alias("area"))


@query(f"""WITH b AS (SELECT conv_id, ord, x0, y0, x1, y1, x0 - 2 AS c0, x1 + 2 AS c1, y1 - 1 AS cb, y0 + 1 AS ct, length(text) % 5 = 0 AS fit, length(text) % 3 = 0 AS math, length(text) / 10.0::DOUBLE AS est FROM (SELECT conv_id, ord, text, 50.0::DOUBLE + ord % 2 * 20 AS x0, y0 / 3 AS y0, 250.0::DOUBLE + ord % 2 * 20 AS x1, y1 / 3 AS y1 FROM ({_BLOCKS}))),
 n AS (SELECT *, lead({{'x0': x0, 'y0': y0, 'x1': x1, 'c0': c0, 'c1': c1, 'ct': ct}}) OVER (PARTITION BY conv_id ORDER BY y0, x0, ord) AS nx FROM b),
 r AS (SELECT *, nx.ct - cb AS gap, nx.y0 - y0 - 0.9::DOUBLE AS room, greatest(1.0::DOUBLE, y1 - y0) AS high, greatest(greatest(0, least(x1, nx.x1) - greatest(x0, nx.x0)) / greatest(1, least(x1 - x0, nx.x1 - nx.x0)), greatest(0, least(c1, nx.c1) - greatest(c0, nx.c0)) / greatest(1, least(c1 - c0, nx.c1 - nx.c0))) AS share FROM n WHERE nx.x0 IS NOT NULL),
 l AS (SELECT *, least(room, greatest(8.0::DOUBLE, high - CASE WHEN gap <= 0.5 THEN CASE WHEN math THEN 7.4::DOUBLE ELSE 6.0::DOUBLE END ELSE 6.0::DOUBLE END)) AS lower FROM r WHERE share >= 0.6 AND gap <= 3 AND room > 0 AND (gap <= 0.5 OR est > room * 0.98::DOUBLE OR fit AND high / greatest(1, room) >= 0.94))
 SELECT conv_id, ord, round(least(greatest(8.0::DOUBLE, lower), lower), 4) AS max_height, 8.9::DOUBLE AS min_font_size, 0.44::DOUBLE AS min_leading FROM l""")
def collision_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose text may run into the next block's."""
    n, shift = F.length("text"), F.col("ord") % 2 * 20
    placed = column_blocks(spark, sf_dir).withColumns({"y0": F.col("y0") / 3, "y1": F.col("y1") / 3, "x0": 50.0 + shift, "x1": 250.0 + shift})
    own = {"cover_x0": F.col("x0") - 2, "cover_y0": F.col("y0") + 1, "cover_x1": F.col("x1") + 2, "cover_y1": F.col("y1") - 1, "font_size": F.lit(10.0), "leading": F.lit(0.5), "estimated": n / 10.0, "fit_to_box": n % 5 == 0, "formulas": n % 3 == 0}
    got = rectangles.collisions(placed.withColumns(own), ["conv_id"], ["ord"])
    return got.select("conv_id", "ord", F.round("max_height", 4).alias("max_height"), F.round("min_font_size", 4).alias("min_font_size"), F.round("min_leading", 4).alias("min_leading"))
