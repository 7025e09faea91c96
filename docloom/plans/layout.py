"""Registered layout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.operators import layout as L
from docloom.plans.base import Registry, Tables
from docloom.session import materialize

R = Registry()

# A shape per line item: several per slide, positions in steps of a twentieth of an inch.
SHAPES = """SELECT 'deck' AS deck, l_orderkey AS slide, (CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 100000 + l_suppkey AS shape_no,
   l_suppkey * 0 + (l_partkey % 97) * 45720 AS left_emu, (l_suppkey % 53) * 45720 AS top_emu, (1 + l_partkey % 61) * 45720 AS width_emu, (1 + l_suppkey % 47) * 45720 AS height_emu,
   CAST(6000000 AS BIGINT) AS slide_w_emu, CAST(4000000 AS BIGINT) AS slide_h_emu, l_partkey, l_suppkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM {lineitem}) li"""
WORDY = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '12' ELSE 'text' END AS text,
   CASE l_suppkey % 4 WHEN 0 THEN 'SLIDE_NUMBER' WHEN 1 THEN 'FOOTER' WHEN 2 THEN 'TITLE' END AS placeholder_type FROM {lineitem}"""


def two_places(df: DataFrame) -> DataFrame:
    for a, b in (("left_2", "left_emu"), ("top_2", "top_emu"), ("width_2", "width_emu"), ("height_2", "height_emu")):
        df = df.withColumn(a, N.inches_2(F.col(b)))
    return df


def _written(t: Tables) -> DataFrame:
    """Shapes with their places in inches, which several steps read: made distinct once."""
    return materialize(two_places(t.sql(SHAPES)).drop("l_partkey", "l_suppkey", "l_linenumber"))


@R.query("units", "SELECT p_partkey, CAST(p_partkey % 97 * 5 AS DOUBLE) / 100 AS inches, CAST(p_partkey % 97 * 48 // 10 AS INT) AS pixels, p_size * 4 AS x3 FROM part")
def units(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", (F.col("p_partkey") % 97 * 45720).alias("emu"), "p_size")
    out = L.units(df, "emu", "p_size")
    return out.select("p_partkey", F.col("inches").cast("double").alias("inches"), "pixels", F.round(F.col("point_pixels") * 3).cast("int").alias("x3"))


@R.query("valid_shapes", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM w WHERE trim(text) <> '' AND coalesce(placeholder_type, '') <> 'SLIDE_NUMBER'
  AND NOT (coalesce(placeholder_type, '') = 'FOOTER' AND text = '12')""", w=WORDY)
def valid_shapes(t: Tables) -> DataFrame:
    return L.valid_shapes(t.sql(WORDY)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@R.query("slide_overflow", """
WITH e AS (SELECT slide, shape_no, left_emu + width_emu - slide_w_emu AS r, top_emu + height_emu - slide_h_emu AS b FROM shapes),
q AS (SELECT slide, shape_no, CASE WHEN r > 0 THEN CAST(round(r / 9144.0) AS BIGINT) END AS r2, CASE WHEN b > 0 THEN CAST(round(b / 9144.0) AS BIGINT) END AS b2 FROM e)
SELECT slide, shape_no, CASE WHEN r2 > 1 THEN r2 END AS r100, CASE WHEN b2 > 1 THEN b2 END AS b100 FROM q""", shapes=SHAPES)
def slide_overflow(t: Tables) -> DataFrame:
    out = L.slide_overflow(t.sql(SHAPES))
    return out.select("slide", "shape_no", (F.col("overflow_right") * 100).cast("long").alias("r100"), (F.col("overflow_bottom") * 100).cast("long").alias("b100"))


PARAS = """SELECT doc_id, text, n_chars FROM {documents}"""


@R.query("manual_bullets", "SELECT doc_id, doc_id % 3 = 1 AS warned FROM documents")
def manual_bullets(t: Tables) -> DataFrame:
    second = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" ● "), F.col("text"))).otherwise(F.concat(F.lit("●"), F.col("text")))
    shapes = t.documents.select("doc_id", F.array(F.struct(F.lit("plain").alias("text")), F.struct(second.alias("text"))).alias("paragraphs"))
    return L.manual_bullets(shapes).select("doc_id", F.col("warning").isNotNull().alias("warned"))


@R.query("frame_overflow", """
WITH a AS (SELECT *, 100 + (l_suppkey % 47) * 5 AS h100, CAST(l_linenumber AS DOUBLE) * (12 * 96.0 / 72) + 6 * 96.0 / 72 + 2 * (20 * 96.0 / 72) + 3 * 96.0 / 72 AS total FROM shapes),
b AS (SELECT *, CAST(floor((CAST(h100 AS DOUBLE) / 100 - 0.1) * 96 + 1e-9) AS INT) AS usable FROM a),
c AS (SELECT *, round((total - usable) / 96, 2) AS o FROM b)
SELECT slide, shape_no, CASE WHEN total > usable AND o > 0.05 THEN o END AS frame_overflow FROM c""", shapes=SHAPES)
def frame_overflow(t: Tables) -> DataFrame:
    d = lambda x: F.lit(x).cast("double")
    para = lambda text, n, size, spacing, before, after: F.struct(
        F.lit(text).alias("text"), n.alias("n_lines"), size.alias("font_size"), spacing.alias("line_spacing"), before.alias("space_before"), after.alias("space_after"))
    shapes = t.sql(SHAPES).withColumn("height_emu", (100 + F.col("l_suppkey") % 47 * 5) * 9144).withColumn("width_emu", F.lit(914400)).withColumn(
        "paragraphs", F.array(para("a", F.col("l_linenumber"), d(12.9), d(None), d(99), d(6)), para(" ", F.lit(9), d(12), d(None), d(1), d(1)),
                              para("b", F.lit(2), d(12), d(20), d(3), d(None))))
    return L.frame_overflow(shapes).select("slide", "shape_no", "frame_overflow")


@R.query("reading_order", """
WITH RECURSIVE tops AS (SELECT DISTINCT slide, (l_suppkey % 53) * 5 AS y FROM shapes),
steps AS (SELECT slide, y, row_number() OVER (PARTITION BY slide ORDER BY y) AS n FROM tops),
walk AS (SELECT slide, y, n, y AS anchor FROM steps WHERE n = 1
  UNION ALL SELECT s.slide, s.y, s.n, CASE WHEN s.y - w.anchor <= 50 THEN w.anchor ELSE s.y END FROM walk w JOIN steps s ON s.slide = w.slide AND s.n = w.n + 1)
SELECT s.slide, s.shape_no, w.anchor AS row100, 'shape-' || (row_number() OVER (PARTITION BY s.slide ORDER BY w.anchor, s.left_emu, s.top_emu, s.shape_no) - 1) AS shape_id
FROM shapes s JOIN walk w ON w.slide = s.slide AND w.y = (s.l_suppkey % 53) * 5""", shapes=SHAPES)
def reading_order(t: Tables) -> DataFrame:
    return L.reading_order(_written(t)).select("slide", "shape_no", (F.col("row_top") * 100).cast("long").alias("row100"), "shape_id")


_RECTS = """r AS (SELECT slide, shape_no, (l_partkey % 97) * 5 AS x0, (l_suppkey % 53) * 5 AS y0, (l_partkey % 97) * 5 + (1 + l_partkey % 61) * 5 AS x1, (l_suppkey % 53) * 5 + (1 + l_suppkey % 47) * 5 AS y1 FROM shapes)"""


@R.query("shape_overlaps", "WITH " + _RECTS + """,
p AS (SELECT a.slide, a.shape_no AS shape_id, b.shape_no AS other_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h
  FROM r a JOIN r b ON a.slide = b.slide AND a.shape_no <> b.shape_no)
SELECT slide, shape_id, other_id, CAST(round_even(CAST(w * h AS DECIMAL(18,4)) / 100, 0) AS BIGINT) AS area100 FROM p WHERE w > 5 AND h > 5""", shapes=SHAPES)
def shape_overlaps(t: Tables) -> DataFrame:
    shapes = _written(t).withColumnRenamed("shape_no", "shape_id")
    return L.shape_overlaps(shapes).select("slide", "shape_id", "other_id", (F.col("area") * 100).cast("long").alias("area100"))


@R.query("issues_only", "WITH " + _RECTS + """,
p AS (SELECT DISTINCT a.slide, a.shape_no FROM r a JOIN r b ON a.slide = b.slide AND a.shape_no <> b.shape_no
  WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 5),
o AS (SELECT slide, shape_no FROM shapes WHERE left_emu + width_emu - slide_w_emu >= 13716 OR top_emu + height_emu - slide_h_emu >= 13716)
SELECT slide, shape_no FROM p UNION SELECT slide, shape_no FROM o""", shapes=SHAPES)
def issues_only(t: Tables) -> DataFrame:
    base = _written(t).withColumnRenamed("shape_no", "shape_id")
    counts = L.shape_overlaps(base).groupBy("deck", "slide", "shape_id").agg(F.count(F.lit(1)).alias("n_overlaps"))
    marked = L.slide_overflow(base).join(counts, ["deck", "slide", "shape_id"], "left")
    marked = marked.withColumn("frame_overflow", F.lit(None).cast("double")).withColumn("warning", F.lit(None).cast("string"))
    return L.issues_only(marked).select("slide", F.col("shape_id").alias("shape_no"))


NESTED = """SELECT 'd' AS deck, p_partkey % 11 AS slide, p_partkey AS shape_no, CASE WHEN p_partkey < 110 THEN NULL ELSE (p_partkey - 110) // 33 * 11 + p_partkey % 11 END AS parent_no,
   p_partkey % 13 * 1000 AS left_emu, p_partkey % 17 * 1000 AS top_emu FROM {part}"""
_NESTED_SPARK = NESTED.replace("//", "div")


@R.query("absolute_positions", """
WITH RECURSIVE a AS (SELECT slide, shape_no, left_emu AS abs_left, top_emu AS abs_top FROM shapes WHERE parent_no IS NULL
  UNION ALL SELECT s.slide, s.shape_no, a.abs_left + s.left_emu, a.abs_top + s.top_emu FROM a JOIN shapes s ON s.parent_no = a.shape_no AND s.slide = a.slide) SELECT * FROM a""", shapes=NESTED)
def absolute_positions(t: Tables) -> DataFrame:
    return L.absolute_positions(t.sql(_NESTED_SPARK)).select("slide", "shape_no", "abs_left", "abs_top")


# Two boxes per part, several hundred per page at most: page = part number in blocks of 40.
BOXES = """SELECT 'd' AS doc, CAST(floor(p_partkey / 40) AS BIGINT) AS page, p_partkey * 2 + k AS box_no, p_partkey AS field_no, CASE k WHEN 0 THEN 'label' ELSE 'entry' END AS rect_type,
   p_partkey * 7 % 97 * 10 + k * 25 AS x0, p_partkey * 5 % 53 * 10 AS y0, p_partkey * 7 % 97 * 10 + k * 25 + 10 + p_partkey % 3 * 10 AS x1, p_partkey * 5 % 53 * 10 + 8 + p_partkey % 7 * 2 AS y1,
   p_partkey % 4 <> 0 AS has_text, CAST(CASE WHEN p_partkey % 2 = 0 THEN 12 END AS DOUBLE) AS font_size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS text
   FROM {part} EACH k BELOW 2"""
_CONFLICTS = """c AS (SELECT a.page, a.box_no, b.box_no AS other_no, a.field_no = b.field_no AS same_field FROM boxes a JOIN boxes b ON a.page = b.page AND a.box_no < b.box_no
  AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)"""


@R.query("box_conflicts", "WITH " + _CONFLICTS + " SELECT page, box_no, other_no, same_field FROM c", boxes=BOXES)
def box_conflicts(t: Tables) -> DataFrame:
    return L.box_conflicts(t.sql(BOXES)).select("page", F.col("box_no_a").alias("box_no"), F.col("box_no_b").alias("other_no"), "same_field")


_SHORT = "s AS (SELECT page, box_no, y1 - y0 AS height FROM boxes WHERE rect_type = 'entry' AND has_text AND y1 - y0 < coalesce(font_size, 14))"


@R.query("entry_too_short", "WITH " + _SHORT + " SELECT page, box_no, height FROM s", boxes=BOXES)
def entry_too_short(t: Tables) -> DataFrame:
    return L.entry_too_short(t.sql(BOXES)).select("page", "box_no", "height")


@R.query("message_cap", "WITH " + _CONFLICTS + ", " + _SHORT + """,
m AS (SELECT page, box_no, other_no FROM c UNION ALL SELECT page, box_no, 2147483647 FROM s),
n AS (SELECT page, box_no, other_no, row_number() OVER (PARTITION BY page ORDER BY box_no, other_no) AS place FROM m)
SELECT page, place, false AS aborting FROM n WHERE place <= 19 UNION ALL SELECT page, 20, true FROM n WHERE place = 19""", boxes=BOXES)
def message_cap(t: Tables) -> DataFrame:
    boxes = t.sql(BOXES).withColumn("doc", F.col("page").cast("string"))
    return L.message_cap(L.box_messages(boxes)).select(F.col("doc").cast("long").alias("page"), "place", F.col("message").startswith("Aborting").alias("aborting"))


PDF_PAGES = """SELECT DISTINCT 'd' AS doc, CAST(floor(p_partkey / 40) AS BIGINT) AS page, 1000 AS image_width, 2000 AS image_height, 500.0 AS pdf_width, CAST(600 + floor(p_partkey / 40) % 3 AS DOUBLE) AS pdf_height FROM {part}"""


@R.query("image_to_pdf_coords", """
SELECT b.page, b.box_no, round(b.x0 * 0.5, 6) AS "left", round(p.pdf_height - b.y1 * (p.pdf_height / 2000), 6) AS bottom, round(b.x1 * 0.5, 6) AS "right", round(p.pdf_height - b.y0 * (p.pdf_height / 2000), 6) AS top
FROM boxes b JOIN pdf_pages p ON p.page = b.page WHERE b.rect_type = 'entry' AND b.text <> ''""", boxes=BOXES, pdf_pages=PDF_PAGES)
def image_to_pdf_coords(t: Tables) -> DataFrame:
    pages = t.sql(PDF_PAGES).withColumn("pdf_width", F.col("pdf_width").cast("double"))
    out = L.image_to_pdf_coords(t.sql(BOXES).where("rect_type = 'entry'"), pages)
    return out.select("page", "box_no", *[F.round(F.col(c), 6).cast("double").alias(c) for c in ("left", "bottom", "right", "top")])


REGIONS = """SELECT 'r' || CAST(page AS VARCHAR(20)) AS region_id, doc, page, 100 AS x0, 100 AS y0, 700 AS x1, 400 AS y1 FROM (SELECT DISTINCT doc, CAST(floor(p_partkey / 40) AS BIGINT) AS page FROM (SELECT 'd' AS doc, p_partkey FROM {part}) z) y"""


@R.query("text_in_bbox", """
SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY b.y0, b.x0, b.box_no) AS place, b.text FROM boxes b JOIN regions r ON r.page = b.page
WHERE b.x0 >= r.x0 AND b.x1 <= r.x1 AND b.y0 >= r.y0 AND b.y1 <= r.y1""", boxes=BOXES, regions=REGIONS)
def text_in_bbox(t: Tables) -> DataFrame:
    words = t.sql(BOXES).withColumnRenamed("box_no", "word_no")
    return L.text_in_bbox(words, t.sql(REGIONS)).select("region_id", "place", "text")


@R.query("batches", "SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) // 10 AS batch_no FROM customer")
def batches(t: Tables) -> DataFrame:
    return L.batches(t.customer, 10, ["c_acctbal", "c_custkey"]).select("c_custkey", "batch_no")


@R.query("grid_batches", "SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 12 AS batch_no FROM customer")
def grid_batches(t: Tables) -> DataFrame:
    return L.grid_batches(t.customer, 3, ["c_custkey"], ["c_nationkey"]).select("c_custkey", "c_nationkey", "batch_no")
