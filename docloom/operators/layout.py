"""Slide-layout operators over ``shapes`` (positions in EMU) and form ``boxes``.

Overlaps are found through grid cells: a rectangle is listed in the cells it covers and a pair is
reported only from the one cell that holds the top-left corner of its intersection, so no full page or
slide is paired as a whole and no pair comes twice.  Crowded cells are cut again.  Pages with few rectangles
need no grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.operators.ordered import anchored, first_n, folded_upwards, numbered
from docloom.session import materialize, wide

# Tolerances of the checks, in inches, and the slide's text margins.
SAME_ROW = 0.5
OVERLAP = 0.05
BEYOND_SLIDE = 0.01
BEYOND_FRAME = 0.05
MARGIN_TOP_BOTTOM, MARGIN_SIDES = 0.05, 0.1
BULLETS = ("•", "●", "○")
FEW = 128  # rectangles on a page up to which all of them are compared
CROWD = 2000  # rectangles in a cell above which the cell is cut
PARTS = 1024  # most cells a side in one cut
CELL = "struct<ox:double,sx:double,kx:bigint,oy:double,sy:double,ky:bigint,gx:bigint,gy:bigint>"  # origin, side, number and place on each axis


def units(df: DataFrame, emu: str = "emu", points: str = "points") -> DataFrame:
    """Adds inches (two places), whole pixels, and pixels of a point size."""
    inch = N.inches(F.col(emu))
    return (df.withColumn("inches", N.inches_2(F.col(emu))).withColumn("pixels", N.pixels(inch))
            .withColumn("point_pixels", N.points_to_pixels(F.col(points))))


def valid_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes with text, without slide numbers and without footers that hold only digits."""
    t, p = F.trim(F.col("text")), F.coalesce(F.col("placeholder_type"), F.lit(""))
    return shapes.where((t != "") & (p != "SLIDE_NUMBER") & ~((p == "FOOTER") & t.rlike(r"^\p{Nd}+$")))


def slide_overflow(shapes: DataFrame) -> DataFrame:
    """Adds how far the right and bottom edges pass the slide, in inches; null up to 0.01."""
    def past(edge: Column, limit: Column) -> Column:
        over = N.inches_2(edge - limit)
        return F.when((edge > limit) & (over > F.lit(BEYOND_SLIDE).cast("decimal(4,2)")), over)
    return (shapes.withColumn("overflow_right", past(F.col("left_emu") + F.col("width_emu"), F.col("slide_w_emu")))
            .withColumn("overflow_bottom", past(F.col("top_emu") + F.col("height_emu"), F.col("slide_h_emu"))))


def manual_bullets(shapes: DataFrame) -> DataFrame:
    """One warning per shape whose paragraphs (array ``paragraphs``) fake a bullet with a character."""
    fake = lambda p: F.array_contains(F.array(*[F.lit(b + " ") for b in BULLETS]), F.substring(F.trim(p["text"]), 1, 2))
    return shapes.withColumn("warning", F.when(F.exists("paragraphs", fake), F.lit("manual_bullet_symbol: use proper bullet formatting")))


def frame_overflow(shapes: DataFrame, default_size: int = 14) -> DataFrame:
    """Adds ``frame_overflow``: how far the text runs past its frame, in inches; null up to 0.05.

    ``paragraphs`` is an array of ``(text, n_lines, font_size, line_spacing, space_before, space_after)``;
    sizes are points.  Paragraphs without text take no room.
    """
    px = lambda c: c * F.lit(N.PIXELS_PER_INCH / N.POINTS_PER_INCH)
    zero = F.lit(0.0)
    parts = F.transform("paragraphs", lambda p, i: F.when(F.trim(p["text"]) == "", zero).otherwise(
        p["n_lines"] * px(F.when(F.coalesce(p["line_spacing"], zero) != 0, p["line_spacing"]).otherwise(
            F.floor(F.when(F.coalesce(p["font_size"], zero) != 0, p["font_size"]).otherwise(F.lit(float(default_size))))))
        + F.when(i > 0, px(F.coalesce(p["space_before"], zero))).otherwise(zero) + px(F.coalesce(p["space_after"], zero))))
    total = F.aggregate(parts, zero, lambda a, x: a + x)
    inside = lambda c, margin: N.pixels(N.inches_2(F.col(c)).cast("double") - F.lit(2 * margin))
    usable = inside("height_emu", MARGIN_TOP_BOTTOM)
    over = F.bround((total - usable) / N.PIXELS_PER_INCH, 2)
    return shapes.withColumn("frame_overflow", F.when(
        (usable > 0) & (inside("width_emu", MARGIN_SIDES) > 0) & (total > usable) & (over > BEYOND_FRAME), over))


def issues_only(shapes: DataFrame) -> DataFrame:
    """Shapes with an overflow, an overlap (``n_overlaps``) or a warning; apply after the overlap search."""
    return shapes.where("frame_overflow IS NOT NULL OR overflow_right IS NOT NULL OR overflow_bottom IS NOT NULL "
                        "OR coalesce(n_overlaps, 0) > 0 OR warning IS NOT NULL")


def absolute_positions(shapes: DataFrame) -> DataFrame:
    """Positions on the slide: own offset plus the offsets of all groups above (``parent_no`` null at the top).

    Log2 of the nesting depth rounds; groups that contain each other come out with ``cyclic`` and without a position.
    """
    start = {"abs_left": F.col("left_emu"), "abs_top": F.col("top_emu")}
    return folded_upwards(shapes, ["deck", "slide"], "shape_no", "parent_no", start, lambda _, below, above: below + above)


def reading_order(shapes: DataFrame, keys: Sequence[str] = ("deck", "slide")) -> DataFrame:
    """Adds ``row_top`` and ``shape_id`` (``shape-0`` ...): top to bottom in rows, left to right inside a row.

    A row holds the shapes whose top is at most half an inch below the top of its *first* shape.  Input
    has ``left_2``/``top_2``, inches with two places, and ``shape_no`` to settle ties.
    """
    hundredths = shapes.withColumn("_y", (F.col("top_2") * 100).cast("long"))
    rows = anchored(hundredths, list(keys), "_y", int(SAME_ROW * 100), "_row", chunk_reaches=1000)  # 500 inches
    order = ["_row", "left_2", "_y", "shape_no"]
    out = numbered(rows, list(keys), order, "_n", sizes=shapes)
    return out.withColumn("row_top", (F.col("_row") / 100).cast("decimal(18,2)")).withColumn(
        "shape_id", F.concat(F.lit("shape-"), (F.col("_n") - 1).cast("string"))).drop("_y", "_row", "_n")


def _sides(df: DataFrame, keys: Sequence[str], x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Cell sides per page: the root mean square of the widths and heights; ``_n`` counts the rectangles."""
    rms = lambda a, b: F.greatest(F.sqrt(F.avg(F.pow((F.col(b) - F.col(a)).cast("double"), 2))), F.lit(1e-6))
    return df.groupBy(*keys).agg(rms(x0, x1).alias("_cw"), rms(y0, y1).alias("_ch"), F.count(F.lit(1)).alias("_n"))


def _cell(c: Column | str, side: str) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c).cast("double") / F.col(side)).cast("long")


def _on_grid(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Grid cells of each rectangle.  With root-mean-square sides, all rectangles of a page together cover at
    most about four cells each on average, whatever the mix of sizes, and a full page gets a fine grid."""
    g = df.withColumn("_gx", F.explode(F.sequence(_cell(x0, "_cw"), _cell(x1, "_cw"))))
    return g.withColumn("_gy", F.explode(F.sequence(_cell(y0, "_ch"), _cell(y1, "_ch"))))


def _place(c: Column, level: Column, axis: str) -> Column:
    """Cell of a coordinate on one level of the grid; a level inside a crowded cell has ``k`` cells, and the outer ones
    take what rounding puts beyond."""
    raw = F.floor((c.cast("double") - level[f"o{axis}"]) / level[f"s{axis}"]).cast("long")
    k = level[f"k{axis}"]
    return F.when(k.isNull(), raw).otherwise(F.least(F.greatest(raw, F.lit(0)), k - 1))


def _levels(df: DataFrame, level: Column, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """One row per cell that a rectangle covers on ``level``; ``_cells`` and ``_path`` grow by the cell."""
    df = df.withColumn("_level", level)
    cells = lambda lo, hi, axis: F.explode(F.sequence(_place(F.col(lo), F.col("_level"), axis), _place(F.col(hi), F.col("_level"), axis)))
    df = df.withColumn("_gx", cells(x0, x1, "x")).withColumn("_gy", cells(y0, y1, "y"))
    cell = F.struct("_level.*", F.col("_gx").alias("gx"), F.col("_gy").alias("gy"))
    path = F.concat_ws("/", F.col("_path"), F.concat_ws(":", "_gx", "_gy"))
    return df.withColumn("_path", path).withColumn("_cells", F.concat("_cells", F.array(cell))).drop("_level", "_gx", "_gy")


def _outer_grid(df: DataFrame, keys: Sequence[str], x0: str, y0: str, x1: str, y1: str, sides: DataFrame | None = None) -> DataFrame:
    """Rectangles by the cells of their page's grid; of the pages in ``sides`` (``_sides`` of all by default)."""
    sides = _sides(df, keys, x0, y0, x1, y1).drop("_n") if sides is None else sides
    none = F.lit(None).cast("long")
    level = F.struct(F.lit(0.0).alias("ox"), F.col("_cw").alias("sx"), none.alias("kx"), F.lit(0.0).alias("oy"), F.col("_ch").alias("sy"), none.alias("ky"))
    sized = df.join(wide(sides), list(keys))
    sized = sized.withColumn("_path", F.lit(None).cast("string")).withColumn("_cells", F.array().cast(f"array<{CELL}>"))
    return _levels(sized, level, x0, y0, x1, y1).drop("_cw", "_ch")


def _split_crowds(g: DataFrame, keys: Sequence[str], x0: str, y0: str, x1: str, y1: str, crowd: int) -> DataFrame:
    """Cells with more than ``crowd`` rectangles get a grid of their own, again and again, until none is left or finer
    cells part nothing.

    The sides of the inner grid are the root mean square of the sizes, none counted as more than the cell, so it adds
    about four cells for each rectangle, as the outer grid does.  Where most sizes fill the cell, or all that do not span it
    start at one place, the rectangles meet each other and finer cells would only list them more often.
    """
    done = []
    while True:
        last = F.element_at("_cells", -1)
        low = lambda axis: last[f"o{axis}"] + last[f"g{axis}"] * last[f"s{axis}"]  # noqa: E731, B023
        spans = lambda axis, a, b: (F.col(a) <= low(axis)) & (F.col(b) >= low(axis) + last[f"s{axis}"])  # noqa: E731, B023
        start = lambda axis, a, b: F.when(~spans(axis, a, b), F.greatest(F.col(a).cast("double"), low(axis)))
        size = lambda axis, a, b: F.least((F.col(b) - F.col(a)).cast("double"), last[f"s{axis}"])  # noqa: E731, B023
        rms = lambda axis, a, b: F.when(F.min(start(axis, a, b)) < F.max(start(axis, a, b)), F.sqrt(F.avg(F.pow(size(axis, a, b), 2))))
        finer = lambda axis, side: F.when(F.col(side).isNull(), 1).otherwise(F.floor(last[f"s{axis}"] / F.greatest(F.col(side), last[f"s{axis}"] / PARTS))).cast("long")  # noqa: E731, B023
        cells = g.groupBy(*keys, "_path").agg(F.count(F.lit(1)).alias("_n"), rms("x", x0, x1).alias("_rx"), rms("y", y0, y1).alias("_ry"), F.first("_cells").alias("_cells"))
        inner = F.struct(*[e.alias(n) for axis, side in (("x", "_rx"), ("y", "_ry")) for n, e in (
            (f"o{axis}", low(axis)), (f"s{axis}", last[f"s{axis}"] / finer(axis, side)), (f"k{axis}", finer(axis, side)))])
        crowded = cells.where(F.col("_n") > crowd).select(*keys, "_path", inner.alias("_inner")).where("_inner.kx > 1 OR _inner.ky > 1")
        crowded = materialize(crowded)  # few rows: the joins below can split a hot cell
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, done, g)
        path = [*keys, "_path"]
        marked = g.withColumn("_k", F.struct(*path))
        small = crowded.select(F.struct(*path).alias("_k"), "_inner")
        done.append(marked.join(small, "_k", "left_anti").drop("_k"))
        g = materialize(_levels(marked.join(small, "_k").drop("_k"), F.col("_inner"), x0, y0, x1, y1).drop("_inner"))


def _pairs(df: DataFrame, keys: Sequence[str], ident: str, x0: str, y0: str, x1: str, y1: str, keep: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """Pairs a < b (by ``ident``) among which are all whose rectangles meet, each once; columns get ``_a``/``_b``.

    On a page with at most ``FEW`` rectangles all are compared: a grid would list each about four times and shuffle it with its
    cells.  On fuller pages rectangles meet in the cells both cover; the pair counts in the one that holds the corner of what they share, on
    every level of the grid.
    """
    cols = [ident, x0, y0, x1, y1, *keep]
    df = df.select(*keys, *cols).dropna(subset=[*keys, x0, y0, x1, y1])
    full = materialize(_sides(df, keys, x0, y0, x1, y1).where(F.col("_n") > min(FEW, crowd)).drop("_n"))
    side = lambda g, end: g.select(*keys, *[F.col(c).alias(f"{c}_{end}") for c in cols])
    once = F.col(f"{ident}_a") < F.col(f"{ident}_b")
    if full.isEmpty():
        few = df.repartition(*keys)  # one shuffle for both sides
        return side(few, "a").join(wide(side(few, "b")), list(keys)).where(once)
    few = df.join(wide(full), list(keys), "left_anti")
    few = side(few, "a").join(wide(side(few, "b")), list(keys)).where(once)
    g = _split_crowds(_outer_grid(df, keys, x0, y0, x1, y1, full), keys, x0, y0, x1, y1, crowd)
    a = g.select(*keys, "_path", "_cells", *[F.col(c).alias(f"{c}_a") for c in cols])
    # Same columns on both sides, so that one shuffle serves both.
    b = g.select(*keys, "_path", F.col("_cells").alias("_cells_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    j = a.join(b, [*keys, "_path"]).where(once)
    corner = lambda c: F.greatest(f"{c}_a", f"{c}_b")
    here = F.forall("_cells", lambda c: (_place(corner(x0), c, "x") == c["gx"]) & (_place(corner(y0), c, "y") == c["gy"]))
    return few.unionByName(j.where(here).drop("_path", "_cells", "_cells_b"))


def shape_overlaps(shapes: DataFrame, keys: Sequence[str] = ("deck", "slide")) -> DataFrame:
    """Overlapping shapes, each pair listed from both sides: ``(..., shape_id, other_id, area)``.

    Works on inches already rounded to two places; width and height of the overlap must exceed 0.05.
    Input has ``shape_id, left_2, top_2, width_2, height_2``.
    """
    r = (shapes.withColumn("_x1", F.col("left_2") + F.col("width_2")).withColumn("_y1", F.col("top_2") + F.col("height_2")))
    p = _pairs(r, keys, "shape_id", "left_2", "top_2", "_x1", "_y1", [])
    width = F.least("_x1_a", "_x1_b") - F.greatest("left_2_a", "left_2_b")
    height = F.least("_y1_a", "_y1_b") - F.greatest("top_2_a", "top_2_b")
    limit = F.lit(OVERLAP).cast("decimal(4,2)")
    hit = p.withColumn("_w", width).withColumn("_h", height).where((F.col("_w") > limit) & (F.col("_h") > limit))
    hit = hit.withColumn("area", F.bround(F.col("_w").cast("decimal(12,2)") * F.col("_h").cast("decimal(12,2)"), 2).cast("decimal(18,2)"))
    both = F.array(F.struct(F.col("shape_id_a").alias("shape_id"), F.col("shape_id_b").alias("other_id")),
                   F.struct(F.col("shape_id_b").alias("shape_id"), F.col("shape_id_a").alias("other_id")))
    return hit.select(*keys, F.explode(both).alias("p"), "area").select(*keys, "p.*", "area")


def box_conflicts(boxes: DataFrame, keys: Sequence[str] = ("doc", "page")) -> DataFrame:
    """Form rectangles that meet on the same page (touching edges do not): ``boxes(doc, page, box_no, field_no,
    rect_type, x0, y0, x1, y1)`` -> one row per pair in list order, with ``same_field``."""
    p = _pairs(boxes, keys, "box_no", "x0", "y0", "x1", "y1", ["field_no", "rect_type"])
    meet = ((F.col("x0_a") < F.col("x1_b")) & (F.col("x1_a") > F.col("x0_b")) & (F.col("y0_a") < F.col("y1_b")) & (F.col("y1_a") > F.col("y0_b")))
    return p.where(meet).withColumn("same_field", F.col("field_no_a") == F.col("field_no_b"))


def entry_too_short(boxes: DataFrame, default_size: float = 14.0) -> DataFrame:
    """Entry rectangles with text that are lower than the font size (14 when not given)."""
    size = F.coalesce(F.col("font_size"), F.lit(default_size))
    return boxes.where((F.col("rect_type") == "entry") & F.col("has_text") & ((F.col("y1") - F.col("y0")) < size)).withColumn(
        "height", F.col("y1") - F.col("y0")).withColumn("needed", size)


def form_boxes(fields: DataFrame) -> DataFrame:
    """Field rows of the form description -> label and entry boxes in list order."""
    one = lambda kind, c, k: F.struct(F.lit(kind).alias("rect_type"), (F.col("field_no") * 2 + k).alias("box_no"),
                                      *[F.col(c)[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return fields.select("doc", F.col("page_number").alias("page"), "field_no", "description", "has_text", F.col("entry_text.font_size").alias("font_size"),
                         F.explode(F.array(one("label", "label_bounding_box", 0), one("entry", "entry_bounding_box", 1))).alias("b")).select(
        "doc", "page", "field_no", "description", "has_text", "font_size", "b.*")


def box_messages(boxes: DataFrame) -> DataFrame:
    """All findings on form boxes as ``(doc, box_no, other_no, message)``, in the order of the box list."""
    pairs = box_conflicts(boxes)
    text = F.when(F.col("same_field"), F.concat(F.lit("intersection between label and entry of field "), F.col("field_no_a").cast("string"))).otherwise(
        F.concat(F.lit("intersection between "), "rect_type_a", F.lit(" of field "), F.col("field_no_a").cast("string"), F.lit(" and "), "rect_type_b",
                 F.lit(" of field "), F.col("field_no_b").cast("string")))
    short = entry_too_short(boxes)
    low = F.concat(F.lit("entry height "), F.col("height").cast("string"), F.lit(" of field "), F.col("field_no").cast("string"), F.lit(" is below font size "), F.col("needed").cast("string"))
    return pairs.select("doc", F.col("box_no_a").alias("box_no"), F.col("box_no_b").alias("other_no"), text.alias("message")).unionByName(
        short.select("doc", "box_no", F.lit(2147483647).cast("long").alias("other_no"), low.alias("message")))


def message_cap(messages: DataFrame, n: int = 20, keys: Sequence[str] = ("doc",), order: Sequence[str] = ("box_no", "other_no")) -> DataFrame:
    """The report form of the findings: a header counts as the first of ``n`` messages; when the list fills up,
    an "aborting" row follows.  The uncapped findings stay available from the input."""
    shown = first_n(messages, list(keys), list(order), n - 1, "place").select(*keys, "place", "message")
    full = shown.where(F.col("place") == n - 1).select(*keys, F.lit(n).alias("place"), F.lit("Aborting further checks; fix bounding boxes and try again").alias("message"))
    return shown.unionByName(full)


def image_to_pdf_coords(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Entry boxes with text from image pixels (y down) to page points (y up): ``left, bottom, right, top``.

    ``pages(doc, page, image_width, image_height, pdf_width, pdf_height)``.
    """
    j = boxes.where((F.coalesce("text", F.lit("")) != "")).join(pages, ["doc", "page"])
    sx, sy = F.col("pdf_width") / F.col("image_width"), F.col("pdf_height") / F.col("image_height")
    return (j.withColumn("left", F.col("x0") * sx).withColumn("bottom", F.col("pdf_height") - F.col("y1") * sy)
            .withColumn("right", F.col("x1") * sx).withColumn("top", F.col("pdf_height") - F.col("y0") * sy))


def text_in_bbox(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Text of the words that lie inside a rectangle, in reading order (top, then left).

    ``words(doc, page, word_no, x0, y0, x1, y1, text)``; ``regions(region_id, doc, page, x0, y0, x1, y1)``.
    Rows stay words, numbered inside the region, because a region has no bound on its words.
    """
    sides = _sides(regions, ["doc", "page"], "x0", "y0", "x1", "y1")
    r = _on_grid(regions.join(sides, ["doc", "page"]), "x0", "y0", "x1", "y1").select(
        "region_id", "doc", "page", "_gx", "_gy", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    # A word sits in the one cell of its top-left corner, a region in all the cells it covers.
    w = words.join(sides, ["doc", "page"]).withColumn("_gx", _cell("x0", "_cw")).withColumn("_gy", _cell("y0", "_ch"))
    inside = w.join(r, ["doc", "page", "_gx", "_gy"]).where(
        (F.col("x0") >= F.col("r_x0")) & (F.col("x1") <= F.col("r_x1")) & (F.col("y0") >= F.col("r_y0")) & (F.col("y1") <= F.col("r_y1")))
    return numbered(inside.select("region_id", "y0", "x0", "word_no", "text"), ["region_id"], ["y0", "x0", "word_no"], "place")


def batches(df: DataFrame, size: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``batch_no`` (from 0) and ``place`` (from 1): ordered chunks of ``size`` rows."""
    n = numbered(df, list(keys), list(order), "_n")
    return n.withColumn("batch_no", F.floor((F.col("_n") - 1) / size).cast("long")).withColumn("place", F.col("_n")).drop("_n")


def grid_batches(df: DataFrame, columns: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Contact-sheet chunks: ``columns`` by ``columns + 1`` pictures each."""
    return batches(df, columns * (columns + 1), order, keys)
