"""Replacement sets, slide sequences and form fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.ordered import first_n, folded_upwards, numbered
from docloom.session import materialize


def duplicate_keys(pairs: DataFrame, scope: Sequence[str] = ("object_id",), key: str = "key") -> DataFrame:
    """Keys given more than once inside one object."""
    return pairs.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def replacement_findings(inventory: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replacements that name a slide or shape the inventory lacks: ``(deck, slide, shape, rule)``.

    Names that do not start with ``slide-`` are ignored; a missing slide is reported once, without its shapes.
    """
    named = replacements.where(F.col("slide").startswith("slide-")).select("deck", "slide", "shape").distinct()
    slides = inventory.select("deck", "slide").distinct()
    no_slide = named.join(slides, ["deck", "slide"], "left_anti").select("deck", "slide").distinct()
    no_shape = named.join(slides, ["deck", "slide"], "left_semi").join(inventory.select("deck", "slide", "shape"), ["deck", "slide", "shape"], "left_anti")
    return no_slide.select("deck", "slide", F.lit(None).cast("string").alias("shape"), F.lit("slide not found").alias("rule")).unionByName(
        no_shape.select("deck", "slide", "shape", F.lit("shape not found").alias("rule")))


def unused_shapes(inventory: DataFrame, replacements: DataFrame) -> DataFrame:
    """For slides with a shape finding: the shapes that got no replacement, with a 50-character preview.
    One row per shape, since a slide has no bound on them."""
    bad = replacement_findings(inventory, replacements).where(F.col("rule") == "shape not found").select("deck", "slide").distinct()
    named = replacements.select("deck", "slide", "shape").distinct()
    left = inventory.join(bad, ["deck", "slide"], "left_semi").join(named, ["deck", "slide", "shape"], "left_anti")
    return left.select("deck", "slide", "shape", T.preview(F.coalesce("text", F.lit(""))).alias("preview"))


def apply_replacements(inventory: DataFrame, replacements: DataFrame) -> DataFrame:
    """New content of every inventoried shape: all are cleared, those with ``paragraphs`` are filled."""
    new = replacements.select("deck", "slide", "shape", "paragraphs")
    out = inventory.select("deck", "slide", "shape").join(new, ["deck", "slide", "shape"], "left")
    return out.select("deck", "slide", "shape", F.coalesce("paragraphs", F.array().cast("array<string>")).alias("paragraphs"),
                      F.col("paragraphs").isNotNull().alias("replaced"))


def replacement_counts(applied: DataFrame) -> DataFrame:
    return applied.groupBy("deck").agg(F.count(F.lit(1)).alias("processed"), F.count(F.lit(1)).alias("cleared"), F.count_if("replaced").alias("replaced"))


def overflow_regressions(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("deck", "slide", "shape")) -> DataFrame:
    """Shapes whose text overflow grew by more than a hundredth of an inch (no entry before means 0)."""
    b = before.select(*keys, F.col("overflow").alias("was"))
    out = after.select(*keys, F.col("overflow").alias("now")).join(b, list(keys), "left").withColumn("was", F.coalesce(F.col("was"), F.lit(0.0)))
    return out.where(F.col("now") > F.col("was") + 0.01).withColumn("worsened_by", F.col("now") - F.col("was"))


def arrange(slides: DataFrame, sequences: DataFrame) -> DataFrame:
    """Slides in the order of ``sequences(deck, sequence array<int>)`` of 0-based numbers.

    A repeated number gives copies (``copy_no`` 0, 1 ...), unlisted slides drop out, and a number outside
    the deck comes back with ``error``.
    """
    wanted = sequences.select("deck", F.posexplode("sequence").alias("position", "slide_no"))
    copies = F.row_number().over(Window.partitionBy("deck", "slide_no").orderBy("position")) - 1  # a deck is one input row
    out = wanted.withColumn("copy_no", copies).join(slides.withColumn("_there", F.lit(True)), ["deck", "slide_no"], "left")
    return out.withColumn("error", F.when(F.col("_there").isNull(), F.lit("slide index out of range"))).drop("_there")


# --- form fields ---------------------------------------------------------------------------------------

def field_full_name(annotations: DataFrame) -> DataFrame:
    """Dotted name of each annotation from the root down: ``annotations(doc, node_no, parent_no, name)``.

    Levels without a name are skipped; no name at all gives null.  Log2 of the depth rounds; annotations whose
    parents run in a circle come out with ``cyclic`` and without a name.
    """
    start = {"full_name": F.when(F.col("name") != "", F.col("name"))}
    return folded_upwards(annotations, ["doc"], "node_no", "parent_no", start, lambda _, below, above: F.when(
        below.isNull(), above).when(above.isNull(), below).otherwise(F.concat_ws(".", above, below)))


def form_inventory(fields: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Form fields with type and place, and their options as rows.

    ``fields(doc, field_id, ft, has_kids, states array<struct<value,text>>)``, ``annotations(doc, field_id, page,
    ann_no, rect array<double>, on_values array<string>)``.  Containers are left out, except button groups,
    whose annotations with exactly one "on" value become the options of a radio group.  Fields without a
    place are dropped.  Result: ``(doc, field_id, type, page, rect, checked_value, unchecked_value)`` and
    ``options(doc, field_id, page, ord, value, text, rect)``, in the order of page and ``ord`` (choices have no page); options
    stay rows because a group has no bound.
    """
    ft = F.col("ft")
    s0, s1 = F.get("states", F.lit(0))["value"], F.get("states", F.lit(1))["value"]
    two, off = F.size("states") == 2, F.exists("states", lambda s: s["value"] == "/Off")
    plain = fields.where(~F.col("has_kids")).select(
        "doc", "field_id", F.when(ft == "/Tx", "text").when(ft == "/Btn", "checkbox").when(ft == "/Ch", "choice").otherwise(
            F.concat(F.lit("unknown ("), F.coalesce(ft, F.lit("None")), F.lit(")"))).alias("type"),
        F.when((ft == "/Btn") & two, F.when(off & (s0 == "/Off"), s1).otherwise(s0)).alias("checked_value"),
        F.when((ft == "/Btn") & two, F.when(off, F.lit("/Off")).otherwise(s1)).alias("unchecked_value"), "states")
    # The last annotation of a field gives its place.
    place = annotations.groupBy("doc", "field_id").agg(F.max_by(F.struct("page", "rect"), F.struct("page", "ann_no")).alias("_at"))
    placed = plain.join(place, ["doc", "field_id"]).select("doc", "field_id", "type", "_at.page", "_at.rect", "checked_value", "unchecked_value", "states")
    groups = fields.where(F.col("has_kids") & (ft == "/Btn")).select("doc", "field_id")
    on = F.filter("on_values", lambda v: v != "/Off")
    radio = annotations.join(groups, ["doc", "field_id"], "left_semi").where(F.size(on) == 1).select("doc", "field_id", "page", "ann_no", on[0].alias("value"), "rect")
    heads = radio.groupBy("doc", "field_id").agg(F.min_by(F.struct("page", "rect"), F.struct("page", "ann_no")).alias("_at"))
    nil = F.lit(None).cast("string")
    heads = heads.select("doc", "field_id", F.lit("radio_group").alias("type"), "_at.page", "_at.rect", nil.alias("checked_value"), nil.alias("unchecked_value"))
    radio_options = radio.select("doc", "field_id", F.col("page").cast("long").alias("page"), F.col("ann_no").cast("long").alias("ord"), "value", nil.alias("text"), "rect")
    choices = placed.where(F.col("type") == "choice").select("doc", "field_id", F.posexplode("states").alias("ord", "s"), F.lit(None).cast("array<double>").alias("rect")).select(
        "doc", "field_id", F.lit(None).cast("long").alias("page"), F.col("ord").cast("long").alias("ord"), "s.value", "s.text", "rect")
    return placed.drop("states").unionByName(heads), choices.unionByName(radio_options)


def form_order(fields: DataFrame) -> DataFrame:
    """Adds ``place``: by page, then from top to bottom (y grows upwards), then left to right."""
    y, x = F.coalesce(F.get("rect", F.lit(1)), F.lit(0.0)), F.coalesce(F.get("rect", F.lit(0)), F.lit(0.0))
    keyed = fields.withColumn("_y", -y).withColumn("_x", x)
    return numbered(keyed, ["doc"], ["page", "_y", "_x", "field_id"], "place").drop("_y", "_x")


def field_value_findings(fields: DataFrame, options: DataFrame, values: DataFrame) -> DataFrame:
    """Values that do not fit their form: ``values(doc, field_id, page, value)`` -> ``(doc, field_id, value, rule)``.

    Unknown field, else wrong page, else a value outside the checkbox pair or the options; text is free.
    """
    f = fields.select("doc", "field_id", F.col("page").alias("_page"), "type", "checked_value", "unchecked_value")
    allowed = options.select("doc", "field_id", "value").distinct().withColumn("_ok", F.lit(True))
    j = values.join(f, ["doc", "field_id"], "left").join(allowed, ["doc", "field_id", "value"], "left")
    v = F.col("value")
    rule = (F.when(F.col("type").isNull(), "unknown field").when(F.col("page") != F.col("_page"), "wrong page").when(v.isNull(), None)
            .when((F.col("type") == "checkbox") & ~v.eqNullSafe(F.col("checked_value")) & ~v.eqNullSafe(F.col("unchecked_value")), "invalid checkbox value")
            .when((F.col("type") == "radio_group") & F.col("_ok").isNull(), "invalid radio value").when((F.col("type") == "choice") & F.col("_ok").isNull(), "invalid choice value"))
    return j.withColumn("rule", rule).where("rule IS NOT NULL").select("doc", "field_id", "value", "rule")


def first_errors(findings: DataFrame, n: int = 3, width: int = 250) -> DataFrame:
    """First messages of each part, cut at ``width`` characters."""
    out = first_n(findings, ["doc", "part"], ["message"], n, "place")
    return out.withColumn("message", F.when(F.length("message") > width, F.concat(F.substring("message", 1, width), F.lit("..."))).otherwise(F.col("message")))
