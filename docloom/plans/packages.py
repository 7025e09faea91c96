"""Registered package-audit queries.  Each customer becomes one slide package whose flaws follow its number;
the package parts are real XML that the tokeniser reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import dom
from docloom.operators import packages as pk
from docloom.plans.base import Registry, Tables
from docloom.session import materialize
from docloom.sources.markup import markup_parts, spread, xml_nodes

R = Registry()

_NS = ('xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
       'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
       'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:w14" xmlns:x="urn:x"')
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def _rel(rid: str, kind: str, target: str) -> str:
    return f'<Relationship Id="{rid}" Type="{_TYPE}{kind}" Target="{target}"/>\n'


# ``{x}`` stands for an SQL expression over n, the package number.
_PARTS = {
    "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster {_NS}>\n<p:sldLayoutId id="{{100 + n % 5}}" r:id="rId1"/>\n<p:sldLayoutId id="{{100 + n % 3}}" r:id="rId{{2 + n % 2}}"/>\n'
                                         f'<mc:AlternateContent><p:sldLayoutId id="{{100 + n % 5}}"/></mc:AlternateContent></p:sldMaster>',
    "ppt/slideMasters/_rels/slideMaster1.xml.rels": _RELS + _rel("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml") + _rel(
        "rId2", "{CASE WHEN n % 4 = 0 THEN 'theme' ELSE 'slideLayout' END}", "../theme/theme1.xml") + "</Relationships>",
    "ppt/slideLayouts/slideLayout1.xml": f"<p:sldLayout {_NS}/>",
    "ppt/theme/theme1.xml": "<theme/>",
    "ppt/presentation.xml": f"""<p:presentation {_NS} {{CASE WHEN n % 3 <> 0 THEN 'xmlns:zz="urn:zz"' ELSE '' END}} mc:Ignorable="w14 zz">\n"""
                            f'<p:sldMasterId id="{{100 + n % 4}}" r:id="rId1"/><p:sldId id="256" r:id="rId9" w14:guid="{{CASE WHEN n % 9 = 0 THEN \'G\' ELSE \'a\' END || substr(md5(CAST(n AS VARCHAR(20))), 2)}}"/>\n'
                            f'<x:ext><p:sldId id="256"/></x:ext></p:presentation>',
    "ppt/_rels/presentation.xml.rels": _RELS + _rel("rId1", "slideMaster", "slideMasters/slideMaster1.xml") + _rel(
        "rId9", "{CASE WHEN n % 6 = 0 THEN 'chart' ELSE 'slide' END}", "slides/slide1.xml")
        + "{CASE WHEN n % 11 = 0 THEN '<Relationship Id=\"rId9\" Type=\"slide\" Target=\"http://x.y/z\"/>' ELSE '' END}" + "</Relationships>",
    "ppt/slides/slide1.xml": f"<p:sld {_NS}>{{CASE WHEN n % 13 = 0 THEN '<open>' ELSE '' END}}</p:sld>",
    "ppt/slides/slide2.xml": f"<p:sld {_NS}/>",
    "ppt/slides/_rels/slide1.xml.rels": _RELS + _rel("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")
        + "{CASE WHEN n % 5 = 0 THEN '" + _rel("rId2", "slideLayout", "../slideLayouts/slideLayout9.xml") + "' ELSE '' END}"
        + _rel("rId3", "notesSlide", "../notesSlides/notesSlide1.xml") + "</Relationships>",
    "ppt/slides/_rels/slide2.xml.rels": _RELS + "{CASE WHEN n % 8 = 0 THEN '" + _rel("rId3", "notesSlide", "../notesSlides/notesSlide1.xml") + "' ELSE '' END}" + "</Relationships>",
    "ppt/notesSlides/notesSlide1.xml": "<notes>a {{{{tag}}}}<t>{{{{kept}}}}</t> tail<b/> {{{{more}}}}</notes>",
    "_rels/.rels": _RELS + _rel("rId1", "officeDocument", "ppt/presentation.xml") + _rel("rId2", "thumbnail", "{CASE WHEN n % 2 = 0 THEN '/docProps/t.jpeg' ELSE 'ppt/../ppt/theme/./theme1.xml' END}") + "</Relationships>",
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{CASE WHEN n % 2 = 0 THEN \'<Default Extension="PNG" ContentType="image/png"/>\' ELSE \'\' END}'
                           '<Override PartName="/ppt/presentation.xml"/><Override PartName="/ppt/slides/slide1.xml"/><Override PartName="/ppt/slides/slide2.xml"/>'
                           '<Override PartName="/ppt/theme/theme1.xml"/><Override PartName="/ppt/slideMasters/slideMaster1.xml"/></Types>',
    "ppt/media/image1.png": "binary",
}


def _as_sql(template: str) -> str:
    """Turn a part template into an SQL string expression."""
    import re
    pieces = []
    for text, expr in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{((?:[^{}])+)\}", template):
        if text:
            pieces.append("'" + text.replace("{{", "{").replace("}}", "}").replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        else:
            pieces.append(f"CAST(({expr}) AS VARCHAR(4000))".replace("\n", ""))
    return " || ".join(pieces)


def parts(t: Tables) -> DataFrame:
    """``(pkg, part, bytes)`` of all packages; package ``k<n>``, without master relationships where n % 7 = 0."""
    exprs = [F.struct(F.lit(name).alias("part"), F.expr(_as_sql(x)).alias("bytes")) for name, x in _PARTS.items()]
    base = spread(t.customer.select(F.col("c_custkey").alias("n")))
    rows = base.select("n", F.concat(F.lit("k"), F.col("n").cast("string")).alias("pkg"), F.explode(F.array(*exprs)).alias("x"))
    return rows.select("n", "pkg", "x.*").where("NOT (n % 7 = 0 AND part = 'ppt/slideMasters/_rels/slideMaster1.xml.rels')").drop("n")


def _nodes(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = parts(t)
    return p, materialize(xml_nodes(markup_parts(p)))


def _rels(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All parts and their relationships, which several steps read."""
    p = parts(t)
    return p, materialize(pk.relationships(xml_nodes(pk.rel_parts(markup_parts(p)))))


_C = "c AS (SELECT c_custkey AS n, 'k' || c_custkey AS doc FROM customer)"


def _both(sql: str) -> str:
    return f"WITH {_C} {sql}"


@R.query("relationships", _both("""SELECT doc, 2 + 1 + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 7 = 0 THEN 0 ELSE 2 END + 2 + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 8 = 0 THEN 1 ELSE 0 END + 1 AS n_rels FROM c"""))
def relationships(t: Tables) -> DataFrame:
    return pk.relationships(xml_nodes(pk.rel_parts(markup_parts(parts(t))))).groupBy(F.col("doc_id").alias("doc")).agg(F.count(F.lit(1)).alias("n_rels"))


@R.query("broken_refs", _both("""
SELECT doc, '_rels/.rels' AS part, 'Broken reference to /docProps/t.jpeg' AS message FROM c WHERE n % 2 = 0
UNION ALL SELECT doc, 'ppt/slides/_rels/slide1.xml.rels', 'Broken reference to ../slideLayouts/slideLayout9.xml' FROM c WHERE n % 5 = 0"""))
def broken_refs(t: Tables) -> DataFrame:
    p, rels = _rels(t)
    return pk.broken_refs(rels, p).select("doc", "part", "message")


@R.query("unreferenced_parts", _both("""
SELECT doc, 'ppt/media/image1.png' AS part FROM c UNION ALL SELECT doc, 'ppt/slides/slide2.xml' FROM c UNION ALL SELECT doc, 'ppt/theme/theme1.xml' FROM c WHERE n % 7 = 0 AND n % 2 = 0"""))
def unreferenced_parts(t: Tables) -> DataFrame:
    p, rels = _rels(t)
    return pk.unreferenced_parts(rels, p).select("doc", "part")


@R.query("customers_without_pending_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def customers_without_pending_orders(t: Tables) -> DataFrame:
    """The same reverse lookup on plain tables: one package per nation, its customers as parts, orders as relationships."""
    pkg = F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))
    name = t.customer.select("c_custkey", pkg.alias("doc_id"))
    pending = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).join(name, "c_custkey")
    rels = pending.select("doc_id", F.lit("_rels/.rels").alias("part"), F.lit("").alias("base"), F.col("c_custkey").cast("string").alias("target"), F.lit(1).alias("line"))
    files = t.customer.select(pkg.alias("pkg"), F.col("c_custkey").cast("string").alias("part"))
    rels_files = t.customer.select(pkg.alias("pkg"), F.lit("_rels/.rels").alias("part")).distinct()
    return pk.unreferenced_parts(rels, files.unionByName(rels_files)).select(F.col("part").try_cast("long").alias("c_custkey"))


@R.query("rid_findings", _both("""
SELECT doc, 'ppt/slideMasters/slideMaster1.xml' AS part, '<sldLayoutId> references non-existent relationship rId3' AS message FROM c WHERE n % 7 <> 0 AND n % 2 = 1
UNION ALL SELECT doc, 'ppt/slideMasters/slideMaster1.xml', '<sldLayoutId> references rId2 which points to theme but should point to slidelayout' FROM c WHERE n % 7 <> 0 AND n % 4 = 0
UNION ALL SELECT doc, 'ppt/presentation.xml', '<sldId> references rId9 which points to chart but should point to slide' FROM c WHERE n % 6 = 0 AND n % 11 <> 0"""))
def rid_findings(t: Tables) -> DataFrame:
    _, n = _nodes(t)
    return pk.rid_findings(n, pk.relationships(n), pk.SLIDE_REL_TYPES).select("doc", "part", "message")


@R.query("expected_rel_type", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'slide' WHEN 1 THEN 'slidemaster' WHEN 2 THEN 'notesmaster' WHEN 3 THEN 'handoutmaster' WHEN 4 THEN 'footer' WHEN 5 THEN 'x' END AS expected FROM orders""")
def expected_rel_type(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("sldId", "sldMasterId", "notesMasterId", "handoutMasterId", "footerReference", "xId", "id")])
    df = t.orders.select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("tag"))
    return df.select("o_orderkey", pk.expected_rel_type(F.col("tag")).alias("expected"))


@R.query("duplicate_rids", _both("SELECT doc, 'ppt/_rels/presentation.xml.rels' AS part, 'Duplicate relationship ID rId9' AS message FROM c WHERE n % 11 = 0"))
def duplicate_rids(t: Tables) -> DataFrame:
    p, rels = _rels(t)
    return pk.duplicate_rids(rels, p).select("doc", "part", "message")


@R.query("duplicate_ids", _both("""
, ids AS (SELECT doc, n, 1 AS o, 'ppt/presentation.xml' AS part, 100 + n % 4 AS v FROM c UNION ALL SELECT doc, n, 2, 'ppt/slideMasters/slideMaster1.xml', 100 + n % 5 FROM c UNION ALL SELECT doc, n, 3, 'ppt/slideMasters/slideMaster1.xml', 100 + n % 3 FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY doc, v ORDER BY o) AS rn FROM ids)
SELECT doc, part, count(*) AS n FROM (SELECT doc, part FROM d WHERE rn > 1 UNION ALL SELECT doc, 'ppt/presentation.xml' FROM c) z GROUP BY 1, 2"""))
def duplicate_ids(t: Tables) -> DataFrame:
    return pk.duplicate_ids(xml_nodes(markup_parts(parts(t)), tags=pk.ID_TAGS)).groupBy("doc", "part").agg(F.count(F.lit(1)).alias("n"))


@R.query("content_type_findings", _both("""
SELECT doc, 'ppt/slideLayouts/slideLayout1.xml' AS part, 'File with <sldLayout> root not declared' AS message FROM c
UNION ALL SELECT doc, 'ppt/media/image1.png', 'File with extension png not declared' FROM c WHERE n % 2 = 1"""))
def content_type_findings(t: Tables) -> DataFrame:
    p, n = _nodes(t)
    return pk.content_type_findings(n, p).select("doc", "part", "message")


@R.query("layout_ref_findings", _both("""
SELECT doc, 'Missing relationships file' AS message FROM c WHERE n % 7 = 0
UNION ALL SELECT doc, 'sldLayoutId with id=' || (100 + n % 3) || ' references missing rId' || (2 + n % 2) FROM c WHERE n % 7 <> 0 AND (n % 2 = 1 OR n % 4 = 0)"""))
def layout_ref_findings(t: Tables) -> DataFrame:
    _, n = _nodes(t)
    return pk.layout_ref_findings(n, pk.relationships(n)).select("doc", "message")


@R.query("multi_layout_slides", _both("SELECT doc, 'has 2 slideLayout references' AS message FROM c WHERE n % 5 = 0"))
def multi_layout_slides(t: Tables) -> DataFrame:
    return pk.multi_layout_slides(pk.relationships(xml_nodes(pk.rel_parts(markup_parts(parts(t)))))).select("doc", "message")


@R.query("shared_notes", _both("SELECT doc, 'ppt/slides/_rels/slide' || k || '.xml.rels' AS part FROM c CROSS JOIN (SELECT unnest([1, 2]) AS k) ks WHERE n % 8 = 0"))
def shared_notes(t: Tables) -> DataFrame:
    return pk.shared_notes(_rels(t)[1]).select("doc", "part")


@R.query("uuid_findings", _both("SELECT doc, 2 AS line, 'ID G' || substr(md5(CAST(n AS VARCHAR)), 2) || ' contains invalid hex characters' AS message FROM c WHERE n % 9 = 0"))
def uuid_findings(t: Tables) -> DataFrame:
    return pk.uuid_findings(xml_nodes(markup_parts(parts(t)))).select("doc", "line", "message")


@R.query("ignorable_findings", _both("SELECT doc, 'Namespace zz in Ignorable but not declared' AS message FROM c WHERE n % 3 = 0"))
def ignorable_findings(t: Tables) -> DataFrame:
    return pk.ignorable_findings(xml_nodes(markup_parts(parts(t)))).select("doc", "message")


@R.query("foreign_namespace_nodes", _both("SELECT doc, 3 AS n_elements, 4 AS n_attrs FROM c"))
def foreign_namespace_nodes(t: Tables) -> DataFrame:
    pres = parts(t).where("part = 'ppt/presentation.xml'")
    # The two foreign attributes (Ignorable, guid) and the foreign subtree go; the root and two ids stay.
    kept = pk.foreign_namespace_nodes(xml_nodes(pres)).where("kind = 'e'")
    return kept.groupBy(F.col("doc_id").alias("doc")).agg(F.count(F.lit(1)).cast("int").alias("n_elements"), F.sum(F.size("attrs")).cast("int").alias("n_attrs"))


@R.query("template_tags", _both("SELECT doc, 'Found template tag in text content: {{tag}}' AS message FROM c UNION ALL SELECT doc, 'Found template tag in tail content: {{more}}' FROM c"))
def template_tags(t: Tables) -> DataFrame:
    notes = parts(t).where("part = 'ppt/notesSlides/notesSlide1.xml'")
    return pk.template_tags(xml_nodes(notes))[1].select("doc", "message")


@R.query("template_tags_removed", _both("SELECT doc, 'a {{kept}} tail ' AS content FROM c"))
def template_tags_removed(t: Tables) -> DataFrame:
    notes = parts(t).where("part = 'ppt/notesSlides/notesSlide1.xml'")
    clean = pk.template_tags(xml_nodes(notes))[0]
    return dom.element_text(clean, F.col("node_id") == 0, keep_blank=True).select(F.col("doc_id").alias("doc"), "content")


@R.query("malformed", _both("SELECT doc, 'ppt/slides/slide1.xml' AS part FROM c WHERE n % 13 = 0"))
def malformed(t: Tables) -> DataFrame:
    return pk.malformed(xml_nodes(markup_parts(parts(t)))).select("doc", "part")


@R.query("validation_report", _both("""
SELECT doc, CASE WHEN n % 13 = 0 THEN 'fail' ELSE 'pass' END AS well_formed, CASE WHEN n % 13 = 0 THEN 'not run' WHEN n % 5 = 0 THEN 'fail' ELSE 'pass' END AS one_layout,
  CASE WHEN n % 13 = 0 THEN 'not run' WHEN n % 9 = 0 THEN 'fail' ELSE 'pass' END AS uuid, CASE WHEN n % 13 = 0 THEN 'not run' ELSE 'fail' END AS unreferenced_file FROM c"""))
def validation_report(t: Tables) -> DataFrame:
    p, n = _nodes(t)
    rels = pk.relationships(n)
    found = pk.malformed(n).unionByName(pk.multi_layout_slides(rels)).unionByName(pk.uuid_findings(n)).unionByName(pk.unreferenced_parts(rels, p))
    return pk.validation_report(found, p, ["well_formed", "one_layout", "uuid", "unreferenced_file"])


@R.query("next_id", "SELECT user_id AS doc_id, CAST(greatest(max(CASE WHEN event_type <> 'view' THEN event_id END), -1) + 1 AS VARCHAR) AS next_id FROM events GROUP BY 1")
def next_id(t: Tables) -> DataFrame:
    ids = t.events.select(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == "view", "x").otherwise(F.col("event_id").cast("string")).alias("id"))
    return dom.next_id(ids)


@R.query("next_rid", "SELECT user_id AS doc_id, 'rId' || (coalesce(max(CASE WHEN event_type = 'view' THEN event_id END), 0) + 1) AS next_id FROM events GROUP BY 1")
def next_rid(t: Tables) -> DataFrame:
    ids = t.events.select(F.col("user_id").alias("doc_id"), F.concat(F.when(F.col("event_type") == "view", "rId").otherwise("id"), F.col("event_id").cast("string")).alias("id"))
    return dom.next_id(ids, prefix="rId", first=1)


@R.query("comment_threads", """
SELECT c.conv_id AS doc, c.turn AS id, p.turn AS parent_id, CASE WHEN c.turn > 0 AND p.turn IS NULL THEN 'parent comment not found' END AS error, 'd' || c.turn AS durable_id
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role <> 'system' WHERE c.role <> 'system'""")
def comment_threads(t: Tables) -> DataFrame:
    para = lambda x: F.concat(F.lit("P"), x.cast("string"))
    c = t.conversations
    comments = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), F.when(F.col("role") == "system", F.array(F.lit(""))).otherwise(
        F.array(F.lit(None), para(F.col("turn")), F.lit("later"))).alias("para_ids"))
    ext = c.select(F.col("conv_id").alias("doc"), para(F.col("turn")).alias("para_id"), F.when(F.col("turn") > 0, para(F.col("turn") - 1)).alias("parent_para_id"), F.lit(False).alias("done"))
    ids = c.select(F.col("conv_id").alias("doc"), para(F.col("turn")).alias("para_id"), F.concat(F.lit("d"), F.col("turn").cast("string")).alias("durable_id"))
    return pk.comment_threads(comments, ext, ids).select("doc", "id", "parent_id", "error", "durable_id")
