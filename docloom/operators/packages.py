"""Audits of document packages over ``nodes`` (``doc_id`` is the package) and ``parts(pkg, part)``.

Every audit returns findings of one shape: ``(doc, part, line, rule, message)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.dom import DOC, drop_subtrees
from docloom.session import materialize, wide

# Namespaces, id rules and declaration rules of the package format.
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
ALLOWED_NAMESPACES = tuple("http://schemas.openxmlformats.org/" + s for s in (
    "officeDocument/2006/math", "officeDocument/2006/relationships", "schemaLibrary/2006/main", "drawingml/2006/main",
    "drawingml/2006/chart", "drawingml/2006/chartDrawing", "drawingml/2006/diagram", "drawingml/2006/picture",
    "drawingml/2006/spreadsheetDrawing", "drawingml/2006/wordprocessingDrawing", "wordprocessingml/2006/main",
    "presentationml/2006/main", "spreadsheetml/2006/main", "officeDocument/2006/sharedTypes")) + ("http://www.w3.org/XML/1998/namespace",)
UNIQUE_IDS: Mapping[str, tuple[str, str]] = {  # element -> (attribute, scope), lower case
    "comment": ("id", "file"), "commentrangestart": ("id", "file"), "commentrangeend": ("id", "file"),
    "bookmarkstart": ("id", "file"), "bookmarkend": ("id", "file"), "sldid": ("id", "file"),
    "sldmasterid": ("id", "global"), "sldlayoutid": ("id", "global"), "cm": ("authorid", "file"),
    "sheet": ("sheetid", "file"), "definedname": ("id", "file"), "cxnsp": ("id", "file"), "sp": ("id", "file"),
    "pic": ("id", "file"), "grpsp": ("id", "file")}
SLIDE_REL_TYPES = {"sldid": "slide", "sldmasterid": "slidemaster", "notesmasterid": "notesmaster",
                   "sldlayoutid": "slidelayout", "themeid": "theme", "tablestyleid": "tablestyles"}
ID_TAGS = (*UNIQUE_IDS, "alternatecontent")  # the elements that :func:`duplicate_ids` looks at
DECLARED_ROOTS = ("sld", "sldLayout", "sldMaster", "presentation", "document", "workbook", "worksheet", "theme")
MEDIA = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "wmf", "emf")


def _finding(rule: str, message: Column, line: Column | None = None) -> list[Column]:
    return [F.col("doc_id").alias("doc"), "part", (F.col("line") if line is None else line).alias("line"), F.lit(rule).alias("rule"), message.alias("message")]


def _local(name: Column) -> Column:
    return F.lower(F.substring_index(name, "}", -1))


def malformed(nodes: DataFrame) -> DataFrame:
    """Parts that are not well-formed XML."""
    return nodes.where(F.col("kind") == "x").select(*_finding("well_formed", F.col("text")))


def rel_parts(parts: DataFrame) -> DataFrame:
    """The members that :func:`relationships` reads; an audit of relationships alone needs no nodes of other members."""
    return parts.where(F.col("part").endswith(".rels"))


def relationships(nodes: DataFrame) -> DataFrame:
    """``(doc_id, part, source_part, base, rid, type, target, line, node_id)`` for each Relationship element;
    ``base`` is the folder that targets are relative to."""
    part = F.col("part")
    folder = F.regexp_replace(part, "[^/]*$", "")
    base = F.when(part.rlike(r"(^|/)\.rels$"), F.lit("")).otherwise(F.regexp_replace(folder, "[^/]*/$", ""))
    source = F.regexp_replace(F.regexp_replace(part, r"_rels/([^/]*)$", "$1"), r"\.rels$", "")
    a = F.col("attrs")
    return nodes.where((F.col("tag") == "Relationship") & part.endswith(".rels")).select(
        "doc_id", "part", source.alias("source_part"), base.alias("base"), a["Id"].alias("rid"), F.coalesce(a["Type"], F.lit("")).alias("type"),
        a["Target"].alias("target"), "line", "node_id")


def _target_part(base: Column, target: Column) -> Column:
    """Part a target points at; leaving the package or an absolute path gives a name no part has."""
    steps = F.filter(F.split(F.concat(base, target), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(
        (s == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))))
    return F.when(target.startswith("/"), target).otherwise(F.array_join(walked, "/"))


def _internal(rels: DataFrame) -> DataFrame:
    t = F.coalesce("target", F.lit(""))
    return rels.where((t != "") & ~t.startswith("http") & ~t.startswith("mailto:")).withColumn("_to", _target_part(F.col("base"), F.col("target")))


def broken_refs(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Relationships whose internal target is not a part."""
    have = parts.select(F.col("pkg").alias("doc_id"), F.col("part").alias("_to"))
    return _internal(rels).join(wide(have), ["doc_id", "_to"], "left_anti").select(*_finding("broken_reference", F.concat(F.lit("Broken reference to "), "target")))


def unreferenced_parts(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts that no relationship names, in packages that have relationships."""
    with_rels = parts.where(F.col("part").endswith(".rels")).select("pkg").distinct()
    files = parts.where(~F.col("part").endswith(".rels") & ~F.col("part").rlike(r"(^|/)\[Content_Types\]\.xml$")).join(wide(with_rels), "pkg", "left_semi")
    named = _internal(rels).select(F.col("doc_id").alias("pkg"), F.col("_to").alias("part")).distinct()
    left = files.join(wide(named), ["pkg", "part"], "left_anti").select(F.col("pkg").alias("doc_id"), "part")
    return left.select(*_finding("unreferenced_file", F.lit("Unreferenced file"), F.lit(None).cast("int")))


def expected_rel_type(tag: Column, types: Mapping[str, str] = SLIDE_REL_TYPES) -> Column:
    """Relationship type an element should point at: the map, then ``...Id``, then ``...Reference``; else null."""
    low = F.lower(tag)
    out = F.when(F.lit(False), F.lit(""))
    for k, v in types.items():
        out = out.when(low == k, v)
    prefix = F.regexp_replace(low, "id$", "")
    return (out.when(low.endswith("id") & (F.length(low) > 2), F.when(prefix == "sld", "slide").otherwise(prefix))
            .when(low.endswith("reference") & (F.length(low) > 9), F.regexp_replace(low, "reference$", "")))


def rid_findings(nodes: DataFrame, rels: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Relationship ids that the part's relationships do not hold, or hold with an unfitting type.

    Parts without a relationships part are skipped; without ``types`` (word processing) types are not checked.
    """
    sources = rels.select("doc_id", F.col("source_part").alias("part")).distinct()
    name = F.substring_index("type", "/", -1)
    known = rels.where("rid IS NOT NULL").groupBy("doc_id", F.col("source_part").alias("part"), "rid").agg(F.max_by(name, "node_id").alias("_actual"))
    used = nodes.where((F.col("kind") == "e") & ~F.col("part").endswith(".rels")).withColumn("rid", F.col("attrs")[REL_ID]).where("rid <> ''")
    j = used.join(wide(sources), DOC, "left_semi").select(*DOC, "rid", "tag", "line").join(wide(known), [*DOC, "rid"], "left")
    want = expected_rel_type(F.col("tag"), types) if types else F.lit(None).cast("string")
    j = j.withColumn("_want", want)
    missing = F.col("_actual").isNull()
    wrong = F.col("_want").isNotNull() & ~F.lower("_actual").contains(F.col("_want"))
    text = F.when(missing, F.concat(F.lit("<"), "tag", F.lit("> references non-existent relationship "), "rid")).otherwise(
        F.concat(F.lit("<"), "tag", F.lit("> references "), "rid", F.lit(" which points to "), "_actual", F.lit(" but should point to "), "_want"))
    return j.where(missing | wrong).select(*_finding("relationship_id", text))


def duplicate_rids(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Relationship ids used again within one relationships part whose source part exists."""
    have = parts.select(F.col("pkg").alias("doc_id"), F.col("part").alias("source_part"))
    r = rels.where("rid IS NOT NULL").join(wide(have), ["doc_id", "source_part"], "left_semi")
    return _repeats(r, ["doc_id", "part", "rid"], ["node_id"]).select(*_finding("duplicate_relationship_id", F.concat(F.lit("Duplicate relationship ID "), "rid")))


def _repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows after the first of their key, with ``_first`` (the first row's order).  The first rows come from a
    partial aggregate, so a key with very many rows is only joined, never sorted in one task."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return df.join(wide(firsts), list(keys)).where(F.struct(*order) > F.col("_first"))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Repeated ids of the elements that must have unique ones, each with its first occurrence.

    File scope compares inside one part by element; global scope compares the bare value over the whole
    package, so a master and a layout can clash.  Alternate-content subtrees do not count.
    """
    low = F.lower("tag")
    aside = (F.col("tag") == "AlternateContent") & (F.col("ns") == MC)
    attr = reduce(lambda c, kv: c.when(low == kv[0], kv[1][0]), UNIQUE_IDS.items(), F.when(F.lit(False), F.lit("")))
    scope = reduce(lambda c, kv: c.when(low == kv[0], kv[1][1]), UNIQUE_IDS.items(), F.when(F.lit(False), F.lit("")))
    # Only the elements with ids and the subtrees left out are sorted and written, without their attributes.
    some = nodes.where(((F.col("kind") == "e") & low.isin(*UNIQUE_IDS)) | aside).withColumn("_attr", attr).withColumn("_scope", scope)
    hit = F.filter(F.map_entries("attrs"), lambda e: _local(e["key"]) == F.col("_attr"))
    some = some.withColumn("_value", F.get(hit, F.lit(0))["value"]).select(*DOC, "node_id", "end_id", "line", "tag", "ns", low.alias("_low"), "_attr", "_scope", "_value")
    rows = drop_subtrees(some.where(F.col("_value").isNotNull() | aside), aside)
    rows = materialize(rows.where("_value IS NOT NULL").select(*DOC, "node_id", "line", "_low", "_attr", "_scope", "_value"))
    in_file = _repeats(rows.where("_scope = 'file'"), ["doc_id", "part", "_low", "_attr", "_value"], ["node_id", "line"])
    text = F.concat(F.lit("Duplicate "), "_attr", F.lit("="), "_value", F.lit(" in <"), "_low", F.lit("> (first at line "), F.col("_first.line").cast("string"), F.lit(")"))
    over_all = _repeats(rows.where("_scope = 'global'"), ["doc_id", "_value"], ["part", "node_id", "line", "_low"])
    wide = F.concat(F.lit("Global ID "), "_value", F.lit(" in <"), "_low", F.lit("> already used in "), "_first.part", F.lit(" at line "), F.col("_first.line").cast("string"), F.lit(" in <"), "_first._low", F.lit(">"))
    return in_file.select(*_finding("unique_ids", text)).unionByName(over_all.select(*_finding("unique_ids", wide)))


def content_type_findings(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts with a main root that have no Override, and media files whose ending has no Default.
    A package without the content-types part is itself a finding."""
    types = nodes.where((F.col("part") == "[Content_Types].xml") & (F.col("kind") == "e"))
    overrides = types.where(F.col("tag") == "Override").select("doc_id", F.regexp_replace(F.col("attrs")["PartName"], "^/+", "").alias("part")).distinct()
    defaults = types.where(F.col("tag") == "Default").select("doc_id", F.lower(F.col("attrs")["Extension"]).alias("_ext")).distinct()
    have = types.select("doc_id").distinct()
    aside = F.col("part").contains(".rels") | F.col("part").contains("[Content_Types]") | F.col("part").contains("docProps/") | F.col("part").contains("_rels/")
    roots = nodes.where((F.col("node_id") == 0) & (F.col("kind") == "e") & F.col("tag").isin(*DECLARED_ROOTS) & ~aside)
    undeclared = roots.join(wide(overrides), DOC, "left_anti").join(wide(have), "doc_id", "left_semi").select(
        *_finding("content_types", F.concat(F.lit("File with <"), "tag", F.lit("> root not declared"))))
    p = parts.select(F.col("pkg").alias("doc_id"), "part", F.lower(F.regexp_extract("part", r"[^/]\.([^./]+)$", 1)).alias("_ext"))
    media = p.where(F.col("_ext").isin(*MEDIA) & ~F.col("part").rlike("(^|/)(_rels|docProps)/"))
    no_default = media.join(wide(defaults), ["doc_id", "_ext"], "left_anti").join(wide(have), "doc_id", "left_semi").select(
        *_finding("content_types", F.concat(F.lit("File with extension "), "_ext", F.lit(" not declared")), F.lit(None).cast("int")))
    none = parts.select(F.col("pkg").alias("doc_id")).distinct().join(wide(have), "doc_id", "left_anti").withColumn("part", F.lit("[Content_Types].xml"))
    return undeclared.unionByName(no_default).unionByName(none.select(*_finding("content_types", F.lit("[Content_Types].xml file not found"), F.lit(None).cast("int"))))


def layout_ref_findings(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """Layout ids of slide masters that the master's layout relationships lack; a master without relationships."""
    masters = nodes.where(F.col("part").rlike(r"^ppt/slideMasters/[^/]*\.xml$"))
    sources = rels.select("doc_id", F.col("source_part").alias("part")).distinct()
    bare = masters.where(F.col("node_id") == 0).join(wide(sources), DOC, "left_anti").select(
        *_finding("layout_reference", F.lit("Missing relationships file"), F.lit(None).cast("int")))
    layouts = rels.where(F.col("type").contains("slideLayout")).select("doc_id", F.col("source_part").alias("part"), "rid").distinct()
    used = masters.where(F.col("tag") == "sldLayoutId").withColumn("rid", F.col("attrs")[REL_ID]).where("rid <> ''").join(wide(sources), DOC, "left_semi")
    lost = used.join(wide(layouts), [*DOC, "rid"], "left_anti").select(*_finding(
        "layout_reference", F.concat(F.lit("sldLayoutId with id="), F.coalesce(F.col("attrs")["id"], F.lit("None")), F.lit(" references missing "), "rid")))
    return bare.unionByName(lost)


def multi_layout_slides(rels: DataFrame) -> DataFrame:
    """Slides with more than one layout relationship."""
    slide = rels.where(F.col("part").rlike(r"^ppt/slides/_rels/[^/]*\.xml\.rels$") & F.col("type").contains("slideLayout"))
    many = slide.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return many.select(*_finding("one_layout", F.concat(F.lit("has "), F.col("_n").cast("string"), F.lit(" slideLayout references")), F.lit(None).cast("int")))


def shared_notes(rels: DataFrame) -> DataFrame:
    """Notes slides that several slide relationships name; one row per slide that does."""
    notes = rels.where(F.col("part").rlike(r"^ppt/slides/_rels/[^/]*\.xml\.rels$") & F.col("type").contains("notesSlide") & (F.coalesce("target", F.lit("")) != ""))
    notes = notes.withColumn("_notes", F.replace("target", F.lit("../"), F.lit("")))
    many = notes.groupBy("doc_id", "_notes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return notes.join(wide(many), ["doc_id", "_notes"]).select(*_finding("shared_notes", F.concat(
        F.lit("Notes slide "), "_notes", F.lit(" is also used by "), (F.col("_n") - 1).cast("string"), F.lit(" other references"))))


def uuid_findings(nodes: DataFrame) -> DataFrame:
    """Ids shaped like a UUID (32 letters and digits) that hold other than hex digits."""
    a = nodes.where((F.col("kind") == "e") & (F.size("attrs") > 0)).select(*DOC, "line", F.explode("attrs").alias("_k", "_v"))
    bare = F.replace(F.regexp_replace("_v", r"^[{}()]+|[{}()]+$", ""), F.lit("-"), F.lit(""))
    like = (F.length(bare) == 32) & bare.rlike(r"^[\p{L}\p{N}]{32}$")
    good = F.col("_v").rlike(r"^[{(]?[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}[})]?$")
    return a.where(_local(F.col("_k")).endswith("id") & like & ~good).select(*_finding("uuid", F.concat(F.lit("ID "), "_v", F.lit(" contains invalid hex characters"))))


def ignorable_findings(nodes: DataFrame) -> DataFrame:
    """Prefixes in the root's Ignorable list that are not declared (the default namespace has no prefix)."""
    root = nodes.where((F.col("node_id") == 0) & (F.col("kind") == "e"))
    listed = F.flatten(F.transform(F.filter(F.map_entries("attrs"), lambda e: e["key"].endswith("Ignorable")), lambda e: F.split(T.strip(e["value"]), r"\s+")))
    lost = F.filter(F.array_except(listed, F.filter(F.map_keys("nsmap"), lambda k: k != "")), lambda p: p != "")
    return root.withColumn("_p", F.explode(lost)).select(*_finding("namespaces", F.concat(F.lit("Namespace "), "_p", F.lit(" in Ignorable but not declared"))))


def whitespace_findings(nodes: DataFrame) -> DataFrame:
    """Text runs of the main document with outer white space and no ``xml:space="preserve"``."""
    run = (F.col("kind") == "e") & (F.col("tag") == "t")
    rows = nodes.where(F.col("part").rlike(r"(^|/)document\.xml$") & (run | ((F.col("kind") == "t") & F.col("path").endswith("/t/"))))
    at = F.when(run, F.col("node_id")).otherwise(F.col("parent_id"))
    kept = F.coalesce(F.col("attrs")[XML_SPACE] == "preserve", F.lit(False))
    rows = rows.select(*DOC, at.alias("_run"), F.when(run, F.col("line")).alias("line"), F.when(run, kept).alias("_kept"), F.when(~run, F.col("node_id")).alias("_t"), "text")
    runs = rows.groupBy(*DOC, "_run").agg(F.max("line").alias("line"), F.max("_kept").alias("_kept"), F.min_by("text", "_t").alias("_text"))
    return runs.where(F.col("_text").rlike(r"(?U)^\s|^.*\s$") & ~F.col("_kept")).select(*_finding("whitespace", T.preview(F.col("_text"))))


def misplaced_text(nodes: DataFrame) -> DataFrame:
    """Plain text inside a deletion; deleted text inside an insertion but outside a deletion."""
    main = nodes.where(F.col("part").rlike(r"(^|/)document\.xml$"))
    t = main.where((F.col("kind") == "t") & F.col("path").rlike("/del/(.*/)?t/$")).groupBy(*DOC, "parent_id").agg(F.min("line").alias("line"), F.min_by("text", "node_id").alias("_text"))
    d = main.where((F.col("tag") == "delText") & F.col("path").contains("/ins/") & ~F.col("path").contains("/del/"))
    return t.select(*_finding("deletions", F.concat(F.lit("<w:t> within <w:del>: "), T.preview(F.col("_text"))))).unionByName(
        d.select(*_finding("insertions", F.lit("<w:delText> within <w:ins>"))))


def foreign_namespace_nodes(nodes: DataFrame, allowed: Sequence[str] = ALLOWED_NAMESPACES) -> DataFrame:
    """Nodes that remain after dropping attributes and subtrees of other namespaces (the root stays)."""
    trimmed = nodes.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.startswith("{") | F.regexp_extract(k, r"^\{([^}]*)\}", 1).isin(*allowed)))
    return drop_subtrees(trimmed, (F.col("kind") == "e") & (F.col("ns") != "") & ~F.col("ns").isin(*allowed) & (F.col("node_id") > 0))


_TAG = r"\{\{[^}]*\}\}"


def template_tags(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placeholders ``{{...}}`` outside ``t`` elements: (nodes with them removed, one finding per placeholder).
    Text right after a ``t`` element is left alone like the text inside it."""
    w = Window.partitionBy(*DOC, "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("kind") == "e", F.col("tag")), ignorenulls=True).over(w)
    marked = nodes.withColumn("_after", before)
    open_ = (F.col("kind") == "t") & ~F.col("path").endswith("/t/") & ~F.coalesce(F.col("_after") == "t", F.lit(False))
    found = marked.where(open_).withColumn("_tag", F.explode(F.regexp_extract_all("text", F.lit(_TAG), F.lit(0))))
    where = F.when(F.col("_after").isNull(), "text content").otherwise("tail content")
    clean = marked.withColumn("text", F.when(open_, F.regexp_replace("text", _TAG, "")).otherwise(F.col("text"))).drop("_after")
    return clean, found.select(*_finding("template_tag", F.concat(F.lit("Found template tag in "), where, F.lit(": "), "_tag")))


def comment_threads(comments: DataFrame, ext: DataFrame, ids: DataFrame) -> DataFrame:
    """Comments with their parent: ``comments(doc, id, para_ids, author, text)``, ``ext(doc, para_id,
    parent_para_id, done)``, ``ids(doc, para_id, durable_id)``.

    A comment's key is its first paragraph id; comments without one are left out; ``error`` marks a reply to
    an unknown comment.
    """
    first = F.get(F.filter("para_ids", lambda p: F.coalesce(p, F.lit("")) != ""), F.lit(0))
    c = comments.withColumn("para_id", first).where("para_id IS NOT NULL").drop("para_ids")
    e = ext.select("doc", "para_id", "parent_para_id", "done")
    parents = c.select("doc", F.col("para_id").alias("parent_para_id"), F.col("id").alias("parent_id"))
    j = c.join(e, ["doc", "para_id"], "left").join(ids.select("doc", "para_id", "durable_id"), ["doc", "para_id"], "left").join(parents, ["doc", "parent_para_id"], "left")
    lost = F.col("parent_para_id").isNotNull() & F.col("parent_id").isNull()
    return j.withColumn("error", F.when(lost, F.lit("parent comment not found"))).drop("parent_para_id")


def validation_report(findings: DataFrame, packages: DataFrame, rules: Sequence[str]) -> DataFrame:
    """``pass``/``fail`` per package and rule.  A malformed part stops the other rules of its package (``not run``)."""
    fails = findings.groupBy("doc").agg(F.max(F.col("rule") == "well_formed").alias("_broken"), *[F.max(F.col("rule") == r).alias(f"_{r}") for r in rules])
    j = packages.select(F.col("pkg").alias("doc")).distinct().join(wide(fails), "doc", "left")
    cell = lambda r: F.when(F.coalesce(F.col(f"_{r}"), F.lit(False)) & (F.lit(r == "well_formed") | ~F.coalesce("_broken", F.lit(False))), "fail").when(
        F.coalesce("_broken", F.lit(False)) & F.lit(r != "well_formed"), "not run").otherwise("pass")
    return j.select("doc", *[cell(r).alias(r) for r in rules])
