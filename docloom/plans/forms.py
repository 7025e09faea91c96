"""Registered queries on replacements and form fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import forms as fm
from docloom.plans.base import Registry, Tables
from docloom.sources.tables import combine_tables as combine

R = Registry()

# Inventory: one shape per customer on the slide of their nation; replacements come from orders.
INVENTORY = """SELECT 'd' AS deck, 'slide-' || CAST(c_nationkey AS VARCHAR(20)) AS slide, 'shape-' || CAST(c_custkey AS VARCHAR(20)) AS shape, c_name || ' in the segment ' || c_mktsegment || ' with balance ' || CAST(c_custkey * 3 AS VARCHAR(20)) AS text FROM {customer} WHERE c_nationkey < 20"""
REPLACEMENTS = """SELECT DISTINCT 'd' AS deck, CASE WHEN o_orderkey % 10 = 9 THEN 'note' ELSE 'slide-' || CAST(c_nationkey AS VARCHAR(20)) END AS slide,
   'shape-' || CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS VARCHAR(20)) AS shape FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0"""
_FINDINGS = """f AS (SELECT DISTINCT r.deck, r.slide, CASE WHEN EXISTS (SELECT 1 FROM inv i WHERE i.slide = r.slide) THEN r.shape END AS shape,
   CASE WHEN EXISTS (SELECT 1 FROM inv i WHERE i.slide = r.slide) THEN 'shape not found' ELSE 'slide not found' END AS rule
  FROM rep r WHERE r.slide LIKE 'slide-%' AND NOT EXISTS (SELECT 1 FROM inv i WHERE i.slide = r.slide AND i.shape = r.shape))"""


@R.query("replacement_findings", "WITH " + _FINDINGS + " SELECT * FROM f", inv=INVENTORY, rep=REPLACEMENTS)
def replacement_findings(t: Tables) -> DataFrame:
    return fm.replacement_findings(t.sql(INVENTORY), t.sql(REPLACEMENTS))


@R.query("unused_shapes", "WITH " + _FINDINGS + """
SELECT slide, shape, substr(text, 1, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS preview FROM inv
WHERE slide IN (SELECT slide FROM f WHERE rule = 'shape not found') AND (slide, shape) NOT IN (SELECT slide, shape FROM rep)""", inv=INVENTORY, rep=REPLACEMENTS)
def unused_shapes(t: Tables) -> DataFrame:
    return fm.unused_shapes(t.sql(INVENTORY), t.sql(REPLACEMENTS)).select("slide", "shape", "preview")


@R.query("duplicate_keys", "SELECT user_id, props AS key, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return fm.duplicate_keys(t.events.select("user_id", F.col("props").alias("key")), ("user_id",))


SLOTS = """SELECT 'd' || CAST(p_size AS VARCHAR(20)) AS deck, p_brand AS slide, 's' || CAST(p_partkey AS VARCHAR(20)) AS shape FROM {part}"""
FILLS = """SELECT 'd' || CAST(p_size AS VARCHAR(20)) AS deck, p_brand AS slide, 's' || CAST(CASE WHEN p_partkey % 7 = 0 THEN -p_partkey ELSE p_partkey END AS VARCHAR(20)) AS shape, p_name AS line FROM {part} WHERE p_partkey % 2 = 0"""


@R.query("apply_replacements", """
SELECT deck, slide, shape, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN name ELSE '' END AS paragraphs, k % 2 = 0 AND (k % 7 <> 0 OR k = 0) AS replaced
FROM (SELECT s.*, p.p_partkey AS k, CASE WHEN p.p_partkey = 0 THEN '' ELSE p.p_name END AS name FROM slots s JOIN part p ON s.shape = 's' || p.p_partkey) z WHERE k > 0""", slots=SLOTS)
def apply_replacements(t: Tables) -> DataFrame:
    rep = t.sql(FILLS).withColumn("paragraphs", F.array("line"))
    out = fm.apply_replacements(t.sql(SLOTS), rep).where("shape <> 's0'")
    return out.select("deck", "slide", "shape", F.array_join("paragraphs", "|").alias("paragraphs"), "replaced")


@R.query("replacement_counts", """
SELECT 'd' || p_size AS deck, count(*) AS processed, count(*) AS cleared, count(*) FILTER (p_partkey % 2 = 0 AND (p_partkey % 7 <> 0 OR p_partkey = 0)) AS replaced FROM part GROUP BY 1""")
def replacement_counts(t: Tables) -> DataFrame:
    rep = t.sql(FILLS).withColumn("paragraphs", F.array("line"))
    return fm.replacement_counts(fm.apply_replacements(t.sql(SLOTS), rep))


BEFORE = """SELECT l_orderkey AS deck, l_partkey AS slide, l_suppkey * 10 + l_linenumber AS shape, max(CAST(l_partkey % 10 AS DOUBLE) / 100) AS overflow FROM {lineitem} WHERE l_suppkey % 3 <> 0 GROUP BY 1, 2, 3"""
AFTER = """SELECT l_orderkey AS deck, l_partkey AS slide, l_suppkey * 10 + l_linenumber AS shape, max(CAST(l_suppkey % 10 AS DOUBLE) / 100) AS overflow FROM {lineitem} WHERE l_partkey % 4 <> 0 GROUP BY 1, 2, 3"""


@R.query("overflow_regressions", """
SELECT a.deck, a.slide, a.shape, coalesce(b.overflow, 0) AS was, a.overflow AS now FROM after_ a LEFT JOIN before_ b ON a.deck = b.deck AND a.slide = b.slide AND a.shape = b.shape
WHERE a.overflow > coalesce(b.overflow, 0) + CAST(0.01 AS DOUBLE)""", before_=BEFORE, after_=AFTER)
def overflow_regressions(t: Tables) -> DataFrame:
    return fm.overflow_regressions(t.sql(BEFORE), t.sql(AFTER)).select("deck", "slide", "shape", "was", "now")


@R.query("arrange", """
WITH s AS (SELECT n_regionkey AS deck, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS slide_no FROM nation),
q AS (SELECT r_regionkey AS deck, unnest([3, 0, 3, 2, 9, 3]) AS slide_no, unnest([0, 1, 2, 3, 4, 5]) AS position, unnest([0, 0, 1, 0, 0, 2]) AS copy_no FROM region)
SELECT q.deck, q.position, q.slide_no, q.copy_no, s.n_nationkey, CASE WHEN s.deck IS NULL THEN 'slide index out of range' END AS error
FROM q LEFT JOIN s ON s.deck = q.deck AND s.slide_no = q.slide_no""")
def arrange(t: Tables) -> DataFrame:
    slides = t.sql("SELECT n_regionkey AS deck, n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS slide_no FROM {nation}")
    seqs = t.region.select(F.col("r_regionkey").alias("deck"), F.array(*[F.lit(i) for i in (3, 0, 3, 2, 9, 3)]).alias("sequence"))
    return fm.arrange(slides, seqs).select("deck", "position", "slide_no", "copy_no", "n_nationkey", "error")


# A three-level field tree over parts: blocks of 100 under blocks of 10 under leaves.
TREE = """SELECT 'd' AS doc, p_partkey AS node_no, CASE WHEN p_partkey % 100 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN p_partkey - p_partkey % 100 ELSE p_partkey - p_partkey % 10 END AS parent_no,
   CASE WHEN p_partkey % 10 = 0 AND p_partkey % 30 = 0 THEN NULL ELSE 'f' || CAST(p_partkey AS VARCHAR(20)) END AS name FROM {part}"""


@R.query("field_full_name", """
WITH RECURSIVE w AS (SELECT node_no, name AS full_name FROM tree WHERE parent_no IS NULL
  UNION ALL SELECT c.node_no, CASE WHEN w.full_name IS NULL THEN c.name WHEN c.name IS NULL THEN w.full_name ELSE w.full_name || '.' || c.name END FROM w JOIN tree c ON c.parent_no = w.node_no)
SELECT node_no, full_name FROM w""", tree=TREE)
def field_full_name(t: Tables) -> DataFrame:
    return fm.field_full_name(t.sql(TREE)).select("node_no", "full_name")


# Form fields over customers: doc = nation, kind by key; a radio group has its options in orders.
FIELDS = """SELECT c_nationkey AS doc, 'f' || CAST(c_custkey AS VARCHAR(20)) AS field_id, CASE c_custkey % 5 WHEN 0 THEN '/Tx' WHEN 1 THEN '/Btn' WHEN 2 THEN '/Ch' WHEN 3 THEN '/Btn' END AS ft, c_custkey % 5 = 3 AS has_kids, c_custkey AS k FROM {customer}"""
ANNOTS = """SELECT c_nationkey AS doc, 'f' || CAST(o_custkey AS VARCHAR(20)) AS field_id, CAST(1 + o_orderkey % 3 AS INT) AS page, o_orderkey AS ann_no, o_orderkey AS k FROM {orders} JOIN {customer} ON c_custkey = o_custkey"""


def _form(t: Tables) -> tuple[DataFrame, DataFrame]:
    st = lambda v, x: F.struct(F.lit(v).alias("value"), F.lit(x).alias("text"))
    none = F.array().cast("array<struct<value:string,text:string>>")
    kind = F.col("k") % 5
    states = F.when(kind == 1, F.when(F.col("k") % 2 == 0, F.array(st("/Off", "n"), st("/Yes", "y"))).otherwise(F.array(st("/A", "a"), st("/B", "b")))).when(
        kind == 2, F.array(st("x", "X"), st("y", "Y"))).otherwise(none)
    fields = t.sql(FIELDS).withColumn("states", states)
    k = F.col("k")
    rect = F.array(*[c.cast("double") for c in (k % 89, k % 61, k % 89 + 5, k % 61 + 5)])
    on = F.when(k % 7 == 0, F.array(F.lit("/Off"))).otherwise(F.array(F.lit("/Off"), F.concat(F.lit("/o"), (k % 11).cast("string"))))
    return fields, t.sql(ANNOTS).withColumn("rect", rect).withColumn("on_values", on)


_FORM = """last AS (SELECT doc, field_id, arg_max(k, (page, ann_no)) AS k FROM annots GROUP BY 1, 2),
radio AS (SELECT doc, field_id, arg_min(k, (page, ann_no)) AS k FROM annots WHERE k % 7 <> 0 GROUP BY 1, 2),
form AS (SELECT f.doc, f.field_id, CASE f.k % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'choice' ELSE 'unknown (None)' END AS type, l.k AS ak,
   CASE WHEN f.k % 5 = 1 THEN CASE WHEN f.k % 2 = 0 THEN '/Yes' ELSE '/A' END END AS checked_value, CASE WHEN f.k % 5 = 1 THEN CASE WHEN f.k % 2 = 0 THEN '/Off' ELSE '/B' END END AS unchecked_value
  FROM fields f JOIN last l ON l.doc = f.doc AND l.field_id = f.field_id WHERE NOT f.has_kids
  UNION ALL SELECT f.doc, f.field_id, 'radio_group', r.k, NULL, NULL FROM fields f JOIN radio r ON r.doc = f.doc AND r.field_id = f.field_id WHERE f.has_kids)"""


@R.query("form_inventory", "WITH " + _FORM + " SELECT doc, field_id, type, CAST(1 + ak % 3 AS INT) AS page, CAST(ak % 89 AS DOUBLE) AS x, checked_value, unchecked_value FROM form", fields=FIELDS, annots=ANNOTS)
def form_inventory(t: Tables) -> DataFrame:
    fields, _ = fm.form_inventory(*_form(t))
    return fields.select("doc", "field_id", "type", "page", F.col("rect")[0].alias("x"), "checked_value", "unchecked_value")


@R.query("form_options", """
SELECT f.doc, f.field_id, '/o' || (a.k % 11) AS value, count(*) AS n FROM fields f JOIN annots a ON a.doc = f.doc AND a.field_id = f.field_id WHERE f.has_kids AND a.k % 7 <> 0 GROUP BY 1, 2, 3
UNION ALL SELECT doc, field_id, unnest(['x', 'y']), 1 FROM fields f WHERE k % 5 = 2 AND (doc, field_id) IN (SELECT doc, field_id FROM annots)""", fields=FIELDS, annots=ANNOTS)
def form_options(t: Tables) -> DataFrame:
    _, options = fm.form_inventory(*_form(t))
    return options.groupBy("doc", "field_id", "value").agg(F.count(F.lit(1)).alias("n"))


@R.query("form_order", "WITH " + _FORM + " SELECT doc, field_id, row_number() OVER (PARTITION BY doc ORDER BY ak % 3, -(ak % 61), ak % 89, field_id) AS place FROM form", fields=FIELDS, annots=ANNOTS)
def form_order(t: Tables) -> DataFrame:
    fields, _ = fm.form_inventory(*_form(t))
    return fm.form_order(fields).select("doc", "field_id", "place")


VALUES = """SELECT c_nationkey AS doc, 'f' || CAST(CASE WHEN c_custkey % 17 = 0 THEN -1 - c_custkey ELSE c_custkey END AS VARCHAR(20)) AS field_id, CAST(1 + c_custkey % 3 AS INT) AS page,
   CASE c_custkey % 4 WHEN 0 THEN '/Yes' WHEN 1 THEN 'x' WHEN 2 THEN '/o3' ELSE '/A' END AS value, c_custkey AS k FROM {customer}"""


@R.query("field_value_findings", "WITH " + _FORM + """,
o AS (SELECT DISTINCT doc, field_id, '/o' || (k % 11) AS value FROM annots WHERE k % 7 <> 0),
j AS (SELECT v.*, f.type, 1 + f.ak % 3 AS fp, f.checked_value, f.unchecked_value, o.value AS hit FROM vals v LEFT JOIN form f ON f.doc = v.doc AND f.field_id = v.field_id
  LEFT JOIN o ON o.doc = v.doc AND o.field_id = v.field_id AND o.value = v.value),
r AS (SELECT doc, field_id, value, CASE WHEN type IS NULL THEN 'unknown field' WHEN page <> fp THEN 'wrong page' WHEN type = 'checkbox' AND value NOT IN (checked_value, unchecked_value) THEN 'invalid checkbox value'
  WHEN type = 'radio_group' AND hit IS NULL THEN 'invalid radio value' WHEN type = 'choice' AND value NOT IN ('x', 'y') THEN 'invalid choice value' END AS rule FROM j)
SELECT * FROM r WHERE rule IS NOT NULL""", fields=FIELDS, annots=ANNOTS, vals=VALUES)
def field_value_findings(t: Tables) -> DataFrame:
    fields, options = fm.form_inventory(*_form(t))
    return fm.field_value_findings(fields, options, t.sql(VALUES))


MESSAGES = """SELECT l_orderkey AS doc, l_returnflag AS part, l_partkey AS k, l_suppkey AS s, l_linenumber AS n, repeat('e', CAST(200 + l_partkey % 100 AS INT)) || CAST(l_partkey AS VARCHAR(20)) || '-' || CAST(l_suppkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) AS message FROM {lineitem}"""


@R.query("first_errors", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc, part ORDER BY message) AS place FROM m)
SELECT doc, part, place, CASE WHEN length(message) > 250 THEN substr(message, 1, 250) || '...' ELSE message END AS message FROM r WHERE place <= 3""", m=MESSAGES)
def first_errors(t: Tables) -> DataFrame:
    return fm.first_errors(t.sql(MESSAGES)).select("doc", "part", "place", "message")


@R.query("preview", "SELECT doc_id, substr(text, 1, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS preview FROM documents")
def preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.preview(F.col("text")).alias("preview"))


@R.query("combine_tables", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), r AS (SELECT doc_id, ls, unnest(range(1, len(ls))) AS i FROM l WHERE len(ls) > 1)
SELECT doc_id, i - 1 AS row_no, md5(ls[1]) AS head, md5(ls[i + 1]) AS cell FROM r""")
def combine_tables(t: Tables) -> DataFrame:
    tables = t.documents.select(F.col("doc_id").alias("table_id"), F.transform(F.split("text", "\n"), lambda x: F.array(x)).alias("rows"))
    out = combine(tables)
    return out.select(F.col("table_id").alias("doc_id"), "row_no", F.md5(F.map_keys("cells")[0]).alias("head"), F.md5(F.map_values("cells")[0]).alias("cell"))
