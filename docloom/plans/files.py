"""Registered source and sink queries: the files they read are written by Spark from the tables first."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import urls as U
from docloom.plans.base import Registry, Tables
from docloom.session import checkpoint_dir
from docloom.sources import markup as mk
from docloom.sources import tables as tb

R = Registry()


def _folder(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@R.query("read_html_bytes", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'iso-8859-1' WHEN 1 THEN 'utf-8' WHEN 2 THEN 'nonsense' ELSE 'windows-1252' END AS charset, md5('é' || url) AS h FROM pages""")
def read_html_bytes(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    head = F.when(k == 0, '<meta charset="ISO-8859-1">').when(k == 1, "").when(k == 2, '<meta charset="nonsense">').otherwise(
        '<meta http-equiv="Content-Type" content="text/html; charset=windows-1252">')
    text = F.concat(head, F.lit("|é"), F.col("url"))
    content = F.when(k.isin(0, 3), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    out = mk.decode_html(t.pages.select(F.col("page_id").cast("string").alias("path"), content.alias("content")))
    return out.select(F.col("path").cast("long").alias("page_id"), "charset", F.md5(F.regexp_replace("html", r"(?s)^.*\|", "")).alias("h"))


_PACKAGE = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _zipped(names: list[str], bodies: list[str]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in zip(names, bodies):
            z.writestr(n, b)
    return buf.getvalue()


def _zip(batches):
    """Pack (path, names, bodies) rows into one zip each."""
    cells = ([c[at].as_py() for c in batch.columns] for batch in batches for at in range(batch.num_rows))
    return mk.by_weight(((path, _zipped(names, bodies)) for path, names, bodies in cells), _PACKAGE, lambda row: len(row[1]))


@R.query("read_packages", """
SELECT doc_id, 'word/document.xml' AS part, md5(text) AS h FROM documents UNION ALL SELECT doc_id, '[Content_Types].xml', md5(lang) FROM documents
UNION ALL SELECT doc_id, 'word/_rels/document.xml.rels', md5(source) FROM documents""")
def read_packages(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("word/document.xml", "[Content_Types].xml", "word/_rels/document.xml.rels", "media/a.png")])
    rows = mk.spread(t.documents).select(F.col("doc_id").cast("string").alias("path"), names.alias("names"), F.array("text", "lang", "source", F.lit("png")).alias("bodies"))
    zips = rows.mapInArrow(_zip, "path string, content binary")
    members = mk.markup_parts(mk.packages(zips))
    return members.select(F.col("pkg").cast("long").alias("doc_id"), "part", F.md5("bytes").alias("h"))


def _esc(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@R.query("cells_from_packages", """
SELECT c_custkey, 'Data' AS sheet, 'A1' AS coord, 1 AS row, 1 AS col, c_name AS value, NULL AS formula FROM customer
UNION ALL SELECT c_custkey, 'Data', 'B1', 1, 2, CAST(c_custkey * 2 AS VARCHAR), '=A2*2' FROM customer
UNION ALL SELECT c_custkey, 'Data', 'AB7', 7, 28, c_mktsegment || '!', NULL FROM customer
UNION ALL SELECT c_custkey, 'Data', 'C9', 9, 3, ' in line ', NULL FROM customer UNION ALL SELECT c_custkey, 'Data', 'D9', 9, 4, NULL, NULL FROM customer""")
def cells_from_packages(t: Tables) -> DataFrame:
    lit, cat = F.lit, F.concat
    n = F.col("c_custkey").cast("string")
    rel = 'http://schemas.openxmlformats.org/officeDocument/2006/relationships'
    parts = {
        "xl/workbook.xml": lit(f'<workbook xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="rId7"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": lit('<Relationships><Relationship Id="rId7" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>'),
        "xl/sharedStrings.xml": cat(lit("<sst><si><t>"), _esc(F.col("c_name")), lit("</t></si><si><r><t>"), _esc(F.col("c_mktsegment")), lit("</t></r><r><t>!</t></r></si></sst>")),
        "xl/worksheets/sheet1.xml": cat(lit('<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>A2*2</f><v>'), (F.col("c_custkey") * 2).cast("string"),
                                        lit('</v></c></row><row r="7"><c r="AB7" t="s"><v>1</v></c></row><row r="9"><c r="C9" t="inlineStr"><is><t> in line </t></is></c><c r="D9"/></row></sheetData></worksheet>'))}
    rows = mk.spread(t.customer).select(n.alias("pkg"), F.explode(F.array(*[F.struct(lit(p).alias("part"), x.alias("bytes")) for p, x in parts.items()])).alias("x")).select("pkg", "x.*")
    out = mk.cells_from_packages(mk.xml_nodes(rows))
    return out.select(F.col("workbook").cast("long").alias("c_custkey"), "sheet", "coord", "row", "col", "value", "formula")


@R.query("read_fields_json", """
SELECT p_partkey, p_partkey % 7 AS page, CAST(p_partkey % 97 AS DOUBLE) AS left_, p_partkey % 3 <> 0 AS has_text, CASE WHEN p_partkey % 3 = 1 THEN 12 END AS font_size, 600 AS width FROM part""")
def read_fields_json(t: Tables) -> DataFrame:
    """One form description per part, written as JSON text and parsed with the declared schema."""
    k = F.col("p_partkey")
    n = lambda c: c.cast("string")
    text = F.concat(F.lit('{"pages":[{"page_number":'), n(k % 7), F.lit(',"image_width":600,"image_height":800}],"form_fields":[{"page_number":'), n(k % 7),
                    F.lit(',"description":"d","field_label":"l","label_bounding_box":['), n(k % 97), F.lit(',1,2,3],"entry_bounding_box":[1,2,3,4]'),
                    F.when(k % 3 == 0, "").when(k % 3 == 1, ',"entry_text":{"text":"x","font_size":12}').otherwise(',"entry_text":{}'), F.lit("}]}"))
    raw = t.part.select(n(k).alias("doc"), F.from_json(text, f"struct<{tb.BOX_FIELDS.replace(chr(10), '').replace('pages array', 'pages:array').replace('form_fields array', 'form_fields:array')}>").alias("j"))
    pages, fields = tb.field_rows(raw.select("doc", "j.*"))
    sized = fields.join(pages.select("doc", "page_number", "image_width"), ["doc", "page_number"])
    return sized.select(F.col("doc").cast("long").alias("p_partkey"), F.col("page_number").cast("long").alias("page"), F.col("label_bounding_box")[0].alias("left_"), "has_text",
                        F.col("entry_text.font_size").cast("int").alias("font_size"), F.col("image_width").alias("width"))


@R.query("write_index", "SELECT url, 'success' AS status, CAST(page_id % 4 AS INT) AS depth FROM pages")
def write_index(t: Tables) -> DataFrame:
    path = _folder(t, "index")
    schema = "url string, status string, depth int"
    none = tb.read_index(t.spark, path, schema)  # absent: reads as empty
    tb.write_index(t.pages.select("url", F.lit("success").alias("status"), (F.col("page_id") % 4).cast("int").alias("depth")), path)
    return tb.read_index(t.spark, path, schema).unionByName(none)


@R.query("write_page_text", """SELECT regexp_extract(url, '//([^/]*)', 1) AS host, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1""")
def write_page_text(t: Tables) -> DataFrame:
    path = _folder(t, "page-text")
    tb.write_page_text(t.pages.select(U.host(F.col("url")).alias("host"), T.file_name(F.col("url")).alias("file"), F.col("html").alias("markdown")), path)
    return t.spark.read.parquet(path).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("markdown")).alias("chars"))


@R.query("write_findings", "SELECT event_type AS rule, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'again', count(*) FROM events WHERE event_type = 'error'")
def write_findings(t: Tables) -> DataFrame:
    path = _folder(t, "findings")
    found = t.events.select(F.col("user_id").alias("doc"), F.lit("p").alias("part"), F.lit(1).alias("line"), F.col("event_type").alias("rule"), F.col("props").alias("message"))
    tb.write_findings(found, path)
    tb.write_findings(found.where("rule = 'error'").withColumn("rule", F.lit("again")), path)
    return t.spark.read.parquet(path).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
