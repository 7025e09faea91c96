"""Registered queries on tracked changes and version comparison.

Each document becomes a word-processing part: one paragraph per line, changed by line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import dom
from docloom.operators import packages as pk
from docloom.operators import revisions as rv
from docloom.plans.base import Registry, Tables
from docloom.session import materialize
from docloom.sources.markup import spread, xml_nodes

R = Registry()

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _doc(t: Tables, tracked: bool, silent: bool = False) -> DataFrame:
    """Line i: i % 4 = 1 gets an insertion by A, 2 is deleted by A and replaced, 3 gets an insertion by B.
    ``silent`` adds an unmarked edit to every line with i % 10 = 5."""
    lit, cat = F.lit, F.concat
    run = lambda c: cat(lit('<w:r><w:t xml:space="preserve">'), c, lit("</w:t></w:r>"))
    ins = lambda who, x: cat(lit(f'<w:ins w:author="{who}">'), run(lit(x)), lit("</w:ins>"))

    def line(x: Column, i: Column) -> Column:
        text = _esc(x)
        if silent:
            text = F.when(i % 10 == 5, cat(text, lit("!"))).otherwise(text)
        b = F.when(i % 4 == 3, ins("B", "BB")).otherwise(lit(""))
        if not tracked:
            return cat(lit("<w:p>"), run(text), b, lit("</w:p>\n"))
        gone = cat(lit('<w:del w:author="A"><w:r><w:delText>'), text, lit("</w:delText></w:r></w:del>"))
        body = F.when(i % 4 == 1, cat(run(text), ins("A", "AA"))).when(i % 4 == 2, cat(gone, ins("A", "NEW"))).otherwise(run(text))
        return cat(lit("<w:p>"), body, b, lit("</w:p>\n"))

    body = F.array_join(F.transform(F.split("text", "\n"), line), "")
    xml = cat(lit(f'<w:document xmlns:w="{_W}"><w:body>'), body, lit("</w:body></w:document>"))
    return spread(t.documents.select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("pkg"), F.lit("word/document.xml").alias("part"), xml.alias("bytes"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT doc_id, i, x, CASE WHEN i % 4 = 3 THEN 'BB' ELSE '' END AS b FROM l)"""


def _numbered(sql_text: str, extra: str = "") -> str:
    return f"""WITH {_LINES}, v AS (SELECT doc_id, i, {sql_text} AS content FROM b)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, md5(content) AS h FROM v WHERE content <> '' {extra}"""


def _hashed(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("no").cast("long").alias("no"), F.md5("content").alias("h"))


@R.query("paragraph_text", _numbered("x || b"))
def paragraph_text(t: Tables) -> DataFrame:
    return _hashed(dom.paragraph_text(xml_nodes(_doc(t, False))))


@R.query("reject_author_changes", _numbered("x || b"))
def reject_author_changes(t: Tables) -> DataFrame:
    return _hashed(dom.paragraph_text(rv.reject_author_changes(xml_nodes(_doc(t, True)), "A")))


@R.query("change_view_accept", _numbered("CASE i % 4 WHEN 1 THEN x || 'AA' WHEN 2 THEN 'NEW' ELSE x || b END"))
def change_view_accept(t: Tables) -> DataFrame:
    return _hashed(rv.change_view(xml_nodes(_doc(t, True)), "accept"))


@R.query("change_view_reject", _numbered("x"))
def change_view_reject(t: Tables) -> DataFrame:
    return _hashed(rv.change_view(xml_nodes(_doc(t, True)), "reject"))


@R.query("change_view_all", _numbered("CASE i % 4 WHEN 1 THEN x || 'AA' WHEN 2 THEN x || 'NEW' ELSE x || b END"))
def change_view_all(t: Tables) -> DataFrame:
    return _hashed(rv.change_view(xml_nodes(_doc(t, True)), "all"))


_VIEW = {"accept": "CASE i % 4 WHEN 1 THEN x || 'AA' WHEN 2 THEN 'NEW' ELSE x || b END", "reject": "x", "all": "CASE i % 4 WHEN 1 THEN x || 'AA' WHEN 2 THEN x || 'NEW' ELSE x || b END"}


@R.query("change_view", f"WITH {_LINES}, v AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, doc_id, i, {c} AS content FROM b" for m, c in _VIEW.items()) + ") "
         "SELECT mode, doc_id, row_number() OVER (PARTITION BY mode, doc_id ORDER BY i) AS no, md5(content) AS h FROM v WHERE content <> ''")
def change_view(t: Tables) -> DataFrame:
    nodes = materialize(xml_nodes(_doc(t, True)))
    views = [_hashed(rv.change_view(nodes, m)).withColumn("mode", F.lit(m)) for m in _VIEW]
    return views[0].unionByName(views[1]).unionByName(views[2])


_EDITS = f"""WITH {_LINES}, t AS (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) > 1),
a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, x || b AS c FROM b WHERE x || b <> ''),
z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, x || CASE WHEN i % 10 = 5 THEN '!' ELSE '' END || b AS c FROM b WHERE x || CASE WHEN i % 10 = 5 THEN '!' ELSE '' END || b <> ''),
d AS (SELECT coalesce(a.doc_id, z.doc_id) AS doc_id, coalesce(a.no, z.no) AS no, a.c AS before, z.c AS after FROM a FULL JOIN z ON a.doc_id = z.doc_id AND a.no = z.no WHERE a.c IS DISTINCT FROM z.c),
e AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM t))"""


def _edits(t: Tables) -> DataFrame:
    return rv.untracked_edits(xml_nodes(_doc(t, False)), xml_nodes(_doc(t, True, True)), "A")


@R.query("untracked_edits", _EDITS + " SELECT doc_id, no, md5(before) AS h1, md5(after) AS h2 FROM e")
def untracked_edits(t: Tables) -> DataFrame:
    return _edits(t).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("no").cast("long").alias("no"), F.md5("before").alias("h1"), F.md5("after").alias("h2"))


@R.query("word_diff", _EDITS + """,
w AS (SELECT doc_id, no, unnest(regexp_split_to_array(coalesce(before, ''), '\\s+')) AS word, -1 AS s FROM e UNION ALL SELECT doc_id, no, unnest(regexp_split_to_array(coalesce(after, ''), '\\s+')), 1 FROM e)
SELECT doc_id, no, word, CAST(sum(s) AS BIGINT) AS change FROM w WHERE word <> '' GROUP BY 1, 2, 3 HAVING sum(s) <> 0""")
def word_diff(t: Tables) -> DataFrame:
    return rv.word_diff(_edits(t), "word").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("no").cast("long").alias("no"), "word", "change")


@R.query("char_diff", f"WITH {_LINES} SELECT doc_id, i, '!' AS added, '' AS removed FROM b WHERE i % 10 = 5 AND x NOT LIKE '%!%'")
def char_diff(t: Tables) -> DataFrame:
    lines = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("no", "before"))
    pairs = lines.where(~F.col("before").contains("!")).withColumn("after", F.when(F.col("no") % 10 == 5, F.concat("before", F.lit("!"))).otherwise(F.col("before")))
    return rv.word_diff(pairs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("no").cast("long").alias("i"), "added", "removed")


@R.query("paragraph_delta", f"""WITH {_LINES} SELECT doc_id, count(*) AS n_before, count(*) AS n_after, 0 AS delta FROM b WHERE doc_id % 3 = 0 GROUP BY 1
UNION ALL SELECT doc_id, 0, count(*), count(*) FROM b WHERE doc_id % 3 = 1 GROUP BY 1 UNION ALL SELECT doc_id, count(*), 0, -count(*) FROM b WHERE doc_id % 3 = 2 GROUP BY 1""")
def paragraph_delta(t: Tables) -> DataFrame:
    n = xml_nodes(_doc(t, True))
    k = F.col("doc_id").cast("long") % 3
    return rv.paragraph_delta(n.where(k != 1), n.where(k != 2)).withColumn("doc_id", F.col("doc_id").cast("long"))


def _runs(t: Tables) -> DataFrame:
    """Lines as runs: i % 3 = 0 padded without the preserve mark, 1 padded with it, 2 text inside a deletion."""
    def line(x: Column, i: Column) -> Column:
        x = _esc(F.regexp_replace(x, r"^\s+|\s+$", ""))
        return (F.when(i % 3 == 0, F.concat(F.lit("<w:t>"), x, F.lit(" </w:t>"))).when(i % 3 == 1, F.concat(F.lit('<w:t xml:space="preserve"> '), x, F.lit("</w:t>")))
                .otherwise(F.concat(F.lit("<w:del><w:r><w:t>x"), x, F.lit("</w:t></w:r></w:del><w:ins><w:delText>y</w:delText><w:del><w:delText>z</w:delText></w:del></w:ins>"))))
    xml = F.concat(F.lit(f'<w:document xmlns:w="{_W}">'), F.array_join(F.transform(F.split("text", "\n"), line), "\n"), F.lit("</w:document>"))
    return spread(t.documents.select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("pkg"), F.lit("word/document.xml").alias("part"), xml.alias("bytes"))


@R.query("whitespace_findings", f"WITH {_LINES} SELECT doc_id, i + 1 AS line FROM b WHERE i % 3 = 0")
def whitespace_findings(t: Tables) -> DataFrame:
    return pk.whitespace_findings(xml_nodes(_runs(t))).select(F.col("doc").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"))


@R.query("misplaced_text", f"WITH {_LINES} SELECT doc_id, i + 1 AS line, r AS rule FROM b CROSS JOIN (SELECT unnest(['deletions', 'insertions']) AS r) rs WHERE i % 3 = 2")
def misplaced_text(t: Tables) -> DataFrame:
    return pk.misplaced_text(xml_nodes(_runs(t))).select(F.col("doc").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "rule")


NOW = """SELECT o_custkey AS doc, o_orderstatus AS part, 'late ' || CAST(o_orderkey % 4 AS VARCHAR(20)) AS message FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'"""
OLD = """SELECT o_custkey AS doc, o_orderstatus AS part, 'late ' || CAST(o_orderkey % 4 AS VARCHAR(20)) AS message FROM {orders} WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00'"""


@R.query("new_errors", "SELECT * FROM now_ EXCEPT SELECT * FROM old_", now_=NOW, old_=OLD)
def new_errors(t: Tables) -> DataFrame:
    return rv.new_errors(t.sql(NOW), t.sql(OLD))


@R.query("error_buckets", """
WITH n AS (SELECT * FROM now_ EXCEPT SELECT * FROM old_), p AS (SELECT c_custkey AS doc, unnest(['F', 'O', 'P']) AS part FROM customer),
x AS (SELECT p.doc, p.part, (SELECT count(*) FROM now_ w WHERE w.doc = p.doc AND w.part = p.part) AS c, (SELECT count(*) FROM n WHERE n.doc = p.doc AND n.part = p.part) AS k FROM p)
SELECT doc, part, CASE WHEN doc % 9 = 0 THEN 'skipped' WHEN c = 0 THEN 'valid' WHEN k = 0 THEN 'only old errors' ELSE 'new errors' END AS bucket, k AS n_new FROM x""", now_=NOW, old_=OLD)
def error_buckets(t: Tables) -> DataFrame:
    parts = t.customer.select(F.col("c_custkey").alias("doc"), F.explode(F.array(*[F.lit(x) for x in "FOP"])).alias("part"), (F.col("c_custkey") % 9 != 0).alias("checked"))
    return rv.error_buckets(parts, t.sql(NOW), t.sql(OLD))
