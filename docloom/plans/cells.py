"""Registered spreadsheet queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import cells as c
from docloom.plans.base import Registry, Tables

R = Registry()

CELLS = """SELECT l_linestatus AS workbook, l_returnflag AS sheet, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS sheet_no,
   CAST(l_orderkey AS INT) + 1 AS row, l_linenumber AS col, substr('ABCDEFGHIJ', l_linenumber, 1) || CAST(l_orderkey + 1 AS VARCHAR(20)) AS coord,
   CASE l_partkey % 37 WHEN 0 THEN '#DIV/0!' WHEN 1 THEN '#REF!' WHEN 2 THEN '=A1' WHEN 3 THEN '#N/A #VALUE!' WHEN 4 THEN '' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS value,
   CASE l_partkey % 37 WHEN 2 THEN '=A1' WHEN 5 THEN '=[book.xlsx]S!A1' WHEN 6 THEN '=Other!B2*2' END AS formula,
   CASE l_suppkey % 4 WHEN 0 THEN 'blue' WHEN 1 THEN 'black' WHEN 2 THEN 'green' ELSE 'red' END AS color,
   l_orderkey, l_partkey, l_suppkey, l_linenumber FROM {lineitem}"""
_CODED = """coded AS (SELECT *, CASE l_partkey % 37 WHEN 0 THEN '#DIV/0!' WHEN 1 THEN '#REF!' WHEN 3 THEN '#VALUE!' END AS code, sheet || '!' || coord AS location FROM cells),
f AS (SELECT *, row_number() OVER (PARTITION BY workbook, code ORDER BY sheet_no, row, col) AS place FROM coded WHERE code IS NOT NULL)"""


@R.query("error_cells", "WITH " + _CODED + " SELECT workbook, code, count(*) AS n, string_agg(location, ',' ORDER BY place) FILTER (place <= 20) AS locations FROM f GROUP BY 1, 2", cells=CELLS)
def error_cells(t: Tables) -> DataFrame:
    return c.error_cells(t.sql(CELLS)).select("workbook", "code", F.col("count").alias("n"), F.array_join("locations", ",").alias("locations"))


@R.query("first_n_locations", "WITH " + _CODED + " SELECT workbook, code, place, location FROM f WHERE place <= 20", cells=CELLS)
def first_n_locations(t: Tables) -> DataFrame:
    return c.first_n_locations(c.error_locations(t.sql(CELLS))).select("workbook", "code", "place", "location")


@R.query("formula_count", "SELECT workbook, count(*) FILTER (formula LIKE '=%') AS total_formulas FROM cells GROUP BY 1", cells=CELLS)
def formula_count(t: Tables) -> DataFrame:
    return c.formula_count(t.sql(CELLS))


@R.query("error_report", "WITH " + _CODED + """ SELECT workbook, 'errors_found' AS status, count(*) FILTER (code IS NOT NULL) AS total_errors,
  count(DISTINCT code) AS n_codes, count(*) FILTER (formula LIKE '=%') AS total_formulas FROM coded GROUP BY 1""", cells=CELLS)
def error_report(t: Tables) -> DataFrame:
    return c.error_report(t.sql(CELLS)).select("workbook", "status", "total_errors", F.size("error_summary").cast("long").alias("n_codes"), "total_formulas")


@R.query("cell_role_audit", """
WITH a AS (SELECT *, CASE l_partkey % 37 WHEN 2 THEN 'formula' WHEN 5 THEN 'external link' WHEN 6 THEN 'sheet link' ELSE 'input' END AS role FROM cells)
SELECT role, color, CASE role WHEN 'formula' THEN 'black' WHEN 'external link' THEN 'red' WHEN 'sheet link' THEN 'green' ELSE 'blue' END AS expected, count(*) AS n FROM a
WHERE color <> CASE role WHEN 'formula' THEN 'black' WHEN 'external link' THEN 'red' WHEN 'sheet link' THEN 'green' ELSE 'blue' END GROUP BY 1, 2, 3""", cells=CELLS)
def cell_role_audit(t: Tables) -> DataFrame:
    return c.cell_role_audit(t.sql(CELLS)).where("mismatch").groupBy("role", "color", "expected").agg(F.count(F.lit(1)).alias("n"))


SHOWN = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'currency' WHEN 1 THEN 'percent' WHEN 2 THEN 'multiple' WHEN 3 THEN 'year' ELSE 'number' END AS kind,
   CAST(CASE WHEN o_orderkey % 5 = 3 THEN 1990 + o_orderkey % 30 WHEN o_orderkey % 5 = 1 THEN 0 ELSE (o_orderkey % 7 - 3) * 1000 * (o_orderkey % 11) END AS DOUBLE) AS value FROM {orders}"""


@R.query("format_report", """
WITH a AS (SELECT *, CAST(abs(value) AS BIGINT) AS v FROM shown),
b AS (SELECT *, CASE WHEN v >= 1000 THEN (v // 1000) || ',' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') ELSE CAST(v AS VARCHAR) END AS g FROM a),
d AS (SELECT *, CASE kind WHEN 'currency' THEN '$' || g WHEN 'multiple' THEN g || '.0x' ELSE g END AS body FROM b)
SELECT o_orderkey, CASE WHEN kind = 'year' THEN CAST(v AS VARCHAR) WHEN value = 0 THEN '-' WHEN value < 0 THEN '(' || body || ')' ELSE body END AS shown FROM d""", shown=SHOWN)
def format_report(t: Tables) -> DataFrame:
    return c.format_report(t.sql(SHOWN)).select("o_orderkey", "shown")


PLACES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey AS INT) AS row, CAST(1 + l_partkey % 18000 AS INT) AS col FROM {lineitem}"


@R.query("cell_address", """
WITH RECURSIVE d AS (SELECT DISTINCT col, col AS rest, '' AS letters FROM places
  UNION ALL SELECT col, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INT)) || letters FROM d WHERE rest > 0)
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, d.letters || p.row AS coord, p.row + 1 AS sheet_row FROM places p JOIN d ON d.col = p.col AND d.rest = 0""", places=PLACES)
def cell_address(t: Tables) -> DataFrame:
    return c.cell_address(t.sql(PLACES)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "coord", "sheet_row")


@R.query("profile", """
WITH p AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT "column", count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max,
  round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75 FROM p GROUP BY 1""")
def profile(t: Tables) -> DataFrame:
    return c.profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).select(
        "column", F.col("count").alias("n"), *[F.round(x, 4).alias(x) for x in ("mean", "std")], "min", "max", *[F.round(x, 4).alias(x) for x in ("p25", "p50", "p75")])


@R.query("totals", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS average,
  round((arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) - arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)))
    / arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 6) AS growth FROM lineitem GROUP BY 1, 2""")
def totals(t: Tables) -> DataFrame:
    out = c.totals(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return out.select("l_returnflag", "l_linestatus", F.round("total", 2).alias("total"), F.round("average", 6).alias("average"), F.round("growth", 6).alias("growth"))


FORMULAS = """SELECT 'b' || CAST(o_custkey % 7 AS VARCHAR(20)) AS workbook, 'S' AS sheet, 'A' || CAST(o_orderkey + 1 AS VARCHAR(20)) AS coord, CAST(o_orderkey AS INT) + 1 AS row, 1 AS col,
   CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE '5' END AS value,
   CASE o_orderkey % 6 WHEN 1 THEN '=A' || CAST(o_orderkey + 3 AS VARCHAR(20)) || '*2' WHEN 2 THEN '=1/A' || CAST(o_orderkey + 3 AS VARCHAR(20))
      WHEN 3 THEN '=SUM(A' || CAST(o_orderkey + 1 AS VARCHAR(20)) || ':A' || CAST(o_orderkey + 1 AS VARCHAR(20)) || ')' WHEN 4 THEN '=LOG10(3)+"A1"' END AS formula, o_orderkey AS k, o_custkey % 7 AS b FROM {orders}"""


@R.query("formula_ref_findings", """
WITH r AS (SELECT *, k + 2 AS tk FROM cells WHERE k % 6 IN (1, 2)),
j AS (SELECT r.*, t.k AS found, t.value AS tv FROM r LEFT JOIN cells t ON t.b = r.b AND t.k = r.tk)
SELECT workbook, sheet, coord, 'missing_reference' AS rule, 'S!A' || (tk + 1) AS target FROM j WHERE found IS NULL
UNION ALL SELECT workbook, sheet, coord, 'zero_divisor', 'S!A' || (tk + 1) FROM j WHERE found IS NOT NULL AND k % 6 = 2 AND tv = '0'
UNION ALL SELECT workbook, sheet, coord, 'circular_reference', '' FROM cells WHERE k % 6 = 3""", cells=FORMULAS)
def formula_ref_findings(t: Tables) -> DataFrame:
    return c.formula_ref_findings(t.sql(FORMULAS))
