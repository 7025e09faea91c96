"""Registered invoice, job and page-range queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import invoices as iv
from docloom.plans.base import Registry, Tables
from docloom.sources.tables import read_sheets_union as stack

R = Registry()

_BASE = """(SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) / 100) AS BIGINT) AS euros FROM {orders}) b"""
INVOICES = """SELECT o_orderkey, o_custkey, o_orderdate, cents, CASE WHEN o_orderkey % 5 = 0 THEN 'REVISAR' ELSE
     CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || CASE WHEN euros >= 1000 THEN CAST(CAST(floor(euros / 1000) AS BIGINT) AS VARCHAR(20)) || '.' || lpad(CAST(euros % 1000 AS VARCHAR(20)), 3, '0') ELSE CAST(euros AS VARCHAR(20)) END
     || ',' || lpad(CAST(cents % 100 AS VARCHAR(20)), 2, '0') END AS total_factura,
   'F' || CAST(o_orderkey % 700 AS VARCHAR(20)) AS numero_factura, CASE o_custkey % 3 WHEN 0 THEN 'ES' WHEN 1 THEN 'LU' ELSE 'FR' END || 'B' || CAST(o_custkey % 50 AS VARCHAR(20)) AS cif,
   CASE WHEN o_orderkey % 9 = 0 THEN 'REVISAR' ELSE 'ACME' END AS nombre_empresa, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'REVISAR' WHEN 2 THEN '31/02/2024' ELSE lpad(CAST(1 + o_orderkey % 28 AS VARCHAR(20)), 2, '0') || '/03/2024' END AS fecha_expedicion,
   CASE WHEN o_orderkey % 13 = 0 THEN 'NO SE DETECTAN DATOS DEL CLIENTE ESPERADO' ELSE '' END AS aviso_cliente, CAST(1 + o_orderkey % 2 AS INT) AS intentos_ocr,
   CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' WHEN 2 THEN 'EUR' ELSE 'XXX' END AS currency FROM """ + _BASE


@R.query("parse_es_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN -cents ELSE cents END END AS total_cents FROM inv", inv=INVOICES)
def parse_es_number(t: Tables) -> DataFrame:
    return iv.parse_es_number(t.sql(INVOICES), "total_factura", "n").select("o_orderkey", (F.col("n") * 100).cast("long").alias("total_cents"))


@R.query("format_es_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE total_factura END AS shown FROM inv", inv=INVOICES)
def format_es_number(t: Tables) -> DataFrame:
    signed = F.when(F.col("o_orderkey") % 2 == 0, -F.col("cents")).otherwise(F.col("cents"))
    df = t.sql(INVOICES).withColumn("n", F.when(F.col("o_orderkey") % 5 != 0, (signed.cast("decimal(18,0)") / 100).cast("decimal(18,2)")))
    return iv.format_es_number(df, "n", "shown").select("o_orderkey", "shown")


@R.query("parse_es_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 2 THEN '2024-03-' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') END AS day FROM orders")
def parse_es_date(t: Tables) -> DataFrame:
    return iv.parse_es_date(t.sql(INVOICES), "fecha_expedicion", "d").select("o_orderkey", F.col("d").cast("string").alias("day"))


@R.query("normalize_cif", "SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'LU' ELSE 'FR' END || 'B' || o_custkey % 50 AS cif FROM orders")
def normalize_cif(t: Tables) -> DataFrame:
    return iv.normalize_cif(t.sql(INVOICES)).select("o_orderkey", "cif")


@R.query("needs_fallback", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 6 = 1 OR o_orderkey % 13 = 0)")
def needs_fallback(t: Tables) -> DataFrame:
    return iv.needs_fallback(t.sql(INVOICES)).select("o_orderkey")


@R.query("select_mode", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'form' WHEN o_orderkey % 7 = 0 THEN 'form' WHEN o_orderkey % 5 = 0 THEN 'table' WHEN o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 THEN 'high_quality'
  WHEN o_orderkey % 2 = 0 OR o_orderkey % 4 IN (1, 2) THEN 'low_cost' ELSE 'native_text' END AS mode FROM orders""")
def select_mode(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    docs = t.orders.select(k, F.element_at(F.array(*[F.lit(x) for x in ("pdf", "image", "office", "excel")]), (k % 4 + 1).cast("int")).alias("kind"), (k % 7 == 0).alias("has_forms"),
                           (k % 5 == 0).alias("has_tables"), (k % 3 == 0).alias("handwritten"), (k % 11 == 0).alias("low_quality"), (k % 2 == 0).alias("scanned"))
    return iv.select_mode(docs).select("o_orderkey", "mode")


@R.query("mode_supports", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE o_orderkey % 2 = 1 END AS supported FROM orders")
def mode_supports(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    docs = t.orders.select(k, F.when(k % 3 == 0, "Layout preserving").when(k % 3 == 1, "MS Office Excel").otherwise("Images").alias("feature"),
                           F.when(k % 2 == 1, "table").otherwise("native_text").alias("mode"))
    return iv.mode_supports(docs).select("o_orderkey", "supported")


@R.query("convert_currency", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0.9200' WHEN 1 THEN '0.0063' WHEN 2 THEN '1.0000' END AS rate, currency AS moneda_origen,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN (cents * 92 + 50) // 100 WHEN 1 THEN (cents * 63 + 5000) // 10000 WHEN 2 THEN cents END AS BIGINT) AS eur_cents FROM inv""", inv=INVOICES)
def convert_currency(t: Tables) -> DataFrame:
    df = t.sql(INVOICES).withColumn("amount", F.col("cents").cast("decimal(18,0)") / 100)
    out = iv.convert_currency(df)
    return out.select("o_orderkey", F.col("tipo_cambio").cast("string").alias("rate"), "moneda_origen", (F.col("amount_eur") * 100).cast("long").alias("eur_cents"))


VAT = """SELECT o_orderkey, 'F' || CAST(o_orderkey AS VARCHAR(20)) AS numero_factura, 'B' || CAST(o_custkey % 50 AS VARCHAR(20)) AS cif, o_orderkey % 3 AS k, o_orderkey % 1000 AS b FROM {orders}"""


def _vat(t: Tables) -> DataFrame:
    k, b = F.col("k"), F.col("b")
    null = F.lit(None).cast("decimal(18,2)")
    d = lambda cond, x: F.when(cond, x.cast("decimal(18,2)")).otherwise(null)
    return t.sql(VAT).select("numero_factura", "cif", d(k == 0, b * 100).alias("base_21"), d(k == 0, b * 21 + F.when(b % 10 == 0, 1).otherwise(0)).alias("iva_21"),
                             d(k == 1, b * 10).alias("base_10"), d(k == 1, b).alias("iva_10"), null.alias("base_4"), null.alias("iva_4"), d(k == 2, b).alias("exento"),
                             d((k == 0) & (b % 2 == 0), b * 52 / 10).alias("recargo_52"), null.alias("recargo_14"), null.alias("recargo_05"),
                             F.when(k == 1, F.lit(15)).alias("porcentaje_retencion"), d(k == 1, b * 15 / 10).alias("cuota_retencion"))


_VAT_LINES = """v AS (SELECT cif, numero_factura, 'iva' AS kind, 2100 AS rate, b * 10000 AS base, b * 2100 + CASE WHEN b % 10 = 0 THEN 100 ELSE 0 END AS quota, b % 10 <> 0 AS fits FROM vat WHERE k = 0
UNION ALL SELECT cif, numero_factura, 'recargo', 520, b * 10000, b * 520, true FROM vat WHERE k = 0 AND b % 2 = 0 UNION ALL SELECT cif, numero_factura, 'iva', 1000, b * 1000, b * 100, true FROM vat WHERE k = 1
UNION ALL SELECT cif, numero_factura, 'exento', 0, b * 100, NULL, true FROM vat WHERE k = 2 UNION ALL SELECT cif, numero_factura, 'retencion', 1500, b * 1000, b * 150, true FROM vat WHERE k = 1)"""
_CENTS = lambda c: (F.col(c) * 100).cast("long").alias(c)


@R.query("vat_lines", "WITH " + _VAT_LINES + " SELECT numero_factura, cif, kind, rate, base, quota, fits FROM v", vat=VAT)
def vat_lines(t: Tables) -> DataFrame:
    return iv.vat_lines(_vat(t)).select("numero_factura", "cif", "kind", (F.col("rate") * 10000).cast("long").alias("rate"), _CENTS("base"), _CENTS("quota"), "fits")


@R.query("vat_summary", "WITH " + _VAT_LINES + """ SELECT cif, kind, rate, CAST(CASE WHEN grouping(kind) = 1 THEN sum(CASE WHEN k = 'iva' OR k = 'exento' THEN base END) ELSE sum(base) END AS BIGINT) AS base, CAST(sum(quota) AS BIGINT) AS quota, count(*) FILTER (NOT fits) AS n_misfits FROM (SELECT *, kind AS k FROM v) w GROUP BY ROLLUP (cif, kind, rate)""", vat=VAT)
def vat_summary(t: Tables) -> DataFrame:
    return iv.vat_summary(iv.vat_lines(_vat(t))).select("cif", "kind", (F.col("rate") * 10000).cast("long").alias("rate"), _CENTS("base"), _CENTS("quota"), "n_misfits")


@R.query("unique_invoices", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY numero_factura, cif ORDER BY o_orderdate, o_orderkey) AS rn FROM inv) SELECT numero_factura, cif, o_orderkey FROM r WHERE rn = 1", inv=INVOICES)
def unique_invoices(t: Tables) -> DataFrame:
    return iv.unique_invoices(t.sql(INVOICES), ["o_orderdate", "o_orderkey"]).select("numero_factura", "cif", "o_orderkey")


ATTEMPTS = """SELECT o_orderkey AS doc, o_custkey AS vendor, CAST(a + 1 AS INT) AS attempt FROM {orders} EACH a BELOW 2 WHERE a = 0 OR o_orderkey % 5 < 3 OR o_custkey % 10 = 0"""


@R.query("tier_stats", """WITH d AS (SELECT doc, max(attempt) AS m FROM att GROUP BY 1) SELECT count(*) AS n_docs, round(count(*) FILTER (m = 1) * 100.0 / count(*), 6) AS first_tier_pct, round(count(*) FILTER (m > 1) * 100.0 / count(*), 6) AS fallback_pct FROM d""", att=ATTEMPTS)
def tier_stats(t: Tables) -> DataFrame:
    return iv.tier_stats(t.sql(ATTEMPTS)).select("n_docs", F.round("first_tier_pct", 6).alias("first_tier_pct"), F.round("fallback_pct", 6).alias("fallback_pct"))


@R.query("always_fallback", "WITH d AS (SELECT vendor, doc, max(attempt) AS m FROM att GROUP BY 1, 2) SELECT vendor, count(*) AS n_docs FROM d GROUP BY 1 HAVING min(m) > 1", att=ATTEMPTS)
def always_fallback(t: Tables) -> DataFrame:
    return iv.always_fallback(t.sql(ATTEMPTS))


JOBS = """SELECT event_id, user_id AS account, 'h' || CAST(event_id % 3000 AS VARCHAR(20)) AS job_hash, ts, event_type AS tag, 1 + event_id % 9 AS pages,
   CASE event_id % 4 WHEN 0 THEN 'native_text' WHEN 1 THEN 'low_cost' WHEN 2 THEN 'high_quality' ELSE 'form' END AS mode,
   CASE event_id % 4 WHEN 0 THEN 'native_text' WHEN 1 THEN 'low_cost' WHEN 2 THEN 'high_quality' ELSE 'form' END AS service_type,
   CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'retrieved' ELSE 'error' END AS status FROM {events}"""


@R.query("usage_report", "SELECT service_type, CAST(sum(pages) AS BIGINT) AS pages_processed FROM jobs WHERE tag = 'click' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1", jobs=JOBS)
def usage_report(t: Tables) -> DataFrame:
    return iv.usage_report(t.sql(JOBS), "click", "2024-01-20", "2024-01-05")


@R.query("usage_report_30_days", "SELECT service_type, CAST(sum(pages) AS BIGINT) AS pages_processed FROM jobs WHERE tag = 'click' AND CAST(ts AS DATE) BETWEEN DATE '2023-12-26' AND DATE '2024-01-25' GROUP BY 1", jobs=JOBS)
def usage_report_30_days(t: Tables) -> DataFrame:
    return iv.usage_report(t.sql(JOBS), "click", "2024-01-25")


@R.query("quota_status", """
SELECT account, CAST(sum(pages) AS BIGINT) AS current_page_count, CAST(coalesce(sum(pages) FILTER (CAST(ts AS DATE) = DATE '2024-01-15'), 0) AS BIGINT) AS today_page_count,
  CAST(coalesce(sum(pages) FILTER (mode = 'form'), 0) AS BIGINT) AS current_page_count_form, CAST(greatest(sum(pages) - 200, 0) AS BIGINT) AS overage_page_count,
  coalesce(sum(pages) FILTER (CAST(ts AS DATE) = DATE '2024-01-15'), 0) > 10 AS over_today FROM jobs WHERE ts < TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1""", jobs=JOBS)
def quota_status(t: Tables) -> DataFrame:
    out = iv.quota_status(t.sql(JOBS), "2024-01-15", 200, 10)
    return out.select("account", "current_page_count", "today_page_count", "current_page_count_form", "overage_page_count", "over_today")


@R.query("page_cost", """
WITH d AS (SELECT account, mode, CAST(ts AS DATE) AS day, sum(pages) AS p FROM jobs GROUP BY 1, 2, 3)
SELECT account, mode, CAST(sum(p) AS BIGINT) AS pages, CAST(round(sum(greatest(p - 2, 0)) * max(CASE mode WHEN 'native_text' THEN 1 WHEN 'low_cost' THEN 5 WHEN 'high_quality' THEN 10 ELSE 15 END)) AS BIGINT) AS milli FROM d GROUP BY 1, 2""", jobs=JOBS)
def page_cost(t: Tables) -> DataFrame:
    jobs = t.sql(JOBS)
    price = F.when(F.col("mode") == "native_text", 1).when(F.col("mode") == "low_cost", 5).when(F.col("mode") == "high_quality", 10).otherwise(15)
    rates = jobs.select("mode").distinct().withColumn("per_thousand", price)
    return iv.page_cost(jobs, rates, 2).select("account", "mode", "pages", F.round(F.col("cost") * 1000).cast("long").alias("milli"))


@R.query("job_latency", "SELECT event_id, event_id % 100 AS elapsed_s, round((event_id % 50) / CAST(1 + event_id % 9 AS DOUBLE), 6) AS seconds_per_page FROM events")
def job_latency(t: Tables) -> DataFrame:
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    rfc = lambda c: F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    jobs = t.events.select("event_id", rfc(ts).alias("processing_started_at"), rfc(F.timestamp_seconds(F.unix_seconds(ts) + F.col("event_id") % 100)).alias("completed_at"),
                           (F.col("event_id") % 50).cast("double").alias("processing_time_in_seconds"), (1 + F.col("event_id") % 9).alias("processed_pages"))
    return iv.job_latency(jobs).select("event_id", "elapsed_s", F.round("seconds_per_page", 6).alias("seconds_per_page"))


@R.query("low_confidence", """
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
x AS (SELECT doc_id, line_no, unnest(string_split(l, ' ')) AS word, unnest(range(len(string_split(l, ' ')))) AS word_no FROM w)
SELECT doc_id AS doc, line_no, count(*) AS n FROM x WHERE (line_no + word_no) % 10 = 0 GROUP BY 1, 2""")
def low_confidence(t: Tables) -> DataFrame:
    word = lambda j: lambda x, i: F.struct(F.when((i + j) % 10 == 0, F.lit("0.801")).otherwise(F.lit("0.900")).alias("confidence"), x.alias("text"))
    jobs = t.documents.select(F.col("doc_id").alias("doc"), F.transform(F.split("text", "\n"), lambda l, j: F.transform(F.split(l, " "), word(j))).alias("confidence"))
    return iv.low_confidence(jobs).groupBy("doc", "line_no").agg(F.count(F.lit(1)).alias("n"))


@R.query("once_only", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY job_hash ORDER BY ts, event_id) = 1 THEN 'served' ELSE 'already delivered' END AS answer FROM jobs", jobs=JOBS)
def once_only(t: Tables) -> DataFrame:
    return iv.once_only(t.sql(JOBS), ("ts", "event_id")).select("event_id", "answer")


@R.query("latest_status", "SELECT job_hash, arg_max(status, (ts, event_id)) AS status FROM jobs GROUP BY 1", jobs=JOBS)
def latest_status(t: Tables) -> DataFrame:
    return iv.latest_status(t.sql(JOBS), ("ts", "event_id")).select("job_hash", "status")


SPECS = """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '1-5,7,21-' WHEN 1 THEN '3' WHEN 2 THEN '2-4, 3-6' ELSE '24-99' END AS spec, CAST(20 + n_nationkey AS INT) AS total FROM {nation}"""


@R.query("expand_ranges", """
SELECT n_nationkey, number FROM specs CROSS JOIN generate_series(1, 60) AS g(number) WHERE number <= total AND CASE n_nationkey % 4 WHEN 0 THEN number BETWEEN 1 AND 5 OR number = 7 OR number >= 21
  WHEN 1 THEN number = 3 WHEN 2 THEN number BETWEEN 2 AND 6 ELSE number >= 24 END""", specs=SPECS)
def expand_ranges(t: Tables) -> DataFrame:
    return iv.expand_ranges(t.sql(SPECS)).select("n_nationkey", F.col("number").cast("long").alias("number"))


@R.query("assemble_pages", """
SELECT o_custkey AS target, o_orderkey AS ord, CASE WHEN p = 1 THEN 0 ELSE p - 2 END AS place, p AS page FROM orders CROSS JOIN generate_series(1, 9) AS g(p) WHERE p <= 3 + o_orderkey % 5 AND (p = 1 OR p >= 3)""")
def assemble_pages(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    src = t.orders.select(F.col("o_custkey").alias("target"), k.alias("ord"), k.alias("doc"), F.lit("1,3-").alias("spec"), (3 + k % 5).cast("int").alias("total"))
    return iv.assemble_pages(src).select("target", "ord", F.col("place").cast("long").alias("place"), F.col("page").cast("long").alias("page"))


@R.query("split_pages", """
WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS x, unnest(range(len(string_split(text, '. ')))) AS i FROM documents) SELECT doc_id, i + 1 AS page_no, md5(x) AS h FROM p""")
def split_pages(t: Tables) -> DataFrame:
    return iv.split_pages(t.documents.select("doc_id", "text"), ". ").select("doc_id", "page_no", F.md5("page_text").alias("h"))


@R.query("highlight_rects", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS x1, (100 + l_partkey % 3000 - 50) * 3508 // 3168 AS y1, 2480 AS x2, (100 + l_partkey % 3000) * 3508 // 3168 AS y2 FROM lineitem")
def highlight_rects(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (100 + F.col("l_partkey") % 3000).alias("base_y"), F.lit(50).alias("height"), F.lit(3168).alias("page_height"))
    return iv.highlight_rects(lines, 2480, 3508).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x1", "y1", "x2", "y2")


@R.query("read_sheets_union", "SELECT 'open' AS sheet, o_orderkey, o_totalprice, CAST(NULL AS BIGINT) AS o_custkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'rest', o_orderkey, NULL, o_custkey FROM orders WHERE o_orderstatus <> 'O'")
def read_sheets_union(t: Tables) -> DataFrame:
    o = t.orders
    return stack({"open": o.where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), "rest": o.where("o_orderstatus <> 'O'").select("o_orderkey", "o_custkey")}).select(
        "sheet", "o_orderkey", "o_totalprice", "o_custkey")


@R.query("read_delimited", "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def read_delimited(t: Tables) -> DataFrame:
    """Round trip: the orders are written as tab-separated text in the shared folder and read back with types."""
    import uuid

    from docloom.session import checkpoint_dir
    from docloom.sources.tables import read_delimited as read
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/delimited-{uuid.uuid4().hex}"
    t.orders.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")).write.option("header", True).option("sep", "\t").csv(path)
    out = read(t.spark, path, "o_orderkey long, o_orderstatus string, day string", ["o_orderkey", "o_orderstatus", "day"], {"day": "dd/MM/yyyy"}, "\t")
    return out.withColumn("day", F.col("day").cast("string"))
