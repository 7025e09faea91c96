"""Invoice extraction results, extraction jobs and page ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.operators.ordered import join_on

# Fields that must be readable, and the mark for a missing customer.
CRITICAL = ("fecha_expedicion", "nombre_empresa", "cif", "numero_factura", "total_factura")
NO_CUSTOMER = "NO SE DETECTAN DATOS DEL CLIENTE ESPERADO"
VAT = {"21": 0.21, "10": 0.10, "4": 0.04}
SURCHARGE = {"recargo_52": ("21", 0.052), "recargo_14": ("10", 0.014), "recargo_05": ("4", 0.005)}
RATES_TO_EUR = {"USD": "0.92", "GBP": "1.17", "CHF": "1.08", "JPY": "0.0063", "CAD": "0.68", "AUD": "0.61", "CNY": "0.13", "EUR": "1"}

# What each processing mode can do, and the scenario each is meant for.
MODES = ("native_text", "low_cost", "high_quality", "form", "table")
FEATURES: Mapping[str, Sequence[str]] = {
    "PDF (not scanned)": ("Yes", "Yes", "Yes", "Yes", "Yes"), "PDF (scanned)": ("No", "Yes", "Yes", "Yes", "Yes"),
    "PDF (with forms)": ("No", "No", "No", "Yes", "Yes"), "Images": ("No", "Yes", "Yes", "Yes", "Yes"),
    "MS Office (Word/PPT)": ("No", "Yes", "Yes", "Yes", "Yes"), "MS Office Excel": ("No", "No", "No", "Yes", "No"),
    "LibreOffice (all)": ("No", "Yes", "Yes", "Yes", "Yes"), "Checkbox/Radio detection": ("No", "No", "No", "Yes", "Yes"),
    "Lines reproduction": ("No", "Yes", "Yes", "Yes", "Yes"), "Speed": ("Very fast", "Medium", "Fast", "Fast", "Fast"),
    "Image preprocessing": ("No", "Yes", "No", "No", "No"), "Languages": ("All unicode", "120+", "300+", "300+", "300+"),
    "Handwriting": ("No", "Basic", "Yes", "Yes", "Yes"), "Layout preserving": ("Yes", "Yes", "Yes", "Yes", "Yes"),
    "AI/ML enhancement": ("No", "No", "Yes", "Yes", "Yes"), "Rotation/skew fix": ("N/A", "No", "Yes", "Yes", "Yes"),
    "Auto repair PDFs": ("Yes", "Yes", "Yes", "Yes", "Yes")}
SCENARIOS = (("checkboxes, radio buttons, form fields", "form"), ("financial statements, invoices, tables", "table"),
             ("low quality scans, handwriting", "high_quality"), ("good scans without handwriting", "low_cost"),
             ("native PDF, low latency", "native_text"))


# --- scalar fields -----------------------------------------------------------------------------------

def parse_es_number(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, N.parse_es_number(F.col(source)))


def format_es_number(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, N.format_es_number(F.col(source)))


def parse_es_date(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumn(name, N.parse_es_date(F.col(source)))


def normalize_cif(df: DataFrame, source: str = "cif", name: str = "cif") -> DataFrame:
    return df.withColumn(name, N.tax_id(F.col(source)))


# --- invoices ------------------------------------------------------------------------------------------

def needs_fallback(invoices: DataFrame) -> DataFrame:
    """First-attempt invoices with an unreadable critical field or without the expected customer."""
    bad = F.col("aviso_cliente") == NO_CUSTOMER
    for c in CRITICAL:
        bad = bad | (F.col(c) == N.UNREADABLE)
    return invoices.where((F.col("intentos_ocr") == 1) & F.coalesce(bad, F.lit(False)))


def select_mode(docs: DataFrame) -> DataFrame:
    """Adds ``mode`` from the traits of a document: ``has_forms, has_tables, handwritten, low_quality, scanned, kind``.

    The first scenario that fits decides; spreadsheets need ``form``, the only mode that reads them, and other
    office files and images cannot go to the text-only mode.
    """
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    return docs.withColumn("mode", F.when(F.col("kind") == "excel", "form").when(t("has_forms"), "form").when(t("has_tables"), "table").when(
        t("handwritten") | t("low_quality"), "high_quality").when(t("scanned") | F.col("kind").isin("image", "office"), "low_cost").otherwise("native_text"))


def mode_features(spark) -> DataFrame:
    """The feature matrix as rows ``(feature, mode, support)`` to join against."""
    return spark.createDataFrame([(f, m, s) for f, row in FEATURES.items() for m, s in zip(MODES, row)], "feature string, mode string, support string")


def mode_supports(docs: DataFrame, wanted: str = "feature") -> DataFrame:
    """Adds ``supported``: whether the row's mode offers the row's feature (85 fixed rows are broadcast)."""
    table = mode_features(docs.sparkSession).withColumnRenamed("feature", wanted)
    return docs.join(F.broadcast(table), [wanted, "mode"], "left").withColumn("supported", ~F.coalesce("support", F.lit("No")).isin("No", "N/A")).drop("support")


def convert_currency(invoices: DataFrame, rates: Mapping[str, str] = RATES_TO_EUR, amount: str = "amount", currency: str = "currency") -> DataFrame:
    """Amounts in EUR at fixed rates; the original currency and the rate stay for the audit."""
    table = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v).cast("decimal(10,4)"))])
    rate = F.try_element_at(table, F.col(currency))
    return (invoices.withColumn("tipo_cambio", rate).withColumn("moneda_origen", F.col(currency)).withColumn("moneda", F.when(rate.isNotNull(), F.lit("EUR")))
            .withColumn("amount_eur", F.round(F.col(amount).cast("decimal(18,2)") * F.col("tipo_cambio"), 2)))


def vat_lines(invoices: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Tax fields in long form ``(numero_factura, cif, kind, rate, base, quota, fits)``; ``fits``: quota is base x rate.

    VAT at 21, 10 and 4 %, the exempt base, the three surcharges on their VAT base, and the withholding.
    """
    d = lambda c: F.col(c).cast("decimal(18,2)")
    rate = lambda r: F.lit(str(r)).cast("decimal(9,4)")
    nil = F.lit(None).cast("decimal(18,2)")
    line = lambda kind, r, base, quota: F.struct(F.lit(kind).alias("kind"), r.alias("rate"), base.alias("base"), quota.alias("quota"))
    rows = [line("iva", rate(v), d(f"base_{k}"), d(f"iva_{k}")) for k, v in VAT.items()]
    rows += [line("recargo", rate(v), d(f"base_{k}"), d(c)) for c, (k, v) in SURCHARGE.items()]
    rows.append(line("exento", rate(0), d("exento"), nil))
    total = sum((F.coalesce(d(f"base_{k}"), F.lit(0).cast("decimal(18,2)")) for k in VAT), F.coalesce(d("exento"), F.lit(0).cast("decimal(18,2)")))
    rows.append(line("retencion", (F.col("porcentaje_retencion") / 100).cast("decimal(9,4)"), total.cast("decimal(18,2)"), d("cuota_retencion")))
    out = invoices.select("numero_factura", "cif", F.inline(F.array(*rows)))
    out = out.where("quota IS NOT NULL OR (kind = 'exento' AND base IS NOT NULL)")
    return out.withColumn("fits", (F.col("kind") == "exento") | F.coalesce(F.abs(F.col("quota") - F.round(F.col("base") * F.col("rate"), 2)) <= F.lit(tolerance).cast("decimal(4,2)"), F.lit(False)))


def vat_summary(lines: DataFrame) -> DataFrame:
    """Base and quota by tax id, kind and rate, with subtotals and a grand total (nulls mark totals).

    Surcharges and withholdings are taken on bases that VAT and exempt lines already hold, so totals over several
    kinds add the base of those two only.
    """
    once = lines.withColumn("_once", F.when(F.col("kind").isin("iva", "exento"), F.col("base")))
    base = F.when(F.grouping("kind") == 1, F.sum("_once")).otherwise(F.sum("base"))
    return once.rollup("cif", "kind", "rate").agg(base.alias("base"), F.sum("quota").alias("quota"), F.count_if(~F.col("fits")).alias("n_misfits"))


def unique_invoices(invoices: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (number, tax id): the first in the given order."""
    keys = ["numero_factura", "cif"]
    rest = [c for c in invoices.columns if c not in keys]
    return invoices.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def tier_stats(jobs: DataFrame) -> DataFrame:
    """Share of documents done in the first attempt: ``jobs(doc, vendor, attempt)`` -> overall percentages."""
    per = jobs.groupBy("doc").agg(F.max("attempt").alias("attempts"))
    n = F.count(F.lit(1))
    return per.agg(n.alias("n_docs"), (F.count_if(F.col("attempts") == 1) * 100 / n).alias("first_tier_pct"), (F.count_if(F.col("attempts") > 1) * 100 / n).alias("fallback_pct"))


def always_fallback(jobs: DataFrame) -> DataFrame:
    """Vendors all of whose documents needed the second attempt."""
    per = jobs.groupBy("vendor", "doc").agg(F.max("attempt").alias("attempts"))
    return per.groupBy("vendor").agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and(F.col("attempts") > 1).alias("_all")).where("_all").drop("_all")


# --- extraction jobs ---------------------------------------------------------------------------------

def usage_report(jobs: DataFrame, tag: str, until: str, since: str | None = None) -> DataFrame:
    """Pages by service type for a tag between two dates; without ``since``, the 30 days up to ``until``."""
    to = F.lit(until).cast("date")
    start = F.lit(since).cast("date") if since else F.date_sub(to, 30)
    day = F.to_date("ts")
    return jobs.where((F.col("tag") == tag) & (day >= start) & (day <= to)).groupBy("service_type").agg(F.sum("pages").alias("pages_processed"))


def quota_status(jobs: DataFrame, today: str, monthly_quota: int = -1, daily_quota: int = -1, modes: Sequence[str] = MODES[:4]) -> DataFrame:
    """Page counts of the day and of the month, per mode, and what goes over the monthly quota (-1: unlimited)."""
    d = F.lit(today).cast("date")
    month = F.trunc("ts", "month") == F.trunc(d, "month")
    pages = F.col("pages")
    zero = F.lit(0)
    aggs = [F.coalesce(F.sum(F.when(month, pages)), zero).alias("current_page_count"), F.coalesce(F.sum(F.when(F.to_date("ts") == d, pages)), zero).alias("today_page_count")]
    aggs += [F.coalesce(F.sum(F.when(month & (F.col("mode") == m), pages)), zero).alias(f"current_page_count_{m}") for m in modes]
    over = zero if monthly_quota < 0 else F.greatest(F.col("current_page_count") - monthly_quota, zero)
    return (jobs.groupBy("account").agg(*aggs).withColumn("monthly_quota", F.lit(monthly_quota)).withColumn("daily_quota", F.lit(daily_quota))
            .withColumn("overage_page_count", over.cast("long")).withColumn("over_today", F.lit(daily_quota >= 0) & (F.col("today_page_count") > daily_quota)))


def page_cost(jobs: DataFrame, rates: DataFrame, free_per_day: int = 0) -> DataFrame:
    """Cost per account and mode at rates per 1,000 pages: ``rates(mode, per_thousand)``, one row per mode."""
    day = jobs.groupBy("account", "mode", F.to_date("ts").alias("day")).agg(F.sum("pages").alias("pages"))
    billed = F.greatest(F.col("pages") - free_per_day, F.lit(0))
    per = day.groupBy("account", "mode").agg(F.sum("pages").alias("pages"), F.sum(billed).alias("billed"))
    return per.join(rates, "mode", "left").withColumn("cost", F.col("billed").cast("decimal(18,0)") * F.col("per_thousand").cast("decimal(8,4)") / 1000)


def rfc_1123(c: Column) -> Column:
    """``Mon, 10 Feb 2025 10:40:53 GMT`` to timestamp (the weekday and zone are cut off first)."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), r"\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))


def job_latency(jobs: DataFrame) -> DataFrame:
    """Seconds from start to end of each job, and processing seconds per page."""
    span = F.unix_seconds(rfc_1123(F.col("completed_at"))) - F.unix_seconds(rfc_1123(F.col("processing_started_at")))
    return jobs.withColumn("elapsed_s", span).withColumn("seconds_per_page", F.when(F.col("processed_pages") > 0, F.col("processing_time_in_seconds") / F.col("processed_pages")))


def low_confidence(jobs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Words below the threshold: ``confidence array<array<struct<confidence string, text>>>`` per document ->
    ``(doc, line_no, word_no, text, score)``."""
    lines = jobs.select("doc", F.posexplode("confidence").alias("line_no", "_w"))
    words = lines.select("doc", "line_no", F.posexplode("_w").alias("word_no", "_x"))
    return words.select("doc", "line_no", "word_no", "_x.text", F.col("_x.confidence").try_cast("double").alias("score")).where(F.col("score") < threshold)


def once_only(retrievals: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Adds ``answer``: the first retrieval of a hash is served, later ones find it already delivered."""
    first = retrievals.groupBy("job_hash").agg(F.min(F.struct(*order)).alias("_first"))
    return join_on(retrievals, first, ["job_hash"]).withColumn(
        "answer", F.when(F.struct(*order) == F.col("_first"), "served").otherwise("already delivered")).drop("_first")


def latest_status(events: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last status of each job."""
    return events.groupBy("job_hash").agg(F.max_by("status", F.struct(*order)).alias("status"), F.max(F.struct(*order))[order[0]].alias("since"))


# --- page ranges and highlights ------------------------------------------------------------------------

def expand_ranges(df: DataFrame, spec: str = "spec", total: str = "total") -> DataFrame:
    """``1-5,7,21-`` as one row per number, in order of mention, each number once; an open end runs to ``total``."""
    piece = lambda p: F.filter(F.sequence(F.split(p, "-")[0].cast("int"), F.greatest(F.split(p, "-")[0].cast("int"), F.when(p.endswith("-"), F.col(total)).otherwise(
        F.element_at(F.split(p, "-"), -1).try_cast("int")))), lambda n: n <= F.col(total))
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: p.rlike(r"^\d+(-\d*)?$"))
    numbers = F.array_distinct(F.flatten(F.transform(parts, piece)))
    return df.select(*df.columns, F.posexplode(numbers).alias("place", "number"))


def assemble_pages(sources: DataFrame) -> DataFrame:
    """Pages of a combined document: ``sources(target, ord, doc, spec, total)`` -> ``(target, ord, place, doc, page)``.
    Ordering by (ord, place) gives the page sequence; splitting is one source row per document."""
    return expand_ranges(sources).select("target", "ord", "place", "doc", F.col("number").alias("page"))


def split_pages(texts: DataFrame, separator: str = "<<<", text: str = "text") -> DataFrame:
    """One row per page of a text with page separators, numbered from 1."""
    import re
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(F.split(text, re.escape(separator), -1)).alias("_p", "page_text")).withColumn("page_no", F.col("_p") + 1).drop("_p")


def highlight_rects(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Full-width rectangle of each text line at a target size: ``(page, base_y, height, page_height)`` in.
    y runs from base minus height to base, scaled and cut to whole pixels."""
    scale = lambda c: F.floor(c * F.lit(height) / F.col("page_height")).cast("long")
    return (lines.withColumn("x1", F.lit(0)).withColumn("y1", scale(F.col("base_y") - F.col("height"))).withColumn("x2", F.lit(width))
            .withColumn("y2", scale(F.col("base_y"))))
