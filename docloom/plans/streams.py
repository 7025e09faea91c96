"""Registered streaming queries: each runs to the end of what the table holds and returns what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import invoices as iv
from docloom.plans.base import Registry, Tables
from docloom.plans.invoices import JOBS
from docloom.plans.usage import _SESSIONS, USAGE
from docloom.session import STATE_STORE, checkpoint_dir, materialize
from docloom.streaming import streams as st

R = Registry()


def _stream(t: Tables, table: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")  # a pattern, since a stream's path may not be a single file


def _folder(t: Tables) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(t: Tables, df: DataFrame) -> DataFrame:
    out = _folder(t)
    st.append_to(df, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{out}/data")


FILES = 4  # files and batches of a disordered stream


def _in_disorder(t: Tables, rows: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream operator gives for rows that arrive up to 50 minutes late, in several files, and then the end.

    The files are written here: each holds a stretch of arrival times, which a hash of the row's id moves behind its time.
    A last file, with a row far ahead and no id, moves the clock, so that the stream gives out everything.
    """
    out = _folder(t)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3000))
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    place = F.least(F.floor((arrival - low) * FILES / ((high - low) + 1)), F.lit(FILES - 1)) if low is not None else F.lit(0)
    placed = materialize(rows.withColumn("_file", place.cast("int")))
    for k in range(FILES):  # one after the other, since a file source goes by the time of writing
        placed.where(F.col("_file") == k).drop("_file").write.mode("append").parquet(f"{out}/in")
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, t.spark.sparkContext.defaultParallelism)).parquet(f"{out}/in")
    result = operator(source)
    end = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts") for f in rows.schema.fields]
    for last in (False, True):
        if last:
            rows.agg(*end).write.mode("append").parquet(f"{out}/in")
        st.append_to(result, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema(result.schema).parquet(f"{out}/data")


def _view(t: Tables, df: DataFrame, sql: str) -> DataFrame:
    return t.sql(sql, events=df.withColumn("ts", F.col("ts").cast("timestamp")))


@R.query("stream_ingest_pages", "SELECT url, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY 1")
def stream_ingest_pages(t: Tables) -> DataFrame:
    out = _folder(t)
    pages = _stream(t, "pages").withColumn("url", F.regexp_replace("url", "[?#].*$", ""))
    for run in ("a", "b"):  # the second run starts afresh on the same input and must add nothing
        st.stream_ingest_pages(pages, f"{out}/index", f"{out}/checkpoint-{run}").awaitTermination()
    return t.spark.read.parquet(f"{out}/index").select("url", "page_id")


@R.query("stream_sessions", _SESSIONS + " SELECT event_id, session_start, prev_total, prompt_count FROM w", usage=USAGE)
def stream_sessions(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return _in_disorder(t, t.sql(USAGE), st.stream_sessions).drop("session")


RETRIED = """SELECT event_id, ts, 'h' || CAST(event_id AS VARCHAR(20)) AS job_hash, CASE k WHEN 0 THEN 'processed' WHEN 1 THEN 'processed' ELSE 'retrieved' END AS status, k
   FROM {events} EACH k BELOW 3"""


@R.query("stream_job_status", "SELECT 'h' || event_id AS job_hash, 'processed' AS status FROM events UNION ALL SELECT 'h' || event_id, 'retrieved' FROM events")
def stream_job_status(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    log = _in_disorder(t, t.sql(RETRIED).select("job_hash", "event_id", "ts", "status"), st.stream_job_status)
    return log.select("job_hash", "status")


@R.query("stream_job_answers", """
WITH a AS (SELECT event_id, job_hash, row_number() OVER (PARTITION BY job_hash ORDER BY ts, event_id) AS n FROM jobs WHERE status = 'retrieved')
SELECT event_id, job_hash, CASE WHEN n = 1 THEN 'served' ELSE 'already delivered' END AS answer FROM a""", jobs=JOBS)
def stream_job_answers(t: Tables) -> DataFrame:
    """One-time retrieval out of the stream's own state: jobs of many events, of any status, in disorder."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    log = _in_disorder(t, t.sql(JOBS).select("job_hash", "event_id", "ts", "status"), st.stream_job_status)
    return log.where("answer IS NOT NULL").select("event_id", "job_hash", "answer")


@R.query("stream_latest_status", "SELECT 'h' || event_id AS job_hash, 'retrieved' AS status FROM events")
def stream_latest_status(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    log = _in_disorder(t, t.sql(RETRIED).select("job_hash", "event_id", "ts", "status"), st.stream_job_status)
    return iv.latest_status(log, ("ts", "status")).select("job_hash", "status")


SERVICE = "SELECT ts, 1 + event_id % 9 AS pages, CASE event_id % 4 WHEN 0 THEN 'native_text' WHEN 1 THEN 'low_cost' WHEN 2 THEN 'high_quality' ELSE 'form' END AS service_type FROM {events}"

YEARS = """SELECT ts + (event_id % 12) * INTERVAL 30 DAYS AS ts, 1 + event_id % 9 AS pages, CASE event_id % 4 WHEN 0 THEN 'native_text' WHEN 1 THEN 'low_cost' WHEN 2 THEN 'high_quality' ELSE 'form' END AS service_type FROM {events}"""


@R.query("stream_usage", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, service_type, CAST(sum(pages) AS BIGINT) AS pages FROM svc
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM svc) GROUP BY 1, 2""", svc=SERVICE)
def stream_usage(t: Tables) -> DataFrame:
    return _run(t, st.stream_usage(_view(t, _stream(t, "events"), SERVICE))).withColumn("day", F.col("day").cast("string"))


@R.query("stream_usage_months", """
SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, service_type, CAST(sum(pages) AS BIGINT) AS pages FROM svc
WHERE date_trunc('month', ts) + INTERVAL 1 MONTH <= (SELECT max(ts) - INTERVAL 1 HOUR FROM svc) GROUP BY 1, 2""", svc=YEARS)
def stream_usage_months(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return _run(t, st.stream_usage_months(_view(t, _stream(t, "events"), YEARS))).withColumn("month", F.col("month").cast("string"))


DELIVERED = """SELECT ts, event_id, 'F' || CAST(event_id % 1000 AS VARCHAR(20)) AS numero_factura, 'B' || CAST(event_id % 7 AS VARCHAR(20)) AS cif FROM {events}"""


@R.query("stream_unique_invoices", "SELECT numero_factura, cif, arg_min(event_id, (ts, event_id)) AS event_id FROM d GROUP BY 1, 2", d=DELIVERED)
def stream_unique_invoices(t: Tables) -> DataFrame:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = _in_disorder(t, t.sql(DELIVERED), lambda rows: st.stream_unique_invoices(rows, "1 hour", keep_days=400))
    return out.select("numero_factura", "cif", "event_id")
