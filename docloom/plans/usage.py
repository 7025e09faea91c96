"""Registered usage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import usage as us
from docloom.plans.base import Registry, Tables

R = Registry()

USAGE = """SELECT user_id AS session, event_id, ts, event_id % 1000 * 10 AS input, event_id % 300 AS output, event_id % 77 * 100 AS cache_creation, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 500 END AS cache_read,
   CASE WHEN event_id % 10 = 0 THEN 0 ELSE 20000 END AS window_size FROM {events}"""
_TOT = "u AS (SELECT *, input + output + cache_creation + cache_read AS total FROM usage)"


@R.query("usage_bands", "WITH " + _TOT + """, p AS (SELECT event_id, total, CASE WHEN window_size > 0 THEN total * 100 // window_size ELSE 0 END AS percent FROM u)
SELECT *, CASE WHEN percent < 50 THEN 'green' WHEN percent < 80 THEN 'yellow' ELSE 'red' END AS band FROM p""", usage=USAGE)
def usage_bands(t: Tables) -> DataFrame:
    return us.usage_bands(t.sql(USAGE)).select("event_id", "total", "percent", "band")


@R.query("prompt_bands", "SELECT event_id, event_id % 160 * 1000 // 125 AS tenths, CASE WHEN event_id % 160 < 75 THEN 'green' WHEN event_id % 160 < 125 THEN 'yellow' ELSE 'red' END AS limit_band FROM events")
def prompt_bands(t: Tables) -> DataFrame:
    out = us.prompt_bands(t.events.select("event_id", (F.col("event_id") % 160).alias("prompt_count")))
    return out.select("event_id", (F.col("limit_percent") * 10).cast("long").alias("tenths"), "limit_band")


COUNTERS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 1000 AS input, l_partkey % 700 AS output, l_suppkey * 3 % 501 AS cache_creation, l_partkey * 7 % 903 AS cache_read FROM {lineitem}"""


@R.query("token_cost", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, input * 300 // 100 + output * 15 + cache_creation * 375 // 100 + cache_read * 30 // 100 AS micro FROM counters""", counters=COUNTERS)
def token_cost(t: Tables) -> DataFrame:
    return us.token_cost(t.sql(COUNTERS)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("cost") * 1000000).cast("long").alias("micro"))


_SESSIONS = """WITH RECURSIVE """ + _TOT + """,
s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n, lag(input + output + cache_creation + cache_read) OVER (PARTITION BY session ORDER BY ts, event_id) AS prev FROM u),
w AS (SELECT session, event_id, sec, n, total, CAST(0 AS BIGINT) AS prev_total, sec AS session_start, CAST(1 AS BIGINT) AS prompt_count FROM s WHERE n = 1
  UNION ALL SELECT s.session, s.event_id, s.sec, s.n, s.total, s.prev, CASE WHEN s.sec - w.session_start > 18000 THEN s.sec ELSE w.session_start END,
    CASE WHEN s.sec - w.session_start > 18000 THEN 1 WHEN s.total > s.prev THEN w.prompt_count + 1 ELSE w.prompt_count END FROM w JOIN s ON s.session = w.session AND s.n = w.n + 1)"""


@R.query("anchored_sessions", _SESSIONS + " SELECT event_id, session_start, prev_total, prompt_count FROM w", usage=USAGE)
def anchored_sessions(t: Tables) -> DataFrame:
    return us.anchored_sessions(t.sql(USAGE)).select("event_id", "session_start", "prev_total", "prompt_count")


@R.query("session_summary", _SESSIONS + " SELECT session, session_start, count(*) AS n_events, max(prompt_count) AS prompts, 18000 - (max(sec) - session_start) AS reset_in FROM w GROUP BY 1, 2", usage=USAGE)
def session_summary(t: Tables) -> DataFrame:
    return us.session_summary(us.anchored_sessions(t.sql(USAGE)))


@R.query("burn_rate", _SESSIONS + """ SELECT event_id, CASE WHEN sec - session_start > 60 THEN CAST(trunc(CAST(total - prev_total AS DOUBLE) * 600 / (sec - session_start)) AS BIGINT) END AS tenths FROM w""", usage=USAGE)
def burn_rate(t: Tables) -> DataFrame:
    return us.burn_rate(us.anchored_sessions(t.sql(USAGE))).select("event_id", (F.col("tokens_per_min") * 10).cast("long").alias("tenths"))


MIXED = """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR(20)) END AS a, CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(event_id % 10 AS VARCHAR(20)) END AS b FROM {events}"""


@R.query("safe_batch", "SELECT event_id, CASE WHEN event_id % 12 = 0 THEN 'x,y' WHEN event_id % 4 = 0 THEN 'x' WHEN event_id % 6 = 0 THEN 'y' ELSE '' END AS error FROM events")
def safe_batch(t: Tables) -> DataFrame:
    good, bad = us.safe_batch(t.sql(MIXED), {"x": "try_cast(a AS BIGINT)", "y": "try_cast(b AS INT)"})
    return good.select("event_id", F.lit("").alias("error")).unionByName(bad.select("event_id", "error"))


@R.query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))
