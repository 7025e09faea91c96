"""Streams fed out of order in several batches must end where the batch operator ends."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import invoices as iv
from docloom.operators.usage import anchored_sessions
from docloom.streaming import streams as st

START = 1704067200


def usage(spark, n=400, step=701):
    return spark.range(n).select(
        (F.col("id") % 3).alias("session"), F.col("id").alias("event_id"), F.timestamp_seconds(START + F.col("id") * step).alias("ts"),
        (F.col("id") * 37 % 101).alias("input"), F.lit(1).cast("long").alias("output"), F.lit(0).cast("long").alias("cache_creation"),
        F.lit(0).cast("long").alias("cache_read"), F.lit(0).cast("long").alias("window_size"))


def feed(spark, df, folder, place, n):
    """One file per slice of ``place`` (0 to 1), so that each micro-batch sees one slice."""
    for i in range(n):
        df.where((place >= i / n) & (place < (i + 1) / n)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def close(df, folder, **values):
    """A row without event_id, far ahead: it only moves the clock."""
    at = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != "ts"]
    row = df.limit(1).select(*at, F.timestamp_seconds(F.lit(START + 86400 * 4000)).alias("ts")).select(*df.columns)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, stream):
    query = st.append_to(stream, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    return query


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_out_of_order(spark, tmp_path, seed):
    """Rows up to 50 minutes late, spread over the files by a jitter; ties in time; one key with most rows."""
    folder, r = str(tmp_path), random.Random(seed)
    df = usage(spark, 300, 600).withColumn("session", F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).cast("long"))
    df = df.unionByName(df.where("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + 1000).withColumn("input", F.col("input") + r.randint(0, 50)))
    late = (F.col("event_id") % 1000 * 600 + F.pmod(F.hash("event_id", F.lit(seed)), F.lit(3000))) / (300 * 600 + 3000)
    source = feed(spark, df, folder, late, 6)
    query = run(spark, folder, st.stream_sessions(source))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 5 and st.dropped_rows(query) == 0
    close(df, folder)
    run(spark, folder, st.stream_sessions(source))
    cols = ["event_id", "session_start", "prev_total", "prompt_count"]
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select(*cols).collect()))
    assert got == sorted(map(tuple, anchored_sessions(df).select(*cols).collect()))


def test_late_rows_are_counted_and_idle_keys_forgotten(spark, tmp_path):
    folder, df = str(tmp_path), usage(spark, 40, 600).withColumn("session", F.lit(7).cast("long"))
    old = df.where("event_id = 1").withColumn("event_id", F.lit(900).cast("long")).withColumn("ts", F.timestamp_seconds(F.lit(START)))
    back = df.where("event_id = 2").withColumn("event_id", F.lit(901).cast("long")).withColumn("ts", F.timestamp_seconds(F.lit(START + 86400 * 90)))
    source = feed(spark, df, folder, F.lit(0.0), 1)
    run(spark, folder, st.stream_sessions(source))
    old.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert st.dropped_rows(run(spark, folder, st.stream_sessions(source))) == 1
    for late in (back, None):
        late.coalesce(1).write.mode("append").parquet(f"{folder}/in") if late is not None else close(df, folder)
        run(spark, folder, st.stream_sessions(source))
    rows = {r["event_id"]: r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert len(rows) == 41 and 900 not in rows and rows[901]["prev_total"] == 0 and rows[901]["prompt_count"] == 1


def test_job_life_cycle(spark, tmp_path):
    """Latest status and single retrieval come out of the stream, with repeated deliveries and disorder."""
    folder = str(tmp_path)
    plan = [(0, "accepted", 0), (1, "processing", 60), (1, "processing", 61), (2, "processed", 120), (2, "processed", 125), (2, "processed", 125), (3, "retrieved", 500),
            (4, "retrieved", 900), (4, "retrieved", 901)]
    rows = [(f"h{j}", j * 100 + k, START + j * 3600 + at, "error" if j % 5 == 0 and at == 120 else status) for j in range(40) for k, (_, status, at) in enumerate(plan) if j % 3 or at < 500]
    df = spark.createDataFrame(rows, "job_hash string, event_id long, s long, status string").select("job_hash", "event_id", F.timestamp_seconds("s").alias("ts"), "status")
    late = (F.unix_seconds("ts") - START + F.pmod(F.hash("event_id"), F.lit(3000))) / (40 * 3600 + 4000)
    source = feed(spark, df, folder, late, 4)
    run(spark, folder, st.stream_job_status(source))
    close(df, folder, status="accepted")
    run(spark, folder, st.stream_job_status(source))
    log = spark.read.parquet(f"{folder}/out")
    order = ("ts", "event_id")
    latest = lambda x: sorted(map(tuple, iv.latest_status(x, order).select("job_hash", "status").collect()))
    assert latest(log) == latest(df)
    asked = df.where("status = 'retrieved'")
    assert sorted(map(tuple, log.where("answer IS NOT NULL").select("event_id", "answer").collect())) == sorted(map(tuple, iv.once_only(asked, order).select("event_id", "answer").collect()))
    want, last = [], {}
    for job, event, _, status in sorted(rows, key=lambda x: (x[2], x[1])):
        if last.get(job) != status or status == "retrieved":
            want.append(event)
        last[job] = status
    assert sorted(r["event_id"] for r in log.collect()) == sorted(want)


def test_usage_by_day_and_month(spark, tmp_path):
    df = spark.range(500).select(F.timestamp_seconds(START + F.col("id") * 20_000).alias("ts"), (1 + F.col("id") % 9).alias("pages"),
                                 F.when(F.col("id") % 3 == 0, "form").otherwise("native_text").alias("service_type"))
    place = (F.unix_seconds("ts") - START + F.pmod(F.hash("ts"), F.lit(3000))) / (500 * 20_000 + 4000)
    source = feed(spark, df, str(tmp_path), place, 5)
    for name, fn, unit in (("day", st.stream_usage, "day"), ("month", st.stream_usage_months, "month")):
        st.append_to(fn(source), f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}").awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}").select(name, "service_type", "pages").collect()))
        unit_start = F.to_date(F.date_trunc(unit, "ts"))
        last = df.agg(F.max(unit_start)).first()[0]
        want = df.groupBy(unit_start.alias(name), "service_type").agg(F.sum("pages").alias("pages")).where(F.col(name) < F.lit(last))
        assert got == sorted(map(tuple, want.collect())) and len(got) > 4


def test_first_invoice_is_fixed(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.range(200).select((F.col("id") % 30).cast("string").alias("numero_factura"), F.lit("B").alias("cif"), F.col("id").alias("event_id"),
                                 F.timestamp_seconds(START + F.floor(F.col("id") / 2) * 60).alias("ts"))
    source = feed(spark, df, folder, F.pmod(F.hash("event_id"), F.lit(100)) / 100, 3)
    run(spark, folder, st.stream_unique_invoices(source))
    close(df, folder)
    run(spark, folder, st.stream_unique_invoices(source))
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").select("numero_factura", "event_id").collect()))
    assert got == sorted(map(tuple, iv.unique_invoices(df, ("ts", "event_id")).select("numero_factura", "event_id").collect()))


def pages(spark, n=400):
    return spark.range(n).select(F.concat(F.lit("u"), (F.col("id") % 90).cast("string")).alias("url"), F.col("id").alias("page_id"))


def test_ingest_in_batches(spark, tmp_path):
    df = pages(spark)
    stream = feed(spark, df, str(tmp_path), F.col("page_id") / 400, 3)
    for name in "ab":
        st.stream_ingest_pages(stream, f"{tmp_path}/index", f"{tmp_path}/cp-{name}").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/index").collect()
    assert len(rows) == 90 and all(r.page_id < 134 for r in rows)


def test_repeated_batch_and_absent_index(spark, tmp_path):
    """A batch that fails after its rows were written is repeated and adds nothing; a file in place of the index raises."""
    df, index = pages(spark, 50), f"{tmp_path}/index"
    stream = feed(spark, df, str(tmp_path), F.lit(0.0), 1)
    st.stream_ingest_pages(stream, index, f"{tmp_path}/cp").awaitTermination()
    for commit in (tmp_path / "cp" / "commits").iterdir():
        commit.unlink()  # as if the driver had died before the commit
    st.stream_ingest_pages(stream, index, f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(index).count() == 50
    assert st.read_page_index(spark, f"{tmp_path}/none", df.schema).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        st.read_page_index(spark, f"{tmp_path}/broken", df.schema).count()
