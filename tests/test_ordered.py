"""Ordered helpers on keys of very different sizes, against plain windows and a plain loop."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import ordered as o


def rows(spark, n=6000, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = None if i % 50 == 0 else "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        data.append((key, rng.randrange(2000), i, rng.randrange(9)))
    return spark.createDataFrame(data, "k string, t long, id long, v long")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_numbered(spark):
    df = rows(spark)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"))
    same(o.numbered(df, ["k"], ["t", "id"]), want)
    same(o.numbered(df, ["k"], ["t", "id"], chunk=F.floor(F.col("t") / 7)), want)
    overall = df.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("t", "id")).cast("long"))
    same(o.numbered(df, [], ["t", "id"]), overall)


def test_running_total_and_previous(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same(o.running_total(df, ["k"], ["t", "id"], F.col("v"), "s"), want)
    same(o.running_total(df, ["k"], ["t", "id"], F.col("v"), "s", F.col("t")), want)
    same(o.previous(df, ["k"], ["t", "id"], "v", "p", F.col("t")), df.withColumn("p", F.lag("v").over(w)))


def test_anchored(spark):
    df = rows(spark).where("k IS NOT NULL")
    got = {(r.k, r.t): r.start for r in o.anchored(df, ["k"], "t", 100).collect()}
    starts, want = {}, {}
    for k, t in sorted({(r.k, r.t) for r in df.collect()}):
        if k not in starts or t - starts[k] > 100:
            starts[k] = t
        want[(k, t)] = starts[k]
    assert got == want


def brute_anchored(rows, reach):
    starts, want = {}, {}
    for k, t in sorted({(k, t) for k, t, _ in rows if t is not None}, key=lambda x: (repr(x[0]), x[1])):
        if k not in starts or t - starts[k] > reach:
            starts[k] = t
        want[k, t] = starts[k]
    return sorted(((k, t, i, want.get((k, t))) for k, t, i in rows), key=repr)


@pytest.mark.parametrize("reach, span, chunk", [(100, 40_000, 4), (7, 300, 1), (1, 60, 2), (0, 50, 4), (50, 100_000, 3), (5000, 3000, 4)])
def test_anchored_over_chunks(spark, reach, span, chunk):
    """One key with most rows, sparse and dense stretches, negative positions, null keys and positions, repeated rows."""
    rng = random.Random(reach + span)
    data = [(None if i % 40 == 0 else "hot" if i % 3 else f"k{i % 11}", None if i % 97 == 0 else rng.randrange(-span, span) // rng.choice([1, 1, 5]), i) for i in range(3000)]
    data += data[:20]
    df = spark.createDataFrame(data, "k string, t long, id long").repartition(5)
    got = sorted(map(tuple, o.anchored(df, ["k"], "t", reach, chunk_reaches=chunk).select("k", "t", "id", "start").collect()), key=repr)
    assert got == brute_anchored(data, reach)
    assert o.anchored(df.where("id < 0"), ["k"], "t", reach).count() == 0


def test_anchored_spreads_a_hot_key(spark):
    """All rows in one key: the positions of a chunk lie in one row, and no row holds more than a chunk's."""
    df = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("t"))
    out = o.anchored(df, ["k"], "t", 100)
    assert out.select("start").distinct().count() == 150_000 // 102 + 1
    width = o.CHUNK_REACHES * 100
    table = next(f for f in out.inputFiles() if "/table-" in f).rsplit("/", 1)[0]
    sizes = [len(r["_ticks"]) for r in spark.read.parquet(table).collect()]
    assert len(sizes) == -(-150_000 // width) and max(sizes) <= width // 3 + 1


def test_first_n_limits_before_the_shuffle(spark):
    df = rows(spark)
    out = o.first_n(df, ["k"], ["t", "id"], 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.count() == sum(min(5, r["count"]) for r in df.groupBy("k").count().collect())
    same(o.first_n(df, ["k"], ["t", "id"], 1500), o.numbered(df, ["k"], ["t", "id"]).where("rn <= 1500"))


def test_written_tables_go_with_their_owner(spark):
    from pathlib import Path

    from docloom.session import checkpoint_dir, materialize, written_tables
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    with written_tables(spark):
        assert materialize(spark.range(3)).count() == 3
        assert len({p.name for p in folder.iterdir()} - before) == 1
    assert {p.name for p in folder.iterdir()} == before
