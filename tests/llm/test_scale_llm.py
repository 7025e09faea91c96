"""Fits that must read everything they are given."""

import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from docloom.llm import jaccard, quality_rules
from docloom.llm.queries import R
from docloom.plans.base import Tables


def test_rules_are_learned_from_every_labelled_document(spark, monkeypatch):
    """A default bound of labelled documents would leave most of these out."""
    monkeypatch.setattr(quality_rules, "LABELLED", 10)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("fine words stand here "), 20)).otherwise(F.repeat(F.lit("BUY$$ NOW## "), 40)).alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    sample = quality_rules.labelled_sample(docs, labels, "doc_id", "text", "quality")
    assert sample.groupBy("y").count().orderBy("y").collect() == [(0, 200), (1, 200)]
    assert quality_rules.fit(docs, labels) == quality_rules.fit(docs, labels, bound=200) != quality_rules.fit(docs, labels, bound=10)


def test_runs_of_frequent_words_make_no_regions(spark, monkeypatch):
    """Runs of frequent words that meet by chance, too seldom for the sample to know them, would put every set in regions with strangers."""
    r = random.Random(3)
    words = lambda i: [f"own{i}x{k}" for k in range(60)] + [r.choice("abcdefgh") for _ in range(200)]
    rows = [(i, " ".join(words(i))) for i in range(200)]
    rows.append((200, rows[7][1] + " more"))
    seen, real = [], jaccard.regions
    monkeypatch.setattr(jaccard, "SAMPLE", 40)
    monkeypatch.setattr(jaccard, "regions", lambda *a: seen.append(real(*a)) or seen[-1])
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {**{i: i for i in range(200)}, 200: 7}
    assert {r["x"] for r in seen[0].select("x").collect()} == {7, 200}


def test_regions_inside_others_go(spark):
    """Only the regions (p, w) whose members all meet around a smaller pivot of the same window."""
    regions = {(1, 4): [1, 2, 3, 4], (2, 4): [2, 3, 4], (3, 4): [3, 4], (2, 5): [2, 3], (4, 4): [4, 9], (6, 4): [6, 7], (0, 5): [0, 2]}
    rows = [(x, p, w) for (p, w), xs in regions.items() for x in xs]
    left = jaccard.without_parts(spark.createDataFrame(rows, "x bigint, p bigint, w int"))
    assert left.columns == ["x", "p", "w"]
    assert sorted({(r["p"], r["w"]) for r in left.collect()}) == [(0, 5), (1, 4), (2, 5), (4, 4), (6, 4)] and left.count() == 12


def test_texts_of_regions_joined_at_every_size(spark, monkeypatch):
    """Texts come to regions by a broadcast of few members, by a join of rows for every text, and by one without their ids."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None), (None, "d"), (9, "e")], "doc_id bigint, text string")
    alive = spark.createDataFrame([(1, 0, "", 1), (1, 0, "", 2), (2, 0, "/1", 2), (2, 0, "/1", 3)], "p bigint, w int, path string, x bigint")
    for bound in (jaccard.BROADCAST_ROWS, 30, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", bound)
        got = [tuple(r) for r in jaccard._full_texts(docs, "doc_id", "text", alive).collect()]
        assert sorted(got, key=str) == [(1, 0, "", 1, "a"), (1, 0, "", 2, "b"), (1, 0, "", 2, "c"), (2, 0, "/1", 2, "b"), (2, 0, "/1", 2, "c"), (2, 0, "/1", 3, None)]


def test_rules_of_the_query_read_every_character(spark, tmp_path):
    """Counts, ratios and scores of op11 against plain Python; the documents differ in the first characters of their words alone."""
    r = random.Random(5)
    word = lambda good: r.choice(["pre", "pré"] if good else ["zq#", "z😀"]) + "".join(r.choice("abcd") for _ in range(r.randint(0, 4))) + "end"
    rows = [(i, " ".join(word(i % 2 == 0) for _ in range(80)) + "  a\nbc ") for i in range(120)]
    rows += [(120, "pré😀" * 50 + " " + "x" * 200), (121, None), (122, ""), (123, "x" * 200_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    n = quality_rules.BUCKETS

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = [w[k:k + 3] for w in words for k in range(max(len(w) - 2, 1))]
        hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in found]
        return [(h - (1 << 64) if h >> 63 else h) % n for h in hashes]

    raw = Counter(b for _, t in rows for b in grams(t))
    sample = quality_rules.labelled_sample(docs, labels, "doc_id", "text", "quality").collect()
    trusted = Counter(b for s in sample if s["y"] == 1 and s["part"] == 0 for b in grams(s["text"]))
    shift = math.log((sum(raw.values()) + n) / (sum(trusted.values()) + n))
    ratios = [round(1e6 * (math.log((trusted[b] + 1) / (raw[b] + 1)) + shift)) for b in range(n)]
    assert quality_rules.fit(docs, labels, every=True).ratios == ratios
    got = {r["doc_id"]: (r["score"], r["kept"]) for r in R.queries["op11_quality_rules"](Tables(spark, str(tmp_path))).collect()}
    assert {i: s for i, (s, _) in got.items()} == {i: sum(ratios[b] for b in grams(t)) / (1e6 * max(1, len(grams(t)))) for i, t in rows}
    assert all(got[i][1] == (i % 2 == 0) for i in range(120))


def test_rules_of_every_character_part_labelled_documents(spark):
    """On sf0.1, since all runs of three need more trusted documents than sf0.01 has: the half that set neither counts nor cut."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, marks.where("doc_id % 2 = 0"), every=True)
    judged = quality_rules.judge(docs, rules).join(marks.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    rate = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.05
