"""Quality rules with DataFrame functions only: counts of bad signs, and a hashed n-gram likelihood ratio for the verdict.

The ratio compares two multinomials over hash buckets of character n-grams: the trusted target, learned from labelled
good documents, and the raw corpus, counted over every document.  The n-grams are all runs of three characters inside
words with ``every`` (what the query asks for), or the last three characters of every word alone; a shorter word is one.
A document's score is its mean log ratio per n-gram, so length does not matter, and a cut that the labels fix decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize, wide

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ENDING = 3  # characters of an n-gram, or the whole of a shorter word
LONG = 64  # characters of a word from which it is cut in one pass, since the place of a character is looked for from the start
BUCKETS = 10_000
SCALE = 1_000_000  # ratios are whole millionths of a nat, so that sums do not depend on their order
LABELLED = 20_000  # a bound for callers that want one: labelled documents of each class, by the smallest hashes of their ids
BINS = 100  # steps per nat in which the cut is looked for
MIN_WORDS = 50
REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rules:
    """Log ratio of every bucket (millionths of a nat), the least mean ratio that is kept, and whether every n-gram of a word counts."""

    ratios: list[int]
    cut: float
    every: bool = False


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS, -1), lambda x: x != "")


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.right(word, F.lit(ENDING))), F.lit(buckets)).cast("int")


def n_grams(word: Column) -> Column:
    """Number of n-grams of a word."""
    return F.greatest(F.length(word) - (ENDING - 1), F.lit(1))


def pieces(found: Column) -> Column:
    """An array of words in which the n-grams of long ones, cut in one pass, stand as words."""
    run = lambda w: F.transform(F.array(F.split(w, "", -1)), lambda c: F.transform(
        F.slice(c, F.lit(1), n_grams(w)), lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, ENDING)])))
    long = lambda w: F.length(w) > LONG
    cut = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(long(w), F.get(run(w), F.lit(0))).otherwise(F.array(w))))
    return F.get(F.transform(F.array(found), lambda ws: F.when(F.exists(ws, long), cut(ws)).otherwise(ws)), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, bound: int | None = None) -> DataFrame:
    """``y``, ``part`` and ``text`` of every labelled document, or of at most ``bound`` of each class; ``part`` halves them by hash."""
    order = F.xxhash64(id)
    marked = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(id).agg(F.max(label).alias("_y"))
    if bound is not None:
        picked = [marked.where(F.col("_y") == y).orderBy(order, id).limit(bound) for y in (0, 1)]
        marked = picked[0].unionByName(picked[1])
    ids = marked.select(F.col(id).alias("_i"), "_y", F.pmod(order, F.lit(2)).alias("_part"))
    rows = docs.select(F.col(id).alias("_i"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.join(wide(ids), "_i").select(F.col("_y").alias("y"), F.col("_part").alias("part"), F.col("_text").alias("text"))


def _counts(texts: DataFrame, buckets: int, every: bool = False) -> dict[int, int]:
    found = F.split("text", BLANKS, -1)
    found = texts.select(F.explode(pieces(found) if every else found).alias("w")).where("w <> ''")
    if every:  # generators are compiled, functions of arrays are not
        found = found.select("w", F.explode(F.sequence(F.lit(1), n_grams(F.col("w")))).alias("i")).select(F.substr("w", "i", F.lit(ENDING)).alias("w"))
    return {r["b"]: r["n"] for r in found.groupBy(bucket(F.col("w"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _best_cut(rows: Sequence[tuple[int, int, int]]) -> float:
    """The cut with the greatest share of good kept plus share of bad removed; of a stretch of equals, the middle.

    ``rows`` holds (y, bin, number).  With one class only, everything is kept.
    """
    all_ = {y: sum(n for k, _, n in rows if k == y) for y in (0, 1)}
    if not all_[0] or not all_[1]:
        return -math.inf
    bins = sorted({b for _, b, _ in rows})
    cuts = range(bins[0], bins[-1] + 2)
    gain, value = {}, 0.0
    weight: dict[int, float] = {}
    for y, b, n in rows:  # raising the cut above a bin loses its good and removes its bad
        weight[b] = weight.get(b, 0.0) + (n / all_[0] if y == 0 else -n / all_[1])
    for c in cuts:
        gain[c] = round(value, 9)
        value += weight.get(c, 0.0)
    top = max(gain.values())
    first = next(c for c in cuts if gain[c] == top)
    last = first
    while gain.get(last + 1) == top:
        last += 1
    return (first + last) / 2 / BINS


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
        buckets: int = BUCKETS, bound: int | None = None, every: bool = False) -> Rules:
    """Rules learned from ``labels`` (1 trusted, 0 not) and counted on all ``docs``.

    The raw multinomial counts every n-gram of every document by an aggregation, of which one row per bucket reaches
    the driver.  The trusted one counts the first half (by hash) of all good documents, both with one added to each
    bucket.  The cut is the best on the other half of all labelled documents, as far as it passes the base; ``bound`` limits
    both for callers that want it.  Labels that are null or neither 0 nor 1 teach nothing, of
    several for one id the larger counts.  Without trusted documents every ratio is 0 and nothing is cut.  ``every`` counts
    all runs of three characters of a word, not its last ones alone.
    """
    raw = _counts(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), buckets, every)
    sample = labelled_sample(docs, labels, id, text, label, bound)
    sample = materialize(sample.where("y = 1 OR part = 1"), "zstd")  # the rest is not read below
    trusted = _counts(sample.where("y = 1 AND part = 0"), buckets, every)
    if not trusted:
        return Rules([0] * buckets, -math.inf, every)
    log_all = math.log((sum(raw.values()) + buckets) / (sum(trusted.values()) + buckets))
    ratios = [round(SCALE * (math.log((trusted.get(b, 0) + 1) / (raw.get(b, 0) + 1)) + log_all)) for b in range(buckets)]
    judged = judge(sample.where("part = 1"), Rules(ratios, -math.inf, every), keep=["y"]).where("NOT base_failed")
    bins = judged.groupBy("y", F.floor(F.col("score") * BINS).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    return Rules(ratios, _best_cut([(r["y"], r["b"], r["n"]) for r in bins]), every)


def score(found: Column, ratios: list[int], every: bool = False) -> Column:
    """Mean log ratio per n-gram of an array of words, in nats (0 without words)."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # one constant of the plan
    if not every:
        total = F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + F.get(table, bucket(x, len(ratios))))
        return total / (F.lit(float(SCALE)) * F.greatest(F.size(found), F.lit(1)))
    number = lambda ws: F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + n_grams(w))
    total = lambda ws: F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: F.aggregate(
        F.sequence(F.lit(1), n_grams(w)), s, lambda t, i: t + F.get(table, bucket(F.substr(w, i, F.lit(ENDING)), len(ratios)))))
    mean = lambda ws: total(ws) / (F.lit(float(SCALE)) * F.greatest(number(ws), F.lit(1)))
    return F.get(F.transform(F.array(pieces(found)), mean), F.lit(0))


def _symbols(text: Column) -> Column:
    any_ = reduce(lambda a, c: a | text.contains(c), SYMBOLS, F.lit(False))
    return F.when(any_, F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))).otherwise(F.lit(0))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.aggregate(F.array(lines), F.lit(0), lambda s, x: s + F.size(x) - F.size(F.array_distinct(x)))


def judge(docs: DataFrame, rules: Rules, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns in ``keep``, then ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``score``, ``kept``.

    Words are runs of other characters than blanks and the characters 9 to 13; windows of three words are compared by
    64-bit hashes within their text.  Windows are sorted with their places, so a text of n words takes n log n steps
    and its repeated windows are found as neighbours.  Null text counts as empty: no words, base failed, not kept.  Rows
    are judged one by one, so repeated rows and ids come out as often as they go in; an empty table gives no rows; other
    columns are not read.  A name in ``keep`` must not be one of the new columns.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_keep"), t.alias("_text"))
    one_pass = lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"), score(w, rules.ratios, rules.every).alias("score"))
    rows = rows.select(
        "_keep", _symbols(F.col("_text")).cast("long").alias("n_symbols"), _dup_lines(F.col("_text")).cast("long").alias("n_dup_lines"),
        F.get(F.transform(F.array(words(F.col("_text"))), one_pass), F.lit(0)).alias("_w"))
    last = F.greatest(F.col("_w.n") - 2, F.lit(0))
    three = F.arrays_zip(*[F.slice("_w.h", k, last).alias(f"h{k}") for k in (1, 2, 3)])
    rows = rows.select(
        "_keep", "n_symbols", "n_dup_lines", F.col("_w.n").cast("long").alias("n_words"), F.col("_w.chars").cast("long").alias("word_chars"), F.col("_w.score").alias("score"),
        F.transform(three, lambda x: F.xxhash64(x)).alias("_windows"))
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(repeats, placed)).drop("_windows")
    s = F.col("_sorted")
    twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
    cover = F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct(
        (i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    kept = (~F.col("base_failed") & (F.col("score") >= rules.cut)).alias("kept")
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]
    # filters on the result would be pushed below the steps above and repeat them for every word; they stop at a generator
    out = rows.select(F.explode(F.array(F.struct("_keep", *new, kept))).alias("r"))
    return out.select(*[F.col("r._keep").getField(k).alias(k) for k in keep], *[f"r.{c}" for c in [*new, "kept"]])
