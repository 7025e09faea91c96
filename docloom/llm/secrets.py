"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models for the rest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base kinds, in their order.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SIZE = len(ALPHABET) + 1
SMOOTH_DOCS = 400  # counts of words in more documents are scaled down to as many, so that smoothing and ruled lines keep their weight
SAMPLE_RANDOM = 4000  # random strings
THRESHOLD = 1.0  # mean log-likelihood ratio per character step, in nats


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame, text: str = "text", label: str = "label") -> list[float]:
    """Log-likelihood ratio of every character step: label 1 (random) against label 0 (ordinary).

    Two first-order Markov models with add-one smoothing.  Steps are counted by an aggregation, so few rows per
    pair of characters of the fixed alphabet reach the driver.  A row counts ``weight / per`` times, where these
    columns exist, else once.  Null texts and labels, and characters outside the alphabet, train nothing; with no
    samples every ratio is 0.
    """
    weight, per = [F.col(c) if c in samples.columns else F.lit(1) for c in ("weight", "per")]
    codes = samples.where(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(F.col(label).alias("y"), weight.alias("w"), per.alias("p"), _codes(F.col(text)).alias("c"))
    steps = codes.where("size(c) > 1").select("y", "w", "p", F.explode(F.arrays_zip(
        F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("s"))
    counts: dict[tuple[int, int, int], float] = {}
    rows = steps.where("s.a > 0 AND s.b > 0").groupBy("y", "p", "s.a", "s.b").agg(F.sum("w").alias("n")).collect()
    for r in sorted(rows, key=lambda r: (r["y"], r["a"], r["b"], r["p"])):
        counts[r["y"], r["a"], r["b"]] = counts.get((r["y"], r["a"], r["b"]), 0) + r["n"] / r["p"]
    log = {}
    for y in (0, 1):
        for a in range(1, SIZE):
            total = sum(counts.get((y, a, b), 0) for b in range(1, SIZE))
            for b in range(1, SIZE):
                log[y, a, b] = math.log((counts.get((y, a, b), 0) + 1) / (total + SIZE - 1))
    return [log[1, a, b] - log[0, a, b] if a and b else 0.0 for a in range(SIZE) for b in range(SIZE)]


def samples_from(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled samples: random strings over usual key alphabets (1), and ordinary identifiers (0), with ``weight`` and ``per``.

    The identifiers are the words of all documents, alone and each joined with the next distinct word of its document the
    way code joins them.  They are not written out: words, and characters that meet where two words are joined, are
    counted first, and what comes out has the same character steps.  The random strings come from digests of
    ``SAMPLE_RANDOM`` numbers.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    random = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(
        F.base64(digest), F.translate(F.base64(digest), "+/", "-_"), F.upper(F.conv(F.substring(F.hex(digest), 1, 15), 16, 36)),
        F.lower(F.hex(digest)))).alias("text"), F.lit(1).alias("label"))
    words = docs.select(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w"))
    # a word is the first of a pair unless it is the last, and the second unless it is the first
    places = F.transform("w", lambda x, i: F.struct(((i < F.size("w") - 1).cast("int") + 2 * (i > 0).cast("int")).alias("kind"), x.alias("s")))
    seams = F.expr("zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> struct(4 AS kind, concat(right(a, 1), left(b, 1)) AS s))")
    counted = words.where("size(w) > 1").select(F.explode(F.concat(places, seams)).alias("x")).groupBy("x.kind", "x.s").agg(F.count(F.lit(1)).alias("n"))
    # the joined forms of a pair: a, a_b, a-b, a/b, aB, A_B
    form = lambda text, times: F.struct(text.alias("text"), times.cast("long").alias("times"))
    s, first, second = F.col("s"), F.col("kind").bitwiseAND(1), F.shiftright("kind", 1)
    a, b = F.substring("s", 1, 1), F.substring("s", 2, 1)
    whole = F.array(form(s, 5 * first + 3 * second), form(F.upper(s), first + second), form(F.initcap(s), second))
    met = F.array(*[form(x, F.lit(1)) for x in (F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat_ws("/", a, b), F.concat(a, F.upper(b)), F.upper(F.concat_ws("_", a, b)))])
    per = max(1.0, docs.count() / SMOOTH_DOCS)
    joined = counted.select(F.explode(F.when(F.col("kind") == 4, met).otherwise(whole)).alias("f"), "n").where("f.times > 0")
    ordinary = joined.select("f.text", F.lit(0).alias("label"), (F.col("n") * F.col("f.times")).alias("weight"), F.lit(per).alias("per"))
    rules = F.transform(F.split(F.lit("-_=/+0"), ""), lambda c: F.repeat(c, 1000))  # lines drawn with one character
    lines = spark.range(20).select(F.explode(rules).alias("text"), F.lit(0).alias("label"))
    once = random.unionByName(lines).select("text", "label", F.lit(1).cast("long").alias("weight"), F.lit(1.0).alias("per"))
    return once.unionByName(ordinary)


def ratio(text: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per step of a string (0 below two characters), in one pass over its characters."""
    table = F.lit(list(model))
    start = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("prev"), (s["sum"] + F.get(table, s["prev"] * SIZE + c)).alias("sum"))
    return F.aggregate(_codes(text), start, step, lambda s: s["sum"] / F.greatest(F.length(text) - 1, F.lit(1)))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, match) of a pattern, in code points, leftmost and non-overlapping.

    The pieces between the matches give the places: each match starts where the pieces and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("p"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def step(s: Column, x: Column) -> Column:
        at = s["pos"] + F.length(x["p"])
        end = at + F.length(x["m"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("match"))
        return F.struct(end.alias("pos"), F.array_append(s["out"], span).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    spans = F.aggregate(F.filter(zipped, lambda x: x["m"].isNotNull()), start, step, lambda s: s["out"])
    return F.when(F.size(found) > 0, spans).otherwise(none)


def scan(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns in ``keep``, ``text`` and ``spans`` (array of start, kind, end, match; by start, then kind).

    Kinds 0 to 2 are the base patterns over the whole text; kind 3 are other runs of 20 and more key characters
    whose mean log-likelihood ratio reaches ``threshold`` and which hold no base match.  Null text counts as empty
    (no spans, text empty); an empty table gives no rows; other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_keep"), whole.alias("_text"))
    t = F.col("_text")
    long_enough = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= 12
    base = rf"{ASSIGN}|{ACCESS}|{HEX}"
    rows = rows.select(
        "_keep", "_text", F.filter(_spans(t, ASSIGN, 0), long_enough).alias("_assign"), _spans(t, ACCESS, 1).alias("_access"), _spans(t, HEX, 2).alias("_hex"),
        F.when(t.rlike(CANDIDATE), F.filter(_spans(t, rf"{base}|{CANDIDATE}", 3), lambda x: ~x["match"].rlike(base))).alias("_rest"))
    random = F.filter(F.coalesce("_rest", F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")), lambda x: ratio(x["match"], model) >= threshold)
    return rows.select(*[F.col("_keep").getField(k).alias(k) for k in keep], F.col("_text").alias(text), F.array_sort(F.concat("_assign", "_access", "_hex", random)).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap are replaced together."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        before = F.substr(text, s["pos"] + 1, x["start"] - s["pos"])
        fresh = F.struct(x["end"].alias("pos"), F.array_append(F.array_append(s["out"], before), F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(s["pos"], x["end"]).alias("pos"), s["out"].alias("out"))
        return F.when(x["start"] >= s["pos"], fresh).otherwise(inside)

    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["pos"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
