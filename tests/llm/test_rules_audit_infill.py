"""Quality rules, filter audit and fill-in-middle against brute force and SQL, with edge rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from compare import compare, connect
from pyspark.sql import functions as F

from docloom.llm import filter_audit, infill, quality_rules
from docloom.llm.queries import R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ["_id", "_hash", "_text", "text2", "n", "k0", "t", "a", "f", "form", "part", "A", "sig", "kept", "score", "good", "output", "r", "_w", "letter", "y"]
SCHEMA = "doc_id bigint, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)
FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, *["z"] * len(CLASHING)) for i, t, g in rows], SCHEMA)


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows = []
    for i in range(80):
        w = [word() for _ in range(r.choice([0, 1, 2, 3, 40, 60, 99, 100, 130]))]
        if i % 5 == 0:
            w = [x + r.choice(["$$", "##", "%"]) for x in w]
        if i % 7 == 0:
            w = w[:12] * r.randint(1, 12)
        if i % 9 == 0:
            w = [x.upper() for x in w]
        text = "".join(x + r.choice([" ", "  ", "\n", "\n\n", "\t", "\x0b", "\r\n"]) for x in w)
        rows.append((i, text, r.choice(["en", "de", None, ""])))
    rows += [(80, None, "en"), (81, "", "de"), (82, "  \n ", "de"), (83, "é ß x 😀\n" * 60, "fr"), (84, "ab " * 30_000, "en"), (85, "w" * 60_000, "en"),
             (86, rows[3][1], "en"), (87, rows[3][1], "de"), (88, "a <P> b", "en"), (89, "a <S> b <M>", "en"), (90, "<", "en"), (91, "😀", "en"),
             (91, "😀", "en"), (92, " <a|b> #1 & 2*3 " * 20, "es"), (None, "null id " * 60, None), (None, "null id " * 60, None), (93, "same line\nsame line\n \nsame line \n" * 2, "en")]
    r.shuffle(rows)
    return rows


LABELS = [(i, int(i % 4 != 0), int(i % 10 == 1)) for i in range(0, 94)] + [(3, 0, 0), (3, None, None), (None, 1, 1), (500, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside), failed


def bucket(word, n=quality_rules.BUCKETS):
    h = xxhash.xxh64_intdigest(word[-3:].encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % n


def test_rules_base_columns(spark, docs):
    got = quality_rules.judge(docs, quality_rules.Rules([0] * 10, -math.inf))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    assert got.columns == names
    assert sorted_rows(got) == sorted(((i, *base(t), 0.0, not base(t)[-1]) for i, t, _ in corpus()), key=repr)
    assert got.where("NOT kept AND n_words > 100").count() == sum(base(t)[-1] and base(t)[0] > 100 for _, t, _ in corpus())


def test_rules_fit_and_score(spark, docs, labels):
    """Counts, ratios and scores of every document against plain Python; the cut parts the held-out half best."""
    rules = quality_rules.fit(docs, labels)
    raw = Counter(bucket(w) for _, t, _ in corpus() for w in WORD.findall(t or ""))
    sample = sorted_rows(quality_rules.labelled_sample(docs, labels, "doc_id", "text", "quality", quality_rules.LABELLED))
    assert len(sample) == sum(i is not None for i, _, _ in corpus()) and {s[0] for s in sample} == {0, 1}
    trusted = Counter(bucket(w) for y, part, t in sample if y == 1 and part == 0 for w in WORD.findall(t))
    n = quality_rules.BUCKETS
    shift = math.log((sum(raw.values()) + n) / (sum(trusted.values()) + n))
    ratios = [round(1e6 * (math.log((trusted[b] + 1) / (raw[b] + 1)) + shift)) for b in range(n)]
    assert rules.ratios == ratios
    mean = lambda t: sum(ratios[bucket(w)] for w in WORD.findall(t or "")) / (1e6 * max(1, len(WORD.findall(t or ""))))
    got = sorted_rows(quality_rules.judge(docs, rules).select("doc_id", "score", "kept"))
    assert got == sorted(((i, mean(t), not base(t)[-1] and mean(t) >= rules.cut) for i, t, _ in corpus()), key=repr)
    held = [(y, mean(t)) for y, part, t in sample if part == 1 and not base(t)[-1]]
    both = [[s for y, s in held if y == k] for k in (0, 1)]
    gain = lambda c: sum(s < c for s in both[0]) / len(both[0]) + sum(s >= c for s in both[1]) / len(both[1])
    assert gain(rules.cut) >= max(gain(b / quality_rules.BINS) for b in range(-2000, 2000)) - 0.1


def test_rules_without_labels_or_rows(spark, docs, labels):
    rules = quality_rules.fit(docs, labels.where("quality = 0"))
    assert set(rules.ratios) == {0} and rules.cut == -math.inf
    assert quality_rules.fit(docs, labels.where("quality = 1")).cut == -math.inf
    empty = docs.where("doc_id < 0")
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).count() == 0


def test_rules_part_labelled_documents(spark):
    """On the given tables: documents of the half that set neither counts nor cut."""
    docs, marks = spark.read.parquet(f"{FOLDER}/../sf0.01/documents.parquet"), spark.read.parquet(f"{FOLDER}/../sf0.01/labels.parquet")
    rules = quality_rules.fit(docs, marks.where("doc_id % 2 = 0"))
    judged = quality_rules.judge(docs, rules).join(marks.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    rate = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.05


def brute_audit(rows, marks):
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = []
    for i, t, g in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in t for c in "#$%&*|"), "E": i is not None and first[t] < i}
        judged.append((g or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in judged}:
        mine, removed = [j for j in judged if j[0] == part], Counter()
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                removed[f] += len(gone)
                steps.append((part, order, k + 1, len(left), len(gone), sum(f in j[1] for j in mine) - len(gone), sum(j[1] == {f} for j in mine),
                              sum(j[2] for j in gone), sum(j[3] for j in gone)))
        out += [(*s, removed[s[1][s[2] - 1]]) for s in steps]
    return sorted(out, key=repr)


def test_audit(spark, docs, labels):
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted_rows(got) == brute_audit(corpus(), LABELS)


def test_audit_edges(spark, labels):
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    fine = " ".join(f"w{i}" for i in range(120))
    rows = [(1, fine, "x"), (1, fine, "x"), (1, "other", "x"), (2, fine, "y")]
    assert sorted_rows(filter_audit.audit(frame(spark, rows), labels.where("doc_id < 0"))) == brute_audit(rows, [])


def test_audit_of_stored_relations(spark):
    """Relations of other filters than the five: any number, any names."""
    fails = {"p": [1, 2, 3], "q": [2, 3, 4], "r": [3, 9]}
    make = lambda ids: spark.createDataFrame([((i,), b"h", "en", 1, i % 2, 0) for i in ids], "_id struct<_id:bigint>, _hash binary, part string, n bigint, good bigint, toxic bigint")
    got = {(r["letter"], r["before"]): (r["n"], r["good"]) for r in filter_audit.removals({f: make(i) for f, i in fails.items()}).collect()}
    want = {}
    for f, ids in fails.items():
        for mask in range(8):
            before = [g for k, g in enumerate(fails) if mask >> k & 1]
            left = [i for i in ids if not any(i in fails[g] for g in before)]
            if f not in before and left:
                want[f, mask] = (len(left), sum(i % 2 for i in left))
    assert got == want


def brute_infill(i, text, units):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


# a unit of words: blanks at the start of a line, or a word with the blanks up to the next word or line
UNITS = {"character": list, "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
         "word": lambda t: [x for line in re.findall(r"[^\n]*\n|[^\n]+", t) for x in re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", line)]}


@pytest.mark.parametrize("unit", list(UNITS))
@pytest.mark.parametrize("block", [infill.BLOCK_BYTES, 300])
def test_infill(spark, unit, block, monkeypatch):
    monkeypatch.setattr(infill, "BLOCK_BYTES", block)
    rows = corpus()
    docs = frame(spark, rows).repartition(3)
    got = infill.transform(docs, unit=unit, keep=["lang", "f"])
    assert got.columns == ["doc_id", "lang", "f", "n", "form", "prefix_units", "middle_units", "output"]
    assert sorted_rows(got.drop("lang", "f")) == sorted(
        ((i, *brute_infill(i, t or "", UNITS[unit](t or ""))) for i, t, _ in rows), key=repr)
    back = got.select("doc_id", infill.restored(F.col("output"), F.col("form")))
    assert sorted_rows(back) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert infill.transform(docs.where("doc_id < -1"), unit=unit).count() == 0


def test_marks_at_the_cuts(spark):
    """Halves of marks next to the cuts do not confuse the way back."""
    r = random.Random(2)
    rows = [(i, "".join(r.choice("<PSM>") for _ in range(r.randint(1, 9))), "en") for i in range(400)]
    out = infill.transform(frame(spark, rows))
    back = out.select("doc_id", infill.restored(F.col("output"), F.col("form")))
    assert sorted_rows(back) == sorted(((i, t) for i, t, _ in rows), key=repr)


def test_wavelet_matrix_ranks():
    r = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        s = r.integers(0, 8, n).astype(np.uint8)
        index = infill.WaveletMatrix(s, 3)
        at = np.arange(n + 1)
        for k in range(8):
            assert (index.rank(k, at) == np.concatenate([[0], np.cumsum(s == k)])).all()


@pytest.mark.parametrize("name", sorted(R.oracles))
def test_query(spark, name):
    """Queries of this subpackage that SQL can express."""
    ok, message, _, _ = compare(spark, connect(FOLDER), FOLDER, name)
    assert ok, message
