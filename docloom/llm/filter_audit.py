"""Filter interaction audit: what each filter of a sequence removes, in every order of the filters.

Each filter has a stored relation of the ids that fail it.  Filter by filter, left semi and left anti joins part the ids
that failed before from the new relation: those that fail both, those that failed before only, and those that fail for the
first time.  After the last filter every failing id lies in one cell, named by the set of its filters, and what a filter
removes behind any prefix is the sum of the cells that hold it and none of the prefix.  Only failing ids take part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations, permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

FILTERS = "ABCDE"
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
KEY = ["_id", "_hash"]
COUNTS = ["n", "good", "toxic"]


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces ``_text`` by whether filters A to D fail; one text after the other, so memory holds one batch."""
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        texts = batch.column(at)
        points = pc.utf8_length(texts).to_pylist()
        a, b, c, d = [], [], [], []
        for text, n in zip(texts.cast(pa.binary()), points):
            raw = text.as_py()
            words = raw.split()  # bytes split at blanks and the characters 9 to 13
            a.append(len(words) < 100)
            b.append(100 * len(set(words)) < 80 * len(words))
            c.append(100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 10 * n)
            d.append(len(raw) != len(raw.translate(None, SYMBOLS)))
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], *map(pa.array, (a, b, c, d))],
                                         names=[*[batch.schema.names[i] for i in rest], *FILTERS[:4]])


def labelled_ids(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per id, text and part: ``_id``, ``_hash`` (the text's), ``part``, filters A to E (failed or not), and the
    number of rows, of good ones (``quality`` 1) and of toxic ones (``toxic`` 1).

    E takes the smallest id of every text from an aggregation on its 256-bit hash, so a hot text is combined inside
    each task first, and joins back only the texts that more than one id has.  Rows that agree in id, text and part fail
    alike and are counted together.  Null texts and parts count as empty; a null id has no smaller one and is nobody's
    smaller one.  Of several labels of an id, any 1 counts.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("_hash"), whole.alias("_text"))
    kinds = dict(rows.dtypes)
    judged = rows.mapInArrow(_measures, ", ".join(f"`{c}` {kinds[c]}" for c in ("_id", "part", "_hash")) + ", " + ", ".join(f"{f} boolean" for f in FILTERS[:4]))
    ids = materialize(judged.groupBy("_id", "part", "_hash").agg(F.count(F.lit(1)).alias("n"), *[F.first(f).alias(f) for f in FILTERS[:4]]))
    firsts = ids.where("_id IS NOT NULL").groupBy("_hash").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    firsts = materialize(firsts.drop("_last"))  # a side of its own, so that the join can split a hot text
    marked = labels.groupBy(F.col(id).alias("_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(f"_{c}") for c in ("quality", "toxic")])
    ids = ids.join(firsts, "_hash", "left").join(marked, "_id", "left")
    count = lambda c: F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0).cast("long"))
    return materialize(ids.select("_id", "_hash", "part", *FILTERS[:4], F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).alias("E"),
                                  "n", count("_quality").alias("good"), count("_toxic").alias("toxic")))


def failing(ids: DataFrame, filters: Sequence[str] = FILTERS) -> dict[str, DataFrame]:
    """The stored relation of every filter: the ids that fail it, with part and counts.  A null id is given its hash alone
    as key, since joins never match nulls."""
    key = [F.struct("_id").alias("_id"), F.col("_hash")]
    return {f: materialize(ids.where(F.col(f)).select(*key, "part", *COUNTS)) for f in filters}


def cells(relations: Mapping[str, DataFrame]) -> DataFrame:
    """``part``, ``sig`` (bits of the filters that an id fails, in the order of ``relations``) and the sums of the counts."""
    counted = lambda rows, sig: rows.select(*KEY, "part", *COUNTS, sig.cast("int").alias("sig"))
    state: DataFrame | None = None
    for at, relation in enumerate(relations.values()):
        bit = F.lit(1 << at)
        if state is None:
            state = counted(relation, bit)
            continue
        both = state.join(relation.select(*KEY), KEY, "left_semi")
        before = state.join(relation.select(*KEY), KEY, "left_anti")
        fresh = relation.join(state.select(*KEY), KEY, "left_anti")
        state = materialize(counted(both, F.col("sig") + bit).unionByName(counted(before, F.col("sig"))).unionByName(counted(fresh, bit)))
    return materialize(state.groupBy("part", "sig").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def removals(relations: Mapping[str, DataFrame]) -> DataFrame:
    """``part``, ``letter``, ``before`` (bits of the filters applied earlier) and the counts of what the filter removes then,
    for every set of the other filters; without a row where it removes nothing."""
    names = list(relations)
    sets = [(f, 1 << at, sum(1 << names.index(g) for g in chosen)) for at, f in enumerate(names) for others in [[g for g in names if g != f]]
            for size in range(len(names)) for chosen in combinations(others, size)]
    every = F.array(*[F.struct(F.lit(f).alias("letter"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for f, bit, before in sets])
    hit = F.filter(every, lambda x: (F.col("sig").bitwiseAND(x["bit"]) > 0) & (F.col("sig").bitwiseAND(x["before"]) == 0))
    found = cells(relations).select("part", F.explode(hit).alias("x"), *COUNTS)
    return found.groupBy("part", "x.letter", "x.before").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, as counts of rows: ``part``, ``filter_order``, ``step``, ``kept``,
    ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    See ``labelled_ids`` for nulls, repeated rows and labels.  A table without rows has no parts and gives no rows; a part
    in which nothing fails gives zeros.  Columns other than the three named ones are not read.
    """
    ids = labelled_ids(docs, labels, id, text, part)
    found = removals(failing(ids))
    parts = ids.groupBy("part").agg(F.sum("n").alias("total"))
    every = (1 << len(FILTERS)) - 1
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = [(len(FILTERS) * at + k, o, k + 1, f, sum(bit[g] for g in o[:k])) for at, o in enumerate(orders) for k, f in enumerate(o)]
    table = F.broadcast(docs.sparkSession.createDataFrame(steps, "at int, filter_order string, step int, letter string, before int"))  # 600 rows
    rows = parts.select("part", "total", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at")).join(table, "at")

    only = F.expr(f"{every} - shiftleft(1, instr('{FILTERS}', letter) - 1)")  # all other filters
    times = F.factorial(F.bit_count("before")) * F.factorial(F.lit(len(FILTERS) - 1) - F.bit_count("before"))  # orders with just this set in front
    of = found.groupBy("part", "letter").agg(F.sum(F.when(F.col("before") == 0, F.col("n"))).alias("fails"), F.sum(F.when(F.col("before") == only, F.col("n"))).alias("unique_fails"),
                                             F.sum(times * F.col("n")).alias("shapley"))
    rows = rows.join(of, ["part", "letter"], "left").join(found, ["part", "letter", "before"], "left")
    none = F.lit(0).cast("long")
    rows = rows.withColumn("n", F.coalesce("n", none))
    gone = F.sum("n").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), F.col("n").alias("removed"), (F.coalesce("fails", none) - F.col("n")).alias("redundant"),
        F.coalesce("unique_fails", none).alias("unique_fails"), F.coalesce("good", none).alias("good_lost"), F.coalesce("toxic", none).alias("toxic_lost"), F.coalesce("shapley", none).alias("shapley"))
