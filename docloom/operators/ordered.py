"""Ordered processing that does not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a hot key to one task.  The functions here
split each key into *chunks* that follow the order, work inside (key, chunk), and carry one small row
per chunk across.  Give ``chunk`` where the data has a natural bound per step (a second of the clock,
a block of sequence numbers); otherwise chunks come from range partitioning over (keys, order).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize, wide

BLOCK = 1 << 17  # rows per chunk where a dense sequence number orders the key
CHUNK_REACHES = 32  # length of a chunk of anchored groups, in reaches
GROUP_LIMIT = 1000  # largest rank limit that Spark applies before the shuffle by default


def block_of(seq: Column | str) -> Column:
    """Chunk expression for dense sequence numbers: bounded rows per (key, chunk)."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(c / F.lit(BLOCK)).cast("long")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys, matching nulls with nulls, keeping one copy of the keys.

    The keys are compared as one struct: inside a struct null equals null, and it stays a plain equality,
    so the partitioning of the join can serve the next step.
    """
    rest = [c for c in right.columns if c not in keys]
    small = right.select(F.struct(*keys).alias("_k"), *rest)
    return left.withColumn("_k", F.struct(*keys)).join(small, "_k", how).drop("_k")


def _cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _chunked(df: DataFrame, keys: Sequence[str], cols: Sequence[Column], chunk: Column | None) -> DataFrame:
    """Adds ``_k`` (the key, as one value) and ``_chunk``.  Without a given chunk, rows are range-partitioned
    over (key, order) and written down, so that the chunk of a row can never change afterwards."""
    if chunk is None:
        by = [*[F.col(k) for k in keys], *cols]
        df = materialize(df.repartitionByRange(*by).withColumn("_chunk", F.spark_partition_id()))
    else:
        df = df.withColumn("_chunk", chunk)
    return df.withColumn("_k", F.struct(*keys) if keys else F.lit(0))


def _with_offsets(placed: DataFrame, value: Column, name: str = "_off") -> DataFrame:
    """Joins the sum of ``value`` over the key's earlier chunks (one row per chunk crosses, not the data)."""
    sums = placed.groupBy("_k", "_chunk").agg(F.sum(value).alias("_n"))
    w = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(sums.select("_k", "_chunk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(name)), ["_k", "_chunk"])


def _inside(cols: Sequence[Column]):
    return Window.partitionBy("_k", "_chunk").orderBy(*cols)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn",
             chunk: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``row_number()`` over (keys, order), starting at 1, for keys of any size.

    ``order`` must be unique within the key for a repeatable result, as with ``row_number`` itself.  ``sizes``, a frame with
    as many rows of each key that is cheap to read, spares keys of at most ``BLOCK`` rows the chunks: a window numbers them.
    """
    cols = _cols(order)
    if sizes is not None and keys:
        full = sizes.groupBy(F.struct(*keys).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
        full = materialize(full.select("_k"))  # one row for each ``BLOCK`` rows at most
        by_window = lambda d: d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*cols)).cast("long"))
        if full.isEmpty():
            return by_window(df)
        keyed = df.withColumn("_k", F.struct(*keys))
        return by_window(keyed.join(full, "_k", "left_anti").drop("_k")).unionByName(numbered(keyed.join(full, "_k", "left_semi").drop("_k"), keys, order, name))
    placed = _with_offsets(_chunked(df, keys, cols, chunk), F.lit(1))
    out = placed.withColumn(name, (F.row_number().over(_inside(cols)) + F.col("_off")).cast("long"))
    return out.select(*df.columns, name)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column,
                  name: str, chunk: Column | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` within the key, chunk by chunk."""
    cols = _cols(order)
    placed = _with_offsets(_chunked(df.withColumn("_value", value), keys, cols, chunk), F.col("_value"))
    w = _inside(cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn(name, F.sum("_value").over(w) + F.col("_off")).select(*df.columns, name)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str,
             chunk: Column) -> DataFrame:
    """``lag(value)`` within the key: inside the chunk, else the last value of the chunk before."""
    cols = _cols(order)
    placed = _chunked(df, keys, cols, chunk)
    last = placed.groupBy("_k", "_chunk").agg(F.max_by(value, F.struct(*cols)).alias("_last"))
    carried = last.select("_k", "_chunk", F.lag("_last").over(Window.partitionBy("_k").orderBy("_chunk")).alias("_carried"))
    w = _inside(cols)
    out = placed.join(carried, ["_k", "_chunk"]).withColumn(
        name, F.when(F.row_number().over(w) == 1, F.col("_carried")).otherwise(F.lag(value).over(w)))
    return out.select(*df.columns, name)


def _hops(ticks: np.ndarray, reach: int) -> np.ndarray:
    """For each position, the place of the first one more than ``reach`` behind it: there the next group opens."""
    return np.searchsorted(ticks, ticks + reach, side="right")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column as arrays."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(ends, ends[1:]))


def _exits(reach: int):
    """Jump function of every chunk: from where a group may open first to the last group that then opens in the chunk.

    A group that is open from before reaches less than ``reach`` into the chunk, so only openings up to the first
    position behind that matter.  Openings that lead to the same last group are one step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto, exits = [], []
            for start, ticks in zip(batch.column(1).to_pylist(), _lists(batch.column(2))):
                after = _hops(ticks, reach)
                last = np.arange(len(ticks))
                while (inside := after[last] < len(ticks)).any():  # as often as groups fit into a chunk
                    last = np.where(inside, after[last % len(ticks)], last)
                n = int(np.searchsorted(ticks, start + reach, side="right")) + 1
                out = ticks[last[:n]]
                steps = np.append(np.flatnonzero(out[1:] != out[:-1]), len(out) - 1)
                upto.append(ticks[steps])
                exits.append(out[steps])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(upto, kind), pa.array(exits, kind)], names=["_k", "_from", "_upto", "_exits"])

    return run


def _chain(reach: int):
    """Runs through the chunks of each key, in order, with one number of state: the open group before every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, None
        for batch in batches:
            before = []
            for at, (upto, exits) in enumerate(zip(_lists(batch.column(2)), _lists(batch.column(3)))):
                mine = (batch.column(0)[at].as_py(),)
                if mine != key:
                    key, anchor = mine, None
                before.append(anchor)
                step = 0 if anchor is None else int(np.searchsorted(upto, anchor + reach, side="right"))
                if step < len(upto):
                    anchor = int(exits[step])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.int64())], names=["_k", "_from", "_before"])

    return run


def _starts(reach: int, name: str):
    """Group of every position of a chunk, given the group that is open before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for before, ticks in zip(batch.column(3).to_pylist(), _lists(batch.column(2))):
                after = _hops(ticks, reach)
                at = 0 if before is None else int(np.searchsorted(ticks, before + reach, side="right"))
                opens = [] if before is None else [before]
                while at < len(ticks):
                    opens.append(int(ticks[at]))
                    at = int(after[at])
                opens = np.array(opens, dtype=np.int64)
                starts.append(opens[np.searchsorted(opens, ticks, side="right") - 1])
            lengths = [len(x) for x in starts]
            if lengths:
                rows = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
                flat = pa.array(np.concatenate(starts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).flatten(), flat], names=["_k", "_pos", name])

    return run


def anchored(df: DataFrame, keys: Sequence[str], pos: str, reach: int, name: str = "start", chunk_reaches: int = CHUNK_REACHES) -> DataFrame:
    """Anchored groups: a group opens at its first position; a position more than ``reach`` past the
    *opening* position opens the next group.  This is not a gap rule, so ``lag`` cannot express it.

    Positions are cut into chunks of ``chunk_reaches * reach``.  A chunk holds its distinct positions, which its span
    bounds however many rows there are, and tells by itself, for every group that could be open before it, which group
    is open behind it: a step function.  One task runs through the functions of a key, a row per chunk; then every chunk
    is grouped by itself, so that no task walks the positions of a whole key.  Keys of one chunk need no functions.  Null
    positions get a null.
    """
    keys = list(keys)
    width = max(1, chunk_reaches * reach)
    placed = df.withColumn("_k", F.struct(*keys) if keys else F.lit(0)).withColumn("_pos", F.col(pos).cast("long"))
    chunks = placed.where("_pos IS NOT NULL").groupBy("_k", (F.col("_pos") - F.pmod("_pos", F.lit(width))).alias("_from"))
    ticks = materialize(chunks.agg(F.sort_array(F.collect_set("_pos")).alias("_ticks")))
    kind = dict(ticks.dtypes)["_k"]
    many = materialize(ticks.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k"))
    if many.isEmpty():
        opened = ticks.withColumn("_before", F.lit(None).cast("long"))
    else:
        steps = ticks.join(wide(many), "_k", "left_semi").mapInArrow(_exits(reach), f"_k {kind}, _from bigint, _upto array<bigint>, _exits array<bigint>")
        chain = steps.repartition("_k").sortWithinPartitions("_k", "_from").mapInArrow(_chain(reach), f"_k {kind}, _from bigint, _before bigint")
        opened = ticks.join(chain, ["_k", "_from"], "left")
    groups = opened.select("_k", "_from", "_ticks", "_before").mapInArrow(_starts(reach, name), f"_k {kind}, _pos bigint, `{name}` bigint")
    return placed.join(wide(groups), ["_k", "_pos"], "left").select(*df.columns, name)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows of each key.  Spark turns the rank filter into a per-task limit before the
    shuffle (WindowGroupLimit), so a hot key ships at most ``n`` rows per task."""
    if n > GROUP_LIMIT:
        return numbered(df, keys, order, name).where(F.col(name) <= n)
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def folded_upwards(df: DataFrame, keys: Sequence[str], node: str, parent: str, start: Mapping[str, Column],
                   combine: Callable[[str, Column, Column], Column], settle: str | None = None) -> DataFrame:
    """Values folded from every node up to its root: ``combine(name, below, above)`` joins two neighbouring stretches.

    Pointer doubling: each round joins every open stretch with the one that follows it, so a chain of n levels takes
    log2(n) rounds, each one written table.  A parent that is not in the table ends the chain.  A round that ends no
    chain shows that only circles are left, since a longer chain has nodes at every shorter distance: nodes whose parents
    run in a circle get ``cyclic`` and null values.  With ``settle``, the name of a value that repetition does not
    change (a largest node), the rounds go on until it is the same all round each circle, and values stay.
    """
    names = list(start)
    rows = df.withColumn("_k", F.struct(*keys)).withColumns({f"_v_{n}": c for n, c in start.items()}).withColumn("_next", F.col(parent))
    values = [f"_v_{n}" for n in names]
    state = materialize(rows.select("_k", F.col(node).alias("_node"), "_next", *values).dropDuplicates(["_k", "_node"]))
    mark = None
    while True:
        seen = state.where("_next IS NOT NULL").agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_k", "_node", *([f"_v_{settle}"] if settle else [])))).first()
        if not seen[0] or seen == mark:
            break
        mark = seen
        above = state.select("_k", F.col("_node").alias("_next"), F.col("_next").alias("_after"), *[F.col(v).alias(f"_a{v}") for v in values], F.lit(True).alias("_there"))
        joined = state.join(above, ["_k", "_next"], "left")
        moved = [F.when(F.col("_there"), combine(n, F.col(f"_v_{n}"), F.col(f"_a_v_{n}"))).otherwise(F.col(f"_v_{n}")).alias(f"_v_{n}") for n in names]
        state = materialize(joined.select("_k", "_node", F.col("_after").alias("_next"), *moved))
    out = df.withColumn("_k", F.struct(*keys)).withColumn("_node", F.col(node)).join(state, ["_k", "_node"], "left")
    open_ = F.col("_next").isNotNull()
    return out.select(*df.columns, *[(F.col(f"_v_{n}") if settle else F.when(~open_, F.col(f"_v_{n}"))).alias(n) for n in names], open_.alias("cyclic"))
