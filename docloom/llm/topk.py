"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.session import materialize

BLOCK = 16_384  # rows of an index block
QUERIES = 256  # queries of a query block
Bits = np.ndarray  # bitmap over the rows of a block, 64 rows in a word


def quantised(vector: list | None, scale: int) -> list[int] | None:
    """floor(scale * x) of every component; nothing for null vectors, for null or non-finite components, and for components
    so large that an inner product of vectors of this length might not fit a long."""
    if vector is None or any(x is None for x in vector):
        return None
    values = np.floor(scale * np.array(vector, dtype=np.float64))
    fits = np.isfinite(values).all() and len(values) * np.square(values).max(initial=0) < 2.0**62
    return values.astype(np.int64).tolist() if fits else None


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps (attribute, bit) of ``values - lowest``, the lowest value of every attribute, and the words of a bitmap."""
    low = values.min(axis=0)
    shifted = (values - low).astype(np.uint64)
    bits = max(int(shifted.max()).bit_length(), 1) if shifted.size else 1
    words = -(-len(values) // 64)
    padded = np.zeros((64 * words, values.shape[1]), dtype=np.uint64)
    padded[: len(values)] = shifted
    maps = np.stack([np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little") for b in range(bits)])
    return np.ascontiguousarray(maps.transpose(2, 0, 1)).view(np.uint64).reshape(values.shape[1], bits, words), low, words


def add_slices(by_weight: dict[int, list[Bits]], words: int) -> list[Bits]:
    """Bit slices (lowest first) of the sum of bitmaps, each counted 2**weight: full adders turn three bitmaps of one
    weight into a sum of that weight and a carry of the next, until one is left of each."""
    out: list[Bits] = []
    weight = 0
    while by_weight:
        waiting = by_weight.pop(weight, [])
        while len(waiting) > 1:
            a, b = waiting.pop(), waiting.pop()
            half = a ^ b
            if waiting:
                c = waiting.pop()
                waiting.insert(0, half ^ c)
                carry = (a & b) | (half & c)
            else:
                waiting.append(half)
                carry = a & b
            by_weight.setdefault(weight + 1, []).append(carry)
        out.append(waiting[0] if waiting else np.zeros(words, dtype=np.uint64))
        weight += 1
    return out


def signed_digits(w: int) -> list[tuple[int, int]]:
    """``w`` as (place, digit) with digits 1 and -1, no two in a row: the fewest slices to add."""
    out, place = [], 0
    while w:
        if w & 1:
            digit = 2 - w % 4
            out.append((place, digit))
            w -= digit
        w >>= 1
        place += 1
    return out


def scores_of(maps: np.ndarray, low: np.ndarray, words: int, query: np.ndarray) -> list[Bits]:
    """Bit slices of the inner products with ``query``, up to a number that is the same for all rows of the block.

    Negative digits add complements: -v is (top - v) - top, with top the largest number of as many bits.
    """
    bits = maps.shape[1]
    by_weight: dict[int, list[Bits]] = {}
    for i in np.flatnonzero(query).tolist():
        for place, digit in signed_digits(int(query[i])):
            source = maps[i] if digit > 0 else ~maps[i]
            for b in range(bits):
                by_weight.setdefault(place + b, []).append(source[b])
    return add_slices(by_weight, words)


def rows_in(bitmap: Bits) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(slices: list[Bits], there: Bits, k: int) -> np.ndarray:
    """Rows of the ``k`` largest sums and all that tie with the last of them, from the most significant slice down.

    ``sure`` rows are in; of the ``even`` rows, which agree so far, those with the bit go in when they are not too many.
    """
    sure, even = np.zeros_like(there), there.copy()
    for s in reversed(slices):
        more = even & s
        if int(np.bitwise_count(sure | more).sum()) >= k:
            even = more
        else:
            sure |= more
            even &= ~s
    return rows_in(sure | even)


def build_index(rows: DataFrame, scale: int, block: int) -> DataFrame:
    """Blocks of the bit-sliced index, one per row, with the ids and the quantised values that settle the boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, tuple[list[int], list[list[int]]]] = {}

        def emit(size: int) -> pa.RecordBatch:
            ids, values = groups.pop(size)
            table = np.array(values, dtype=np.int64).reshape(-1, size)
            maps, low, words = slices_of(table)
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([table.tobytes()]), pa.array([maps.tobytes()]),
                 pa.array([maps.shape[1]], pa.int32()), pa.array([low.tolist()], pa.list_(pa.int64()))], names=["size", "ids", "rows", "maps", "bits", "low"])

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = quantised(value, scale)
                if not q or i is None:
                    continue
                ids, values = groups.setdefault(len(q), ([], []))
                ids.append(i)
                values.append(q)
                if len(ids) == block:
                    yield emit(len(q))
        for size in list(groups):
            yield emit(size)

    return rows.mapInArrow(run, "size int, ids array<bigint>, rows binary, maps binary, bits int, low array<bigint>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of every query row with all other rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Vectors are quantised to floor(scale * x).  The rows are cut into blocks, each a bit-sliced index; the stated
    queries are cut into blocks too, and every query block meets every index block in a task.  There the scores of all
    rows are built as bitmaps by adding slices, the top rows are taken from the most significant slice down, and the
    rows at the boundary are settled by exact score and id.  The best of each block then meet under a rank limit.

    Ties go to the smaller id; a query never finds a row of its own id; rows that share an id are candidates of their
    own, and of queries that share one the smallest usable vector is answered; vectors that are null or empty, hold null or non-finite components, have components
    beyond the square root of 2**62 over their length once quantised, or have no id take no part, and only vectors of the query's length are compared.  Fewer candidates than ``k`` give all; no queries give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("i"), F.col(vector).alias("v"))
    rows = rows.repartition(max(1, -(-rows.count() // block)))
    index = _numbered(build_index(rows, scale, block), "n")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        pack = lambda size, part: pa.RecordBatch.from_arrays(
            [pa.array([size], pa.int32()), pa.array([[q for q, _ in part]], pa.list_(pa.int64())), pa.array([b"".join(v for _, v in part)])], names=["q_size", "q_ids", "q_rows"])
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = quantised(value, scale)
                if not q or i is None:
                    continue
                part = held.setdefault(len(q), [])
                part.append((i, np.array(q, dtype=np.int64).tobytes()))
                if len(part) == QUERIES:
                    yield pack(len(q), held.pop(len(q)))
        for size, part in held.items():
            yield pack(size, part)

    asked = queries.select(F.col(id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    reach = F.sqrt(F.lit(2.0**62) / F.size("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(F.lit(float(scale)) * x).cast("double")) < reach) & (F.abs(F.lit(float(scale)) * x) < reach + 1))
    asked = asked.where(F.col("i").isNotNull() & (F.size("v") > 0) & usable).groupBy("i").agg(F.min("v").alias("v"))
    asked = asked.repartition(max(1, -(-asked.count() // QUERIES)))
    asked = _numbered(asked.mapInArrow(blocks, "q_size int, q_ids array<bigint>, q_rows binary"), "g")
    n, g = index.count(), asked.count()  # blocks, not rows
    if not n or not g:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    left = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    right = asked.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = left.groupBy("n", "g").cogroup(right.groupBy("n", "g"))
    found = met.applyInArrow(lambda a, b: _best(a, b, k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Written blocks with consecutive numbers; only the keys of the blocks are seen by the driver."""
    blocks = materialize(blocks.withColumn("key", F.uuid()))
    keys = sorted(r["key"] for r in blocks.select("key").collect())
    numbers = blocks.sparkSession.createDataFrame(list(enumerate(keys)), f"{name} int, key string")
    return blocks.join(F.broadcast(numbers), "key").drop("key")  # one short row per block


def _best(index: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The best rows of one index block for one block of queries."""
    out: list[tuple[int, int, int]] = []
    for row in index.to_pylist():
        size, ids = row["size"], np.array(row["ids"], dtype=np.int64)
        values = np.frombuffer(row["rows"], dtype=np.int64).reshape(len(ids), size)
        words = -(-len(ids) // 64)
        maps = np.frombuffer(row["maps"], dtype=np.uint64).reshape(size, row["bits"], words)
        low = np.array(row["low"], dtype=np.int64)
        everyone = np.packbits(np.arange(64 * words) < len(ids), bitorder="little").view(np.uint64)
        for part in asked.filter(pa.compute.equal(asked["q_size"], size)).to_pylist():
            for q, query in zip(part["q_ids"], np.frombuffer(part["q_rows"], dtype=np.int64).reshape(-1, size)):
                own = np.packbits(np.pad(ids == q, (0, 64 * words - len(ids))), bitorder="little").view(np.uint64)
                rows = top_rows(scores_of(maps, low, words, query), everyone & ~own, k)
                score = values[rows] @ query
                best = np.lexsort((ids[rows], -score))[:k]
                out += [(q, int(ids[rows[b]]), int(score[b])) for b in best.tolist()]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns)})
