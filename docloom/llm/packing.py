"""Best-fit packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.units import LibraryTokenizer, worker_state
from docloom.operators.ordered import numbered
from docloom.session import materialize

CAPACITY = 2048
BUCKET_ROWS = 100_000  # rows in which pieces of one length are numbered at a time


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, id: str = "doc_id",
           text: str = "text", with_ids: bool = False, added: bool = False) -> DataFrame:
    """Token pieces of every whole text: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``.

    A document is its ids and then ``end_id``; only longer ones than ``capacity`` are cut, into full pieces and a
    rest.  Null text counts as empty (one piece with the end id); rows that repeat give their pieces again; an
    empty table gives none.  Other columns are not read.  ``added`` as in ``LibraryTokenizer``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_state(f"tokenizer {path} {added}", lambda: LibraryTokenizer(path, pattern, added=added))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, number, start, length, crc, all_ids = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                raw = tokenizer(value.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        all_ids.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(all_ids, pa.list_(pa.int64()))] if with_ids else [])], names=names)
        tokenizer.forget()

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    names = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = f"_id {rows.schema[0].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id)


class Exact:
    """Exact complements: sums of one, two or three available lengths, looked up by the gap that they fill.

    Counts only fall, so a gap without an answer never gets one again; an answer is looked up again when one of
    its lengths has run out.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.triples: dict[int, tuple[int, int, int] | None] = {}

    def enough(self, lengths: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def pair(self, gap: int) -> tuple[int, int] | None:
        found = self.pairs.get(gap, ())
        if found == () or (found is not None and not self.enough(found)):
            there = self.counts[: gap + 1] > 0
            small = np.flatnonzero(there[1 : gap // 2 + 1] & there[gap - 1 : gap - gap // 2 - 1 : -1]) + 1
            small = small[(2 * small != gap) | (self.counts[small] >= 2)]
            found = self.pairs[gap] = (gap - int(small[0]), int(small[0])) if len(small) else None
        return found

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        found = self.triples.get(gap, ())
        if found == () or (found is not None and not self.enough(found)):
            found = None
            for a in np.flatnonzero(self.counts[:gap])[::-1].tolist():
                rest = self.pair(gap - a)
                if rest is not None and self.enough((a, *rest)):
                    found = (a, *rest)
                    break
            self.triples[gap] = found
        return found

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if self.counts[gap] > 0:
            return (gap,)
        return self.pair(gap) or self.triple(gap)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Largest first, into the fullest sequence with room; equal pieces are placed together."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fits = min((r for r in room if r >= length), default=None)
            if fits is None:
                each = capacity // length
                if left >= each:
                    times, many = left // each, each
                else:
                    times, many = 1, left
                left -= times * many
                room.setdefault(capacity - many * length, []).append((times, (length,) * many))
                continue
            times, use = room[fits].pop()
            if not room[fits]:
                del room[fits]
            k = min(times, left)
            if times > k:
                room.setdefault(fits, []).append((times - k, use))
            room.setdefault(fits - length, []).append((k, (*use, length)))
            left -= k
    return [group for groups in room.values() for group in groups]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences as (how many, lengths in them), for ``counts[length]`` pieces of every length.

    First every length, from the largest, takes one, two or three others that fill its gap exactly, as often as
    the counts allow.  What is left goes best-fit.  Exact fillings can use up small pieces that others needed: where
    best fit alone takes fewer sequences, its plan stands.  The work depends on the number of different lengths, not of
    pieces.
    """
    alone = best_fit(counts, capacity)
    counts = counts.astype(np.int64).copy()
    done: list[tuple[int, tuple[int, ...]]] = []
    exact = Exact(counts)
    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            counts[length] -= 1  # the piece that looks for company
            found = () if length == capacity else exact.fill(capacity - length)
            counts[length] += 1
            if found is None:
                break
            use = (length, *found)
            times = min(int(counts[x]) // use.count(x) for x in use)
            for x in use:
                counts[x] -= times
            done.append((times, use))
    done += best_fit(counts, capacity)
    number = lambda groups: sum(times for times, _ in groups)
    return done if number(done) <= number(alone) else alone


def slots(groups: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of ranks, with the first sequence and the offset of each run, by (length, rank)."""
    rows, used, sequence = [], {}, 0
    for times, use in groups:
        offset = 0
        for length in use:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def pack(cut: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``cut`` (one row per piece) with ``sequence_id`` and ``offset``: gapless from 0, at most ``capacity`` in a sequence.

    Only the histogram of lengths (at most ``capacity`` numbers) goes to the driver, and the plan that comes back
    is as large as the number of different combinations.  Pieces of one length are interchangeable: they are
    numbered, in buckets by hash so that a common length does not meet in one task, and look their place up by
    number.  Lengths outside 1 to ``capacity`` raise; an empty table stays empty; repeated rows are pieces of their own.
    """
    cut = materialize(cut)
    histogram = cut.groupBy(F.col(length).alias("_length")).agg(F.count(F.lit(1)).alias("_n")).collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:
        if row["_length"] is None or not 1 <= row["_length"] <= capacity:
            raise ValueError(f"a piece of length {row['_length']} does not fit {capacity}")
        counts[row["_length"]] = row["_n"]
    table = slots(plan(counts, capacity))
    buckets = int(counts.sum()) // BUCKET_ROWS + 16
    chunk = F.pmod(F.xxhash64(*order), F.lit(buckets))
    ranked = numbered(cut, [length], list(order), "_rank", chunk)
    names = [*cut.columns, "sequence_id", "offset"]
    at_length, at_rank = ranked.columns.index(length), ranked.columns.index("_rank")
    keys = (table["length"] << 40) + table["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy() - 1
            at = np.searchsorted(keys, (lengths << 40) + ranks, side="right") - 1
            sequence = table["sequence"][at] + ranks - table["first"][at]
            columns = [c for i, c in enumerate(batch.columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(table["offset"][at])], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")
