"""Substring deduplication: passages that repeat across documents, found by backward search in compressed FM-indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import run_hashes, word_hashes, word_spans
from docloom.session import materialize

WINDOW = 50  # words of a passage that counts
SEED = 8  # words of the runs among which a window's seed is chosen
STEP = 10  # words of an index symbol; a window is WINDOW / STEP of them
SHARD = 400_000  # symbols of an index
CROWD = 2_000  # different segments of a seed that one index takes
BROADCAST_ROWS = 1_000_000  # largest table of ids that is broadcast


class WaveletMatrix:
    """Ranks over a sequence of numbers: one bitmap per binary digit, packed, with a running count per 64 bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(int(symbols - 1).bit_length(), 1)
        self.words, self.counts, self.zeros = [], [], []
        values = values.astype(np.int64)
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level & 1).astype(bool)
            packed = np.packbits(np.pad(bits, (0, 64 - n % 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(n - int(bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])
        self.origin = self._walk(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & below)
            at = np.where(symbol >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """Backward search over texts of symbols from 1 up, each followed by 0.

    Suffixes are sorted by their first ``depth`` symbols, which is all that patterns up to that length need.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int = 8):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < depth:
            after = np.concatenate([rank[width:], np.zeros(min(width, n), dtype=np.int64)])[:n]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.last = WaveletMatrix(text[self.suffixes - 1], symbols)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of ``patterns``."""
        symbol = patterns[:, -1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[:, k]
            low, high = self.first[symbol] + self.last.rank(symbol, low), self.first[symbol] + self.last.rank(symbol, high)
        return low, high


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a document: first window, number of windows, seed.

    The seed of a window is the smallest hash among its runs of ``SEED`` words (the leftmost, if equal); a segment is a
    run of windows with the seed at the same place.  Equal windows have equal seeds, wherever they are.
    """
    runs = run_hashes(words, SEED)
    span = WINDOW - SEED + 1
    if len(runs) < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.view(np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(runs, span)
    place = np.concatenate([views[i : i + 4096].argmin(axis=1) for i in range(0, len(views), 4096)]) + np.arange(len(views))
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return first, np.diff(np.r_[first, len(views)]), runs[place[first]]


def _segments(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_hashes((value.as_py() or "").encode())
                first, windows, seed = seeds(words)
                if not len(first):
                    continue
                raw = words.tobytes()
                digests = [hashlib.blake2b(raw[8 * a : 8 * (a + n + WINDOW - 1)], digest_size=8).digest() for a, n in zip(first.tolist(), windows.tolist())]
                columns[0].append(np.full(len(first), doc))
                columns[1].append(first)
                columns[2].append(windows)
                columns[3].append(seed.view(np.int64))
                columns[4].append(np.frombuffer(b"".join(digests), dtype="<i8"))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["doc", "first", "windows", "seed", "segment"])

    return materialize(docs.mapInArrow(run, "doc bigint, first bigint, windows bigint, seed bigint, segment bigint"))


def _filtered(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose id is wanted, before they are shuffled; ids are broadcast only when they are few."""
    ids = materialize(wanted.select("doc").distinct())
    return docs.join(F.broadcast(ids), "doc", "left_semi") if ids.count() <= BROADCAST_ROWS else docs


def _contents(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Word hashes of the wanted segments, cut from the document that stands for each."""
    asked = heads.groupBy("doc").agg(F.collect_list(F.struct("seed", "segment", "first", "windows", "crowd")).alias("parts"))  # parts of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value, parts in zip(*[batch.column(i) for i in range(3)]):
                words = word_hashes((value.as_py() or "").encode())
                parts = parts.as_py()
                doc = doc.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["seed"] for p in parts]), pa.array([p["segment"] for p in parts]), pa.array([doc] * len(parts), pa.int64()), pa.array([p["crowd"] for p in parts]),
                     pa.array([words[p["first"] : p["first"] + p["windows"] + WINDOW - 1].tobytes() for p in parts])], names=["seed", "segment", "doc", "crowd", "words"])

    met = _filtered(docs, heads).join(asked, "doc").select("doc", "text", "parts")
    return materialize(met.mapInArrow(run, "seed bigint, segment bigint, doc bigint, crowd boolean, words binary"))


def _runs(values: np.ndarray) -> list[dict]:
    """Windows of a segment with the same first document, as runs."""
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return [{"at": int(a), "n": int(n), "least": int(values[a])} for a, n in zip(cuts, np.diff(np.r_[cuts, len(values)]))]


FOUND = "seed bigint, segment bigint, runs array<struct<at:int,n:int,least:bigint>>"
RUNS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("least", pa.int64())]))


def first_documents(segments: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
    """The smallest document of every window of every segment, among all segments of the shard.

    Index symbols are runs of ``STEP`` words; the symbols at every STEP-th place are one text, so that a window is a
    pattern of five symbols.  All windows are streamed through the index; each interval of suffixes is an occurrence
    list, of which the smallest document counts.
    """
    grams = [run_hashes(s, STEP) for s in segments]
    lengths = np.array([len(g) for g in grams])
    _, codes = np.unique(np.concatenate(grams), return_inverse=True)
    codes = codes + 1
    owner = np.repeat(np.arange(len(grams)), lengths)
    within = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((within // STEP, within % STEP, owner))
    sequence = owner[order] * STEP + within[order] % STEP
    starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
    text = np.insert(codes[order], np.r_[starts[1:], len(codes)], 0)
    owners = np.insert(owner[order], np.r_[starts[1:], len(codes)], owner[order][np.r_[starts[1:] - 1, len(codes) - 1]])
    index = FMIndex(text, int(codes.max()) + 1)
    document = docs[owners][index.suffixes]

    is_window = within + WINDOW - STEP < np.repeat(lengths, lengths)
    starts = np.flatnonzero(is_window)
    least = np.empty(len(starts), dtype=np.int64)
    for at in range(0, len(starts), 100_000):
        part = starts[at : at + 100_000]
        low, high = index.search(codes[part[:, None] + np.arange(0, WINDOW, STEP)])
        intervals, which = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
        edges = np.append(document, np.iinfo(np.int64).max)
        least[at : at + len(part)] = np.minimum.reduceat(edges, intervals.ravel())[::2][which.ravel()]
    counts = lengths - (WINDOW - STEP)
    return np.split(least, np.cumsum(counts)[:-1])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed; whole seeds fill an index until it holds ``SHARD`` symbols."""
    held: list[tuple[int, int, int, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = first_documents([h[3] for h in held], np.array([h[2] for h in held], dtype=np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([_runs(f) for f in found], RUNS)], names=["seed", "segment", "runs"])

    for batch in batches:
        for seed, segment, doc, raw in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if held and seed != held[-1][0] and size >= SHARD:
                yield flush()
                held, size = [], 0
            held.append((seed, segment, doc, np.frombuffer(raw, dtype=np.uint64)))
            size += len(held[-1][3])
    if held:
        yield flush()


def _crowded(contents: DataFrame) -> DataFrame:
    """Seeds with very many different segments (the edge of a passage in a third of all documents): equal windows are
    first combined by their hash, inside tasks and then across, so that no index has to take them all."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, segment, doc, raw in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                h = run_hashes(np.frombuffer(raw, dtype=np.uint64), WINDOW).view(np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, seed)), pa.array(np.full(n, segment)), pa.array(np.full(n, doc)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h)],
                                                 names=["seed", "segment", "doc", "at", "hash"])

    rows = contents.mapInArrow(windows, "seed bigint, segment bigint, doc bigint, at int, hash bigint")
    least = rows.groupBy("hash").agg(F.min("doc").alias("least"))
    met = rows.join(least, "hash")
    return met.groupBy("seed", "segment").agg(F.array_sort(F.collect_list(F.struct("at", F.lit(1).alias("n"), "least"))).alias("runs"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc`` and ``spans`` (first word, words; may overlap): windows whose words also start in a smaller document."""
    segments = _segments(docs)
    seeds_met = segments.groupBy("seed").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("seed")
    seeds_met = materialize(seeds_met)  # a side of its own, so that the join can split a hot seed
    candidates = materialize(segments.join(seeds_met, "seed", "left_semi"))
    head = F.min(F.struct("doc", "first", "windows")).alias("head")
    heads = materialize(candidates.groupBy("seed", "segment").agg(head).select("seed", "segment", "head.*"))
    crowds = heads.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("seed", (F.col("k") > CROWD).alias("crowd"))
    contents = _contents(docs, materialize(heads.join(crowds, "seed")))
    calm = contents.where("NOT crowd").select("seed", "segment", "doc", "words").repartition("seed").sortWithinPartitions("seed")
    found = calm.mapInArrow(_search, FOUND)
    crowded = contents.where("crowd").select("seed", "segment", "doc", "words")
    answers = found.unionByName(_crowded(crowded).select("seed", "segment", F.col("runs").cast("array<struct<at:int,n:int,least:bigint>>").alias("runs")))
    alone = F.array(F.struct(F.lit(0).alias("at"), F.col("windows").cast("int").alias("n"), F.col("doc").alias("least")))
    least = materialize(heads.join(answers, ["seed", "segment"], "left").select("seed", "segment", F.coalesce("runs", alone).alias("runs")))
    met = candidates.join(least, ["seed", "segment"])
    late = F.filter("runs", lambda r: r["least"] < F.col("doc"))
    spans = F.transform(late, lambda r: F.struct((F.col("first") + r["at"]).alias("at"), (r["n"] + WINDOW - 1).cast("long").alias("n")))
    return met.where(F.size(late) > 0).groupBy("doc").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Every whole text without the words of repeated passages: ``id``, ``n_words``, ``n_removed`` and ``kept`` (words
    joined by one space) or, with ``digests``, ``kept_sha256``.

    A word goes when a window of 50 words that covers it also starts, word for word, in a document with a smaller id
    (64-bit hashes stand for words and windows).  Windows are judged on the input.  Each window goes to the shard of
    its seed, so equal windows meet wherever they are, and the indexes together see every window that may repeat.

    Null and empty texts have no words; null ids take no part in the search and keep all; rows that share an id are
    one document in the search, and each is cut at its own places only if they are the same text (give unique ids);
    an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    spans = materialize(repeated_spans(rows.where("doc IS NOT NULL")))
    names = ["doc", "n_words", "n_removed", "kept_sha256" if digests else "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for doc, value, places in zip(*[batch.column(i) for i in range(3)]):
                raw = (value.as_py() or "").encode()
                starts, ends = word_spans(raw)
                change = np.zeros(len(starts) + 1, dtype=np.int64)
                for p in places.as_py() or ():
                    change[p["at"]] += 1
                    change[min(p["at"] + p["n"], len(starts))] -= 1
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())])
                for c, v in zip(columns, (doc.as_py(), len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digests else kept.decode())):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = f"doc bigint, n_words bigint, n_removed bigint, {names[3]} string"
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    ids = spans.select("doc")
    if spans.count() <= BROADCAST_ROWS:  # most texts then need no shuffle
        cut = rows.join(F.broadcast(ids), "doc", "left_semi").join(spans, "doc").select("doc", "text", "spans")
        whole = rows.join(F.broadcast(ids), "doc", "left_anti").select("doc", "text", none)
        out = cut.mapInArrow(run, schema).unionByName(whole.mapInArrow(run, schema))
    else:
        out = rows.join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(run, schema)
    return out.withColumnRenamed("doc", id)
