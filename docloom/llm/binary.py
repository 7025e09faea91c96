"""Token ids in binary shards: fixed-size blocks, transposed into byte or bit planes, each plane compressed with zstandard."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.units import MEMORY, LibraryTokenizer, worker_state
from docloom.session import checkpoint_dir

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16  # ids per block


def file_system(folder: str):
    """The file system and the path of a shared folder, for Python code in tasks."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of little-endian unsigned 32-bit ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    return [np.packbits(raw[:, i // 8] >> (i % 8) & 1).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), dtype=np.uint8)
    for i, plane in enumerate(planes):
        if kind == "byte":
            raw[:, i] = np.frombuffer(plane, dtype=np.uint8)
        else:
            raw[:, i // 8] |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n) << (i % 8)
    return raw.reshape(-1).view("<u4")


class ShardWriter:
    """One shard: blocks one after the other, then the documents, then the index of blocks, then its length and the magic."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.kind, self.block = out, kind, block
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.waiting: list[bytes] = []
        self.held = 0
        self.at = out.write(MAGIC)
        self.blocks: list[list] = []  # offset, ids, sizes of the planes
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            raw = b"".join(self.waiting)
            full = len(raw) // (4 * self.block) * 4 * self.block
            for i in range(0, full, 4 * self.block):
                self._block(raw[i : i + 4 * self.block])
            self.waiting, self.held = [raw[full:]], len(raw) - full

    def _block(self, raw: bytes) -> None:
        planes = [self.compress(p) for p in to_planes(np.frombuffer(raw, dtype="<u4"), self.kind)]
        self.blocks.append([self.at, len(raw) // 4, [len(p) for p in planes]])
        self.at += self.out.write(b"".join(planes))

    def close(self) -> int:
        if self.held:
            self._block(b"".join(self.waiting))
        ids = np.array([d or 0 for d, _ in self.docs], dtype="<i8")
        null = np.array([d is None for d, _ in self.docs], dtype=np.uint8)
        counts = np.array([n for _, n in self.docs], dtype="<i8")
        docs = self.compress(ids.tobytes() + counts.tobytes() + null.tobytes())
        index = self.compress(json.dumps({"kind": self.kind, "docs": [self.at, len(docs), len(self.docs)], "blocks": self.blocks}).encode())
        self.out.write(docs + index + struct.pack("<q", len(index)) + MAGIC)
        return int(counts.sum())


class ShardReader:
    """Reads a shard by its index: documents, and any range of ids from the blocks that hold it."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.expand = zstandard.ZstdDecompressor().decompress
        size = source.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard, or cut short")
        length = struct.unpack("<q", tail[:8])[0]
        index = json.loads(self.expand(self._at(size - 16 - length, length)))
        self.kind, self.blocks = index["kind"], index["blocks"]
        at, length, n = index["docs"]
        raw = self.expand(self._at(at, length))
        self.null = np.frombuffer(raw, dtype=np.uint8, offset=16 * n).astype(bool)
        self.doc_ids = np.frombuffer(raw, dtype="<i8", count=n)
        self.counts = np.frombuffer(raw, dtype="<i8", count=n, offset=8 * n)
        self.firsts = np.cumsum([0, *[b[1] for b in self.blocks]])

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.blocks[i]
        raw = self._at(at, sum(sizes))
        cuts = np.cumsum([0, *sizes])
        return from_planes([self.expand(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], n, self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on."""
        first, last = np.searchsorted(self.firsts, [start, start + n - 1], side="right") - 1
        got = np.concatenate([self.block(i) for i in range(first, last + 1)]) if n else np.zeros(0, dtype="<u4")
        return got[start - self.firsts[first] :][:n] if n else got

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first place, ids) of every document, with one block and one document in memory."""
        rest, block, at = np.zeros(0, dtype="<u4"), 0, 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.counts.tolist()):
            parts, missing = [], n
            while missing:
                if not len(rest):
                    rest, block = self.block(block), block + 1
                parts.append(rest[:missing])
                missing -= len(parts[-1])
                rest = rest[len(parts[-1]) :]
            yield None if null else doc_id, at, parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else rest[:0]
            at += n


def write_ids(docs: DataFrame, path: str, pattern: str, end_id: int = 2, folder: str | None = None, id: str = "doc_id",
              text: str = "text", kind: str = "byte", block: int = BLOCK, added: bool = False) -> str:
    """Encodes every whole text with the tokenizer file, appends ``end_id``, and writes shards in ascending ``id``; gives the folder.

    Texts are dealt by ranges of ``id``; every task sorts its range and streams it into one shard, which takes its
    name only when complete, so a task that runs again just puts the same shard in place again.  The driver sees
    one row per shard and writes ``index.json`` (shards in order with the ids before each).

    Null text counts as empty (only the end id); null ids come first; rows that share an id are ordered by their
    text.  An empty table gives an index without shards.  Other columns are not read.
    ``added`` as in ``LibraryTokenizer``.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_state(f"tokenizer {path} {added}", lambda: LibraryTokenizer(path, pattern, added=added))
        store, base = file_system(folder)
        shard = TaskContext.get().partitionId()
        name, temporary = f"shard-{shard:06d}.ids", f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        end = struct.pack("<I", end_id)
        out = writer = None
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    out = store.open_output_stream(temporary)
                    writer = ShardWriter(out, kind, block)
                writer.add(doc_id, tokenizer(value.as_py() or "") + end)
        tokenizer.forget(MEMORY)
        if writer is not None:
            total = writer.close()
            out.close()
            store.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([total], pa.int64())],
                names=["shard", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    ranges = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    shards = ranges.mapInArrow(run, "shard int, file string, n_docs bigint, n_ids bigint").collect()
    start, index = 0, []
    for s in sorted(shards, key=lambda s: s["shard"]):
        index.append({"file": s["file"], "start": start, "n_docs": s["n_docs"], "n_ids": s["n_ids"]})
        start += s["n_ids"]
    with fs.open_output_stream(f"{place}/index.json") as f:
        f.write(json.dumps(index).encode())
    return folder


def read_ids(spark: SparkSession, folder: str, digests: bool = False, id: str = "doc_id") -> DataFrame:
    """Documents of a written folder: ``id``, ``start`` (ids of all documents before it), ``n_tokens``, and ``ids``
    (array<long>) or, with ``digests``, ``ids_crc32``.  One task reads one shard, block by block."""
    fs, place = file_system(folder)
    with fs.open_input_file(f"{place}/index.json") as f:
        index = json.loads(f.read())
    names = [id, "start", "n_tokens", "ids_crc32" if digests else "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digests else pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                with store.open_input_file(f"{base}/{index[shard]['file']}") as source:
                    rows = []
                    for doc_id, at, ids in ShardReader(source).documents():
                        rows.append((doc_id, index[shard]["start"] + at, len(ids), zlib.crc32(ids.tobytes()) if digests else ids.tolist()))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    shards = spark.range(0, len(index), 1, max(len(index), 1))
    return shards.mapInArrow(run, f"`{id}` bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digests else 'ids array<bigint>'}")
