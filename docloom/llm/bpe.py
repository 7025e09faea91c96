"""Byte-level BPE by backtracking over longest matches, and its inverse."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.units import MEMORY, Memory, UnitMemory, simple_pieces, worker_state

NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BackTracker:
    """Exact merges of one piece in linear time.

    Bytes are read as Latin-1, so that an Aho-Corasick automaton gives the longest token at every place.  Tokens
    are taken greedily; where the next one is not compatible with the one before, a shorter one is tried, and
    where none is left the walk steps back and never returns to that place.  Two tokens are compatible when the
    merges of their joined bytes never cross the border; answers are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], memory: int = 4 * MEMORY):
        import ahocorasick

        self.ranks, self.memory = ranks, memory
        self.bytes = {i: b for b, i in ranks.items()}
        self.parts = self._parts()
        self.size = {i: len(b) for b, i in ranks.items()}
        usable = {b: i for b, i in ranks.items() if len(b) == 1 or i in self.parts}
        self.shorter = {i: next((usable[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in usable), -1) for b, i in usable.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in usable.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b) - 1))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token; tokens that merges never make have no entry."""
        ranks, parts = self.ranks, {}
        for b, i in ranks.items():
            if len(b) == 1:
                continue
            options = [n for n in range(1, len(b)) if ranks.get(b[:n], NEVER) < i and ranks.get(b[n:], NEVER) < i]
            if options:
                merged = self._merge(b, i)  # a split alone proves nothing: merges may never meet at it
                options = [len(merged[0])] if len(merged) == 2 else []
            if options:
                parts[i] = (ranks[b[: options[0]]], ranks[b[options[0] :]])
        return parts

    def _merge(self, text: bytes, below: int) -> list[bytes]:
        """Plain merging with tokens under ``below``; only for building the table of parts."""
        pieces = [text[i : i + 1] for i in range(len(text))]
        while len(pieces) > 1:
            rank, at = min((self.ranks.get(pieces[i] + pieces[i + 1], NEVER), i) for i in range(len(pieces) - 1))
            if rank >= below:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces

    def _compatible(self, left: int, right: int) -> bool:
        """Merges happen in the order of ranks, so undoing the later of the two border tokens goes back in time."""
        ranks, text, parts = self.ranks, self.bytes, self.parts
        left_until = right_until = NEVER
        while True:
            joined = ranks.get(text[left] + text[right], NEVER)
            if joined < left_until and joined <= right_until and joined != NEVER:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                left_until, left = left, a[1]
            else:
                right_until, right = right, b[0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) > self.memory:
                self.known.clear()
            found = self.known[key] = self._compatible(left, right)
        return found

    def __call__(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out = self._greedy(piece)
        return out if out is not None else self._walk(piece)

    def _greedy(self, piece: bytes) -> list[int] | None:
        """Longest tokens one after the other, if they are compatible all the way: then the walk never steps back."""
        known, size, out, at, last = self.known, self.size, [], 0, -1
        for end, (token, back) in self.automaton.iter_long(piece.decode("latin-1")):
            if end - back != at:
                return None
            if last >= 0:
                fits = known.get(last << 32 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if not fits:
                    return None
            out.append(token)
            at += size[token]
            last = token
        return out if at == len(piece) else None

    def _walk(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        for end, (token, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = token  # later ends are longer
        size, shorter, compatible = self.size, self.shorter, self.compatible
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out


class Encoder:
    """Texts to ids (as strings, counts and the bytes that the ids decode to), unit by unit with a bounded memory."""

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        import regex

        self.ranks = load_ranks(path)
        self.tracker = BackTracker(self.ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = Memory(lambda p: self.tracker(p.encode()), memory)
        self.units = UnitMemory(self.unit, memory)

    def unit(self, text: str) -> tuple[str, bytes]:
        ids = [i for piece in self.pieces.all(simple_pieces(text, self.find)) for i in piece]
        return "".join([f" {i}" for i in ids]), self.decode(ids)

    def decode(self, ids: list[int]) -> bytes:
        vocabulary = self.tracker.bytes
        return b"".join([vocabulary[i] for i in ids])

    def ids(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.tracker(piece.encode())]


def round_trip(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to: ``id``, ``n_tokens`` and

    - ``ids`` (array<int>) and ``decoded`` (binary), or with ``digests``
    - ``ids_sha256`` (of the decimal ids joined by one space) and ``decoded_sha256``.

    Null text counts as empty (no ids, no bytes); rows come back one for one, repeated ones too; other columns
    are not read.  Every match of ``pattern`` is merged alone, without special tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"ranks {path} {pattern}", lambda: Encoder(path, pattern))
        for batch in batches:
            counts, first, second = [], [], []
            for value in batch.column(1):
                found = encoder.units(value.as_py() or "")
                ids = "".join([f[0] for f in found])
                decoded = b"".join([f[1] for f in found])
                counts.append(ids.count(" "))
                if digests:
                    first.append(hashlib.sha256(ids[1:].encode()).hexdigest())
                    second.append(hashlib.sha256(decoded).hexdigest())
                else:
                    first.append([int(x) for x in ids.split()])
                    second.append(decoded)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=names)
        encoder.pieces.forget()
        encoder.units.later.forget()

    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    names = ["_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return rows.mapInArrow(run, f"_id {rows.schema[0].dataType.simpleString()}, n_tokens bigint, {kinds}").withColumnRenamed("_id", id)
