"""Fill-in-middle transformation: two cuts per text, found by rank queries on a wavelet matrix over character classes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
PLAIN_PERCENT = 10
SPM_PERCENT = 20
BLOCK_BYTES = 1 << 22  # texts are indexed together up to so many bytes; a longer text is a block of its own

# Classes of the bytes: inside a character, first byte of a character, of a word, of a line.
INSIDE, CHARACTER, WORD, LINE = range(4)
UNITS = {"character": (CHARACTER, WORD, LINE), "word": (WORD, LINE), "line": (LINE,)}
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every byte of texts laid end to end; ``starts`` are their first bytes (of texts that are not empty).

    A line begins behind a line end.  A word begins where another character follows a blank, and with every line, so the
    blanks behind a word belong to it and those at the start of a line are a unit of their own: units cover the whole text.
    """
    blank = _BLANK[raw]
    behind = np.ones(len(raw), dtype=bool)
    behind[1:] = blank[:-1]
    line = np.zeros(len(raw), dtype=bool)
    line[1:] = raw[:-1] == 10
    line[starts] = True
    out = np.where((raw & 0xC0) == 0x80, INSIDE, CHARACTER).astype(np.uint8)
    out[~blank & behind] = WORD
    out[line] = LINE
    return out


class _Bits:
    """A bit vector with ranks: 64 bits a word, and the number of ones before every word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class WaveletMatrix:
    """Ranks of symbols below ``2 ** levels``: one bit vector per bit, highest first; zeros go before ones on each level."""

    def __init__(self, symbols: np.ndarray, levels: int = 2):
        self.levels = []
        for k in range(levels - 1, -1, -1):
            one = (symbols >> k & 1).astype(bool)
            bits = _Bits(one)
            self.levels.append((k, bits, len(symbols) - int(bits.before[-1])))
            if k:
                symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``i`` symbols, for many ``i`` at once."""
        low, high = np.zeros_like(i), i
        for k, bits, zeros in self.levels:
            a, b = bits.rank(low), bits.rank(high)
            low, high = (zeros + a, zeros + b) if symbol >> k & 1 else (low - a, high - b)
        return high - low

    def boundaries(self, symbols: Sequence[int], i: np.ndarray) -> np.ndarray:
        """Units that begin among the first ``i`` symbols: the ranks of the classes that begin one."""
        return sum(self.rank(s, i) for s in symbols)

    def place(self, symbols: Sequence[int], low: np.ndarray, high: np.ndarray, count: np.ndarray) -> np.ndarray:
        """First place in ``low`` .. ``high`` with ``count`` units begun before it and the next beginning there, by bisection on
        ranks: the last place that has no more than ``count`` of them before it."""
        goal = self.boundaries(symbols, low) + count
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.boundaries(symbols, middle) <= goal
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)
        return low


def _cut_block(raw: bytes, ends: np.ndarray, numbers: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of every text of a block, and for its two numbers r the places of the cuts (r mod units + 1), smaller first."""
    low = np.concatenate([[0], ends[:-1]])
    full = low < ends
    if not raw:
        zero = np.zeros(len(ends), dtype=np.int64)
        return zero, np.zeros((len(ends), 2), dtype=np.int64), np.stack([low, low], axis=1)
    index = WaveletMatrix(classes(np.frombuffer(raw, dtype=np.uint8), low[full]))
    kinds = UNITS[unit]
    n = index.boundaries(kinds, ends) - index.boundaries(kinds, low)
    cuts = np.sort(numbers % (n + 1)[:, None], axis=1)
    return n, cuts, np.stack([index.place(kinds, low, ends, cuts[:, k]) for k in (0, 1)], axis=1)


def _rows(unit: str, names: Sequence[str]):
    prefix, suffix, middle = (m.encode() for m in MARKS)

    def write(texts: list[bytes], numbers: np.ndarray, forms: list[str]) -> tuple[list, ...]:
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        n, cuts, places = _cut_block(b"".join(texts), ends, numbers, unit)
        shown, out, lengths = [], [], ([], [])
        for text, form, end, k, (first, second) in zip(texts, forms, ends.tolist(), cuts.tolist(), places.tolist()):
            begin = end - len(text)
            a, b = first - begin, second - begin
            if form == "plain" or not text or prefix in text or suffix in text or middle in text:
                form, result = "plain", text
            elif form == "psm":
                result = b"".join((prefix, text[:a], suffix, text[b:], middle, text[a:b]))
            else:
                result = b"".join((suffix, text[b:], prefix, text[:a], middle, text[a:b]))
            shown.append(form)
            out.append(result)
            lengths[0].append(None if form == "plain" else k[0])
            lengths[1].append(None if form == "plain" else k[1] - k[0])
        return n.tolist(), shown, *lengths, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [batch.column(i) for i in range(batch.num_columns - 4)]
            column = batch.column(batch.num_columns - 4).cast(pa.binary())
            numbers = np.stack([batch.column(batch.num_columns - k).to_numpy() for k in (3, 2)], axis=1)
            form = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                texts, size, end = [], 0, at
                while end < batch.num_rows and (not texts or size < BLOCK_BYTES):
                    texts.append(column[end].as_py())
                    size += len(texts[-1])
                    end += 1
                n, shown, first, second, out = write(texts, numbers[at:end], form.slice(at, end - at).to_pylist())
                made = [pa.array(n, pa.int64()), pa.array(shown), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, end - at) for c in keep], *made], names=list(names))
                at = end

    return run


def number(id: Column, k: int, salt: str = "1") -> Column:
    """The ``k``-th number (from 1) of an id: eight digits of a digest, read as unsigned; null ids count as empty."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "character", keep: Sequence[str] = (),
              plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = "1") -> DataFrame:
    """One row per row of ``docs``: ``id``, the columns in ``keep``, ``n`` (units of the text), ``form``, ``prefix_units``,
    ``middle_units`` and ``output``.

    ``unit`` is ``character`` (code points), ``word`` (with the blanks behind it) or ``line``.  The digest of the id fixes both
    cuts and the form: ``psm`` is prefix, suffix, middle behind their marks, ``spm`` suffix, prefix, middle, ``plain`` the text
    itself.  Empty texts (null too) and texts that hold a mark are plain, and plain rows have null lengths.  Cuts never part
    the bytes of a character.  Rows are transformed one by one: repeated rows come out as often as they go in, rows that
    share an id share its numbers, an empty table gives no rows, other columns are not read.  A name in ``keep`` must not be one
    of the new columns.
    """
    kinds = dict(docs.dtypes)
    share = F.when(number(F.col(id), 3, salt) % 100 >= 100 - plain_percent, "plain").when(number(F.col(id), 4, salt) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate((id, *keep))], F.coalesce(F.col(text), F.lit("")).alias("t"),
                       number(F.col(id), 1, salt).alias("a"), number(F.col(id), 2, salt).alias("b"), share.alias("f"))
    new = {"n": "long", "form": "string", "prefix_units": "long", "middle_units": "long", "output": "string"}
    fields = {f"k{i}": kinds[c] for i, c in enumerate((id, *keep))} | new
    out = rows.mapInArrow(_rows(unit, list(fields)), ", ".join(f"`{c}` {t}" for c, t in fields.items()))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate((id, *keep))], *new)


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form.  No mark is in the text, and none can begin in one part and end in the
    next, so the marks found are the three that were written."""
    parts = F.split(output, "|".join(MARKS), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
