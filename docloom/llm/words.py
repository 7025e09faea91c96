"""Hashes of words and of runs of words, for whole texts at once in numpy."""

from __future__ import annotations

import numpy as np

LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (shifts and odd multipliers)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_BASE = U(0x5851F42D4C957F2D)


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_SHORT = _powers(256)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, which are separated by blanks and the characters 9 to 13."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~BLANK[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(raw: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """64-bit hash of every word, in order."""
    starts, ends = spans or word_spans(raw)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    longest = int(lengths.max())
    powers = _SHORT if longest <= len(_SHORT) else _powers(longest)
    letters = np.frombuffer(raw, dtype=np.uint8)[place + np.repeat(starts, lengths)]
    with np.errstate(over="ignore"):
        return _mix(np.add.reduceat(_BYTE[letters] * powers[place], firsts) + lengths.astype(np.uint64))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` words (none where there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            total = total * _BASE + words[k : k + m]
        return _mix(total + U(n))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word runs, A-Z lower-cased; a shorter text is one run, no words are none."""
    words = word_hashes((text or "").encode().translate(LOWERED))
    return np.unique(run_hashes(words, min(n, max(len(words), 1))))
