"""Splitting texts into units that a tokenizer treats alone, and a bounded memory of their results."""

from __future__ import annotations

import json
import re
import string
import sys
import types
from array import array
from collections.abc import Callable
from itertools import islice
from typing import Any

# White space other than single blanks and line ends; a blank next to white space is not a safe place to cut.
UNUSUAL = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
UNUSUAL_WIDE = UNUSUAL + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
MEMORY = 200_000  # units kept while a task runs, in each of two generations
KEPT = 20_000  # of these kept between tasks
PIECES = 20_000  # and pieces of units that are not just a word
MARKS = string.punctuation.replace("'", "")  # a run of them behind a word is one piece; "'" may begin a contraction
LATIN = re.compile(r"[!-~\xa1-\xff]+").fullmatch  # printable Latin-1 without blanks: no composition, one-to-one lower case


def units_of(text: str) -> list[str]:
    """Pieces of ``text`` cut at every blank between two other characters; the blank itself is left out.

    Pre-tokenizers of byte-level and word-level BPE begin a new piece at such a blank, so pieces can be
    encoded one by one (the first as it is, the others with a blank in front).
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return BOUNDARY.split(text)
    for c in UNUSUAL if text.isascii() else UNUSUAL_WIDE:
        if c in text:
            return BOUNDARY.split(text)
    return text.split(" ")


def worker_state(key: str, build: Callable[[], Any]) -> Any:
    """``build()`` once per Python worker; later tasks of the worker find it again, until another key comes."""
    store = sys.modules.setdefault("docloom_worker_state", types.ModuleType("docloom_worker_state"))
    if getattr(store, "key", None) != key:
        store.value = None  # the old one goes before the new one is built
        store.value, store.key = build(), key
    return store.value


class Memory:
    """Results by key in two generations: when the young one is full, the old one goes.  That bounds the memory."""

    def __init__(self, compute: Callable[[str], Any], limit: int = MEMORY):
        self.compute, self.limit = compute, limit
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def get(self, key: str) -> Any:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.compute(key)
            self.young[key] = value
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
        return value

    def all(self, keys: list[str]) -> list[Any]:
        found = list(map(self.young.get, keys))
        for i in [i for i, value in enumerate(found) if value is None]:
            found[i] = self.get(keys[i])
        return found

    def forget(self, kept: int = KEPT) -> None:
        """Drops all but the ``kept`` entries that came first into the young generation, common ones mostly."""
        self.young, self.old = dict(islice(self.young.items(), kept)), {}


class UnitMemory:
    """Results of the units of whole texts; ``later`` computes a unit behind a blank, which is not part of its key."""

    def __init__(self, compute: Callable[[str], Any], limit: int = MEMORY, later: Callable[[str], Any] | None = None):
        self.compute = compute
        self.later = Memory(later or (lambda w: compute(" " + w)), limit)

    def __call__(self, text: str) -> list[Any]:
        words = units_of(text)
        first = self.compute(words.pop(0))
        found = self.later.all(words)
        found.insert(0, first)
        return found


def simple_pieces(unit: str, find: Callable[[str], list[str]]) -> list[str]:
    """``find(unit)``, without the search where the unit is a blank, letters and a run of closing marks."""
    core = unit.rstrip(MARKS)
    if (core[1:] if core[:1] == " " else core).isalpha():
        return [unit] if len(core) == len(unit) else [core, unit[len(core) :]]
    return find(unit)


def byte_alphabet() -> dict[int, str]:
    """The usual printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stays, the rest moves past 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryTokenizer:
    """``tokenizers`` on one unit at a time: its normalizer and its merges, with pieces remembered.

    Handles the two usual pre-tokenizers, byte-level with its own pattern, and a pattern whose matches are kept
    followed by byte-level; others raise.  Gives the ids as unsigned 32-bit bytes.

    With ``added``, texts are first split at the file's added tokens, as the library does by itself; without, the strings
    of these tokens are ordinary text (the library's ``encode_special_tokens``).
    """

    def __init__(self, path: str, pattern: str, limit: int = MEMORY, added: bool = False):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        before = file["pre_tokenizer"]
        steps = before["pretokenizers"] if before["type"] == "Sequence" else [before]
        if len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed":
            pattern = steps[0]["pattern"]["Regex"]
        elif len(steps) != 1 or not steps[0].get("use_regex") or steps[0].get("add_prefix_space"):
            raise ValueError("unsupported pre-tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.model = self.tokenizer.normalizer, self.tokenizer.model
        rules = file["normalizer"]
        kinds = [] if rules is None else [n["type"] for n in rules.get("normalizers", [rules])]
        blanks = [n for n in (rules or {}).get("normalizers", [rules]) if n and n["type"] == "Replace"]
        self.latin = set(kinds) <= {"NFC", "Replace", "Lowercase"} and all(n["pattern"] == {"Regex": r"\s+"} for n in blanks)
        self.lowers = "Lowercase" in kinds
        self.find = regex.compile(pattern).findall
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.blank = " " if len(steps) == 1 else ""  # patterns of words leave blanks out
        self.before = self.blank.translate(self.table)
        self.pieces = Memory(self.piece, PIECES)
        self.units = UnitMemory(self.unit, limit, self.later_unit)
        tokens = [t for t in file.get("added_tokens") or [] if t["content"]] if added else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
            raise ValueError("unsupported added token")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens}
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})").split  # leftmost, then longest

    def piece(self, text: str) -> bytes:
        return self.merged(text.encode().decode("latin-1").translate(self.table))

    def merged(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def later_unit(self, word: str) -> bytes:
        """A unit behind a blank.  Words of printable Latin-1 with closing marks need neither normalizer nor search;
        the word before the marks is mostly remembered."""
        if self.latin and word.isascii() and word.isalpha():
            return self.merged(self.before + (word.lower() if self.lowers else word))
        if self.latin and LATIN(word):
            if self.lowers:
                word = word.lower()
            core = word.rstrip(MARKS)
            if core.isalpha():
                if len(core) < len(word):
                    return self.units.later.get(core) + self.pieces.get(word[len(core) :])
                return self.piece(self.blank + core)
        return self.unit(" " + word)

    def forget(self, kept: int = KEPT) -> None:
        """Drops most of what was remembered, at the end of a task: reused workers hold little beside the vocabulary."""
        self.pieces.forget()
        self.units.later.forget(kept)

    def unit(self, text: str) -> bytes:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if not self.blank:
            text = text.removeprefix(" ")
        return b"".join(self.pieces.all(simple_pieces(text, self.find)))

    def __call__(self, text: str) -> bytes:
        if not any(map(text.__contains__, self.added)):
            return b"".join(self.units(text))
        parts = self.split(text)  # stretches between added tokens at even places; each is normalized by itself
        return b"".join(self.added[part] if i % 2 else b"".join(self.units(part)) for i, part in enumerate(parts))
