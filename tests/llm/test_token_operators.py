"""Tokens, their files and their packing, against the libraries."""

import array
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from docloom.llm import binary, bpe, packing, units

SCHEMA = "doc_id bigint, text string, _id string, ids string, n_tokens string, length string, piece string, _rank string, `start` string"
ODD = ["", None, " ", "  a  b ", "a\n b", "\ta  b c", "don't  'S we'll", "é ́a b", "ΑΣ ΣΑΣ x", "<|endoftext|> a <|endoftext|>", "\n\n a\n", "x\x1c y z", "x\x85 y\xa0z", "日本 語 😀",
       "\x00a \x00", "a" * 3000, "-=" * 900, "İ ß ǅ 12 ½ Ⅷ", " ".join(f"w{i}x" for i in range(5000)), "a　 b"]


def corpus():
    r = random.Random(2)
    letters = "abc é\n .,'s12\t́Σ语"
    return [(i, t) for i, t in enumerate(ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 300))) for _ in range(150)])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(i, t, *["z"] * 7) for i, t in rows], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return array.array("I", ids).tobytes()


def test_backtracking_is_exact(docs, none):
    path = P.path("byte_bpe_50k.tiktoken")
    expected = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, path, P.PATTERN).collect()}
    short = {r.doc_id: r for r in bpe.round_trip(docs, path, P.PATTERN, digests=True).collect()}
    assert len(got) == len(corpus())
    for i, t in corpus():
        ids = expected.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and bytes(got[i].decoded) == (t or "").encode()
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(none, path, P.PATTERN).count() == 0


def test_backtracking_with_other_ranks():
    """A small vocabulary in which the greedy choice is often wrong."""
    r = random.Random(9)
    tokens = [bytes([c]) for c in range(97, 100)]
    while len(tokens) < 60:
        joined = r.choice(tokens) + r.choice(tokens)
        if joined not in tokens:
            tokens.append(joined)
    ranks = {t: i for i, t in enumerate(tokens)}
    walk = bpe.BackTracker(ranks)
    for _ in range(3000):
        text = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
        expected = [ranks[text]] if text in ranks else [ranks[p] for p in walk._merge(text, bpe.NEVER)]
        assert walk(text) == expected, text


@pytest.mark.parametrize("kind,block", [("byte", 1 << 16), ("bit", 700), ("byte", 64)])
def test_plane_files(spark, docs, kind, block):
    ids_of = library("byte_bpe_50k.json")
    folder = binary.write_ids(docs, P.path("byte_bpe_50k.json"), P.PATTERN, end_id=2, kind=kind, block=block)
    rows = {r.doc_id: r for r in binary.read_ids(spark, folder).collect()}
    short = {r.doc_id: r for r in binary.read_ids(spark, folder, digests=True).collect()}
    start = 0
    for i, t in corpus():
        ids = [*ids_of(t), 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids) == (start, len(ids), ids)
        assert short[i].ids_crc32 == zlib.crc32(raw(ids))
        start += len(ids)


def test_plane_file_edges(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    assert binary.read_ids(spark, binary.write_ids(none, path, P.PATTERN)).count() == 0
    odd = spark.createDataFrame([(None, "b"), (3, None), (3, None), (1, "a")], "doc_id bigint, text string")
    got = [(r.doc_id, r.start, r.n_tokens) for r in binary.read_ids(spark, binary.write_ids(odd, path, P.PATTERN)).orderBy("start").collect()]
    assert got == [(None, 0, 2), (1, 2, 2), (3, 4, 1), (3, 5, 1)]


def test_blocks_by_index(tmp_path):
    ids = np.random.default_rng(3).integers(0, 2**32, 5000).astype("<u4")
    from pyarrow import fs
    store = fs.LocalFileSystem()
    with store.open_output_stream(str(tmp_path / "s")) as out:
        writer = binary.ShardWriter(out, "bit", 512)
        writer.add(1, ids[:3000].tobytes())
        writer.add(None, b"")
        writer.add(2, ids[3000:].tobytes())
        assert writer.close() == 5000
    with store.open_input_file(str(tmp_path / "s")) as source:
        reader = binary.ShardReader(source)
        assert all(np.array_equal(reader.ids(a, n), ids[a : a + n]) for a, n in [(0, 5000), (511, 2), (1024, 512), (4999, 1), (7, 0)])
        assert [(d, a, len(x)) for d, a, x in reader.documents()] == [(1, 0, 3000), (None, 3000, 0), (2, 3000, 2000)]
    (tmp_path / "t").write_bytes((tmp_path / "s").read_bytes()[:-9])
    with store.open_input_file(str(tmp_path / "t")) as source, pytest.raises(ValueError):
        binary.ShardReader(source)


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_and_packing(docs, none):
    path, ids_of = P.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    cut = packing.pieces(docs, path, P.PATTERN, with_ids=True)
    rows = packing.pack(cut).collect()
    expected = {}
    for i, t in corpus():
        ids = [*ids_of(t), 0]
        for at in range(0, len(ids), 2048):
            expected[i, at // 2048] = (at, ids[at : at + 2048])
    assert {(r.doc_id, r.piece): (r.start, r.ids) for r in rows} == expected and len(rows) == len(expected)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(raw(r.ids)) for r in rows)
    check_packing(rows, 2048)
    assert packing.pack(packing.pieces(none, path, P.PATTERN)).count() == 0


def dual(lengths, capacity, k):
    """Lower bound on sequences: a size whose (k + 1)-fold is whole counts as itself, another as its part rounded down, over k."""
    total = sum(Fraction(n, capacity) if n * (k + 1) % capacity == 0 else Fraction(n * (k + 1) // capacity, k) for n in lengths)
    return math.ceil(total)


def test_packing_repeats_and_hot_lengths(spark):
    r = random.Random(8)
    lengths = [30] * 3000 + [70] * 1000 + [r.randint(1, 100) for _ in range(3000)]
    table = spark.createDataFrame([(i % 5000, 0, n) for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    rows = packing.pack(table, capacity=100).collect()
    assert len(rows) == len(lengths)
    used = check_packing(rows, 100)
    # x (k + 1) rounded down, over k, is a dual feasible function of sizes x: no packing can go below these sums
    least = max(dual(lengths, 100, k) for k in range(1, 100))
    assert least <= used <= 1.003 * least
    counts = np.bincount(lengths, minlength=101)
    assert used <= sum(times for times, _ in packing.best_fit(counts, 100))
    with pytest.raises(ValueError):
        packing.pack(table, capacity=50)


def test_plan_fills_gaps_exactly():
    counts = np.zeros(101, dtype=int)
    counts[[60, 40, 50, 25, 15]] = [3, 2, 1, 3, 1]  # 60+40 twice, 60+25+15, 50+25+25
    groups = packing.plan(counts, 100)
    assert sum(n for n, _ in groups) == 4 and all(sum(use) == 100 for _, use in groups)


def test_memory_is_bounded():
    memory = units.Memory(lambda k: k, 10)
    for i in range(1000):
        assert memory.all([str(i), "a"]) == [str(i), "a"]
        assert len(memory.young) + len(memory.old) <= 24


MARKED = ["end of page <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|><|endoftext|>  Y\n", " <|endoftext|> ", "<|ENDOFTEXT|> <|endoftext", "é<|endoftext|>\u0301a",
          "don't<|endoftext|>'s <|startoftext|>\n\n q", "<|<|endoftext|>|>", "<|endoftext|>" * 900 + " tail"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens(name):
    """The library's default setting, in which strings of added tokens give one id."""
    encode = Tokenizer.from_file(P.path(name)).encode
    tokenizer = units.LibraryTokenizer(P.path(name), P.PATTERN, added=True)
    r = random.Random(8)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "a", "Don't", "é", "\u0301", "12"]
    for t in [*MARKED, *[t or "" for _, t in corpus()], *["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(2000)]]:
        assert tokenizer(t) == raw(encode(t, add_special_tokens=False).ids), t


def test_queries_split_at_added_tokens(spark, tmp_path):
    """op5, op10 and the last stage of the pipeline."""
    import corpus_pipeline
    from docloom.llm import queries
    from docloom.plans.base import Tables

    table = spark.createDataFrame(list(enumerate(MARKED)), "doc_id bigint, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    t = Tables(spark, str(tmp_path))
    for name, end, got in [("word_bpe_49k.json", 0, queries.op5(t)), ("word_bpe_49k.json", 0, corpus_pipeline.packed_sequences(spark, table, "")), ("byte_bpe_50k.json", 2, queries.op10(t))]:
        encode, start, rows = Tokenizer.from_file(P.path(name)).encode, 0, {r.doc_id: r for r in got.collect()}
        for i, text in enumerate(MARKED):
            ids = [*encode(text, add_special_tokens=False).ids, end]
            assert rows[i].ids_crc32 == zlib.crc32(raw(ids)), text
            if end:
                assert (rows[i].start, rows[i].n_tokens) == (start, len(ids))
            else:
                assert rows[i].length == len(ids)
            start += len(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_of_odd_blanks_equal_the_library(name):
    """What the library gives text by text, with odd blanks, nulls and added tokens."""
    r = random.Random(5)
    parts = ["the", "Café", "naïve,", "don't", "x", "42", "$$", "Straße.", "😀", "<|endoftext|>", "\n", "  ", "\t", "\u00a0", "A's"]
    texts = [r.choice([" ", " ", " ", ""]).join(r.choice(parts[: r.choice([9, 15])]) for _ in range(r.randint(0, 40))) for _ in range(600)] + ["", " ", "one", " a", "a "]
    library = Tokenizer.from_file(P.path(name))
    ours = units.LibraryTokenizer(P.path(name), P.PATTERN, added=True)
    assert [np.frombuffer(ours(t), dtype="<u4").tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_before_marks_are_merged_once(file):
    """A word with closing marks was merged again for each run of marks, and forgotten with the task."""
    tokenizer, library = units.LibraryTokenizer(P.path(file), P.PATTERN, added=True), Tokenizer.from_file(P.path(file))
    merged, seen = tokenizer.merged, []
    tokenizer.merged = lambda shown: seen.append(shown) or merged(shown)
    same = lambda text: list(memoryview(tokenizer(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids
    assert same("a haus haus, haus. haus; café) café")
    assert seen.count(tokenizer.before + "haus") == 1
    tokenizer.forget(units.MEMORY)
    assert same("a haus. haus) café,")
    assert seen.count(tokenizer.before + "haus") == 1
    assert same("a Haus, HAUSß, b  c \n haus.\nhaus, (haus) don't can't. 12.5, 日本 日本, été, Ångström!")
