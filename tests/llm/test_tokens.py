import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundshift.llm import packing, tokenfile, tokens

from .helpers import ODD, SF, docs


@pytest.fixture(scope="module")
def cache():
    return tokens.word_ids(tokens.vocabulary_path())


def library(cache, text):
    return np.array(cache.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB19 .,'’!<|>\n\t \x1c\x85éÉßñÿŸſﬁ́日", max_size=40))
def test_cache_equals_library(text):
    c = tokens.word_ids(tokens.vocabulary_path())
    assert c.encode(text.encode()) == library(c, text)


def test_special_strings(cache):
    for text in ("a<|endoftext|>b", "<|ENDOFTEXT|> A.B", "x <|startoftext|>. Y"):
        assert cache.encode(text.encode()) == library(cache, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_round_trip(values):
    x = np.array(values, np.uint32)
    assert (tokenfile.decode_ranks(tokenfile.encode_ranks(x), len(x)) == x).all()


def check_files(cache, rows, got):
    by_id = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    whole = sum(len(library(cache, t)) // 4 + 1 for _, t in rows)
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [i for i, _ in by_id]
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    assert at == whole
    want = sorted((str(i), zlib.crc32(library(cache, t) + np.uint32(1).tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want


def test_files_of_the_corpus(spark, cache):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    check_files(cache, [(r.doc_id, r.text) for r in d.collect()], tokenfile.digests(d).collect())


def test_files_of_odd_rows(spark, cache):
    check_files(cache, ODD, tokenfile.digests(docs(spark, ODD)).collect())
    assert tokenfile.digests(docs(spark, [])).count() == 0


def check_pieces(cache, rows, got):
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library(cache, t) + np.uint32(2).tobytes())
    assert sum(r.length for r in got) == sum(len(x) // 4 for v in ids.values() for x in v)
    sequences = {}
    for r in got:
        assert r.doc_tokens * 4 in map(len, ids[r.doc_id])
        assert r.ids_crc32 in {zlib.crc32(x[4 * r.start:4 * (r.start + r.length)]) for x in ids[r.doc_id]}
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    order = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id or -1 for r in order] == sorted(r.doc_id or -1 for r in order)
    return [sum(r.length for r in p) for p in sequences.values()]


def test_pieces_of_the_corpus(spark, cache):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = check_pieces(cache, [(r.doc_id, r.text) for r in d.collect()], packing.pack(d).collect())
    padded = sum(n if n & (n - 1) == 0 else 4096 for n in sizes)
    assert sum(sizes) >= 0.97 * padded


def test_pieces_of_odd_rows(spark, cache):
    check_pieces(cache, ODD, packing.pack(docs(spark, ODD)).collect())
    assert packing.pack(docs(spark, [])).count() == 0


def cost(points, penalties, cuts, size):
    total, before = 0, 0
    for c in cuts:
        n = points[c] - points[before]
        total += (0 if n & (n - 1) == 0 else size - n) + penalties[c] + packing.WINDOW_COST
        before = c
    return total


def test_cuts_are_the_best_ones():
    rng = random.Random(2)
    for _ in range(60):
        size = 32
        steps = [rng.randint(1, size if rng.random() < 0.1 else 9) for _ in range(rng.randint(1, 40))]
        points = np.cumsum([0, *steps])
        penalties = np.array([0, *[rng.choice([0, 4, 64]) for _ in steps]])
        best = [0] + [10**9] * len(steps)
        for j in range(1, len(points)):
            for i in range(j):
                n = int(points[j] - points[i])
                if n <= size:
                    pad = 0 if n & (n - 1) == 0 else size - n
                    best[j] = min(best[j], best[i] + pad + int(penalties[j]) + packing.WINDOW_COST)
        cuts = packing.cut(points, penalties, size)
        assert cuts[-1] == len(points) - 1
        assert cost(points.tolist(), penalties.tolist(), cuts, size) == best[-1]


def test_long_streams_are_cut_block_by_block():
    packer = packing.Packer(0, size=64, block=500)
    out = []
    rng = random.Random(1)
    sizes = [rng.randint(0, 200) for _ in range(200)]
    for i, n in enumerate(sizes):
        ids = np.arange(n, dtype="<u4").tobytes()
        parts = [min(7, n - k) for k in range(0, n, 7)]
        out += packer.add(i, ids, parts)
    out += packer.flush(last=True)
    assert sum(r[2] for r in out) == sum(n + 1 for n in sizes)
    seen = {}
    for doc, start, length, _, total, _, _ in out:
        assert start == seen.get(doc, 0) and total == sizes[doc] + 1
        seen[doc] = start + length


def test_words_with_marks_are_put_together_from_pieces(monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    whole, cache = Tokenizer.from_file(path), tokens.WordIds(path)
    text = "Ofrest### it's I'LL x's'tis éaneau&&& a1b22. (don't) thitihe.*** ÉÈ$$$ #'s'"
    want = whole.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(cache, "_encode", lambda word: 1 / 0)
    assert np.frombuffer(cache.encode(text.encode()), "<u4").tolist() == want


def test_sentences_end_at_stops_and_line_ends():
    cache = tokens.word_ids(tokens.vocabulary_path())
    for text in (b"", b" \n ", b"\n\na b. c\nd ! e.f g.\n\n", "é. x \x0b y?\tz".encode(), b"a.\n b\r\nc", b"one <|endoftext|>. Two"):
        parts = [cache.encode(s) for s in re.split(rb"(?<=[.!?])[ \t-\r]+|\n", text)]
        assert packing.boundaries(text, cache) == (b"".join(parts), [len(x) // 4 for x in parts if x])


def test_staged_ids_take_sixteen_bits_where_the_vocabulary_fits(spark):
    rows = tokenfile.tokenise(docs(spark, ODD), None, tokenfile.END_ID, 2).collect()
    assert rows and all(len(r.ids) == 2 * r.n for r in rows)


def test_figures_are_put_together_digit_by_digit(monkeypatch):
    """Words of figures ask neither the library nor the model and get the library's ids."""
    from tokenizers import Tokenizer

    cache = tokens.WordIds(tokens.vocabulary_path())
    library = Tokenizer.from_file(tokens.vocabulary_path())
    said = ["7", "00", "1234567890", "987" * 50]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in said]
    monkeypatch.setattr(cache, "_encode", None)
    monkeypatch.setattr(cache, "model", None)
    assert [cache[x.encode()] for x in said] == want


def test_points_of_long_and_short_sentences():
    """A sentence of exactly a window is not cut, a longer one is, also where the end id makes it longer."""
    for sentences, points, penalties in (
        ([3, 8], [0, 3, 11, 12], [0, 4, 64, 0]), ([3, 7], [0, 3, 11], [0, 4, 0]), ([20, 1], [0, 8, 16, 20, 22], [0, 64, 64, 4, 0]), ([], [0, 1], [0, 0]),
    ):
        p = packing.Packer(0, size=8)
        assert list(p.add(1, np.zeros(sum(sentences), "<u4").tobytes(), sentences)) == []
        assert (p.points, p.penalties) == (points, penalties)


def test_texts_are_looked_up_together(monkeypatch):
    """Words of many texts come from the table: known ones need neither the cache nor the library, long and odd ones stay right."""
    cache = tokens.WordIds(tokens.vocabulary_path())
    said = ["", " \n", "a", "a a\0 b\0\0 \0", "x" * 23 + " " + "y" * 24 + " " + "Z" * 300, "é" * 11 + "a é" + "é" * 11, "Ñandú,&&& año. ÀÉ÷× it's o' d'ou!? (so)",
            "<|im_end|> Foo. <|IM a<|endoftext|>. B<|", "\x1c a\x1db \x85 　xﷺ \x7f.", "1,2 a1, l.a. é. a​, ß." + " b, c" * 5000]
    want = [library(cache, x) + np.uint32(7).tobytes() for x in said]
    for limit in (40, 1 << 20):
        monkeypatch.setattr(tokens, "_TEXTS", limit)
        ids, counts = cache.encode_all([x.encode() for x in said], 7)
        assert ids.astype("<u4").tobytes() == b"".join(want) and counts.tolist() == [len(x) // 4 for x in want]
    short = [x.encode() for x in said if max(map(len, x.split()), default=0) < 9] * 2
    first = cache.encode_all(short, 7)
    cache.clear()
    monkeypatch.setattr(cache, "model", None)
    monkeypatch.setattr(cache, "_encode", None)
    assert all((x == y).all() for x, y in zip(first, cache.encode_all(short, 7)))
    assert [len(x) for x in cache.encode_all([], 7)] == [0, 0]


def test_table_of_words_tells_all_apart():
    table = tokens._Table(2)
    keys = np.random.default_rng(1).integers(0, 4, (3, 4000)).astype(np.uint64)
    keys = np.unique(keys + np.arange(4000, dtype=np.uint64) // np.uint64(50), axis=1)
    places = np.arange(1, keys.shape[1] + 1).astype(np.uint64) << np.uint64(16) | np.uint64(2)
    for i in range(0, keys.shape[1], 70):
        assert not table.find(keys[:, i:i + 70]).any()
        table.add(keys[:, i:i + 70], places[i:i + 70])
    assert (table.find(keys) == places).all()
