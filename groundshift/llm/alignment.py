"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which tokens of another.

Both token sequences of a text spell the same bytes, so each is a rising list of byte offsets where its tokens end. Offsets at
which both have an end are shared cuts. They are found by divide and conquer: of an interval between two shared cuts the end
nearest the middle of its first sequence is looked up among the ends of the second by bisection, then the ends on either side of
it, further and further out; at the first common one the interval is divided and both halves go on in the same way. An interval
without a common end inside is a leaf group. All intervals of all texts of a batch take each of these steps together, as arrays.

Tokens whose byte ranges overlap are linked. How many documents link a pair of ids is counted over the corpus. Pairs that more
than one document in ``SHARE`` has are at most ``SHARE`` times as many as a document has pairs on average, so their counts go to
all tasks; the counts of the others are joined, and no such pair is a hot key. The highest count of each first id is one row for
each entry of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .tokens import byte_letters, vocabulary_path

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
SHARE = 1024  # documents to each document that has a pair, below which all tasks are given the pair's count
_TEXTS = 1 << 20  # bytes of text that are aligned together
_HELD = 2_000_000  # pairs that a task adds up before it hands them on
_SIDE = 1 << 15  # ids of the second vocabulary stay below; a pair of ids is one 32-bit integer


class ByteBpe:
    """Ids of a byte-level BPE vocabulary in a ``tokenizers`` file. Strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(back.__getitem__, entry)): i for entry, i in vocabulary.items() if all(c in back for c in entry)}
        self.path, self.library = path, None
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for spelling, i in ranks.items():
            self.spelled[i] = spelling
        special = [i for i, s in enumerate(self.spelled) if s == b"<|endoftext|>"]
        for i in special:
            del ranks[self.spelled[i]]
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoding.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # white space of a million characters overflows the faster library's stack
                raise
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """Ids of a sentencepiece vocabulary, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

        def spelled(i: int) -> bytes:
            piece = self.model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

        self.spelled = [spelled(i) for i in range(self.model.get_piece_size())]
        if len(self.spelled) > _SIDE:
            raise ValueError("the second vocabulary is too large")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def vocabularies(first: str, second: str) -> tuple[ByteBpe, PieceBpe, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both vocabularies of a worker, the lengths of their entries, and the entries' decimal ids with what follows in a digest."""
    a, b = ByteBpe(first), PieceBpe(second)
    lengths = [np.fromiter(map(len, v.spelled), np.int64, len(v.spelled)) for v in (a, b)]
    decimals = []
    for v, last in ((a, "|"), (b, ";")):
        said = np.empty(2 * len(v.spelled), object)
        said[:] = [f"{i}{mark}" for i in range(len(v.spelled)) for mark in (",", last)]
        decimals.append(said)
    return a, b, *lengths, *decimals


def shared_cuts(a: np.ndarray, b: np.ndarray, a_texts: np.ndarray, b_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: rising exclusive token indices of both sequences.

    ``a`` and ``b`` are the rising end offsets of the tokens of several texts laid one after the other, ``a_texts`` and
    ``b_texts`` the number of tokens up to the end of each text, where both have a common end. Texts without tokens are allowed.
    """
    some = np.diff(a_texts, prepend=0) > 0
    a_texts, b_texts = a_texts[some], b_texts[some]
    open_ = np.stack([np.r_[0, a_texts][:-1], a_texts, np.r_[0, b_texts][:-1], b_texts, np.zeros(len(a_texts), np.int64)]).astype(np.int64)
    leaves = []
    while open_.shape[1]:
        a_lo, a_hi, b_lo, b_hi, tried = open_
        # the inner ends of [a_lo, a_hi) are those of its tokens but the last; tried steps lead out from their middle
        middle = (a_lo + a_hi - 2) // 2
        at = middle + np.where(tried % 2 == 1, (tried + 1) // 2, -(tried // 2))
        done = (a_hi - a_lo < 2) | (b_hi - b_lo < 2) | (tried > a_hi - a_lo)
        leaves.append(open_[1:4:2, done])
        open_, at = open_[:, ~done], at[~done]
        a_lo, a_hi, b_lo, b_hi, tried = open_
        inside = (at >= a_lo) & (at < a_hi - 1)
        ends = a[np.where(inside, at, a_lo)]
        there = np.searchsorted(b, ends)
        common = inside & (b[np.minimum(there, len(b) - 1)] == ends)
        zero = np.zeros(int(common.sum()), np.int64)
        cut_a, cut_b = at[common] + 1, there[common] + 1
        left = np.stack([a_lo[common], cut_a, b_lo[common], cut_b, zero])
        right = np.stack([cut_a, a_hi[common], cut_b, b_hi[common], zero])
        more = open_[:, ~common]
        more[4] += 1
        open_ = np.concatenate([left, right, more], axis=1)
    ends_a, ends_b = np.concatenate(leaves, axis=1) if leaves else np.zeros((2, 0), np.int64)
    order = np.argsort(ends_a)
    return ends_a[order], ends_b[order]


@dataclass
class Aligned:
    """Tokens of some texts laid one after the other, up to where each text's tokens and groups go, and where groups end."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_texts: np.ndarray
    b_texts: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    groups: np.ndarray  # groups up to the end of each text
    links: np.ndarray  # rows: text, first token, second token


def align(bodies: list[bytes | None], first: str, second: str) -> Aligned:
    """Aligns texts given as UTF-8. A text that is empty or that a vocabulary does not spell exactly has no tokens."""
    a, b, a_len, b_len, *_ = vocabularies(first, second)
    texts = [(x or b"").decode("utf-8", "replace") for x in bodies]
    a_ids, b_ids, sizes = [], [], []
    for body, text, theirs in zip(bodies, texts, b.encode(texts)):
        whole = b" " + (body or b"")
        own = a.encode(" " + text) if text else []
        fits = bool(own) and b"".join(map(a.spelled.__getitem__, own)) == whole and b"".join(map(b.spelled.__getitem__, theirs)) == whole
        a_ids.append(own if fits else [])
        b_ids.append(theirs if fits else [])
        sizes.append(len(whole) if fits else 0)
    a_texts, b_texts = (np.cumsum([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
    flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64, int(n[-1]) if len(n) else 0) for ids, n in ((a_ids, a_texts), (b_ids, b_texts)))
    # no entry is empty, so offsets rise, and those of one text lie below those of the next
    a_ends, b_ends = np.cumsum(a_len[flat_a]), np.cumsum(b_len[flat_b])
    a_cuts, b_cuts = shared_cuts(a_ends, b_ends, a_texts, b_texts)
    groups = np.searchsorted(a_cuts, a_texts, "right")
    # between two neighbouring ends of either kind lies the overlap of one pair, and no other overlap of it
    ends = np.union1d(a_ends, b_ends)
    links = np.stack([np.searchsorted(np.cumsum(sizes), ends), np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)])
    return Aligned(flat_a, flat_b, a_texts, b_texts, a_cuts, b_cuts, groups, links)


def _digests(x: Aligned, first: str, second: str) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text, an empty string for a text without tokens."""
    *_, a_said, b_said = vocabularies(first, second)
    out = np.empty(len(x.a_ids) + len(x.b_ids), object)
    a_last, b_last = np.zeros(len(x.a_ids), np.int64), np.zeros(len(x.b_ids), np.int64)
    a_last[x.a_cuts - 1] = 1
    b_last[x.b_cuts - 1] = 1
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    # a first token follows the second tokens of earlier groups, a second token also the first ones of its own
    out[np.arange(len(a_last)) + np.r_[0, x.b_cuts][a_group]] = a_said[2 * x.a_ids + a_last]
    out[np.arange(len(b_last)) + x.a_cuts[b_group]] = b_said[2 * x.b_ids + b_last]
    ends = (x.a_texts + x.b_texts).tolist()
    return [hashlib.sha256("".join(out[p:q].tolist())[:-1].encode()).hexdigest() if q > p else "" for p, q in zip([0, *ends], ends)]


def _portions(bodies: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``_TEXTS`` bytes."""
    start = size = 0
    for i, x in enumerate(bodies):
        size += len(x or b"")
        if size >= _TEXTS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(bodies):
        yield start, len(bodies)


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    return first or vocabulary_path(BYTE_BPE), second or vocabulary_path(PIECE_BPE)


_GROUPS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a_ids", "b_ids", "a_cuts", "b_cuts")]])


def token_groups(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """The alignment itself: for each row of ``docs`` its doc_id, the ids of both vocabularies, and the number of ids up to the
    end of each group in both. Texts that are null, empty, or not spelled exactly by a vocabulary have empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _paths(first, second)
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            for p, q in _portions(bodies):
                x = align(bodies[p:q], *paths)
                a0, b0, g0 = (np.r_[0, n][:-1] for n in (x.a_texts, x.b_texts, x.groups))
                rows = [(x.a_ids[i:j], x.b_ids[k:m], x.a_cuts[g:h] - i, x.b_cuts[g:h] - k)
                        for i, j, k, m, g, h in zip(a0, x.a_texts, b0, x.b_texts, g0, x.groups)]
                columns = [pa.array([r[c].astype(np.int32) for r in rows], pa.list_(pa.int32())) for c in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p, q - p), *columns], _GROUPS.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(run, _GROUPS)


_ROWS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType()),
])


def aligned_rows(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: a number of its own, counts, digest, and its linked pairs (little-endian 32-bit
    ``a * 32768 + b``, rising) with how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _paths(first, second)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            for p, q in _portions(bodies):
                x = align(bodies[p:q], *paths)
                text, i, j = x.links
                keys, times = np.unique(text << 32 | x.a_ids[i] * _SIDE + x.b_ids[j], return_counts=True)
                edges = np.searchsorted(keys, np.arange(q - p + 1) << 32).tolist()
                pairs, times = (keys & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
                counts = [np.diff(n, prepend=0) for n in (x.a_texts, x.b_texts, x.groups)] + [np.bincount(text, minlength=q - p)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + q - p), pa.int64()), batch.column(0).slice(p, q - p), *[pa.array(n, pa.int64()) for n in counts],
                    pa.array(_digests(x, *paths)), *[pa.array([v[s:e].tobytes() for s, e in zip(edges, edges[1:])], pa.binary()) for v in (pairs, times)],
                ], _ROWS.names)
                row += q - p

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(run, _ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many of the aligned ``rows`` link each pair of ids. Tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def given() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, "<u4"))
                size += len(held[-1])
                if size > _HELD:
                    yield given()
                    held, size = [], 0
        if held:
            yield given()

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def report(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    A pair's count is the number of rows that link it; ``count_sum`` adds up the counts of a text's links, ``n_best`` is how many
    of them have the highest count of their first id. Texts that are null, empty, or not spelled exactly by both vocabularies have
    zeros and an empty digest. Rows that share a doc_id, null included, stay apart and count each; extra columns are ignored; an
    empty table gives an empty result.

    To the driver come the highest count of each entry of the first vocabulary, and the pairs that more than one row in
    ``SHARE`` has.
    """
    spark = docs.sparkSession
    rows = staged(aligned_rows(docs, first, second), "aligned")
    counts = staged(pair_counts(rows), "pair-counts")
    best_of = counts.groupBy(F.floor(F.col("pair") / _SIDE).cast("int").alias("a")).agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(int(best_of["a"].max()) + 1 if len(best_of) else 1, np.int64)
    best[best_of["a"].to_numpy(np.int64)] = best_of["n"].to_numpy(np.int64)
    common = counts.filter(F.col("n") * SHARE > rows.count()).toPandas().sort_values("pair")
    given = spark.sparkContext.broadcast((best, common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))

    def known(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a row, their times, and their counts where those were given."""
        _, named, n = given.value
        p, t = np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
        if not len(named):
            return p, t, np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        at = np.minimum(np.searchsorted(named, p), len(named) - 1)
        return p, t, n[at], named[at] == p

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = given.value[0]
        for b in batches:
            out = []
            for pairs, times in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                p, t, n, there = known(pairs, times)
                out.append((int(t[there & (n == top[p // _SIDE])].sum()), int((t * n)[there].sum())))
            cols = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], ["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = given.value[0]
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                found = []
                for row, pairs, times in zip(*[c.to_pylist() for c in some.columns]):
                    p, t, _, there = known(pairs, times)
                    p, t = p[~there], t[~there]
                    found.append((np.full(len(p), row), p, t, top[p // _SIDE]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["row", "pair", "times", "top"])

    arrays = rows.select("row", "pairs", "times")
    rest = arrays.mapInArrow(others, "row long, pair long, times long, top long").join(counts, "pair").select(
        "row", F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = arrays.mapInArrow(settled, "row long, n_best long, count_sum long").union(rest).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
