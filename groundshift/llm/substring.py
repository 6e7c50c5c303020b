"""Removal of word sequences that occur in an earlier document, found by recompression.

Recompression rewrites a text in rounds. One kind of round names every maximal run of one symbol, the other deals the symbols
to a left and a right half and names every adjacent left-right pair. A name is a hash of what it replaces, so that it is
the same in every task and document without a table of names, and equal substrings are rewritten alike but for their
borders. For each symbol the words that decide about it (its context) are tracked. A window of words that also lies in another
document shares with it all symbols whose context is inside the window.

The whole text is the last symbol: texts with the same root are copies and are settled by their root alone. Of the
others, Spark counts in which roots each symbol lies. A symbol of one root only proves that every window around its context
occurs in no other text; what is proved this way, some three quarters of all windows, is done. The shared symbols leave
candidate windows, which are verified by hash over all documents.

No text and no group of equal symbols is gathered: counts are aggregated before they are shuffled, symbols of one root go
to that root's document, and windows meet in a join of rows with one row for each distinct window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, staged

WINDOW = 13
ROUNDS = 3
LEAST = 3  # words of a symbol that is worth counting
PORTION = 1 << 20  # bytes of text that are rewritten at a time

_FAR = 1 << 40  # beyond any position: decided by what lies outside the text
_G, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a + _G) ^ (b * _B + _G))


class Line:
    """Symbols of several texts in a row, each text followed by a separator that never joins anything."""

    def __init__(self, names: np.ndarray, separator: np.ndarray):
        self.sym, self.sep = names, separator
        self.first = np.arange(len(names))
        self.end = self.first + 1
        self.low, self.high = self.first.copy(), self.end.copy()
        self._open()
        self.joined = np.zeros(len(names), bool)

    def _open(self) -> None:
        self.low[self.sep], self.high[self.sep] = -_FAR, _FAR

    def runs(self) -> None:
        """Names maximal runs. Both neighbours decide whether a symbol stands in a run."""
        new = np.ones(len(self.sym), bool)
        new[1:] = (self.sym[1:] != self.sym[:-1]) | self.sep[1:] | self.sep[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(self.sym)) - 1
        count = (last - first + 1).astype(np.uint64)
        low, high = np.append(-_FAR, self.low[last[:-1]]), np.append(self.high[first[1:]], _FAR)
        self.joined = count > 1
        self.sym = np.where(self.joined, _name(self.sym[first], count), self.sym[first])
        self.first, self.end, self.sep, self.low, self.high = self.first[first], self.end[last], self.sep[first], low, high
        self._open()

    def pairs(self, number: int) -> None:
        """Names left-right pairs. A symbol that stays alone does so because of its right or left neighbour."""
        side = (_mix(self.sym + np.array(number, np.uint64) * _G) >> np.uint64(40)) & np.uint64(1)
        left, right = (side == 0) & ~self.sep, (side == 1) & ~self.sep
        opens = np.zeros(len(side), bool)
        opens[:-1] = left[:-1] & right[1:]
        closes = np.zeros(len(side), bool)
        closes[1:] = opens[:-1]
        alone = ~opens & ~closes
        low = np.where(alone & right, np.append(-_FAR, self.low[:-1]), self.low)
        high = np.where(alone & left, np.append(self.high[1:], _FAR), self.high)
        at = np.flatnonzero(~closes)
        mate = np.where(opens[at], np.minimum(at + 1, len(side) - 1), at)
        self.joined = opens[at]
        self.sym = np.where(self.joined, _name(self.sym[at], self.sym[mate]), self.sym[at])
        self.first, self.end, self.sep = self.first[at], self.end[mate], self.sep[at]
        self.low, self.high = low[at], np.where(self.joined, self.high[mate], high[at])
        self._open()


_SHORT, _MANY = 32, 1 << 14  # bytes of a word that is hashed with others, and how many of them at a time
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _G)
_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full(_SHORT * _MANY, _A)))
_INVERSES = np.multiply.accumulate(np.append(np.uint64(1), np.full(_SHORT * _MANY, np.uint64(pow(int(_A), -1, 1 << 64)))))


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit name of each word: a polynomial of its bytes, by differences of running sums over many words; XXH64 for long words."""
    out = np.zeros(len(words), np.uint64)
    for i in range(0, len(words), _MANY):
        part = words[i:i + _MANY]
        n = np.fromiter(map(len, part), np.int64, len(part))
        long = np.flatnonzero(n > _SHORT).tolist()
        if long:
            part = list(part)
            far = [xxhash.xxh64_intdigest(part[k], 7) for k in long]
            for k in long:
                part[k] = b""
            n[long] = 0
        body = np.frombuffer(b"".join(part), np.uint8)
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTES[body] * _POWERS[:len(body)], out=sums[1:])
        end = np.cumsum(n)
        names = _mix((sums[end] - sums[end - n]) * _INVERSES[end - n])
        if long:
            names[long] = np.array(far, np.uint64)
        out[i:i + _MANY] = names
    return out


def line_up(bodies: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the words of all texts and their separators, which are separators, where each text starts)."""
    sizes = np.array([len(w) for w in bodies], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    names = np.zeros(int(sizes.sum()) + len(bodies), np.uint64)
    separator = np.zeros(len(names), bool)
    separator[starts + sizes] = True
    names[~separator] = word_names(list(chain.from_iterable(bodies)))
    names[separator] = np.arange(len(bodies), dtype=np.uint64)
    return names, separator, starts


def symbols(names: np.ndarray, separator: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, low, high) of all rounds: those of LEAST words or more whose context fits into a window."""
    line = Line(names, separator)
    line.runs()
    found = []
    for number in range(1, ROUNDS + 1):
        line.pairs(number)
        use = line.joined & (line.end - line.first >= LEAST) & (line.high - line.low <= window)
        found.append((line.sym[use], line.low[use], line.high[use]))
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def window_names(names: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit name of the windows that start at ``at``."""
    h, g = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i in range(window):
        w = names[at + i]
        h = h * _A + w
        g = (g ^ w) * _B
        g ^= g >> np.uint64(29)
    return _mix(h).view(np.int64), (_mix(g) >> np.uint64(33)).astype(np.int32)


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def portions(rows: list[tuple], body: int) -> Iterator[list[tuple]]:
    """``rows`` in groups of about PORTION bytes of text; an Arrow batch may hold many times what a task should split at once."""
    group: list[tuple] = []
    size = 0
    for row in rows:
        group.append(row)
        size += len(row[body])
        if size >= PORTION:
            yield group
            group, size = [], 0
    if group:
        yield group


def _root(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _small(root: bytes) -> int:
    return int.from_bytes(root[:8], "little", signed=True)


def summarise(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, root): root is the SHA-256 of the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(w := x.split()), _root(w)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], ["doc_id", "n_words", "root"])

    return docs.select("doc_id", raw().alias("body")).mapInArrow(run, "doc_id long, n_words long, root binary")


def symbol_rows(docs: DataFrame, window: int) -> DataFrame:
    """(sym, root) for every countable symbol of every text with a doc_id; root as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in portions([(x,) for x in b.column(0).to_pylist()], 0):
                bodies = [w for (x,) in group if len(w := x.split()) >= window]
                if not bodies:
                    continue
                names, separator, starts = line_up(bodies)
                sym, low, _ = symbols(names, separator, window)
                roots = np.array([_small(_root(w)) for w in bodies], np.int64)
                own = roots[np.searchsorted(starts, low, "right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(sym.view(np.int64)), pa.array(own)], ["sym", "root"])

    return docs.filter(F.col("doc_id").isNotNull()).select(raw().alias("body")).mapInArrow(run, "sym long, root long")


def candidates(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, root, body, starts) of the texts with windows that no symbol of one root lies in; starts as 32-bit integers.

    ``texts`` has (doc_id, root, alone, body); alone are the symbols that only this root has.
    """

    def of_group(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = [(d, r, a, x, w) for d, r, a, x in group if len(w := x.split()) >= window and _root(w) == r]
        if not rows:
            return
        names, separator, starts = line_up([w for *_, w in rows])
        sym, low, high = symbols(names, separator, window)
        alone = np.concatenate([a for _, _, a, _, _ in rows]).view(np.uint64)
        single = np.isin(sym, alone)
        # windows [high - window, low] hold the whole context of a symbol
        n = len(names) + 1
        step = np.bincount(np.maximum(high[single] - window, 0), minlength=n) - np.bincount(low[single] + 1, minlength=n)
        open_ = np.cumsum(step[:-1]) == 0
        out = []
        for (d, r, _, x, w), s in zip(rows, starts.tolist()):
            at = np.flatnonzero(open_[s:s + len(w) - window + 1])
            if len(at):
                out.append((d, r, x, at.astype("<i4").tobytes()))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["doc_id", "root", "body", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            alone = [values[i:j] if known else values[:0] for i, j, known in zip(ends, ends[1:], lists.is_valid().to_pylist())]
            for group in portions(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), alone, b.column(3).to_pylist())), 3):
                yield from of_group(group)

    return texts.mapInArrow(run, "doc_id long, root binary, body binary, starts binary")


def windows(found: DataFrame, window: int) -> DataFrame:
    """(h, g, doc_id, root, start) of every candidate window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in portions(list(zip(*[c.to_pylist() for c in b.columns])), 2):
                names, _, starts = line_up([x.split() for _, _, x, _ in group])
                at = [np.frombuffer(s, "<i4") for *_, s in group]
                count = [len(x) for x in at]
                start = np.concatenate(at).astype(np.int64)
                h, g = window_names(names, start + np.repeat(starts, count), window)
                own = [np.repeat(np.array(v, np.int64), count) for v in ([d for d, *_ in group], [_small(r) for _, r, *_ in group])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g, *own, start.astype(np.int32))], ["h", "g", "doc_id", "root", "start"])

    return found.mapInArrow(run, "h long, g int, doc_id long, root long, start int")


def removals(found: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(doc_id, root, n_removed, kept): what is left of the candidates' texts; kept is the SHA-256 of the words that stay."""
    marks = windows(found, window).join(repeated, ["h", "g"]).filter("doc_id > least").groupBy("doc_id", "root").agg(F.collect_list("start").alias("at"))
    marks = staged(marks, "substring-marks").withColumnRenamed("root", "small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, r, x, s, at in zip(*[c.to_pylist() for c in b.columns]):
                if s != _small(r):
                    continue
                w = x.split()
                gone = covered(np.array(at, np.int64), len(w), window)
                out.append((d, r, int(gone.sum()), _root([y for y, z in zip(w, gone.tolist()) if not z])))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
                                                 ["doc_id", "root", "n_removed", "kept"])

    joined = found.drop("starts").join(marks, "doc_id").select("doc_id", "root", "body", "small", "at")
    return joined.mapInArrow(run, "doc_id long, root binary, n_removed long, kept binary").dropDuplicates(["doc_id", "root"])


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text).

    A word goes if it lies in a window of ``window`` words whose words also start in a document with a smaller doc_id; windows
    are judged on the input. A null text has no words. A row with a null doc_id is left whole and takes nothing from
    others. Rows that share a doc_id take nothing from each other. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = staged(summarise(docs), "substring-roots")
    least = rows.filter("doc_id IS NOT NULL").groupBy("root", "n_words").agg(F.min("doc_id").alias("doc_id"))
    alone = (
        symbol_rows(docs, window).groupBy("sym").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        .filter("root = other").groupBy("root").agg(F.collect_list("sym").alias("alone"))
    )
    alone = staged(alone.withColumnRenamed("root", "small"), "substring-symbols")

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_small(r) for r in b.column(1).to_pylist()], pa.int64())], ["doc_id", "root", "small"])

    reps = least.filter(F.col("n_words") >= window).select("doc_id", "root").mapInArrow(shortened, "doc_id long, root binary, small long")
    reps = reps.join(alone, "small", "left").select("doc_id", "root", "alone")
    texts = docs.select("doc_id", raw().alias("body")).join(reps, "doc_id").select("doc_id", "root", "alone", "body")
    found = staged(candidates(texts, window), "substring-candidates")
    repeated = windows(found, window).groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = staged(repeated.filter("least < most").select("h", "g", "least"), "substring-repeated")
    left = removals(found, repeated, window)

    firsts = least.select("root", F.col("doc_id").alias("first"))
    judged = rows.join(firsts, "root", "left").join(left, ["doc_id", "root"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False))
    empty = F.lit(hashlib.sha256(b"").digest())
    return judged.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(copy, empty).otherwise(F.coalesce("kept", "root")))).alias("kept_sha256"),
    )
