"""Order-preserving packing of token streams by dynamic programming.

Documents are laid one after the other in order of doc_id. A window is what lies between two cuts, at most ``size``
tokens; cuts may fall at document ends for nothing, at sentence ends for a small truncation penalty, and inside a sentence
only where one is longer than a window. Over all ways to cut, the sum of padding, penalties and a cost for each window
is made smallest: with positions p and best costs f,

    f[j] = penalty[j] + cost + min over i with p[j] - p[i] <= size of  f[i] + size - (p[j] - p[i]).

Apart from what depends on j alone this is the minimum of f[i] + p[i] over a sliding window, which a monotone queue gives in
constant time for each j. A window whose length is a power of two needs no padding, which is a dozen more places to look.

Spark deals ranges of doc_id to tasks. A task reads its range in order and keeps one block of tokens at a time; what lies
behind the last cut of a block that is sure to stay opens the next block.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, raw
from .tokens import vocabulary_path, word_ids

SIZE = 4096
END_ID = 2
SENTENCE_PENALTY = 4  # tokens of padding that a cut between two sentences of a document is worth
INSIDE_PENALTY = 64  # the same for a cut inside a sentence
WINDOW_COST = 24  # the same for one more window
BLOCK = 1 << 19  # tokens that a task holds before it cuts

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_STOP = np.isin(np.arange(256), list(b".!?"))

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False), T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False),
])


def cut(points: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the points to cut at, of increasing token positions ``points`` that start at 0; the last one is a cut.

    No two neighbouring points are further apart than ``size``.
    """
    p, pen = points.tolist(), penalties.tolist()
    n = len(p)
    f, back = [0] * n, [0] * n
    waiting: deque[int] = deque([0])  # indices whose f + p increases
    key = [0] * n
    # for each point the earlier ones a power of two before it, one after the other
    place = np.full(p[-1] + 1, -1, np.int32)
    place[points] = np.arange(n)
    before = np.full((n, size.bit_length()), -1, np.int32)
    for k in range(size.bit_length()):
        far = np.searchsorted(points, 1 << k)
        before[far:, k] = place[points[far:] - (1 << k)]
    hit = before >= 0
    upto = np.append(0, np.cumsum(hit.sum(axis=1))).tolist()
    powers = before[hit].tolist()
    for j in range(1, n):
        pj = p[j]
        while pj - p[waiting[0]] > size:
            waiting.popleft()
        i = waiting[0]
        best, come = key[i] + size - pj, i
        for i in powers[upto[j]:upto[j + 1]]:
            if f[i] < best:
                best, come = f[i], i
        f[j], back[j] = best + pen[j] + WINDOW_COST, come
        key[j] = f[j] + pj
        while waiting and key[waiting[-1]] >= key[j]:
            waiting.pop()
        waiting.append(j)
    out = []
    j = n - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


def boundaries(text: bytes, cache) -> tuple[bytes, list[int]]:
    """(ids of a text, token counts of its sentences).

    A sentence ends with a word that a full stop, exclamation or question mark ends, and where a line ends.
    """
    ids = cache.words(text)
    if not ids:
        return b"", []
    body = np.frombuffer(text, np.uint8)
    space = _SPACE[body]
    last = np.flatnonzero(~space & np.append(space[1:], True))  # of each word
    ends = _STOP[body[last]]
    lines = np.searchsorted(last, np.flatnonzero(body == 10))  # words before each line end
    ends[lines[lines > 0] - 1] = True
    ends[-1] = True
    upto = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[ends] // 4
    counts = np.diff(upto, prepend=0)
    return b"".join(ids), counts[counts > 0].tolist()


class Packer:
    """Takes documents in order and gives pieces: (doc_id, start, length, crc, doc tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, size: int = SIZE, block: int = BLOCK):
        self.sequence, self.size, self.block = first_sequence, size, block
        self.docs: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids from there on, tokens of the document
        self.points: list[int] = [0]
        self.penalties: list[int] = [0]

    def add(self, doc_id: int | None, ids: bytes, sentences: list[int]) -> Iterator[tuple]:
        total = len(ids) // 4 + 1
        self.docs.append((doc_id, 0, ids + np.uint32(END_ID).tobytes(), total))
        sentences = [*sentences[:-1], sentences[-1] + 1] if sentences else [1]
        if max(sentences) <= self.size:
            self.points.extend(accumulate(sentences, initial=self.points.pop()))
            self.penalties.extend([SENTENCE_PENALTY] * len(sentences))
        else:
            for n in sentences:
                end = self.points[-1] + n
                while end - self.points[-1] > self.size:  # a sentence longer than a window
                    self.points.append(self.points[-1] + self.size)
                    self.penalties.append(INSIDE_PENALTY)
                self.points.append(end)
                self.penalties.append(SENTENCE_PENALTY)
        self.penalties[-1] = 0
        if self.points[-1] >= self.block:
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if len(self.points) == 1:
            return
        cuts = cut(np.array(self.points), np.array(self.penalties), self.size)
        if not last:  # the last windows may change with what follows
            sure = [c for c in cuts if self.points[-1] - self.points[c] >= 4 * self.size]
            cuts = sure or cuts
        ends = [self.points[c] for c in cuts]
        left, i, offset, opened = [], 0, 0, 0
        for doc_id, start, ids, total in self.docs:
            n, done = len(ids) // 4, 0
            while done < n and i < len(ends):
                take = min(n - done, ends[i] - opened - offset)
                part = ids[4 * done:4 * (done + take)]
                yield doc_id, start + done, take, zlib.crc32(part), total, self.sequence, offset
                done, offset = done + take, offset + take
                if opened + offset == ends[i]:
                    opened, offset, i = ends[i], 0, i + 1
                    self.sequence += 1
            if done < n:
                left.append((doc_id, start + done, ids[4 * done:], total))
        self.docs = left
        kept = cuts[-1]
        self.points = [x - ends[-1] for x in self.points[kept:]]
        self.penalties = [0, *self.penalties[kept + 1:]]


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, partitions: int | None = None) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text), see PIECES; sequence_id grows with doc_id.

    A null text counts as empty and gives the end id alone; rows with a null doc_id come first; rows that share a doc_id are
    packed each, ordered by text; extra columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # rows that share a doc_id, a third of all in the worst case, are dealt by text
    rows = docs.select("doc_id", raw().alias("body")).withColumn(f"{OWN}h", F.xxhash64("body"))
    rows = rows.repartitionByRange(n, "doc_id", f"{OWN}h").sortWithinPartitions("doc_id", f"{OWN}h", "body").select("doc_id", "body")
    names = [f.name for f in PIECES.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(vocabulary or vocabulary_path())
        packer = Packer(TaskContext.get().partitionId() << 40, size)

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for b in batches:
            out: list[tuple] = []
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.extend(packer.add(doc_id, *boundaries(body, cache)))
            if out:
                yield given(out)
        if out := list(packer.flush(last=True)):
            yield given(out)

    return rows.mapInArrow(run, PIECES)
