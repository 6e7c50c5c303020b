"""SimHash document fingerprints of 128 bits, and a search for all fingerprints within a Hamming radius.

Each distinct word of a text votes on every bit of the fingerprint with its weight: for 1 where its MD5 has the bit set, else
against it. A word weighs the bit length of its count in the text times the bit length of its rarity, the number of documents
divided by the number of documents that have it, at most 32. All weights are integers, so the order of additions does not
matter and equal texts get equal fingerprints on any cluster.

Only words of more than one document in 32 weigh less than the most. There are at most 32 times as many of these as a document
has distinct words on average, whatever the size of the corpus: they are all that is brought to the driver and to the tasks.

The search cuts fingerprints into ``radius + 2`` blocks. Of two fingerprints within the radius at least two blocks agree, so for
each choice of two blocks a table permutes these to the front and joins on them; the distance of all bits is checked next.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, discard, raw, released_shuffles, staged

BITS = 128
RARE = 32  # documents to each document that has a word, from which on the word weighs the most
RADIUS = 4  # differing bits of fingerprints that the search takes for near
_BLOCK = 1 << 16  # votes added up at a time; exact in 32-bit floats, as weights are below 256
_DIGESTS = 300_000  # words whose digests a worker remembers
_HELD = 300_000  # words that a task adds up before it hands them on


class Voter:
    """Fingerprints of texts (bytes), given the documents to each document that has a common word."""

    def __init__(self, rarity: dict[bytes, int]):
        self.rarity = {w: r.bit_length() for w, r in rarity.items()}
        self.most = RARE.bit_length()
        self.digests: dict[bytes, bytes] = {}

    def __call__(self, text: bytes) -> bytes:
        counts = Counter(text.lower().split())
        if not counts:
            return bytes(BITS // 8)
        if len(self.digests) > _DIGESTS:
            self.digests.clear()
        known, rarity, most = self.digests, self.rarity, self.most
        said = []
        for w in counts:
            d = known.get(w)
            if d is None:
                d = known[w] = hashlib.md5(w, usedforsecurity=False).digest()
            said.append(d)
        weights = np.fromiter((min(n.bit_length(), 32) * rarity.get(w, most) for w, n in counts.items()), np.float32, len(counts))
        bits = np.frombuffer(b"".join(said), np.uint8).reshape(-1, BITS // 8)
        votes = np.zeros(BITS, np.int64)
        for i in range(0, len(bits), _BLOCK):
            votes += (weights[i:i + _BLOCK] @ np.unpackbits(bits[i:i + _BLOCK], axis=1).astype(np.float32)).astype(np.int64)
        return np.packbits(2 * votes > int(weights.sum(dtype=np.float64))).tobytes()


def common_words(docs: DataFrame) -> dict[bytes, int]:
    """Documents to each document that has a word, for the words of ``docs`` where these are fewer than RARE."""

    def given(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for body in b.column(0).to_pylist():
                held.update(set(body.lower().split()))
                if len(held) > _HELD:
                    yield given(held)
                    held.clear()
        if held:
            yield given(held)

    total = docs.count()
    counts = docs.select(raw().alias("body")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with released_shuffles(docs.sparkSession):
        found = counts.filter(F.col("n") * RARE > total).collect()
    return {bytes(r["word"]): total // r["n"] for r in found}


_ROWS = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("body", T.BinaryType()),
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("print", T.BinaryType()), T.StructField("edited", T.BinaryType()), T.StructField("next", T.BinaryType()),
])
_WHOLE, _FIRST, _LAST = 0, 1, 2


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``, or all of it."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _row(kind: int, part: int, doc_id: int | None, text: str, own: bytes, after: tuple[str, bytes] | None, vote: Voter) -> tuple:
    if after is None:
        return kind, part, text.encode(), doc_id, len(text), None, own, None, None
    body = edited(text, after[0]).encode()
    return kind, part, None, doc_id, len(text), hashlib.sha256(body).hexdigest(), own, vote(body), after[1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _ROWS.names)


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Staged (doc_id, n_chars, edited_sha256, print, edited, next): fingerprints of each text, of its edited text and of the text after it.

    Texts are dealt by ranges of doc_id and read in ascending order, so the text after one in descending order is the one read
    before it. The first text of a range meets the last one of the range before, one row for each range; the very first one
    meets the very last.
    """
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rarity = common_words(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("body")).withColumn(f"{OWN}h", F.xxhash64("body"))
    rows = rows.repartitionByRange(n, "doc_id", f"{OWN}h").sortWithinPartitions("doc_id", f"{OWN}h", "body").select("doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote, part, before = Voter(rarity), TaskContext.get().partitionId(), None
        for b in batches:
            out = []
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text, own = body.decode("utf-8", "replace"), vote(body)
                out.append(_row(_WHOLE if before else _FIRST, part, doc_id, text, own, before, vote))
                before = text, own
            if out:
                yield _batch(out)
        if before:
            yield _batch([_row(_LAST, part, None, before[0], before[1], None, vote)])

    found = staged(rows.mapInArrow(run, _ROWS), "prints-dealt")
    lasts = found.filter(F.col("kind") == _LAST)
    parts = sorted(r["part"] for r in lasts.select("part").collect())
    if not parts:
        return found.drop("kind", "part", "body")
    source = F.element_at(F.create_map(*[F.lit(x) for p, q in zip(parts, [parts[-1], *parts[:-1]]) for x in (p, q)]), F.col("part"))
    ends = lasts.select(F.col("part").alias("source"), F.col("body").alias("before"), F.col("print").alias("before_print"))
    met = found.filter(F.col("kind") == _FIRST).withColumn("source", source).join(ends, "source")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = Voter(rarity)
        for b in batches:
            out = [_row(_WHOLE, 0, r["doc_id"], r["body"].decode(), r["print"], (r["before"].decode(), r["before_print"]), vote) for r in b.to_pylist()]
            if out:
                yield _batch(out)

    met = met.select("doc_id", "body", "print", "before", "before_print").mapInArrow(meet, _ROWS)
    done = staged(found.filter(F.col("kind") == _WHOLE).union(met).drop("kind", "part", "body"), "prints")
    discard(found)
    return done


def _long(half: Column) -> Column:
    """A signed long of 8 bytes."""
    return F.conv(F.hex(half), 16, -10).cast("long")


def halves(prints: Column) -> list[Column]:
    """``hi`` and ``lo`` of a 16-byte fingerprint as longs."""
    return [_long(F.substring(prints, 1, 8)).alias("hi"), _long(F.substring(prints, 9, 8)).alias("lo")]


def tables(radius: int, chosen: int = 2) -> list[tuple[int, int]]:
    """Masks (hi, lo) as signed longs of the bits that each permuted table has in front: any ``chosen`` of ``radius + chosen`` blocks."""
    m = radius + chosen
    edges = [BITS * i // m for i in range(m + 1)]
    out = []
    for blocks in combinations(range(m), chosen):
        mask = sum(((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in blocks)
        out.append(tuple(x - (1 << 64) if x >> 63 else x for x in (mask >> 64, mask & (1 << 64) - 1)))
    return out


def distance(a: str, b: str) -> Column:
    """Differing bits of the fingerprints of the struct columns ``a`` and ``b`` (hi, lo)."""
    return F.bit_count(F.col(f"{a}.hi").bitwiseXOR(F.col(f"{b}.hi"))) + F.bit_count(F.col(f"{a}.lo").bitwiseXOR(F.col(f"{b}.lo")))


def within(asked: DataFrame, held: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of structs (q, p): each of ``asked`` (hi, lo) with each of ``held`` (hi, lo) within ``radius`` bits, both distinct rows.

    Exact. A pair that meets in several tables counts in the first of them alone.
    """
    masks = tables(radius)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.xxhash64(F.lit(i), F.col("hi").bitwiseAND(F.lit(hi)), F.col("lo").bitwiseAND(F.lit(lo))) for i, (hi, lo) in enumerate(masks)]
        return df.select(F.struct("hi", "lo").alias(name), F.posexplode(F.array(*keys)).alias("number", "key"))

    x, y = (F.col(f"q.{h}").bitwiseXOR(F.col(f"p.{h}")) for h in ("hi", "lo"))
    agree = [(x.bitwiseAND(F.lit(hi)) == 0) & (y.bitwiseAND(F.lit(lo)) == 0) for hi, lo in masks]
    first = F.coalesce(*[F.when(a, F.lit(i)) for i, a in enumerate(agree)])
    pairs = keyed(asked, "q").join(keyed(held, "p"), ["number", "key"])
    return pairs.filter((first == F.col("number")) & (distance("q", "p") <= radius)).select("q", "p")


def report(docs: DataFrame, radius: int = RADIUS, every: int = 50, partitions: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every row of ``docs`` (doc_id, text).

    ``near_...`` is the share of equal bits. ``n_near`` counts the other rows whose fingerprint is within ``radius`` bits; it is
    asked for rows whose doc_id ``every`` divides, against all rows, and null for the others.

    A null text counts as empty; a text without words has fingerprint 0. Rows with a null doc_id come first in ascending order
    and are not asked for; rows that share a doc_id are ordered by a hash of the text, then the text. A single row is its own
    next. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = with_next(docs, partitions)
    rows = rows.select("*", *halves(F.col("print")))
    ask = (F.col("doc_id") % every == 0)
    known = staged(rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(ask, F.lit(False))).alias("asked")), "prints-known")
    pairs = within(known.filter("asked").select("hi", "lo"), known.select("hi", "lo"), radius)
    sizes = known.select(F.struct("hi", "lo").alias("p"), "n")
    near = staged(pairs.join(sizes, "p").groupBy("q").agg((F.sum("n") - 1).alias("n_near")).select("q.hi", "q.lo", F.lit(True).alias("ask"), "n_near"), "prints-near")
    said = [F.lower(F.hex(c)).alias(name) for c, name in (("print", "fingerprint"), ("edited", "edited_fingerprint"))]

    def alike(other: str) -> Column:
        bits = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(halves(F.col("print")), halves(F.col(other)))]
        return (BITS - bits[0] - bits[1]).cast("double") / BITS

    return rows.withColumn("ask", F.when(ask, F.lit(True))).join(near, ["hi", "lo", "ask"], "left").select(
        "doc_id", "n_chars", "edited_sha256", *said, alike("edited").alias("near_edited"), alike("next").alias("near_next"), "n_near")
