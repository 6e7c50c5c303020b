"""SimHash near-duplicate classes with pigeonring candidate filtering.

Fingerprints are cut into ``m`` segments on a ring. If two fingerprints differ in at most ``d`` bits, some
segment starts a chain in which, for every length ``l``, the first ``l`` segments together differ in at most
``l * d / m`` bits (the pigeonring principle; the pigeonhole principle is its case ``l = 1``). With ``m = d + 1``
the first segment of the chain must be equal and the first two may differ in one bit, so both together are a
join key: one side states its key, the other side also states every key that is one bit away. The rest of the
chain and the full distance are checked on the joined pairs.

Equal fingerprints are one node, whatever number of documents has them, so copies never meet in pairs; the
distinct fingerprints within ``d`` bits of one are bounded in number, and so are the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import star_roots
from .common import OWN, discard, staged

BITS = 64
_BLOCK = 1 << 16  # shingles whose bits are unpacked at a time


def text_fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of an ASCII-lower-cased text, as a signed long."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    elif shingle == 1:
        grams = words
    else:
        grams = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), "<u8", len(grams)))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed long."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), _BLOCK):
        block = h[i:i + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, name: str, shingle: int, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """``docs`` with an array of longs ``name``, one fingerprint of ``text`` for each seed.

    A null text counts as empty; a text without words has fingerprint 0.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[text_fingerprint(x or b"", shingle, s) for s in seeds] for x in b.column(at).to_pylist()]
            columns = [c.cast(pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, name])

    out = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, out)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``distance + 1`` ring segments, as even as possible."""
    m = distance + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(x: Column, part: tuple[int, int]) -> Column:
    first, width = part
    mask = (1 << width) - 1
    return F.shiftrightunsigned(x, first).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _within_one(x: Column, width: int) -> Column:
    """``x`` and, for each unset bit, ``x`` with that bit set: of two values one bit apart, one names both."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(width)])
    return F.transform(F.filter(masks, lambda bit: x.bitwiseAND(bit) == 0), lambda bit: x.bitwiseOR(bit))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct longs in ``prints.fp`` that differ in at most ``distance`` bits.

    Exact: every such pair is found. Both steps of a chain are one equi-join key of about
    ``128 / (distance + 1)`` bits.
    """
    ring = segments(distance)
    m = len(ring)
    fp = F.col("fp")
    if distance == 0:
        return prints.select(fp.alias("u"), fp.alias("v")).limit(0)

    def key(i: int, second: Column) -> Column:
        return F.struct(F.lit(i).alias("i"), _segment(fp, ring[i]).alias("a"), second.alias("b"))

    nexts = [(i, ring[(i + 1) % m]) for i in range(m)]
    stated = prints.select(fp.alias("v"), F.explode(F.array(*[key(i, _segment(fp, part)) for i, part in nexts])).alias("k"))

    def probe(i: int, part: tuple[int, int]) -> Column:
        return F.transform(_within_one(_segment(fp, part), part[1]), lambda second: key(i, second))

    probes = [probe(i, part) for i, part in nexts]
    asked = prints.select(fp.alias("u"), F.explode(F.concat(*probes)).alias("k"))

    u, v = F.col("u"), F.col("v")
    x = u.bitwiseXOR(v)
    chain = F.lit(False)
    for i in range(m):
        ok, seen = F.lit(True), F.lit(0)
        for l in range(1, m + 1):
            seen = seen + F.bit_count(_segment(x, ring[(i + l - 1) % m]))
            ok = ok & (seen <= l * distance // m)
        chain = chain | ((F.col("k.i") == i) & ok)
    pairs = asked.join(stated, "k").filter((u != v) & chain & (_distance(u, v) <= distance))
    return pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def classes(rows: DataFrame, distance: int = 2) -> DataFrame:
    """(fp, component_id) for every fingerprint in ``rows`` (doc_id, fp): the smallest doc_id that can be reached.

    Null doc_ids do not count as smallest; a class that has no other gets null. A repeated row changes nothing.
    """
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = links(nodes.select("fp"), distance)
    roots = star_roots(edges, [])
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return staged(grouped.join(named, "root").select("fp", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    A null text is an empty one. Texts without words all have fingerprint 0 and so form one class. Rows with a null
    doc_id take part and get the class of their fingerprint. Extra columns are ignored; repeated rows give repeated rows;
    an empty table gives an empty result.
    """
    rows = with_fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", F.col("fp")[0].alias("fp"))
    rows = staged(rows, "simhash-prints")
    return rows.join(classes(rows, distance), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies share at least ALIKE[0] / ALIKE[1] of their distinct five-word shingles.
ALIKE = (4, 5)
WORDS = 5  # of a shingle
BANDS, ROWS = 40, 5  # a pair at four fifths shares no key once in 8 million (0.672 ** 40), whatever kind of edit made it

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct five-word shingles of an ASCII-lower-cased text, sorted; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k in range(WORDS):
        h += w[k:k + n] * _ODD[k]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One hash for each band of MinHash values: two sets share a band with the ROWS-th power of their Jaccard similarity."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), _BLOCK >> 5):
        least = np.minimum(least, ((grams[i:i + (_BLOCK >> 5), None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    keys = (least.reshape(BANDS, ROWS) * _ODD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[1]
    keys ^= keys >> np.uint64(32)
    return keys * _ODD[0]


def _by_text(docs: DataFrame, columns: list[T.StructField], run) -> DataFrame:
    """``docs`` with ``columns`` in place of ``text``: lists of ``run`` (text) for each row."""
    at = docs.columns.index("text")
    others = [i for i in range(len(docs.columns)) if i != at]
    schema = T.StructType([*[docs.schema.fields[i] for i in others], *columns])
    kinds = [pa.list_(pa.int64()) if isinstance(c.dataType, T.ArrayType) else pa.int64() for c in columns]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [run(x or b"") for x in b.column(at).to_pylist()]
            new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in others], *new], schema.names)

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(mapped, schema)


SKETCH = 4  # longs of a parity sketch


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall to each bit: two sketches differ in no more bits than their sets in shingles."""
    at = _mixed(grams) % np.uint64(64 * SKETCH)
    odd = np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


FILTER = 1 << 18  # longs of the bits that tell which texts are wanted


def wanted(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``texts`` (tkey, ...) with one of ``keys`` (tkey), and a few others: one bit for each hash, FILTER longs at most, goes to all tasks.

    What is left is joined by its full key; so only wanted texts are shuffled, however many keys there are.
    """
    word = F.pmod(F.shiftrightunsigned("tkey", 6), F.lit(FILTER)).alias("word")
    bits = keys.groupBy(word).agg(F.expr("bit_or(shiftleft(1L, int(tkey & 63)))").alias("bits"))
    return texts.withColumn("word", word).join(F.broadcast(bits), "word").filter("getbit(bits, int(tkey & 63)) = 1").drop("word", "bits")


def gram_sets(nodes: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Staged (node, grams, sketch): the distinct shingles of each of ``nodes`` (node), from one of its ``texts`` (tkey, text)."""
    keys = staged(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("tkey").alias("tkey")), "near-wanted")

    def found(text: bytes) -> list:
        grams = shingles(text)
        return [grams.view(np.int64), sketch(grams)]

    sets = _by_text(wanted(texts, keys).join(keys, "tkey").select("node", "text"), [T.StructField(c, T.ArrayType(T.LongType())) for c in ("grams", "sketch")], found)
    sets = staged(sets.dropDuplicates(["node"]), "near-sets")
    discard(keys)
    return sets


def _near_sketches(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles with these sketches can be alike: alike sets differ in a ninth of n + m at most."""
    p, q = ALIKE
    apart = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH)), F.lit(0))
    return (p + q) * apart <= (q - p) * (n + m)


def _near_sizes(a: Column, b: Column) -> Column:
    """Whether sets of so many shingles can be alike."""
    p, q = ALIKE
    return (q * a >= p * b) & (q * b >= p * a)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) of nodes whose ``sets`` (node, grams) are alike, decided exactly."""
    left, right = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    a, b = F.size("a"), F.size("b")
    p, q = ALIKE
    # shared / (a + b - shared) >= p / q
    both = pairs.join(left, "u").join(right, "v")
    return both.filter((p + q) * F.size(F.array_intersect("a", "b")) >= p * (a + b)).select("u", "v")


def rare_meetings(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of nodes of different components in ``open_`` (node, root) that may be alike, by prefix filtering.

    Shingles are ordered by how many of the ``sets`` have them. Of two alike sets of n <= m shingles the smaller has a common one
    among its first n/9 + 1 and the larger among its first m/5 + 1, and what follows there is enough for the similarity. Pairs whose
    sketches, where ``sets`` have them, differ in more bits than alike sets can in shingles are left out as well. So texts meet at rare shingles, and passages that many texts share make no pairs. Shingles of one set or one component are left out,
    and of a component that has most texts of a shingle no two texts are compared.
    """
    p, q = ALIKE
    said = sets.join(open_, "node").select("node", "root", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    freq = staged(sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "near-freq")
    own = W.partitionBy("node")
    # shingles of one set come first in every order, those of several follow by frequency
    placed = said.join(freq, "gram").select("*", F.count(F.lit(1)).over(own).alias("common"), F.row_number().over(own.orderBy("f", "gram")).alias("place"))
    placed = placed.withColumn("at", F.col("n") - F.col("common") + F.col("place")).filter(F.col("at") <= F.floor(F.col("n") * (q - p) / q) + 1)
    placed = staged(placed.select("gram", "node", "root", "n", "at"), "near-rare")
    by_root = placed.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = by_root.groupBy("gram").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("c", "root")).alias("most")).filter("roots > 1")
    staged_meeting = staged(placed.join(mixed.select("gram", "most"), "gram"), "near-meeting")
    sketched = "sketch" in sets.columns
    meeting = staged_meeting.join(sets.select("node", "sketch"), "node") if sketched else staged_meeting.withColumn("sketch", F.lit(None))
    x = meeting.filter("root <> most").select("gram", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "n", "at", "sketch")])
    y = meeting.select("gram", *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "n", "at", "sketch")])
    n, m, i, j = F.col("x_n"), F.col("y_n"), F.col("x_at"), F.col("y_at")
    smaller = F.when(n != m, n < m).otherwise(F.col("x_node") < F.col("y_node"))
    first = F.when(smaller, i <= F.floor(n * (q - p) / (q + p)) + 1).otherwise(j <= F.floor(m * (q - p) / (q + p)) + 1)
    enough = (p + q) * (1 + F.least(n - i, m - j)) >= p * (n + m)
    pairs = x.join(y, "gram").filter((F.col("x_root") != F.col("y_root")) & _near_sizes(n, m) & first & enough)
    if sketched:
        pairs = pairs.filter(_near_sketches(F.col("x_sketch"), F.col("y_sketch"), n, m))
    pairs = staged(pairs.select(F.least("x_node", "y_node").alias("u"), F.greatest("x_node", "y_node").alias("v")).distinct(), "near-more")
    discard(freq, placed, staged_meeting)
    return pairs


def chain_meetings(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (u, v), u < v, of ``nodes`` (node, n, fp) whose fingerprints pigeonring chains link, two for each node at most.

    Every node meets the least one of its fingerprint and the least one of its component of fingerprints.
    """
    prints = staged(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lead")), "near-prints")
    roots = star_roots(links(prints.select("fp"), distance), [])
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("lead").alias("first"))
    leads = rooted.join(firsts, "root").select("fp", F.explode(F.array_distinct(F.array("lead", "first"))).alias("lead"))
    pairs = nodes.join(leads, "fp").filter((F.col("node") > F.col("lead.node")) & _near_sizes(F.col("n"), F.col("lead.n")))
    pairs = staged(pairs.select(F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct(), "near-chains")
    discard(prints)
    return pairs


def near_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Staged links (u, v) between the nodes of ``rows`` (node, tkey, n, keys) that join up the same nodes as all links of near copies do.

    First the nodes meet whose SimHash, where ``rows`` have it as fp, is linked by pigeonring chains, and every node meets the
    least one under each of its keys, so that large groups become one component without pairs. Nodes of keys at which components still meet are compared where they share a rare shingle.
    """
    said = rows.select("node", "n", "keys").dropDuplicates(["node"]).select("node", "n", F.explode("keys").alias("key"))
    leads = said.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).filter("lead.node < last").select("key", "lead")
    shared = staged(said.join(leads, "key"), "near-shared")
    pairs = shared.filter(F.col("node") != F.col("lead.node")).filter(_near_sizes(F.col("n"), F.col("lead.n")))
    pairs = pairs.select(F.col("lead.node").alias("u"), F.col("node").alias("v"))
    chains = chain_meetings(rows.select("node", "n", "fp").distinct()) if "fp" in rows.columns else pairs.limit(0)
    pairs = staged(pairs.union(chains).distinct(), "near-pairs")
    discard(chains)
    sets = gram_sets(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), texts, rows)
    found = staged(alike(pairs, sets), "near-links")
    discard(pairs, sets)
    roots = star_roots(found, [])
    rooted = staged(shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-rooted")
    discard(shared)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    still = staged(rooted.join(mixed, "key", "left_semi").select("node", "root").distinct(), "near-open")
    discard(rooted)
    sets = gram_sets(still.select("node"), texts, rows)
    more = rare_meetings(still, sets)
    links = staged(found.union(alike(more, sets)), "near-all")
    discard(found, still, sets, more)
    return links


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest doc_id, columns unchanged.

    Near copies share four fifths or more of their distinct five-word shingles, and a class is what a chain of near copies
    joins. Candidates are the texts whose SimHash of these shingles is linked by pigeonring chains at 2 bits. Edits that move more
    bits are found by a band of MinHash values of the same shingles, which feels the share alone and not what kind of edit made it;
    each pair is decided by the exact share. Texts with the same shingles are one node, told apart by 128
    bits.

    Of rows that repeat a doc_id and a text one stays. Where no row of a class has a doc_id, one of its texts stays.
    Null texts count as empty, and texts without words are copies of each other.
    """
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(said).alias("tkey"), said.alias("text"))

    def keyed(text: bytes) -> list:
        grams = shingles(text)
        return [len(grams), *[xxhash.xxh64_intdigest(grams.tobytes(), seed) - (1 << 63) for seed in (0, 1)], majority(grams), band_keys(grams).view(np.int64)]

    fields = [*[T.StructField(n, T.LongType()) for n in ("n", "node", "check", "fp")], T.StructField("keys", T.ArrayType(T.LongType()))]
    rows = staged(_by_text(docs.select("doc_id", F.xxhash64(said).alias("tkey"), said.alias("text")), fields, keyed), "near-rows")
    # sets that differ in the second hash alone get names of their own
    clashes = rows.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least <> most").select("node", "least")
    clashes = staged(clashes, "near-clashes")
    rows = rows.join(clashes, "node", "left").withColumn(
        "node", F.when(F.col("check") != F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("check", "least")
    links = near_links(rows, texts)
    roots = star_roots(links, [])
    # null doc_ids come last
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("best")
    nodes = rows.groupBy("node").agg(best)
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    none, some = F.col("doc_id").isNull().alias(f"{OWN}none"), F.coalesce("doc_id", F.lit(0)).alias(f"{OWN}id")
    kept = staged(grouped.select("best.doc_id", F.col("best.tkey").alias(f"{OWN}tkey")).select(none, some, f"{OWN}tkey"), "near-kept")
    # the join and the removal of repeated rows have the same keys, so that texts are shuffled once
    full = docs.select("*", none, some, F.xxhash64(said).alias(f"{OWN}tkey"))
    return full.join(kept, kept.columns, "left_semi").dropDuplicates(kept.columns).select(*docs.columns)
