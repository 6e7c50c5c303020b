"""Token ids on disk: frequency ranks in byte-aligned variable-length coding with separate control bytes.

The most frequent id of the corpus gets rank 0, and ranks take one to four bytes. The lengths of four ranks are two bits
each of a control byte; control bytes and data bytes lie apart, so that a block is decoded by looking its control bytes up
in a table, without a loop over tokens.

A dataset is a folder of two tables. ``blocks`` has one encoded block to a row: the range of documents it came from (part),
the number of ids before it in the dataset (start), and the payload:

    4 bytes  "FVB1"
    u32      documents d          u32      tokens n
    d x i64  doc_id               d x u8   1 where the doc_id is null        d x u32  tokens of the document
    ceil(n / 4) control bytes     data bytes

all little-endian. ``ranks`` has the id of each rank. Blocks are written by Spark's own committed writer, so a lost or
repeated task leaves no half file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir
from .common import OWN, raw, staged
from .tokens import vocabulary_path, word_ids

MAGIC = b"FVB1"
END_ID = 1
ROWS = 256  # documents that a task tokenises before it hands them on
BLOCK = 1 << 18  # tokens after which a block is closed; a document is never divided

# what a control byte says of its four ranks: their widths, where each begins, and the bytes of all four
_CODES = np.arange(256)
_WIDTHS = np.stack([(_CODES >> 2 * i & 3) + 1 for i in range(4)], axis=1).astype(np.int64)
_BEGINS = np.cumsum(_WIDTHS, axis=1) - _WIDTHS
_LENGTHS = _WIDTHS.sum(axis=1)


def encode_ranks(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    r = ranks.astype("<u4")
    n = len(r)
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = extra
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = r.view(np.uint8).reshape(n, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes() + data.tobytes()


def decode_ranks(body: bytes, n: int) -> np.ndarray:
    """Inverse of encode_ranks for ``n`` ranks."""
    m = -(-n // 4)
    control = np.frombuffer(body, np.uint8, m)
    data = np.frombuffer(body + b"\0\0\0\0\0\0\0", np.uint8, offset=m)
    lengths = _LENGTHS[control]
    begin = ((np.cumsum(lengths) - lengths)[:, None] + _BEGINS[control]).ravel()[:n]
    width = _WIDTHS[control].ravel()[:n]
    out = data[begin].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        out[more] |= data[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, rank_of: np.ndarray) -> bytes:
    head = MAGIC + struct.pack("<II", len(doc_ids), len(ids))
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids),
        np.array(lengths, "<u4").tobytes(), encode_ranks(rank_of[ids]),
    ])


def decode_block(payload: bytes, id_of: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a block's documents, in order."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    d, n = struct.unpack_from("<II", payload, 4)
    at = 12
    doc_ids = np.frombuffer(payload, "<i8", d, at).tolist()
    none = payload[at + 8 * d:at + 9 * d]
    lengths = np.frombuffer(payload, "<u4", d, at + 9 * d).tolist()
    ids = id_of[decode_ranks(payload[at + 13 * d:], n)]
    done = 0
    for doc_id, null, length in zip(doc_ids, none, lengths):
        yield None if null else doc_id, ids[done:done + length]
        done += length


def tokenise(docs: DataFrame, vocabulary: str | None, end_id: int, partitions: int | None) -> DataFrame:
    """(part, doc_id, before, n, ids) in ascending order of doc_id; before counts the ids of a part's earlier documents.

    The n ids of a document are little-endian unsigned, of 16 bits where the vocabulary fits into them, else of 32.
    """
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select("doc_id", raw().alias("body")).withColumn(f"{OWN}h", F.xxhash64("body"))
    rows = rows.repartitionByRange(n, "doc_id", f"{OWN}h").sortWithinPartitions("doc_id", f"{OWN}h", "body").select("doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(vocabulary or vocabulary_path())
        kind = "<u2" if max(cache.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
        width = np.dtype(kind).itemsize
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                some = b.slice(i, ROWS)
                ids, counts = cache.encode_all(some.column(1).to_pylist(), end_id)
                upto = np.cumsum(counts)
                packed = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(np.append(0, upto * width).astype("<i4")), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(counts), pa.int32()), some.column(0), pa.array(before + upto - counts), pa.array(counts), packed],
                    ["part", "doc_id", "before", "n", "ids"])
                before += int(upto[-1])

    return rows.mapInArrow(run, "part int, doc_id long, before long, n long, ids binary")


def _staged_ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch that ends with the columns n and ids, and where those of each row end."""
    upto = np.cumsum(b.column(b.num_columns - 2).to_numpy())
    packed = b.column(b.num_columns - 1).cast(pa.large_binary())
    ends = np.frombuffer(packed.buffers()[1], "<i8", len(packed) + 1, 8 * packed.offset)
    width = (ends[-1] - ends[0]) // upto[-1]  # that of all ids; each document has one at least
    return np.frombuffer(packed.buffers()[2], f"<u{width}", upto[-1], ends[0]), upto


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs. Tasks add up their own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for some in (b.slice(i, ROWS) for i in range(0, b.num_rows, ROWS)):
                own = np.bincount(_staged_ids(some)[0], minlength=len(total))
                own[:len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Writes the dataset of all rows of ``docs`` (doc_id, text) below ``path``.

    A null text counts as empty and has the end id alone; rows with a null doc_id come first; rows that share a doc_id are
    ordered by text and stay apart; extra columns are ignored; an empty table gives a dataset without blocks.

    The ranks, as many as the vocabulary has ids at most, and the first start of each part are what reaches the driver.
    """
    tokens = staged(tokenise(docs, vocabulary, end_id, partitions), "tokens")
    ranked = count_ids(tokens).orderBy(F.desc("n"), "id").collect()
    id_of = np.array([r["id"] for r in ranked], np.int64)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    start_of, total = {}, 0
    for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        start_of[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, size, docs_, lengths, ids_ = None, 0, 0, [], [], []

        def closed() -> pa.RecordBatch:
            body = encode_block(docs_, lengths, np.concatenate(ids_), rank_of)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([body], pa.binary())], ["part", "start", "payload"])

        for some in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids, upto = _staged_ids(some)
            begin = done = 0  # the ids of these rows that are in ids_, and those that have been looked at
            for p, doc_id, before, n, end in zip(*[c.to_pylist() for c in some.columns[:4]], upto.tolist()):
                if docs_ and (p != part or size >= BLOCK or before + start_of[p] != start + size):
                    ids_.append(ids[begin:done])
                    begin = done
                    yield closed()
                    docs_, lengths, ids_ = [], [], []
                if not docs_:
                    part, start, size = p, start_of[p] + before, 0
                docs_.append(doc_id)
                lengths.append(n)
                size += n
                done = end
            ids_.append(ids[begin:])
        if docs_:
            yield closed()

    spark = docs.sparkSession
    tokens.mapInArrow(run, "part int, start long, payload binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(id_of)], "rank int, id long")
    table.coalesce(1).write.parquet(f"{path}/ranks")


def _read(spark: SparkSession, path: str, names: list[str], made, schema: str) -> DataFrame:
    """A dataset's documents: doc_id, start and the columns that ``made`` gives for each document's ids."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranks], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for doc_id, own in decode_block(payload, id_of):
                    rows.append((doc_id, start, *made(own)))
                    start += len(own)
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], names)

    return spark.read.parquet(f"{path}/blocks").select("start", "payload").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids as little-endian unsigned 32-bit bytes) of a dataset's documents."""
    return _read(spark, path, ["doc_id", "start", "ids"], lambda ids: (ids.tobytes(),), "doc_id long, start long, ids binary")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs``, reads the files back and gives doc_id, start, n_tokens and ids_crc32 of each document read."""
    path = run_dir(docs.sparkSession, "llm-token-files")
    write_tokens(docs, path, vocabulary)
    return _read(docs.sparkSession, path, ["doc_id", "start", "n_tokens", "ids_crc32"], lambda ids: (len(ids), zlib.crc32(ids)),
                 "doc_id long, start long, n_tokens long, ids_crc32 long")
