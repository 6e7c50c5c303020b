"""Spelling variants: corpus words that differ by one edit, by asymmetric q-chunks, and the form each one stands for.

Two words are near if one inserted, deleted or replaced code point makes one the other. Of such a pair the longer word (of two
equally long ones the smaller) gives chunks: its first and its last half, which do not overlap. One edit touches one of them at
most, so the other one is a gram of the shorter word, at the chunk's own place or one before it. The shorter word gives its
positional grams under the lengths that its partner may have. Which of the two shifts applies follows from the two lengths, so
length, place and shift are part of the key: an equi-join finds all near pairs, and each is verified by its edit distance.
Chunks are half a word long, which keeps the words that share one few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, raw, staged

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6  # code points of a word
LEAST_COUNT = 5  # occurrences of a word
TIMES = 5  # a form is at least so many times as frequent
TYPO = 199  # one of so many (document, run) pairs loses a code point
_HELD = 400_000  # words that a task adds up before it hands them on


def count_words(docs: DataFrame, typo: int = TYPO, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all texts of ``docs`` (doc_id, text), words of fewer than ``least_length`` code points left out.

    A run of letters has its A-Z lowered; if ``typo`` divides h, the CRC-32 of ``<doc_id>:<run>``, its code point h modulo its
    length is deleted. A null doc_id is written as nothing. Tasks add up their own words first.
    """
    find = re.compile(LETTERS).findall

    def given(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                begun = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(find(body.lower().decode("utf-8", "replace"))).items():
                    size = len(word)
                    if size < least_length:
                        continue
                    h = zlib.crc32(word.encode(), begun)
                    if h % typo == 0:
                        if size == least_length:
                            continue
                        at = h % size
                        word = word[:at] + word[at + 1:]
                    held[word] += n
                if len(held) > _HELD:
                    yield given(held)
                    held.clear()
        if held:
            yield given(held)

    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("body"))
    return said.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _key(size: Column, part: int, chunk: Column) -> Column:
    return F.struct(size.alias("size"), F.lit(part).alias("part"), chunk.alias("chunk"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(r, rn, s, sn): each unordered pair of different ``words`` (word, n) that are one edit apart, once.

    Exact for words of two code points and more. A chunk that very many words share is an ordinary skewed join key.
    """
    word, size = F.col("word"), F.char_length("word")
    half = F.floor(size / 2).cast("int")
    chunks = F.array(_key(size, 0, F.substring(word, F.lit(1), half)), _key(size, 1, F.substring(word, size - half + 1, half)))
    r = words.select(word.alias("r"), F.col("n").alias("rn"), F.explode(chunks).alias("key"))

    def grams(longer: int) -> list[Column]:
        """Grams of a word for partners that are ``longer`` by so many code points."""
        theirs = size + longer
        q = F.floor(theirs / 2).cast("int")
        return [_key(theirs, 0, F.substring(word, F.lit(1), q)), _key(theirs, 1, F.substring(word, theirs - q - longer + 1, q))]

    s = words.select(word.alias("s"), F.col("n").alias("sn"), F.explode(F.array(*grams(0), *grams(1))).alias("key"))
    length = F.floor(F.col("key.size") / 2).cast("int")
    new = (F.col("key.part") == 0) | (F.substring(F.col("r"), F.lit(1), length) != F.substring(F.col("s"), F.lit(1), length))
    once = (F.char_length("r") > F.char_length("s")) | (F.col("r") < F.col("s"))
    found = r.join(s, "key").filter(once & new & (F.levenshtein("r", "s", 1) == 1))
    return found.select("r", "rn", "s", "sn")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that can be reached from each word of ``forms`` (word, form), by pointer doubling.

    A form is more frequent than its word, so there are no circles; with a factor of five a chain has 27 steps at most,
    which five rounds cover.
    """
    held = staged(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "variant-roots")
        discard(held)
        if moved.filter("more").isEmpty():
            return moved.select("word", "root")
        held = moved


def group(docs: DataFrame, typo: int = TYPO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that occurs ``least_count`` times in ``docs`` (doc_id, text).

    ``form`` is a word's most frequent near word (of equally frequent ones the smallest in code-point order) if it is at least
    ``times`` as frequent, else null, and ``form_n`` how often that one occurs; ``root`` is where following forms ends.
    Null and empty texts have no words; repeated rows count again; extra columns are ignored; an empty table gives no words.
    """
    words = staged(count_words(docs, typo, least_length).filter(F.col("n") >= least_count), "variant-words")
    pairs = near_pairs(words)
    sides = F.array(F.struct(F.col("r").alias("word"), F.col("s").alias("near"), F.col("sn").alias("m")),
                    F.struct(F.col("s").alias("word"), F.col("r").alias("near"), F.col("rn").alias("m")))
    best = pairs.select(F.inline(sides)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= times * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, -F.col("best.m")).alias("form_n"))
    found = staged(found, "variant-forms")
    roots = follow(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
