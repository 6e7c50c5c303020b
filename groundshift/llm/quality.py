"""Quality by weak supervision: rules vote good, bad or nothing, expectation-maximisation learns how far to trust
each of them, and a posterior probability decides.

The model is a mixture of two classes. How often a rule votes in each class is estimated from how the rules agree over
all documents; a rule that abstains says nothing. The vote patterns of the
whole corpus are counted by Spark; there are at most 3 to the number of rules of them, whatever the input, and only
these counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, staged

WINDOW = 5
_WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LETTERS = _UPPER + _UPPER.lower()

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_letters",
           "n_shouted", "n_distinct"]


def _covered(repeated: np.ndarray, n: int) -> int:
    """Words that lie in one of the windows whose start is marked."""
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def _named(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1]


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """(words in five-word windows that occur twice or more, the first occurrence included; distinct words)."""
    n = len(words)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if n <= WINDOW:
        return 0, len(names)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        sums = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            sums = sums * np.uint64(0xBF58476D1CE4E5B9) + mixed[i:n - WINDOW + 1 + i]
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():  # equal windows have equal sums
        return 0, len(names)
    pairs = _named(ids[:-1] * len(names) + ids[1:])
    fours = _named(pairs[:-2] * (n + 1) + pairs[2:])
    fives = fours[:-1] * len(names) + ids[WINDOW - 1:]
    _, at, count = np.unique(fives, return_inverse=True, return_counts=True)
    return _covered(count[at] > 1, n), len(names)


def measure(text: str | None) -> tuple[int, ...]:
    """The values of METRICS for one text; null counts as empty."""
    body = (text or "").encode()
    words = body.split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    repeats, distinct = repeat_words(words)
    white = len(body) - len(body.translate(None, _WHITE))
    return (
        len(words), len(text or "") - white, len(body) - len(body.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats,
        len(lines), sum(x.rstrip()[-1] in b".!?:;" for x in lines), len(body) - len(body.translate(None, _UPPER)),
        len(body) - len(body.translate(None, _LETTERS)), body.count(b"!!") + body.count(b"??"), distinct,
    )


def with_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with one long column for each of METRICS, whose names start with the package's own prefix."""
    at = docs.columns.index("text")
    names = [OWN + m for m in METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(x) for x in b.column(at).to_pylist()]
            own = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]]))


def m(name: str) -> Column:
    return F.col(OWN + name)


def rules() -> dict[str, Column]:
    """The votes: 1 good, -1 bad, 0 none. Most rules only ever say bad: passing one proves nothing."""
    n, lines, letters = m("n_words"), m("n_lines"), m("n_letters")
    ended = 2 * m("n_ended_lines") >= lines
    bad = {
        "length": n < 10,
        "word_length": (m("word_chars") < 2 * n) | (m("word_chars") > 15 * n),
        "symbols": 10 * m("n_symbols") > n,
        "duplicate_lines": 10 * m("n_dup_lines") > 3 * lines,
        "repeated_windows": 5 * m("n_repeat_words") > n,
        "capitals": 10 * m("n_upper") > 3 * letters,
        "shouting": 20 * m("n_shouted") > n,
        "variety": (5 * m("n_distinct") < n) & (n >= 50),
    }
    good = {
        "prose": ended & (n >= 20) & (50 * m("n_symbols") <= n),
    }
    return {k: F.when(v, -1).otherwise(0) for k, v in bad.items()} | {k: F.when(v, 1).otherwise(0) for k, v in good.items()}


@dataclass(frozen=True)
class Votes:
    """What EM learned: the share of good documents, and for each rule how often it votes in either class."""

    good: float
    if_good: tuple[float, ...]
    if_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for v, p, q in zip(votes, self.if_good, self.if_bad):
            odds = odds + F.when(v != 0, math.log(p / q)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, trust: float = 0.5) -> Votes:
    """EM over counted vote patterns; it starts from "bad if any rule says bad".

    The share of good documents is held near that of documents without a bad vote (a prior worth as many documents as there
    are) and not below a half, so that a document without votes stays. Each rule brings a prior worth ``trust`` of the documents that it is right nine times in ten, and is never read
    against its own word. Abstaining is not scored, since junk of one kind is silent under the rules for another.
    """
    if not patterns:
        return Votes(0.5, (), ())
    patterns = sorted(patterns)
    v = np.array([p for p, _ in patterns], np.int64)
    w = np.array([c for _, c in patterns], np.float64)
    says_bad, voted = (v < 0).any(axis=0), v != 0
    share = w @ voted / w.sum()
    blamed = (v < 0).any(axis=1)
    unblamed = min(max(float(w @ ~blamed), 0.01 * w.sum()), 0.99 * w.sum())
    r = np.where(blamed, 0.1, 0.95)
    for _ in range(rounds):
        g, b = w * r, w * (1 - r)
        good = max((g.sum() + unblamed) / (2 * w.sum()), 0.5)
        prior = trust * w.sum() * np.maximum(share, 1e-6)
        wrong, right = 0.1 * prior, 0.9 * prior
        p = np.minimum((g @ voted + np.where(says_bad, wrong, right) + 1e-3) / (g.sum() + trust * w.sum() * good + 1), 1 - 1e-6)
        q = np.minimum((b @ voted + np.where(says_bad, right, wrong) + 1e-3) / (b.sum() + trust * w.sum() * (1 - good) + 1), 1 - 1e-6)
        p, q = np.where(says_bad, np.minimum(p, q), np.maximum(p, q)), np.where(says_bad, np.maximum(p, q), np.minimum(p, q))
        odds = math.log(good / (1 - good)) + np.where(voted, np.log(p / q), 0.0).sum(1)
        now = 1 / (1 + np.exp(-odds))
        if np.abs(now - r).max() < 1e-9:
            break
        r = now
    return Votes(float(good), tuple(map(float, p)), tuple(map(float, q)))


def learn(measured: DataFrame) -> Votes:
    """Counts the vote patterns of all rows and fits the model on the counts."""
    votes = rules()
    counted = measured.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count()
    return fit([(tuple(row[k] for k in votes), row["count"]) for row in counted.collect()])


def base_failed() -> Column:
    return (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))


def judge(measured: DataFrame, model: Votes, least: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (posterior probability of a good document) and kept, under the package's own prefix."""
    quality = model.posterior(list(rules().values())) if model.if_good else F.lit(0.5)
    kept = ~base_failed() & (F.col(f"{OWN}quality") >= least)
    return measured.withColumn(f"{OWN}quality", quality).withColumns({f"{OWN}base_failed": base_failed(), f"{OWN}kept": kept})


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, the five base counts, base_failed, kept and quality.

    A null text has no words and so fails; a null doc_id stays null; repeated rows are judged each; extra columns are ignored;
    an empty table gives an empty result.
    """
    measured = staged(with_metrics(docs.select("doc_id", "text")).drop("text"), "quality-metrics")
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(measured, learn(measured)).select("doc_id", *[F.col(OWN + c).alias(c) for c in own])


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, columns unchanged.

    The texts are measured twice (to count the votes and to decide) rather than stored a second time.
    """
    model = learn(with_metrics(docs.select("text")))
    return judge(with_metrics(docs), model).filter(f"{OWN}kept").select(*docs.columns)
