import itertools
import math
import re
from collections import Counter


from groundshift.llm import quality

from .helpers import ODD, SF, docs

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    w = re.findall(WORD, text or "")
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_base_counts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    texts = d.collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.report(d).collect())
    want = Counter()
    for r in texts:
        b = plain(r.text)
        want[(r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want


def test_verdict_follows_the_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.report(d).join(labels.withColumnRenamed("quality", "label"), "doc_id").filter("not base_failed").collect()
    right = sum(r.kept == (r.label == 1) for r in rows)
    assert right >= 0.97 * len(rows)
    assert sum(not r.kept for r in rows if r.label == 1) <= 0.01 * len(rows)


def test_posterior_is_that_of_the_model(spark):
    d = quality.with_metrics(spark.read.parquet(f"{SF}/documents.parquet"))
    model = quality.learn(d)
    votes = quality.rules()
    rows = quality.judge(d, model).select("_gs_llm_quality", *[v.alias(k) for k, v in votes.items()]).collect()
    for r in rows:
        odds = math.log(model.good / (1 - model.good))
        odds += sum(math.log(p / q) for k, p, q in zip(votes, model.if_good, model.if_bad) if r[k] != 0)
        assert math.isclose(r[0], 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_fit_finds_the_unreliable_rule():
    # three rules know one document in ten to be bad, a fourth one says so of every fifth document, whatever it is
    rows = {}
    for bad in (0, 1):
        for votes in itertools.product((-1, 0), repeat=4):
            n = 10000 * (0.1 if bad else 0.9)
            for v, hit in zip(votes, (0.8 if bad else 0.01,) * 3 + (0.2,)):
                n *= hit if v else 1 - hit
            rows[votes] = rows.get(votes, 0) + n
    model = quality.fit(list(rows.items()))
    trust = [q / p for p, q in zip(model.if_good, model.if_bad)]
    assert min(trust[:3]) > 3 * trust[3]


def test_filter_keeps_columns_and_nothing_else(spark):
    d = docs(spark, [*ODD, (9, "Plain words that make a sentence of some length, and then some more of them."), (10, "!! ## ** " * 30)])
    got = quality.keep_good(d)
    assert got.columns == d.columns
    assert {r.doc_id for r in got.collect()} == {9}


def test_empty_table(spark):
    d = docs(spark, [])
    assert quality.report(d).count() == 0
    assert quality.keep_good(d).count() == 0
    assert quality.report(d).schema["n_words"].dataType.simpleString() == "bigint"
