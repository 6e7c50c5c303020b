import random
import re
import zlib
from collections import Counter

from groundshift.llm import variants

from .helpers import ODD, SF, docs


def counted(rows, typo=199, least=6):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall(variants.LETTERS, text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % typo == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                out[w] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def grouped(words, times=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, all_ in near.items():
        best = min(all_, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_whole_table_against_all_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    words = {w: n for w, n in counted([(r.doc_id, r.text) for r in d.collect()]).items() if n >= 5}
    assert found(variants.group(d)) == grouped(words)
    assert any(form for form, *_ in found(variants.group(d)).values())


def test_near_pairs_of_random_words(spark):
    rng = random.Random(3)
    words = set()
    while len(words) < 900:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(2, 9)))
        words.add(w)
    df = spark.createDataFrame([(w, rng.randint(1, 50)) for w in sorted(words)], "word string, n long")
    got = [frozenset((r.r, r.s)) for r in variants.near_pairs(df).collect()]
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_chain_of_forms_and_ties(spark):
    rows = [(1, "abcdefg " * 200 + "abcdefx " * 30 + "abcdeyx " * 5), (2, "mnopqr " * 5 + "mnopqs " * 25 + "mnopqt " * 25)]
    got = found(variants.group(docs(spark, rows), typo=10**10))
    assert got["abcdeyx"][:2] == ("abcdefx", "abcdefg") and got["abcdefx"][:2] == ("abcdefg", "abcdefg")
    assert got["abcdefg"][0] is None and got["abcdefg"][1] == "abcdefg"
    assert got["mnopqr"] == ("mnopqs", "mnopqs", 5, 2, 25)


def test_one_first_half_shared_by_all(spark):
    rng = random.Random(9)
    words = {"aaaaaa" + "".join(rng.choice("bcdefgh") for _ in range(6)) for _ in range(3000)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {frozenset((r.r, r.s)) for r in variants.near_pairs(df).collect()}
    want = {frozenset((w, w[:i] + c + w[i + 1:])) for w in words for i in range(12) for c in "abcdefgh" if c != w[i] and w[:i] + c + w[i + 1:] in words}
    assert got == want and want


def test_odd_rows(spark):
    rows = ODD + [(None, "Größere größere " * 5)]
    want = {w: n for w, n in counted(rows).items() if n >= 5}
    assert found(variants.group(docs(spark, rows))) == grouped(want)
    assert variants.group(docs(spark, [])).count() == 0
