import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from groundshift.llm import fingerprints

from .helpers import ODD, SF, docs


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def plain(rows):
    """(n_chars, sha, fingerprint, edited fingerprint, near_edited, near_next) of (doc_id, text) rows of different doc_ids."""
    df = Counter(w for _, t in rows for w in set(low(t)))

    def bits(text):
        votes = [0] * 128
        for w, n in Counter(low(text)).items():
            weight = n.bit_length() * (min(len(rows) // df[w], 32) if df[w] else 32).bit_length()
            h = int(hashlib.md5(w).hexdigest(), 16)
            for b in range(128):
                votes[b] += weight if h >> b & 1 else -weight
        return sum(1 << b for b in range(128) if votes[b] > 0)

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        changed = text[:len(text) - k] + nxt[:k]
        a, b, c = bits(text), bits(changed), bits(nxt)
        out[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), format(a, "032x"), format(b, "032x"),
                       1 - bin(a ^ b).count("1") / 128, 1 - bin(a ^ c).count("1") / 128)
    return out


def near(prints, ids, radius):
    return {i: sum(bin(int(prints[i], 16) ^ int(p, 16)).count("1") <= radius for p in prints.values()) - 1 for i in ids}


def test_whole_table_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in d.collect()])
    got = {r.doc_id: r for r in fingerprints.report(d, partitions=5).collect()}
    assert {i: tuple(r)[1:7] for i, r in got.items()} == want
    asked = [i for i in want if i % 50 == 0]
    assert {i: r.n_near for i, r in got.items() if r.n_near is not None} == near({i: w[2] for i, w in want.items()}, asked, fingerprints.RADIUS)


def test_edited_texts_are_nearer_than_strangers(spark):
    rows = [r for r in fingerprints.report(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.n_chars > 200 and r.near_next < 1]
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.99 * len(rows)


def test_search_is_exact(spark):
    rng = random.Random(8)
    values = {rng.getrandbits(128) for _ in range(25)}
    for v in list(values):
        for bits in range(1, 7):
            values.add(v ^ sum(1 << b for b in rng.sample(range(128), bits)))

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    rows = {v: (signed(v >> 64), signed(v & (1 << 64) - 1)) for v in values}
    df = spark.createDataFrame(list(rows.values()), "hi long, lo long")
    for radius in (1, 3, 4):
        got = [(tuple(r.q), tuple(r.p)) for r in fingerprints.within(df, df, radius).collect()]
        want = {(rows[a], rows[b]) for a in values for b in values if bin(a ^ b).count("1") <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_order_does_not_depend_on_partitions(spark):
    d = docs(spark, [(i, f"word{i} and some more words of text number {i} " * (i % 7)) for i in range(60)])
    one, many = ([tuple(r) for r in fingerprints.report(d, partitions=n).orderBy("doc_id").collect()] for n in (1, 9))
    assert one == many


def test_odd_rows(spark):
    rows = [r for r in ODD if r != (4, "one")] + [(4, "one")]
    got = {r.doc_id: tuple(r)[1:7] for r in fingerprints.report(docs(spark, rows)).collect()}
    assert got == plain(rows)
    assert fingerprints.report(docs(spark, [])).count() == 0
    alone = fingerprints.report(docs(spark, [(7, "only one here")])).collect()
    assert len(alone) == 1 and alone[0].near_edited > 0.5 and alone[0].near_next == 1
    same = fingerprints.report(docs(spark, [(50, "same text here")] * 40)).collect()
    assert len(same) == 40 and {r.n_near for r in same} == {39} and len({r.fingerprint for r in same}) == 1


def test_equal_texts_get_equal_fingerprints(spark):
    d = docs(spark, [(i, "one and the same text with a tail") for i in range(20)] + [(i, f"other {i}") for i in range(20, 40)])
    got = fingerprints.report(d, partitions=4).filter(F.col("doc_id") < 20)
    assert got.select("fingerprint").distinct().count() == 1
