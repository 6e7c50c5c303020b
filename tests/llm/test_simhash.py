import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from groundshift.llm import simhash

from .helpers import ODD, SF, docs


def plain(text, shingle=3):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not w:
        return 0
    grams = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    out = 0
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            out |= 1 << b
    return out


def reachable(prints, distance):
    """Smallest id of each id's component, by looking at all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    prints = {r.doc_id: plain(r.text) for r in d.collect()}
    got = simhash.near_duplicates(d).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: format(x, "016x") for i, x in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == reachable(prints, 2)


def test_links_are_exact(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for bits in range(1, 5):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for distance in (0, 1, 2, 3):
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
        assert {tuple(r) for r in simhash.links(df, distance).collect()} == want


def test_odd_rows(spark):
    got = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == [("0" * 16, 1)]
    assert len(by[4]) == 2 and by[4][0][1] == by[5][0][1] == 4
    assert by[None][0][1] is None
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_copy_stays(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w50 ", "other ").replace("w150 ", "else ")
    rows = [(5, base), (3, base), (4, near), (9, "quite another text " + " ".join(f"v{i}" for i in range(100))), (3, base), (None, "w1 w2 alone"), (1, None), (2, "")]
    d = docs(spark, rows)
    got = simhash.keep_one(d)
    assert got.columns == d.columns
    assert sorted(got.select("doc_id").collect(), key=str) == sorted([(3,), (9,), (None,), (1,)], key=str)
    assert simhash.keep_one(docs(spark, [])).count() == 0


def classes_of(texts):
    """id -> smallest id of its class, by the shares of all pairs."""
    grams = {i: frozenset(zip(*[t.lower().split()[k:] for k in range(5)])) or frozenset([tuple(t.lower().split())]) for i, t in texts.items()}
    root = {i: i for i in grams}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(grams)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if min(len(grams[i]), len(grams[j])) >= 0.8 * max(len(grams[i]), len(grams[j])) and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_block_edits_are_near_copies(spark):
    """Appended, cut and inserted blocks at every share: those at four fifths or more go, the others stay."""
    rng = random.Random(3)
    texts = {}
    for n in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        block = [f"b{rng.randrange(3000)}" for _ in range(int(len(words) * rng.choice([0.1, 0.15, 0.2, 0.23, 0.3])))]
        at = rng.randrange(len(words))
        kinds = [words, words + block, block + words, words[:at] + block + words[at:], words[len(block):], words[:len(words) - len(block)]]
        texts |= {100 * n + k: " ".join(x) for k, x in enumerate([kinds[0], rng.choice(kinds[1:])])}
    want = classes_of(texts)
    assert 10 < len(texts) - len(set(want.values())) < 40
    assert {r.doc_id for r in simhash.keep_one(docs(spark, sorted(texts.items()))).collect()} == set(want.values())


def test_only_near_copies_go(spark):
    """What stays of the corpus is the least of each class at four fifths; the same words in another order are another text."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    words = [f"w{i}" for i in range(120)]
    texts |= {10**6: " ".join(words), 10**6 + 1: " ".join(words[::-1]), 10**6 + 2: " ".join(words[:60] + words[60:][::-1])}
    d = d.select("doc_id", "text").union(spark.createDataFrame([(i, texts[i]) for i in texts if i >= 10**6], "doc_id long, text string"))
    assert {r.doc_id for r in simhash.keep_one(d).collect()} == set(classes_of(texts).values())


def test_copies_meet_behind_a_stranger(spark):
    """Two copies whose only common key belongs to an unrelated text with a smaller node are linked all the same."""
    base = " ".join(f"w{i}" for i in range(100))
    said = [(-9, 1, "a stranger to " + " ".join(f"v{i}" for i in range(90))), (3, 2, base), (5, 3, base + " x y z")]
    rows = spark.createDataFrame([(n, t, len(simhash.shingles(x.encode())), [7]) for n, t, x in said], "node long, tkey long, n long, keys array<long>")
    texts = spark.createDataFrame([(t, x) for _, t, x in said], "tkey long, text string")
    assert {tuple(r) for r in simhash.near_links(rows, texts).collect()} == {(3, 5)}


def test_rare_meetings_lose_no_alike_pair(spark):
    """All pairs of different components at four fifths or more meet, and what all texts share makes no pairs."""
    rng = random.Random(12)
    passage = [rng.getrandbits(62) for _ in range(45)]
    sets = {}
    while len(sets) < 400:
        own = [rng.getrandbits(62) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.5:
            own += passage[:rng.randint(1, 45)]
        if sets and rng.random() < 0.4:  # an edited copy
            own = [x for x in sets[rng.choice(list(sets))] if rng.random() < 0.95] + own[:rng.randint(0, 8)]
        if own:
            sets[len(sets)] = sorted(set(own))
    hot = {1000 + i: sorted({*passage, *(rng.getrandbits(62) for _ in range(8))}) for i in range(300)}  # 45 of 61 shared
    sets |= hot
    root = {i: rng.choice([i, i, i - i % 7]) for i in sets}
    df = spark.createDataFrame(list(sets.items()), "node long, grams array<long>")
    got = {tuple(r) for r in simhash.rare_meetings(spark.createDataFrame(list(root.items()), "node long, root long"), df).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b]
            and 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))}
    assert want and want <= got
    assert sum(a >= 1000 and b >= 1000 for a, b in got) == 0 and len(got) < 40 * len(sets)



def test_texts_that_only_meet_at_rare_shingles_are_no_candidates(spark):
    s, x, y = ([f"{c}{i}" for i in range(n)] for c, n in (("s", 60), ("x", 40), ("y", 40)))
    texts = [s + x, s + y, x, x + ["q"], y, y + ["q"], s + x[:-2] + ["r"]]
    grams = [simhash.shingles(" ".join(t).encode()) for t in texts]
    for a in grams:
        for b in grams:
            apart = np.unpackbits((simhash.sketch(a) ^ simhash.sketch(b)).view(np.uint8)).sum()
            assert apart <= len(np.setxor1d(a, b))
    sets = spark.createDataFrame([(i, g.view(np.int64).tolist(), simhash.sketch(g).tolist()) for i, g in enumerate(grams)],
                                 "node long, grams array<long>, sketch array<long>")
    open_ = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, root long")
    pairs = {tuple(r) for r in simhash.rare_meetings(open_, sets).collect()}
    assert (0, 1) not in pairs and (0, 6) in pairs


def test_near_copies_meet_by_chains_without_a_band(spark):
    """Texts whose fingerprints differ in 2 bits at most are linked if they are alike, whatever their bands."""
    base = " ".join(f"w{i}" for i in range(400))
    said = [(1, 11, base), (2, 12, base + " x"), (3, 13, " ".join(f"v{i}" for i in range(400)))]
    grams = {n: simhash.shingles(x.encode()) for n, _, x in said}
    prints = {n: simhash.majority(g) for n, g in grams.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2
    prints[3] = prints[1] ^ 1  # near by its bits, not by its shingles
    rows = spark.createDataFrame([(n, t, len(grams[n]), prints[n], [n]) for n, t, _ in said], "node long, tkey long, n long, fp long, keys array<long>")
    texts = spark.createDataFrame([(t, x) for _, t, x in said], "tkey long, text string")
    assert {tuple(r) for r in simhash.near_links(rows, texts).collect()} == {(1, 2)}


def test_meetings_by_chains_are_two_for_each_node(spark):
    """A large group of near fingerprints makes no pairs of all its nodes."""
    nodes = [(i, 100, (1 << i % 60) | (1 << i % 59)) for i in range(2000)]
    got = {tuple(r) for r in simhash.chain_meetings(spark.createDataFrame(nodes, "node long, n long, fp long")).collect()}
    assert {v for _, v in got} == set(range(1, 2000)) and len(got) < 2 * 2000


def test_only_wanted_texts_are_shuffled(spark):
    texts = spark.range(20000).select(F.xxhash64("id").alias("tkey"), F.lit("x").alias("text"))
    keys = {r.tkey for r in texts.limit(50).collect()} | {-1}
    got = [r.tkey for r in simhash.wanted(texts, spark.createDataFrame([(k,) for k in keys], "tkey long")).collect()]
    assert keys - {-1} <= set(got) and len(got) < 100


def test_texts_go_through_one_exchange_at_the_end(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (None, "c d"), (2, "a b"), (0, "c e")], "doc_id long, text string")
        got = simhash.keep_one(d)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2  # the texts and what stays
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect()) == [(False, 0, "c e"), (False, 1, "a b"), (True, 0, "c d")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
