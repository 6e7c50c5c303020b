import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from groundshift.llm import alignment

from .helpers import ODD, SF, docs


@lru_cache
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: i for i, c in alignment.byte_letters().items()}
    return a, b, byte_of


def spans(pieces):
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def tokens(text):
    a, b, byte_of = libraries()
    if not text:
        return None
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    return a_ids, b_ids, spans(a_bytes), spans(b_bytes)


def plain(rows):
    """The contract's columns by pairwise comparison."""
    found = [(doc_id, tokens(text)) for doc_id, text in rows]
    counts, links_of = Counter(), []
    for _, t in found:
        links, start = [], 0
        for i, (p, q) in zip(t[0], t[2]) if t else ():
            while start < len(t[3]) and t[3][start][1] <= p:
                start += 1
            for k in range(start, len(t[3])):
                if t[3][k][0] >= q:
                    break
                links.append((i, t[1][k]))
        links_of.append(links)
        counts.update(set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, t), links in zip(found, links_of):
        groups = []
        if t:
            cuts = sorted({e for _, e in t[2]} & {e for _, e in t[3]})
            for lo, hi in zip([0, *cuts], cuts):
                own = [",".join(str(i) for i, (p, q) in zip(ids, ends) if lo <= p and q <= hi) for ids, ends in ((t[0], t[2]), (t[1], t[3]))]
                groups.append("|".join(own))
        said = hashlib.sha256(";".join(groups).encode()).hexdigest() if t else ""
        out.append((doc_id, len(t[0]) if t else 0, len(t[1]) if t else 0, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links),
                    sum(counts[x] for x in links), said))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


SOME = [
    (1, "Plain words, and <|endoftext|> </s> <unk> inside."), (2, "▁ is a letter here"), (3, "é́ \U0001f600\U0001f600 日本語のテキスト"), (4, "a  b\n\n c\t\td\x00e"),
    (5, "ﬁne ﷺ"), (6, " "), (7, "zz" * 3000), (8, "unterschiedliche Wörter 12345678901234567890"), (50, "repeat " * 300), (50, "repeat " * 300), (9, "  leading"),
]


def test_texts_against_pairwise_comparison(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect() if len(r.text or "") < 4000]
    short = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(alignment.report(short.repartition(5))) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(i, (x or "")[:3000] if x is not None else None) for i, x in ODD] + SOME
    assert found(alignment.report(docs(spark, rows))) == plain(rows)
    assert alignment.report(docs(spark, [])).count() == 0
    assert found(alignment.report(docs(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_counts_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SHARE", 2)
    assert found(alignment.report(docs(spark, SOME))) == plain(SOME)
    monkeypatch.setattr(alignment, "SHARE", 0)
    assert found(alignment.report(docs(spark, SOME))) == plain(SOME)


def test_groups_spell_the_text(spark):
    a, b, *_ = alignment.vocabularies(*alignment._paths(None, None))
    for r in alignment.token_groups(docs(spark, SOME + [(60, None), (61, "")])).collect():
        text = dict(SOME).get(r.doc_id)
        if not r.a_ids:
            assert text is None or tokens(text) is None
            continue
        assert r.a_cuts[-1] == len(r.a_ids) and r.b_cuts[-1] == len(r.b_ids)
        sides = [[b"".join(v.spelled[i] for i in ids[p:q]) for p, q in zip([0, *cuts], cuts)] for v, ids, cuts in ((a, r.a_ids, r.a_cuts), (b, r.b_ids, r.b_cuts))]
        assert sides[0] == sides[1] and b"".join(sides[0]) == b" " + text.encode()


def test_shared_cuts_of_random_ends():
    rng = random.Random(4)
    for _ in range(200):
        a, b, a_texts, b_texts, base = [], [], [], [], 0
        for _ in range(rng.randint(1, 5)):
            size = rng.choice([0, 1, 5, 60])
            if size:
                a += sorted({base + size, *(base + rng.randint(1, size) for _ in range(rng.randint(0, 30)))})
                b += sorted({base + size, *(base + rng.randint(1, size) for _ in range(rng.randint(0, 30)))})
            base += size
            a_texts.append(len(a))
            b_texts.append(len(b))
        both = sorted(set(a) & set(b))
        got = alignment.shared_cuts(np.array(a, np.int64), np.array(b, np.int64), np.array(a_texts), np.array(b_texts))
        assert [x.tolist() for x in got] == [[a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both]]


def test_long_interval_without_a_cut():
    a, b = np.r_[np.arange(2, 20000, 2), 20001], np.r_[np.arange(1, 20000, 2), 20001]
    got = alignment.shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
    assert [x.tolist() for x in got] == [[len(a)], [len(b)]]


def test_white_space_that_overflows_the_faster_library(spark):
    text = "a" + " " * 1_500_000 + "b"
    rows = docs(spark, [(1, text)], clash=False)
    got = alignment.report(rows).collect()[0]
    assert got.n_a == len(libraries()[0].encode(" " + text, add_special_tokens=False).ids) and got.n_b > 0
