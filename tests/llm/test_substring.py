import hashlib
import random
import re

import duckdb
import numpy as np

from groundshift.llm import queries, substring
from tools.check_oracle import canonical

from .helpers import ODD, SF, docs

WORD = r"[^\x20\x09-\x0D]+"


def plain(rows, window=13):
    """Every window of every document, kept in a dictionary."""
    least = {}
    split = [(i, re.findall(WORD, t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k:k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op10_substring_dedup(spark, SF).toPandas()
    assert canonical(got, None) == canonical(con.execute(queries.OP10_SQL).df(), None)


def test_odd_and_repetitive_rows(spark):
    rng = random.Random(4)
    line = [f"w{i}" for i in range(60)]
    rows = list(ODD)
    for i in range(20, 70):
        parts = []
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(45)
            parts += rng.choice([line[k:k + rng.randint(10, 30)], ["a"] * rng.randint(1, 40), ["a", "b"] * rng.randint(1, 20), [f"u{rng.random()}"]])
        rows.append((i, " ".join(parts)))
    rows += [(15, rows[-1][1]), (90, rows[-1][1]), (90, rows[-1][1]), (90, rows[-2][1]), (None, rows[-1][1])]
    assert found(substring.deduplicate(docs(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert substring.deduplicate(docs(spark, [])).count() == 0


def test_equal_windows_share_their_inner_symbols():
    rng = random.Random(3)
    for _ in range(200):
        window = [f"w{rng.randint(0, 6)}" for _ in range(13)]
        seen = []
        for _ in range(2):
            before = [f"w{rng.randint(0, 6)}" for _ in range(rng.randint(0, 20))]
            after = [f"w{rng.randint(0, 6)}" for _ in range(rng.randint(0, 20))]
            text = [x.encode() for x in before + window + after]
            names, separator, _ = substring.line_up([text])
            sym, low, high = substring.symbols(names, separator, 13)
            inside = (low >= len(before)) & (high <= len(before) + 13)
            seen.append(sorted(zip(sym[inside].tolist(), (low[inside] - len(before)).tolist())))
        assert seen[0] == seen[1]


def test_most_windows_are_settled_by_symbols():
    rng = random.Random(9)
    names, separator, _ = substring.line_up([[str(rng.random()).encode() for _ in range(20000)]])
    _, low, high = substring.symbols(names, separator, 13)
    step = np.zeros(len(names) + 14, int)
    np.add.at(step, np.maximum(high - 13, 0), 1)
    np.add.at(step, low + 1, -1)
    assert (np.cumsum(step)[:19988] > 0).mean() > 0.85


def test_a_word_has_one_name_wherever_it_stands():
    """Names depend on the word alone, not on its neighbours, and differ between words, long ones and letters in another order too."""
    rng = random.Random(4)
    words = list({bytes(rng.choice(b"ab\xc3\xa9.,019") for _ in range(rng.choice([1, 2, 5, 9, 31, 32, 33, 200]))) for _ in range(30000)})
    names = substring.word_names(words)
    assert len(set(names.tolist())) == len(words) > substring._MANY
    order = rng.sample(range(len(words)), len(words))
    assert (substring.word_names([words[i] for i in order]) == names[order]).all()
    assert substring.word_names([words[0]])[0] == names[0] and len(substring.word_names([])) == 0
