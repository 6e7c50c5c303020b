import random

from groundshift.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Parents by looking through all messages: (conv, turn) -> (own text, parent, thread, depth)."""
    said = {}
    for c, t, _, text in rows:
        lines = (text or "").split("\n")
        own = [x for x in lines if not x.startswith(">")]
        said[c, t] = (own, [x.lstrip("> ") for x in lines if x.startswith(">") and not x.startswith(">>")])
    first = {}
    for (c, t), (own, _) in said.items():
        for x in set(own):
            first.setdefault(x, []).append((c, t))
    parent = {}
    for (c, t), (_, quoted) in said.items():
        votes = {}
        for x in set(quoted):
            here = min((b for a, b in first.get(x, []) if a == c), default=None)
            p = (c, here) if here is not None and here < t else min(first.get(x, []), default=None)
            if p and p != (c, t) and (p[1] < t or p[1] == t and p[0] < c):
                votes[p] = votes.get(p, 0) + 1
        parent[c, t] = max(votes, key=lambda p: (votes[p], p[1], -p[0])) if votes else (c, t - 1) if (c, t - 1) in said else None
    out = {}
    for k in said:
        head, depth = k, 0
        while parent[head]:
            head, depth = parent[head], depth + 1
        out[k] = ("\n".join(said[k][0]).strip(" "), parent[k], head, depth)
    return out


def found(df):
    return {(r.conv_id, r.turn): (r.text, (r.parent_conv, r.parent_turn) if r.parent_turn is not None else None, (r.thread_conv, r.thread_turn), r.depth)
            for r in df.collect()}


def test_against_all_messages(spark):
    rng = random.Random(6)
    rows, sentences = [], []
    for c in range(12):
        for t in range(rng.randint(1, 40) if c else 150):
            if rng.random() < 0.1:
                continue
            lines = []
            for _ in range(rng.randint(0, 3)):
                if sentences and rng.random() < 0.6:
                    lines.append(f"{'>' * rng.randint(1, 2)} {rng.choice(sentences[-30:])}")
            new = f"message {c} {t} says {rng.randint(0, 10**6)}." if rng.random() < 0.8 else "thanks."
            sentences.append(new)
            rows.append((c, t, "user", "\n".join([*lines, new])))
    assert found(quotes.conversations(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_levels_attribution_and_wrapping(spark):
    rows = [(1, 0, "u", "Hello there. How are you doing today?"), (1, 1, "a", "I am fine, thanks. And you?"),
            (1, 2, "u", "On Monday A wrote:\n> Hello there. How\n> are you doing today?\nGreat question."),
            (1, 3, "a", "Bob wrote:\n> On Monday A wrote:\n> > Hello there.\n> Great question.\nOk, nested.")]
    got = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2].text, got[2].parent_turn, got[2].n_quoted, got[2].n_linked) == ("Great question.", 0, 2, 2)
    assert (got[3].text, got[3].parent_turn, got[3].n_quoted, got[3].n_linked, got[3].depth) == ("Ok, nested.", 2, 2, 2, 2)


def test_odd_rows(spark):
    rows = [(None, 1, "u", None), (None, 1, "u", "a"), (1, None, "u", "b"), (2, 0, None, ""), (2, 0, "u", "x"), (2, 0, "u", "x"), (3, 0, "u", "> unknown"), (3, 5, "u", ">")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "2 AS own", "3 AS depth", "4 AS parent_turn")
    got = quotes.conversations(df).collect()
    assert sorted(str((r.conv_id, r.turn)) for r in got) == sorted(map(str, [(None, 1), (None, 1), (1, None), (2, 0), (3, 0), (3, 5)]))
    assert all(r.depth == 0 for r in got)
    assert quotes.conversations(df.limit(0)).count() == 0
