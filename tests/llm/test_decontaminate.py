import re

import pytest

from groundshift.llm import decontaminate

from .helpers import ODD, SF, docs

ITEM = "Alice has 12 apples and gives 3 of them to her friend Bob before walking 5 km home with Carol"


def plain_template(text):
    t = re.sub(r"(?<=[0-9])[.,:/](?=[0-9])", "", text or "")
    t = re.sub(r"(?<=[0-9])(?=[^\W\d_])", " ", t)
    raw = re.findall(r"[^\W_]+", t)

    def kind(w):
        if w[0].isnumeric():
            return "0"
        if len(w) > 1 and w[0].isupper() and w[1].islower():
            return "2"
        low = w.lower()
        return "0" if low in decontaminate.NUMBER_WORDS else "1" if low in decontaminate.UNIT_WORDS else low

    return raw, [kind(w) for w in raw]


def plain(doc_rows, items):
    """Every diagonal of every pair of a document and an item."""
    first = {}
    for i, t in items:
        raw, typed = plain_template(t)
        if i is not None and (tuple(typed) not in first or i < first[tuple(typed)][0]):
            first[tuple(typed)] = (i, raw)
    out = set()
    for d, t in doc_rows:
        draw, dtyped = plain_template(t)
        where = {}
        for k in range(len(dtyped) - 7):
            where.setdefault(tuple(dtyped[k:k + 8]), []).append(k)
        for typed, (i, raw) in first.items():
            met, seen = {}, set()
            for k in range(len(typed) - 7):
                w = typed[k:k + 8]
                if w in seen or sum(x not in "012" for x in w) < 5:
                    continue
                seen.add(w)
                for p in where.get(w, ()):
                    met.setdefault(p - k, set()).update(range(k, k + 8))
            for diag, places in met.items():
                slots = [(raw[k].lower(), draw[k + diag].lower()) for k in places if typed[k] in "012"]
                if len(places) >= min(13, len(typed)) and len({a for a, _ in slots}) >= 0.75 * len(set(slots)):
                    out.add((d, i))
    return out


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_corpus(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
    assert want and pairs(decontaminate.report(d, b)) == want


@pytest.mark.parametrize("held", [decontaminate.BROADCAST_ROWS, 0])
def test_other_values_and_odd_rows(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", held)
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, ITEM.replace("12", "7")), (None, ITEM)], "item_id long, text string")
    rows = [
        *ODD, (20, ITEM), (21, "x y. Maria has 7 apples and gives 2 of them to her friend Tom before walking 9 km home with Eve! z"),
        (22, "1 2 3 " * 200), (23, "Alice has 12 apples and gives"), (24, ITEM + " and again " + ITEM),
        (25, "Alice has five apples, and gives two of them to her friend Bob before walking 5 miles home with Carol"),
    ]
    d = docs(spark, rows)
    got = decontaminate.report(d, items)
    assert pairs(got) == plain(rows, [(1, ITEM), (4, "too short")]) == {(i, 1) for i in (20, 21, 24, 25)}
    assert {r.doc_id: r.verbatim for r in got.collect()}[21] is False
    clean = decontaminate.keep_clean(d, items)
    assert clean.columns == d.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in (20, 21, 24, 25))


def test_inconsistent_slots_are_no_leak(spark):
    items = spark.createDataFrame([(1, " ".join(f"word{i} said A{'bcde'[i % 2]}a to all of" for i in range(6)).replace("word", "w").replace("w0", "so"))], "item_id long, text string")
    text = items.first().text
    names = iter(f"N{c}" for c in ["ora", "ick", "eda", "ils", "ina", "oel"])
    other = re.sub(r"A[bc]a", lambda _: next(names), text)
    d = docs(spark, [(1, text), (2, other)])
    assert pairs(decontaminate.report(d, items)) == {(1, 1)}


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.report(docs(spark, []), items).count() == 0
    assert decontaminate.keep_clean(docs(spark, [(1, ITEM)]), items.limit(0)).count() == 1


@pytest.mark.parametrize("held", [decontaminate.BROADCAST_ROWS, 0])
def test_every_filling_of_a_template_counts(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", held)
    said = "Ann has {} apples and {} pears and {} plums in the big round basket by the door"
    same, other = said.format(2, 2, 2), said.format(3, 4, 5)
    items = spark.createDataFrame([(1, same), (5, other), (6, other), (7, None)], "item_id long, text string")
    d = docs(spark, [(1, same), (2, other), (3, said.format(9, 9, 8))])
    got = {r.doc_id: (r.item_id, r.n_changed, r.verbatim) for r in decontaminate.report(d, items).collect()}
    assert got == {1: (1, 0, True), 2: (1, 0, True), 3: (1, 3, False)}
    assert {tuple(r) for r in decontaminate.members(items).collect()} == {(1, 1), (5, 1), (6, 1), (7, 7)}
    assert decontaminate.keep_clean(d, items).count() == 0


def test_every_place_of_a_window_counts(spark):
    part, other = "we went along the old road to find", "so long as the rain kept falling over us"
    items = spark.createDataFrame([(1, f"{part} {other} {part} nothing more at all here")], "item_id long, text string")
    assert pairs(decontaminate.report(docs(spark, [(1, f"then {part} nothing more at all here again")]), items)) == {(1, 1)}


def test_a_copy_before_a_changed_copy_is_verbatim(spark):
    """The item word for word and behind it with other numbers: of equally long diagonals the unchanged one counts."""
    item = "in the old mill by the river 12 men grind 34 sacks of corn before noon every single day"
    other = item.replace("12", "56").replace("34", "78")
    d = docs(spark, [(1, item + " . and then " + other), (2, other + " . and then " + item), (3, other)])
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_changed, r.verbatim) for r in decontaminate.report(d, b).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (2, False)}


def test_sql_knows_all_fillings_and_places(spark):
    import duckdb

    from groundshift.llm.queries import OP1_SQL

    line = "a farmer sells {} apples and {} pears at the market by the old town gate"
    items = [(5, line.format(3, 4)), (9, line.format(8, 9)), (6, "one two three blue birds sit on the long wire " * 2 + "and sing")]
    rows = [(1, "so " + line.format(8, 9)), (2, line.format(5, 6)), (3, "one two three blue birds sit on the long wire " * 3), (4, None)]
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.report(d, b).select("doc_id", "item_id", "n_tokens", "n_slots", "n_changed", "verbatim").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = {tuple(r) for r in con.execute("SELECT doc_id, item_id, n_tokens, n_slots, n_changed, verbatim FROM (" + OP1_SQL + ")").fetchall()}
    assert got == want and (1, 5) in {r[:2] for r in got} and next(r for r in got if r[:2] == (1, 5))[5]
