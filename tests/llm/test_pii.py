import hashlib
import random
import re

from groundshift.llm import pii

from .helpers import ODD, SF, docs


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


PARTS = ["a@b.com", "_x@c.org", "x..y@z-", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "00001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1111 1",
         "+1 (555) 555-0100", "+49 30 1234567.", "++12345678901", "\n", " ", "é", "\U0001f600", "555-123-4567", "123-45-6789", "version 1.2.3.4 ",
         'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "Dr. Jane Doe", "@", ".", " 12", "0", "9999999999999999999999"]


def test_base_spans(spark):
    rng = random.Random(3)
    rows = [*ODD, *((100 + i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))) for i in range(400)),
            (900, "1" * 30000), (901, "1 " * 20000), (902, "a" * 30000 + "@"), (903, "x@y.zz " * 1000)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    got = pii.report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain(texts[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_method_adds_secrets_and_names(spark):
    text = 'my token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", signed Dr. Jane Doe'
    got = pii.report(docs(spark, [(i, text) for i in range(20)])).first()
    assert got.spans == "secret:12:52,name:62:74"


def test_redaction(spark):
    d = docs(spark, [(1, "a@b.com\nplain 4\n+1 (555) 555-0100, 1.2.3.4"), (2, None), (3, "nothing"), (3, "nothing"), (None, "x@y.org")])
    got = pii.redact(d)
    assert got.columns == d.columns and got.dtypes == d.dtypes
    rows = {(r.doc_id, r.text, r.n_chars) for r in got.collect()}
    clean = "<EMAIL>\nplain 4\n<PHONE>, <IP>"
    assert rows == {(1, clean, len(clean)), (2, None, None), (3, "nothing", 7), (None, "<EMAIL>", 7)} and got.count() == 5


def test_empty_table(spark):
    assert pii.report(docs(spark, [])).count() == 0
    assert pii.redact(docs(spark, [])).count() == 0


def test_reliable_labelers_weigh_more():
    rows = []
    for truth, n in ((1, 100), (0, 100)):
        for wrong in (0, 1):  # the first two labelers agree, the fourth one guesses
            v = 1 if truth else -1
            rows.append(("phone", (v, v, 0, v if not wrong else -v, 0, 0), 1, n // 2))
    p = pii.reliabilities(rows)
    assert all((q > 0.5) == (r[1][0] > 0) for q, r in zip(p, rows))
