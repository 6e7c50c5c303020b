"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Labelers (strict shape, check of the value, gazetteers, words before the span, words that speak
against it, what touches it) vote for, against or not at all on each. Spark counts the vote patterns of all spans;
expectation-maximisation over these counts estimates how reliable each labeler is, and a logistic classifier over kind,
votes and length is trained on the resulting probabilities. Its weights become a column expression. The number of
patterns is bounded by the labelers and kinds, not by the data, and they are all that reaches the driver.

Spans of the base patterns are always kept; the classifier decides about those of the others that touch none of them. No proposed span crosses a line
feed, so that texts are taken line by line and only lines with a cue are looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN

#: Base kinds in the order of their listing, then what the method may add.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "secret", "name"]

# The base patterns with possessive repeats and a look-behind, which give the same leftmost matches in linear time:
# a match can only begin where a run of its first class begins, or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{24,}+",
    "name": r"(?<![\p{L}.])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
_CUE = r"[0-9@]|(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}"

# Words that speak for a kind when they stand before a span, and words that speak against any.
_BEFORE = {
    "email": "mail|contact|write", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax|contact|whatsapp", "ssn": r"ssn|social|security", "secret": "token|secret|key|password|passwd|bearer|auth",
    "name": "name|contact|by|dear|signed",
}
_AGAINST = r"version|isbn|issn|doi|order|invoice|page|section|figure|table|commit|sha\b|md5|build|release"
_TOP_DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|nl|eu|it|ch|at|us|ca)$"

_SPAN = "array<struct<kind:string,base:boolean,start:int,end:int,value:string>>"
LABELERS = ["shape", "value", "gazetteer", "before", "against", "touching"]


def _found(line: Column, kind: str, pattern: str, base: bool, valid: Column | None = None) -> Column:
    """The matches of a pattern in a line, with code-point offsets: what ``split`` leaves lies between them."""
    hits = F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(line, pattern, -1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), begin.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        n = F.length(_digits(x))
        return (n >= 13) & (n <= 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        n = F.length(_digits(x))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _none(cond: Column, spans: Column) -> Column:
    return F.when(cond, spans).otherwise(F.array().cast(_SPAN))


def line_spans(line: Column) -> Column:
    """All proposed spans of a line, base ones first by kind and start."""

    def base(kind: str) -> Column:
        return F.filter(_found(line, kind, _PATTERNS[kind], True), lambda s: _valid(kind, s["value"]))

    def loose(kind: str) -> Column:
        return _found(line, kind, _LOOSE[kind], False)

    digits = line.rlike("[0-9]")
    plus = F.contains(line, F.lit("+"))
    sure = F.concat(
        _none(F.contains(line, F.lit("@")), base("email")), _none(digits, base("ip")), _none(digits, base("card")), _none(plus & digits, base("phone")))
    more = F.concat(_none(digits, F.concat(loose("phone"), loose("ssn"), loose("secret"))), _none(line.rlike("(?:Mr|Mrs|Ms|Dr|Prof)"), loose("name")))
    return F.concat(sure, more)


def with_lines(docs: DataFrame) -> DataFrame:
    """Adds the lines of the text that have a cue, each with its place and its spans, votes included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    kept = "array<struct<at:int,no:int,line:string>>"
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("no"), F.array().cast(kept).alias("out"))

    def step(acc: Column, line: Column) -> Column:
        here = F.struct(acc["pos"].alias("at"), acc["no"].alias("no"), line.alias("line"))
        out = F.when(line.rlike(_CUE), F.concat(acc["out"], F.array(here))).otherwise(acc["out"])
        return F.struct((acc["pos"] + F.length(line) + 1).alias("pos"), (acc["no"] + 1).alias("no"), out.alias("out"))

    cued = F.when(text.rlike(_CUE), F.aggregate(lines, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(kept))
    marked = docs.withColumn(f"{OWN}cued", cued)
    voted = F.transform(f"{OWN}cued", lambda c: F.struct(
        c["at"].alias("at"), c["no"].alias("no"), c["line"].alias("line"),
        F.transform(line_spans(c["line"]), lambda s: _with_votes(c["line"], s)).alias("spans")))
    return marked.withColumn(f"{OWN}lines", F.filter(voted, lambda c: F.size(c["spans"]) > 0)).drop(f"{OWN}cued")


def _by_kind(kind: Column, cases: dict[str, Column], other: Column) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(other)


def _with_votes(line: Column, s: Column) -> Column:
    x, kind = s["value"], s["kind"]
    begin = F.greatest(s["start"] - 24, F.lit(0))
    before = F.lower(line.substr(begin + 1, s["start"] - begin))
    left = line.substr(F.greatest(s["start"], F.lit(1)), F.when(s["start"] > 0, 1).otherwise(0))
    right = line.substr(s["end"] + 1, F.lit(1))

    def vote(yes: Column, no: Column | None = None) -> Column:
        v = F.when(yes, 1)
        return (v if no is None else v.when(no, -1)).otherwise(0)

    n = F.length(_digits(x))
    shape = vote(s["base"] | (kind == "ssn") | ((kind == "phone") & (n == 10)), (kind == "secret") & ~x.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9_/+-]{32,})$"))
    value = _by_kind(kind, {
        "card": vote(_valid("card", x)), "ip": vote(_valid("ip", x), x.rlike(r"^0\.|\.0\.0$|^255\.")),
        "ssn": vote(~x.rlike("^(?:000|666|9..)-|-00-|-0000$"), x.rlike("^(?:000|666|9..)-|-00-|-0000$")),
        "secret": vote(F.length(F.regexp_replace(x, "[^0-9]", "")) * 8 >= F.length(x), x.rlike("^[A-Za-z_/-]+[0-9]{1,4}$"))}, F.lit(0))
    gazetteer = _by_kind(kind, {"email": vote(F.lower(x).rlike(_TOP_DOMAINS)), "card": vote(x.rlike("^(?:4|5[1-5]|3[47]|6011)")),
                                "phone": vote(x.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"))}, F.lit(0))
    cue = vote(_by_kind(kind, {k: before.rlike(v) for k, v in _BEFORE.items()}, F.lit(False)))
    against = F.when(before.rlike(_AGAINST), -1).otherwise(0)
    touching = F.when(left.rlike("[A-Za-z0-9]") | right.rlike("[A-Za-z0-9]"), -1).otherwise(0)
    votes = F.struct(*[v.cast("int").alias(k) for k, v in zip(LABELERS, (shape, value, gazetteer, cue, against, touching))])
    length = F.when(F.length(x) < 12, 0).when(F.length(x) < 24, 1).otherwise(2)
    return F.struct(*[s[c].alias(c) for c in ("kind", "base", "start", "end")], votes.alias("votes"), length.alias("size"))


class Classifier:
    """Weights of the final span classifier: an intercept, one for each kind, each vote and each length class."""

    def __init__(self, weights: list[float]):
        self.weights = weights

    @staticmethod
    def features(kind: str, votes: tuple[int, ...], size: int) -> list[float]:
        return [1.0, *[float(kind == k) for k in KINDS], *[float(v == 1) for v in votes], *[float(v == -1) for v in votes], float(size == 1), float(size == 2)]

    def score(self, s: Column) -> Column:
        w = iter(self.weights)
        out = F.lit(next(w))
        for k in KINDS:
            out = out + F.when(s["kind"] == k, next(w)).otherwise(0.0)
        for side in (1, -1):
            for name in LABELERS:
                out = out + F.when(s["votes"][name] == side, next(w)).otherwise(0.0)
        return out + F.when(s["size"] == 1, next(w)).otherwise(0.0) + F.when(s["size"] == 2, next(w)).otherwise(0.0)


def reliabilities(rows: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 100) -> np.ndarray:
    """Posterior probability of personal data for each (kind, votes, size, count), by EM over the votes."""
    v = np.array([r[1] for r in rows])
    w = np.array([r[3] for r in rows], float)
    p = np.clip(0.5 + 0.2 * v.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        odds = np.log((w @ p + 1) / (w @ (1 - p) + 1)) + np.zeros(len(w))
        for side in (1, -1):
            hit = v == side
            yes = ((w * p) @ hit + (0.9 if side == 1 else 0.1)) / (w @ p + 1)
            no = ((w * (1 - p)) @ hit + (0.1 if side == 1 else 0.9)) / (w @ (1 - p) + 1)
            # a labeler is never read against its own word
            ratio = np.log(yes / no)
            odds += hit @ (np.maximum(ratio, 0.1) if side == 1 else np.minimum(ratio, -0.1))
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return p


def train(rows: list[tuple[str, tuple[int, ...], int, int]], ridge: float = 1.0) -> Classifier:
    """Ridge logistic regression on the EM posteriors of counted patterns, by Newton steps."""
    width = len(Classifier.features(KINDS[0], (0,) * len(LABELERS), 0))
    if not rows:
        return Classifier([-1.0, *[0.0] * (width - 1)])
    rows = sorted(rows)
    y, c = reliabilities(rows), np.array([r[3] for r in rows], float)
    x = np.array([Classifier.features(*r[:3]) for r in rows])
    b = np.zeros(width)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (c * q * (1 - q))[:, None]).T @ x + ridge * np.eye(width), x.T @ (c * (y - q)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8 or not math.isfinite(float(b.sum())):
            break
    return Classifier([float(z) for z in b])


def learn(docs: DataFrame) -> Classifier:
    """Counts the vote patterns of all spans of all rows, and trains the classifier on them."""
    spans = with_lines(docs.select("text")).select(F.explode(F.flatten(F.col(f"{OWN}lines.spans"))).alias("s"))
    counted = spans.groupBy("s.kind", *[F.col(f"s.votes.{k}").alias(k) for k in LABELERS], "s.size").count()
    return train([(r["kind"], tuple(r[k] for k in LABELERS), r["size"], r["count"]) for r in counted.collect()])


def _accepted(line: Column, model: Classifier) -> Column:
    def free(s: Column) -> Column:
        return ~F.exists(line["spans"], lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.filter(line["spans"], lambda s: s["base"] | ((model.score(s) >= 0) & free(s)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row of ``docs`` (doc_id, text).

    Counts and base_sha256 are of the base spans; spans has all, as kind:start:end in code points, by kind, then start.
    A null text counts as empty; null doc_ids and repeated rows are reported as they come; extra columns are ignored; an
    empty table gives an empty result.
    """
    model = learn(docs)
    at = with_lines(docs.select("doc_id", "text"))
    spans = F.flatten(F.transform(f"{OWN}lines", lambda c: F.transform(_accepted(c, model), lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("order"), (s["start"] + c["at"]).alias("start"),
        (s["end"] + c["at"]).alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))))
    found = at.select("doc_id", F.sort_array(spans).alias("s"))

    def told(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("s", lambda s: s["base"])
    unique = F.array_distinct(F.transform("s", lambda s: F.struct(s["order"], s["start"], s["end"], s["kind"])))
    counts = [F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == F.lit(k)))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(unique).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; touching spans of different kinds become one.

    Columns and rows stay; ``n_chars``, where there is one, is counted anew for texts that change. A null text stays null.
    """
    model = learn(docs)
    done = with_lines(docs)

    def clean(c: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))

        def step(acc: Column, s: Column) -> Column:
            opens = s["start"] >= acc["pos"]
            out = F.concat(acc["out"], c["line"].substr(acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.struct(F.when(opens, out).otherwise(acc["out"]).alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

        spans = F.sort_array(F.transform(_accepted(c, model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], c["line"].substr(acc["pos"] + 1, F.length(c["line"]))))

    fixed = F.map_from_arrays(F.col(f"{OWN}lines.no"), F.transform(f"{OWN}lines", clean))
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.coalesce(F.try_element_at(F.col(f"{OWN}fixed"), i), line))
    done = done.withColumn(f"{OWN}fixed", fixed).withColumn(
        f"{OWN}text", F.when(F.size(f"{OWN}lines") > 0, F.array_join(lines, "\n")).otherwise(F.col("text")))
    out = []
    for name in docs.columns:
        if name == "text":
            out.append(F.col(f"{OWN}text").alias("text"))
        elif name == "n_chars":
            changed = F.col(f"{OWN}text") != F.col("text")
            out.append(F.when(changed, F.length(f"{OWN}text")).otherwise(F.col(name)).cast(docs.schema[name].dataType).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return done.select(*out)
