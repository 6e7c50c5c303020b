"""Benchmark leaks in template form, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question asked again with other values keeps its template.
Windows of WINDOW template tokens are hashed on both sides and joined; a window of mostly placeholders says nothing and is
left out on the benchmark's side. What joins is then laid along its diagonal (place in the document less place in the item)
and its slots are compared: the same filler of the item must always meet the same filler in the document.

Items of one template are one class under their smallest item_id, which ``members`` lists. The benchmark's windows are one row
for each place in a template; what meets a template is compared with every filling that the class has. The windows are counted first: up to BROADCAST_ROWS go to every executor, and the
documents stay where they are; more are joined by a shuffle of hashes, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, staged

WINDOW = 8
LITERALS = 5  # words of a benchmark window that must not be placeholders
COVERED = 13  # tokens of one diagonal that make a leak, or the whole item if it is shorter
BROADCAST_ROWS = 2_000_000  # benchmark windows that every executor may hold, some 60 MB; more are joined by a shuffle
CONSISTENT = 0.75  # share of the slot fillers that must meet one filler each

# Words for numbers and for units.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
                "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
                "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen", "half", "twice"]
UNIT_WORDS = ["mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
              "kilometer", "kilometers", "kilometre", "kilometres", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons",
              "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
              "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
              "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "kmh", "mph", "celsius", "fahrenheit"]


def tokens(text: Column) -> Column:
    """Words and numbers as written, in order: separators inside numbers and all punctuation are dropped."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(t, r"(?<=[0-9])[.,:/](?=[0-9])", ""), r"(?<=[0-9])(?=\p{L})", " ")
    t = F.when(t.rlike("[0-9]"), digits).otherwise(t)
    return F.regexp_extract_all(t, F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def placeholder(token: Column) -> Column:
    """``0`` for a number, ``1`` for a unit, ``2`` for a capitalised word, else the word in lower case.

    Sentence openings are slots too; slot consistency has the last word on them.
    """
    low = F.lower(token)
    return (
        F.when(token.rlike(r"^\p{N}"), "0").when(token.rlike(r"^\p{Lu}\p{Ll}"), "2").when(low.isin(NUMBER_WORDS), "0").when(low.isin(UNIT_WORDS), "1")
        .otherwise(low)
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(raw: Column) -> Column:
    """Hashes of all windows of the template of a token array, in order."""
    typed = F.transform(raw, lambda w: F.xxhash64(placeholder(w)))

    def hashes(h: Column) -> Column:
        last = F.size(h) - WINDOW
        window = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]))
        return F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>"))

    return _let(typed, hashes)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, raw, typed): one row for each distinct filling of a template, under the smallest item_id that has the template.

    Null ids and texts are left out.
    """
    t = benchmark.filter("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("raw"))
    t = t.withColumn("typed", F.transform("raw", placeholder))
    least = t.groupBy("typed").agg(F.min("item_id").alias("item_id"))
    return t.select("typed", "raw").distinct().join(least, "typed").select("item_id", "raw", "typed")


def members(benchmark: DataFrame) -> DataFrame:
    """(item_id, template_id) for every item of ``benchmark``: a leak is reported under template_id, the smallest item_id of the template."""
    t = benchmark.filter("item_id IS NOT NULL").select("item_id", F.transform(tokens(F.col("text")), placeholder).alias("typed"))
    least = t.groupBy("typed").agg(F.min("item_id").alias("template_id"))
    return t.join(least, "typed").select("item_id", "template_id").distinct()


def item_windows(items: DataFrame) -> DataFrame:
    """(h, item_id, ipos): every place of each window with enough literal words in a template."""
    one = items.dropDuplicates(["item_id"])
    at = one.select("item_id", "typed", F.posexplode(window_hashes(F.col("raw"))).alias("ipos", "h"))
    literal = F.size(F.filter(F.slice("typed", F.col("ipos") + 1, WINDOW), lambda w: ~w.isin("0", "1", "2")))
    return at.filter(literal >= LITERALS).select("h", "item_id", "ipos")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, n_tokens, n_slots, n_changed, verbatim) for every pair of a document and a template that it leaks.

    A template is leaked if any of its fillings is, and item_id is the smallest one of its items (see ``members``).
    key is a hash of the text; n_tokens counts the template tokens that meet along the best diagonal, n_slots the
    placeholders among them and n_changed those filled otherwise than in the nearest item of the template, the fewest of equally long
    diagonals. A null text is empty and leaks nothing,
    nor do items of fewer than WINDOW tokens; repeated rows give one result; extra columns are ignored.
    """
    items = staged(items_of(benchmark), "leak-items")
    parts = staged(item_windows(items), "leak-windows")
    text = docs.select("doc_id", F.xxhash64("text").alias("key"), tokens(F.col("text")).alias("draw"))
    at = text.select("doc_id", "key", "draw", F.posexplode(window_hashes(F.col("draw"))).alias("dpos", "h"))
    said = F.slice("draw", F.col("dpos") + 1, WINDOW)
    place = ["doc_id", "key", "item_id", "ipos", "dpos"]
    if parts.count() <= BROADCAST_ROWS:
        met = at.join(F.broadcast(parts), "h").select(*place, said.alias("said"))
    else:  # tokens do not travel with the windows of a shuffled join: matched texts are read again
        found = staged(at.drop("draw").join(parts, "h").select(*place), "leak-places")
        mine, theirs = F.col("h.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("h.key") == F.col("t.key")
        again = text.dropDuplicates(["doc_id", "key"]).alias("t")
        met = found.alias("h").join(again, mine & theirs).select(*[f"h.{c}" for c in place], said.alias("said"))
    hits = met.groupBy("doc_id", "key", "item_id").agg(F.collect_set(F.struct("ipos", "dpos", "said")).alias("at"))
    both = staged(hits, "leak-hits").join(items, "item_id")
    met = F.flatten(F.transform("at", lambda p: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.struct(
        (p["dpos"] - p["ipos"]).alias("diag"), (p["ipos"] + k).alias("i"), F.element_at("typed", p["ipos"] + k + 1).isin("0", "1", "2").alias("slot"),
        F.element_at("raw", p["ipos"] + k + 1).alias("iv"), F.element_at(p["said"], k + 1).alias("dv")))))
    cells = both.select("doc_id", "key", "item_id", "raw", F.size("raw").alias("size"), F.explode(F.array_distinct(met)).alias("c")).select(
        "doc_id", "key", "item_id", F.xxhash64("raw").alias("filling"), "size", "c.*")
    slot = F.col("slot")
    lines = cells.groupBy("doc_id", "key", "item_id", "filling", "diag").agg(
        F.first("size").alias("size"), F.count("*").alias("n_tokens"), F.count_if(slot).alias("n_slots"),
        F.count_if(slot & (F.lower("iv") != F.lower("dv"))).alias("n_changed"),
        F.size(F.collect_set(F.when(slot, F.lower("iv")))).alias("fillers"),
        F.size(F.collect_set(F.when(slot, F.struct(F.lower("iv"), F.lower("dv"))))).alias("pairs"))
    good = lines.filter((F.col("n_tokens") >= F.least(F.lit(COVERED), F.col("size"))) & (F.col("fillers") >= CONSISTENT * F.col("pairs")))
    return _best(good.withColumn("verbatim", F.col("n_changed") == 0), ["doc_id", "key", "item_id"])


def _best(found: DataFrame, by: list[str]) -> DataFrame:
    """The longest diagonal of each group, of equal ones that with the fewest changed slots, and whether any is unchanged."""
    best = found.groupBy(*by).agg(F.max(F.struct("n_tokens", "n_slots", (-F.col("n_changed")).alias("kept"))).alias("b"), F.max("verbatim").alias("verbatim"))
    return best.select(*by, "b.n_tokens", "b.n_slots", (-F.col("b.kept")).alias("n_changed"), "verbatim")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks, one row for each pair of doc_id and item_id. ``verbatim`` is true where a leaking diagonal has no changed slot, also
    if another one is longer."""
    return _best(leaks(docs, benchmark), ["doc_id", "item_id"])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item, columns unchanged. Null texts stay."""
    bad = staged(leaks(docs, benchmark).select(F.col("doc_id").alias(f"{OWN}id"), F.col("key").alias(f"{OWN}key")).distinct(), "leak-rows")
    same = docs["doc_id"].eqNullSafe(bad[f"{OWN}id"]) & (F.xxhash64(docs["text"]) == bad[f"{OWN}key"])
    return docs.join(bad, same, "left_anti")
