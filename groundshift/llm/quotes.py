"""Quotation linking, in DataFrame functions only.

A message's lines carry quote levels (leading ``>`` signs, with or without blanks between them). Own text is what has
level 0; lines of one level in a row form a passage, attribution lines ("... wrote:") belong to neither. Passages are cut
into sentences, normalised and hashed, which survives re-wrapped lines, and joined to the sentences of the messages' own
text: first within the conversation, to the first turn that has the sentence if it is an earlier one, else to the earliest
message anywhere that has it. A message replies to the one that most of its level-1 sentences come from; without a resolved quotation
it replies to the turn before it, if there is one. Following the replies gives threads, and (thread, depth, turn) is an
order in which every message comes after the one it replies to.

A sentence that a third of all messages share is one row on the original side, since that side is aggregated by hash
before it is joined; no two messages are ever paired through a common sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_ATTRIBUTION = r"(?i)(?:\bwrote|\bschrieb|a écrit|escribió)\s*:?\s*$"
_MARKS = r"^[ \t]*(?:>[ \t]?)+"


def _lines(text: Column) -> Column:
    """Array of (level, body) of a text's lines; null counts as empty."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, f"({_MARKS})", 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line)


def _hashes(lines: Column) -> Column:
    """Hashes of the normalised sentences of some lines, in order, without repeats; lines are joined first."""
    text = F.lower(F.array_join(F.transform(lines, lambda x: x["body"]), " "))
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.transform(F.filter(sentences, lambda s: s != ""), lambda s: F.xxhash64(s)))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotations), own_hashes and quoted: hashes by level, for each message.

    Of rows that repeat (conv_id, turn) the one with the smallest role and text stays; without a place, equal rows are one.
    """
    said = F.struct("role", "text")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    first = messages.select("conv_id", "turn", said.alias("said"), F.when(~placed, said).alias("own_key")).groupBy("conv_id", "turn", "own_key")
    m = first.agg(F.min("said").alias("m")).select("conv_id", "turn", "m.role", "m.text", _lines(F.col("m.text")).alias("lines"))
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~(x["body"].rlike(_ATTRIBUTION) & quoting))
    deepest = F.array_max(F.transform("lines", lambda x: x["level"]))
    levels = F.when(quoting, F.sequence(F.lit(1), deepest)).otherwise(F.array().cast("array<int>"))
    quoted = F.transform(levels, lambda v: F.struct(v.alias("level"), _hashes(F.filter(
        "lines", lambda x: (x["level"] == v) & ~x["body"].rlike(_ATTRIBUTION))).alias("hashes")))
    return m.select("conv_id", "turn", "role", F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n")).alias("own"),
                    _hashes(own).alias("own_hashes"), quoted.alias("quoted"))


def quotation_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, h, from_conv, from_turn) for every quoted sentence that some other message has as its own."""
    own = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("own_hashes").alias("h"))
    asked = rows.select("conv_id", "turn", F.explode("quoted").alias("q")).select(
        "conv_id", "turn", F.col("q.level").alias("level"), F.explode("q.hashes").alias("h"))
    asked = staged(asked, "quote-asked")
    own = staged(own.join(asked.select("h").distinct(), "h", "left_semi"), "quote-own")
    origin = own.groupBy("conv_id", "h").agg(F.min("turn").alias("near"))
    near = asked.join(origin, ["conv_id", "h"], "left").withColumn("near", F.when(F.col("near") < F.col("turn"), F.col("near")))
    anywhere = own.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    found = near.join(anywhere, "h", "left").select(
        "conv_id", "turn", "level", "h",
        F.when(F.col("near").isNotNull(), F.col("conv_id")).otherwise(F.col("first.conv_id")).alias("from_conv"),
        F.when(F.col("near").isNotNull(), F.col("near")).otherwise(F.col("first.turn")).alias("from_turn"))
    itself = F.col("conv_id").eqNullSafe(F.col("from_conv")) & F.col("turn").eqNullSafe(F.col("from_turn"))
    return found.filter(F.col("from_conv").isNotNull() & ~itself)


def _earlier(conv: str, turn: str) -> Column:
    """Whether (conv, turn) comes before the message in the order that keeps replies free of circles."""
    return (F.col(turn) < F.col("turn")) | ((F.col(turn) == F.col("turn")) & (F.col(conv) < F.col("conv_id")))


def conversations(messages: DataFrame) -> DataFrame:
    """One row for each (conv_id, turn) of ``messages`` (conv_id, turn, role, text), without its quotations.

    role, text, n_quoted (quoted sentences), n_linked (those with a known original), parent_conv and parent_turn (null for
    the first message of a thread), thread_conv and thread_turn (its first message) and depth. A message only replies to
    one with a smaller turn (or the same turn of a smaller conversation), so that there are no circles. Null texts are empty;
    messages with a null conv_id or turn are threads of their own; repeated rows are one message; extra columns are ignored; an
    empty table gives an empty result.
    """
    rows = staged(parsed(messages), "quote-messages")
    links = staged(quotation_links(rows), "quote-links")
    votes = links.filter((F.col("level") == 1) & _earlier("from_conv", "from_turn")).groupBy("conv_id", "turn", "from_conv", "from_turn").count()
    # most sentences, then the later turn, then the smaller conversation
    best = F.max_by(F.struct("from_conv", "from_turn"), F.struct("count", "from_turn", (-F.col("from_conv")).alias("c")))
    replies = votes.groupBy("conv_id", "turn").agg(best.alias("p"))
    counts = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows"))
    joined = rows.join(replies, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    quoted = F.aggregate("quoted", F.lit(0), lambda a, q: a + F.size(q["hashes"]))
    parents = staged(joined.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), quoted.cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.when(F.col("p").isNotNull(), F.col("p.from_conv")).when(F.col("follows"), F.col("conv_id")).alias("parent_conv"),
        F.when(F.col("p").isNotNull(), F.col("p.from_turn")).when(F.col("follows"), F.col("turn") - 1).alias("parent_turn")), "quote-parents")

    # pointer doubling: after k rounds each message knows the one 2^k replies up, or has found its thread's first message
    heads = staged(parents.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("parent_conv", "conv_id").alias("up_conv"), F.coalesce("parent_turn", "turn").alias("up_turn"),
        F.when(F.col("parent_conv").isNull(), 0).otherwise(1).cast("long").alias("depth")), "quote-heads")
    done, active = heads.filter("depth = 0"), heads.filter("depth > 0")
    while not active.isEmpty():
        known = done.withColumn("ended", F.lit(True)).unionByName(active.withColumn("ended", F.lit(False))).select(
            F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("next_conv"), F.col("up_turn").alias("next_turn"),
            F.col("depth").alias("more"), "ended")
        step = staged(active.join(known, ["up_conv", "up_turn"]).select(
            "conv_id", "turn", F.col("next_conv").alias("up_conv"), F.col("next_turn").alias("up_turn"), (F.col("depth") + F.col("more")).alias("depth"), "ended"),
            "quote-heads")
        done, active = done.unionByName(step.filter("ended").drop("ended")), step.filter("NOT ended").drop("ended")
    heads = done
    threads = heads.select("conv_id", "turn", F.col("up_conv").alias("thread_conv"), F.col("up_turn").alias("thread_turn"), "depth")
    return parents.join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quoted", "n_linked", "parent_conv", "parent_turn",
        F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"))
