"""URL verdicts from a tree of path templates, in DataFrame functions only.

Each host has a tree whose branches are path segments. Segments that vary (numbers, hashes, dates, long words with digits)
become wildcards by shape; a literal segment becomes one if it is too rare at its place to be a word of the site. A node
thus stands for a template such as ``/en/*.html``. Labels are counted at every node. Sister branches whose shares of bad
labels do not differ significantly are merged into one, such as ``/de|en/*.html``. A
template is rejected if the share of bad labels among its addresses, smoothed towards its parent's and in the end towards the
whole table's, reaches a limit with enough confidence; an address follows its deepest template.

Rows are only ever aggregated by (host, template) with partial sums, so a host that holds a third of all pages is a few rows
after the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, staged

DEPTH = 4  # segments of a template; what lies deeper is one wildcard
RARE = 0.02  # a literal with a smaller share of its branch is a variable segment
Z = 1.96  # how far two shares may lie apart, in standard errors, for their branches to be merged
PRIOR = 8.0  # labels that the parent's share counts for
LIMIT = 0.5  # a template with a larger smoothed share of bad labels is rejected
MARGIN = 1.0  # standard errors by which it has to be larger

#: (verdict, domain, path start): a rule fits its domain and all subdomains; the longest one wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as written, its verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # longer ones overwrite
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        name = F.when(fits, F.lit(domain + start)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The first DEPTH path segments with varying parts replaced by ``*``; a suffix such as ``.html`` stays."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    head = F.slice(parts, 1, DEPTH)

    def shape(s: Column) -> Column:
        stem, end = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{2,5})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{2,5})?$", 2)
        varies = stem.rlike(r"^[0-9]+$|^[0-9a-fA-F-]{12,}$|[0-9]{4,}|^[0-9]{4}-[0-9]{2}|%[0-9A-Fa-f]{2}") | (F.length(stem) > 40)
        return F.concat(F.when(varies, "*").otherwise(F.lower(stem)), F.lower(end))

    deep = F.when(F.size(parts) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    slash = F.when(F.endswith(path, F.lit("/")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(head, shape), deep, slash)


def _node(keys: Column, depth: int | Column) -> Column:
    return F.array_join(F.slice(keys, 1, depth), "/")


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, bad) summed up: one row for each host and sequence of segments, with n, labelled and bad.

    ``bad`` is null where there is no label. Rare literals become wildcards, level by level from the host down.
    """
    rows = pages.select("host", segments(F.col("path")).alias("keys"), "bad").groupBy("host", "keys").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = staged(rows.withColumn("raw", F.col("keys")), "url-templates")
    for d in range(DEPTH):
        here = F.coalesce(F.try_element_at("keys", F.lit(d + 1)), F.lit(""))
        placed = rows.withColumn("above", _node(F.col("keys"), d)).withColumn("here", here)
        share = placed.groupBy("host", "above", "here").agg(F.sum("n").alias("own"))
        whole = share.groupBy("host", "above").agg(F.sum("own").alias("all"), F.count("*").alias("kinds"))
        rare = share.join(whole, ["host", "above"]).filter(
            (F.col("own") < RARE * F.col("all")) & (F.col("kinds") > 10) & (F.col("here") != "")).select("host", "above", "here", F.lit(True).alias("rare"))
        marked = placed.join(rare, ["host", "above", "here"], "left")
        suffix = F.regexp_extract("here", r"(\.[a-z]{2,5})$", 1)
        wild = F.concat(F.slice("keys", 1, d), F.array(F.concat(F.lit("*"), suffix)), F.slice("keys", d + 2, DEPTH + 2))
        rows = marked.withColumn("keys", F.when(F.col("rare"), wild).otherwise(F.col("keys"))).drop("above", "here", "rare")
        rows = staged(rows, "url-level")
    return rows


def merge_sisters(rows: DataFrame) -> DataFrame:
    """Adds ``merged``: keys in which sister branches under the host whose shares of bad labels are alike have become one.

    The sisters stand in order of their smoothed shares, and two neighbours stay apart only if a two-proportion test tells
    them apart. Rare literals are wildcards by now, so that a host has a few dozen branches at most.
    """
    placed = rows.withColumn("branch", F.coalesce(F.try_element_at("keys", F.lit(1)), F.lit("")))
    own = placed.filter(F.size("keys") > 1).groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    host = Window.partitionBy("host")
    shared = F.sum("b").over(host) / F.greatest(F.sum("l").over(host), F.lit(1))
    own = own.withColumn("s", (F.col("b") + PRIOR * shared) / (F.col("l") + PRIOR))
    line = host.orderBy("s", "branch")
    l, b, pl, pb = F.col("l"), F.col("b"), F.lag("l").over(line), F.lag("b").over(line)
    pooled = (b + pb) / F.greatest(l + pl, F.lit(1))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(l, F.lit(1)) + 1 / F.greatest(pl, F.lit(1))))
    apart = (l > 0) & (pl > 0) & (F.abs(b / F.greatest(l, F.lit(1)) - pb / F.greatest(pl, F.lit(1))) > Z * error)
    own = own.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("group", F.sum("apart").over(line))
    named = own.groupBy("host", "group").agg(F.sort_array(F.collect_list("branch")).alias("names"))
    named = named.select("host", F.explode("names").alias("branch"), F.array_join("names", "|").alias("name"))
    joined = placed.join(named, ["host", "branch"], "left")
    merged = F.when(F.size("keys") > 1, F.concat(F.array("name"), F.slice("keys", 2, DEPTH + 2))).otherwise(F.col("keys"))
    return joined.withColumn("merged", merged).drop("branch", "name")


def judged_templates(pages: DataFrame) -> DataFrame:
    """(host, raw, template, share, rejected) for every host and raw key sequence of ``pages`` (host, path, bad)."""
    rows = staged(merge_sisters(templates(pages)), "url-merged")
    total = rows.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    hosts = rows.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    nodes = rows.groupBy("host", "merged").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    for_all = ((total["b"] or 0) + 1) / ((total["l"] or 0) + 2)
    for_host = (F.col("hb") + PRIOR * for_all) / (F.col("hl") + PRIOR)
    share = (F.col("b") + PRIOR * for_host) / (F.col("l") + PRIOR)
    error = F.sqrt(share * (1 - share) / (F.col("l") + PRIOR))
    scored = nodes.join(hosts, "host").select(
        "host", "merged", share.alias("share"), (share - MARGIN * error > LIMIT).alias("rejected"))
    return rows.join(scored, ["host", "merged"]).select("host", "raw", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "share", "rejected")


def labels_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` (host, path, ...) with ``bad``: 1 if the document that the address names is labelled poor or toxic, 0 if it is
    labelled otherwise, null without a label. The last number of the path is the document's id."""
    number = F.expr(f"try_cast(regexp_extract({OWN}path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT)")
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(f"{OWN}number")).agg(bad.alias("bad"))
    return pages.withColumn(f"{OWN}path", F.col("path")).withColumn(f"{OWN}number", number).join(known, f"{OWN}number", "left").drop(f"{OWN}number", f"{OWN}path")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, share) for every row of ``pages`` (page_id, url).

    A null url, or one without ``://``, has an empty host and path and follows the template of such addresses. Repeated rows are judged each;
    null page_ids stay; extra columns are ignored. Without any labels every template is allowed. An empty table gives an empty result.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    known = judged_templates(labels_of(split, labels).select("host", "path", "bad"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    found = split.withColumn("raw", segments(F.col("path"))).join(staged(known, "url-verdicts"), ["host", "raw"], "left")
    own = F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")
    return found.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "share")
