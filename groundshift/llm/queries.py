"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, fingerprints, htmlmain, packing, pii, quality, quotes, simhash, substring, tokenfile, urls, variants
from .common import table

#: A word as DuckDB reads it.
_WORD = r"[^\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op4_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digests(table(spark, sf_dir, "documents"))


def op7_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"))


def op11_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tokens(text: str) -> str:
    """Tokens as decontaminate.tokens gives them; separators between digits may overlap, so they are dropped in two passes."""
    for _ in range(2):
        text = f"regexp_replace({text}, '([0-9])[.,:/]([0-9])', '\\1\\2', 'g')"
    return f"regexp_extract_all(regexp_replace({text}, '([0-9])(\\p{{L}})', '\\1 \\2', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


_KIND = (
    "CASE WHEN regexp_matches(w, '^\\p{N}') THEN '0' WHEN regexp_matches(w, '^\\p{Lu}\\p{Ll}') THEN '2' "
    f"WHEN lower(w) IN ({_listed(decontaminate.NUMBER_WORDS)}) THEN '0' WHEN lower(w) IN ({_listed(decontaminate.UNIT_WORDS)}) THEN '1' ELSE lower(w) END"
)

OP1_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, md5(text) AS key, {_tokens("text")} AS raw FROM documents WHERE text IS NOT NULL),
dt AS (SELECT *, list_transform(raw, lambda w: {_KIND}) AS typed FROM d),
b AS (SELECT item_id, {_tokens("coalesce(text, '')")} AS raw FROM benchmark WHERE item_id IS NOT NULL),
bt AS (SELECT *, list_transform(raw, lambda w: {_KIND}) AS typed FROM b),
fill AS (SELECT DISTINCT typed, raw, md5(array_to_string(raw, ' ')) AS filling, item_id FROM (SELECT typed, raw, min(item_id) OVER (PARTITION BY typed) AS item_id FROM bt)),
parts AS (SELECT DISTINCT item_id, s AS ipos, win FROM (
  SELECT item_id, s, array_to_string(typed[s:s + 7], ' ') AS win, len(list_filter(typed[s:s + 7], lambda w: w NOT IN ('0', '1', '2'))) AS words
  FROM (SELECT *, unnest(range(1, len(typed) - 6)) AS s FROM fill)) WHERE words >= 5),
wins AS (SELECT doc_id, key, raw AS draw, s AS dpos, array_to_string(typed[s:s + 7], ' ') AS win FROM (SELECT *, unnest(range(1, len(typed) - 6)) AS s FROM dt)),
hits AS (SELECT doc_id, key, item_id, ipos, dpos, draw[dpos:dpos + 7] AS said FROM wins JOIN parts USING (win)),
cells AS (SELECT DISTINCT doc_id, key, item_id, filling, len(raw) AS size, dpos - ipos AS diag, ipos + k AS i, typed[ipos + k] IN ('0', '1', '2') AS slot,
  lower(raw[ipos + k]) AS iv, lower(said[k + 1]) AS dv FROM (SELECT *, unnest(range(0, 8)) AS k FROM hits) JOIN fill USING (item_id)),
lines AS (SELECT doc_id, key, item_id, filling, diag, any_value(size) AS size, count(*) AS n_tokens, count(*) FILTER (slot) AS n_slots,
  count(*) FILTER (slot AND iv <> dv) AS n_changed, count(DISTINCT iv) FILTER (slot) AS fillers, count(DISTINCT (iv, dv)) FILTER (slot) AS pairs
  FROM cells GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT doc_id, item_id, max(struct_pack(a := n_tokens, b := n_slots, c := -n_changed)) AS m, bool_or(n_changed = 0) AS verbatim
  FROM lines WHERE n_tokens >= least(13, size) AND fillers >= 0.75 * pairs GROUP BY 1, 2)
SELECT doc_id, item_id, m.a AS n_tokens, m.b AS n_slots, -m.c AS n_changed, verbatim FROM best
"""


_OWN_HASHES = """list_distinct(list_filter(list_transform(string_split(regexp_replace(lower({0}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda s: s <> ''))"""

OP3_SQL = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, min(struct_pack(r := role, t := text)) AS m FROM conversations GROUP BY conv_id, turn),
l AS (SELECT conv_id, turn, m.r AS role, list_transform(string_split(coalesce(m.t, ''), chr(10)), lambda x: struct_pack(
  level := len(regexp_replace(regexp_extract(x, '^[ \\t]*(?:>[ \\t]?)+'), '[^>]', '', 'g')), body := regexp_replace(x, '^[ \\t]*(?:>[ \\t]?)+', ''))) AS lines FROM m),
q AS (SELECT *, len(list_filter(lines, lambda x: x.level > 0)) > 0 AS quoting FROM l),
o AS (SELECT conv_id, turn, role, lines, list_filter(lines, lambda x: x.level = 0 AND NOT (quoting AND regexp_matches(x.body, '{{A}}'))) AS own FROM q),
rows_ AS (SELECT conv_id, turn, role, lines, trim(array_to_string(list_transform(own, lambda x: x.body), chr(10))) AS text,
  {_OWN_HASHES.format("array_to_string(list_transform(own, lambda x: x.body), ' ')")} AS hashes FROM o),
levels AS (SELECT conv_id, turn, lines, unnest(range(1, 1 + list_max(list_transform(lines, lambda x: x.level)))) AS level FROM rows_),
asked AS (SELECT conv_id, turn, level, unnest({_OWN_HASHES.format("array_to_string(list_transform(list_filter(lines, lambda x: x.level = level AND NOT regexp_matches(x.body, '{A}')), lambda x: x.body), ' ')")}) AS h FROM levels),
own_h AS (SELECT conv_id, turn, unnest(hashes) AS h FROM rows_),
near AS (SELECT a.*, CASE WHEN n.t < a.turn THEN n.t END AS near FROM asked a LEFT JOIN (SELECT conv_id, h, min(turn) AS t FROM own_h GROUP BY 1, 2) n USING (conv_id, h)),
links AS (SELECT * FROM (SELECT conv_id, turn, level, h, CASE WHEN near IS NOT NULL THEN conv_id ELSE f.m.c END AS from_conv, coalesce(near, f.m.t) AS from_turn
  FROM near LEFT JOIN (SELECT h, min(struct_pack(c := conv_id, t := turn)) AS m FROM own_h GROUP BY h) f USING (h))
  WHERE from_conv IS NOT NULL AND NOT (conv_id = from_conv AND turn = from_turn)),
votes AS (SELECT conv_id, turn, from_conv, from_turn, count(*) AS n FROM links
  WHERE level = 1 AND (from_turn < turn OR (from_turn = turn AND from_conv < conv_id)) GROUP BY 1, 2, 3, 4),
replies AS (SELECT conv_id, turn, arg_max(struct_pack(c := from_conv, t := from_turn), (n, from_turn, -from_conv)) AS p FROM votes GROUP BY 1, 2),
parents AS (SELECT r.conv_id, r.turn, r.role, r.text, coalesce(a.n, 0) AS n_quoted, coalesce(k.n, 0) AS n_linked,
  CASE WHEN p IS NOT NULL THEN p.c WHEN b.turn IS NOT NULL THEN r.conv_id END AS parent_conv, CASE WHEN p IS NOT NULL THEN p.t WHEN b.turn IS NOT NULL THEN r.turn - 1 END AS parent_turn
  FROM rows_ r LEFT JOIN replies USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM asked GROUP BY 1, 2) a USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM links GROUP BY 1, 2) k USING (conv_id, turn) LEFT JOIN rows_ b ON b.conv_id = r.conv_id AND b.turn = r.turn - 1),
up(conv_id, turn, thread_conv, thread_turn, depth) AS (SELECT conv_id, turn, conv_id, turn, 0 FROM parents WHERE parent_conv IS NULL
  UNION ALL SELECT c.conv_id, c.turn, u.thread_conv, u.thread_turn, u.depth + 1 FROM up u JOIN parents c ON c.parent_conv = u.conv_id AND c.parent_turn = u.turn)
SELECT conv_id, turn, role, text, n_quoted, n_linked, parent_conv, parent_turn, thread_conv, thread_turn, depth FROM parents JOIN up USING (conv_id, turn)
""".replace("{A}", "(?i)(?:\\bwrote|\\bschrieb|a écrit|escribió)\\s*:?\\s*$")

OP10_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS t FROM starts JOIN d USING (doc_id)),
firsts AS (SELECT t, min(doc_id) AS least FROM win GROUP BY t),
marks AS (SELECT DISTINCT doc_id, s FROM win JOIN firsts USING (t) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM marks),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lag(text) OVER (ORDER BY doc_id), (SELECT arg_max(text, doc_id) FROM d)) AS nxt,
  coalesce(lag(doc_id) OVER (ORDER BY doc_id), (SELECT max(doc_id) FROM d)) AS next_id FROM d),
e AS (SELECT *, text[:length(text) - length(text) // 3] || nxt[:length(text) // 3] AS edited FROM o),
said AS (SELECT doc_id, v, unnest(regexp_extract_all({_LOWER.format("t")}, '{_WORD}')) AS w FROM (
  SELECT doc_id, 0 AS v, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e)),
counts AS (SELECT doc_id, v, w, count(*) AS c FROM said GROUP BY 1, 2, 3),
df AS (SELECT w, least((SELECT count(*) FROM d) // count(*), 32) AS r FROM counts WHERE v = 0 GROUP BY w),
weighed AS (SELECT doc_id, v, length(bin(c)) * length(bin(coalesce(r, 32))) AS wt, md5(w) AS h FROM counts LEFT JOIN df USING (w)),
digits AS (SELECT doc_id, v, i, wt, strpos('0123456789abcdef', h[i]) - 1 AS x FROM (SELECT *, unnest(range(1, 33)) AS i FROM weighed)),
votes AS (SELECT doc_id, v, i, [sum(CASE WHEN x & 8 > 0 THEN wt ELSE -wt END), sum(CASE WHEN x & 4 > 0 THEN wt ELSE -wt END),
  sum(CASE WHEN x & 2 > 0 THEN wt ELSE -wt END), sum(CASE WHEN x & 1 > 0 THEN wt ELSE -wt END)] AS s FROM digits GROUP BY 1, 2, 3),
prints AS (SELECT doc_id, v, string_agg('0123456789abcdef'[1 + (8 * (s[1] > 0)::INT + 4 * (s[2] > 0)::INT + 2 * (s[3] > 0)::INT + (s[4] > 0)::INT)], '' ORDER BY i) AS p FROM votes GROUP BY 1, 2),
p AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, next_id, coalesce(a.p, repeat('0', 32)) AS fingerprint, coalesce(b.p, repeat('0', 32)) AS edited_fingerprint
  FROM e LEFT JOIN (FROM prints WHERE v = 0) a USING (doc_id) LEFT JOIN (FROM prints WHERE v = 1) b USING (doc_id)),
n AS (SELECT *, [('0x' || fingerprint[:16])::UBIGINT, ('0x' || fingerprint[17:])::UBIGINT] AS f, [('0x' || edited_fingerprint[:16])::UBIGINT, ('0x' || edited_fingerprint[17:])::UBIGINT] AS g FROM p),
near AS (SELECT q.doc_id, count(*) - 1 AS n_near FROM n q JOIN n p ON bit_count(xor(q.f[1], p.f[1])::BIT) + bit_count(xor(q.f[2], p.f[2])::BIT) <= 4 WHERE q.doc_id % 50 = 0 GROUP BY 1)
SELECT n.doc_id, n.n_chars, n.edited_sha256, n.fingerprint, n.edited_fingerprint, 1 - (bit_count(xor(n.f[1], n.g[1])::BIT) + bit_count(xor(n.f[2], n.g[2])::BIT)) / 128.0::DOUBLE AS near_edited,
  1 - (bit_count(xor(n.f[1], m.f[1])::BIT) + bit_count(xor(n.f[2], m.f[2])::BIT)) / 128.0::DOUBLE AS near_next, n_near
FROM n JOIN n m ON m.doc_id = n.next_id LEFT JOIN near ON near.doc_id = n.doc_id
"""

#: CRC-32 by the usual table, which is made from its polynomial; UTF-8 bytes of code points below 256.
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN ord(x) < 128
  THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT)"""

#: DuckDB's levenshtein counts bytes, so the 64 accented letters become single ASCII characters, none of them a lower-case letter.
_ONE_BYTE = "translate({0}, '" + "".join(map(chr, range(0xC0, 0x100))) + "', '" + "".join(map(chr, range(0x21, 0x61))).replace("'", "''") + "')"

OP13_SQL = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY 1, 2),
hashed AS (SELECT w, c, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM runs, crc WHERE length(w) >= 6),
said AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM hashed),
words AS (SELECT word, {_ONE_BYTE.format("word")} AS plain, sum(c)::BIGINT AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM words a JOIN words b
  ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, near := near)) AS b FROM pairs GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN b.near END AS form, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n
  FROM words LEFT JOIN best USING (word)),
up(word, top) AS (SELECT word, word FROM forms UNION ALL SELECT u.word, f.form FROM up u JOIN forms f ON f.word = u.top WHERE f.form IS NOT NULL),
ends AS (SELECT u.word, u.top AS root FROM up u JOIN forms f ON f.word = u.top WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_template_leaks, op2_quality_votes, op3_quotation_links, op4_pii_votes, op5_path_templates, op6_token_files, op7_packing_dp, op8_simhash_near_dedup, op9_html_main_text, op10_substring_dedup,
    op11_simhash_fingerprints, op12_token_alignment, op13_spelling_variants,
)}
ORACLES: dict[str, str] = {"op1_template_leaks": OP1_SQL, "op3_quotation_links": OP3_SQL, "op10_substring_dedup": OP10_SQL, "op11_simhash_fingerprints": OP11_SQL, "op13_spelling_variants": OP13_SQL}
