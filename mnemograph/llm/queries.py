"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from mnemograph.llm import binary_ids, byte_bpe, decontaminate, fill_in_middle, language_id, language_model, near_dedup, quality_rules, sharding, source_divergence, streaming_bpe, token_counts, url_rules
from mnemograph.llm.common import stored, table


def op1_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark, sf_dir):
    return url_rules.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_language_id(spark, sf_dir):
    return language_id.report(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark, sf_dir):
    return language_model.report(table(spark, sf_dir, "documents"))


def op7_token_id_files(spark, sf_dir):
    return binary_ids.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_dedup(spark, sf_dir):
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    return byte_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_streaming_bpe(spark, sf_dir):
    return streaming_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence.report(table(spark, sf_dir, "documents"))


# parts of operators that SQL can express


def url_fixed_rules(spark, sf_dir):
    """Host, path and fixed rule of every page."""
    return url_rules.parsed(table(spark, sf_dir, "pages")).select("page_id", "host", "path", url_rules.fixed()[0].alias("rule"))


def lm_base_scores(spark, sf_dir):
    """Counts and unigram base of every text, by the model before its training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stored(language_model.count_words(docs.where(~language_model.held_out())), "word-counts")
    lex = language_model.lexicon(counts)
    found = language_model.score(docs, counts, lex, language_model.start(lex))
    return found.select("doc_id", language_model.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), F.round("base_score", 3).alias("base_score"))


def quality_counts(spark, sf_dir):
    """Base statistics and base verdict of every text."""
    m = quality_rules.measured(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [], "m")
    return m.select("doc_id", *(F.col("m." + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), quality_rules.base_failed("m.").alias("base_failed"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_url_filter, op3_language_id, op4_token_counts, op5_sharding, op6_lm_scores, op7_token_id_files, op8_quality_rules, op9_near_dedup, op10_byte_bpe, op11_fill_in_middle, op12_streaming_bpe, op13_source_divergence, url_fixed_rules, lm_base_scores, quality_counts)
}

ORACLES = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hits AS (
  SELECT dp.doc_id, dp.p, s.n, iw.item_id
  FROM dp CROSS JOIN sizes s JOIN iw ON iw.n = s.n AND iw.win = array_to_string(dp.w[dp.p : dp.p + s.n - 1], ' ')
  WHERE dp.p + s.n - 1 <= len(dp.w)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov c USING (doc_id) LEFT JOIN its t USING (doc_id)
""",
    "op5_sharding": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)), 32, '0')
         || lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 8) AS BIGINT)), 32, '0') AS bits
  FROM documents),
split AS (
  SELECT 0 AS depth, doc_id, n_bytes, bits, CAST(sum(n_bytes) OVER () AS BIGINT) AS shard_bytes FROM sized
  UNION ALL
  SELECT depth + 1, doc_id, n_bytes, bits, CAST(sum(n_bytes) OVER (PARTITION BY substr(bits, 1, depth + 1)) AS BIGINT)
  FROM split WHERE shard_bytes > 67108864 AND depth < 64)
SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, depth, shard_bytes, shard_bytes <= 67108864 AS fits
FROM split WHERE shard_bytes <= 67108864 OR depth = 64
""",
    "op11_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT doc_id, t, n, form, least(x, y) AS a, greatest(x, y) AS b FROM u),
s AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s
""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT k, lang, source, term, count(*) AS c FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
v AS MATERIALIZED (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS n FROM o GROUP BY ALL HAVING count(*) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, CAST(sum(c) AS HUGEINT) AS c FROM o JOIN v USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM v GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(any_value(t.n), 0) AS n, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.n), 0) AS ln
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM c GROUP BY ALL) t USING (lang, source) LEFT JOIN l USING (lang) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, v.term, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (g.n + g.v) AS p FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pv AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(any_value(x.value), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY ALL),
tq AS (SELECT lang, source, term AS item, 1 + 1000000000 * (c + 1) // (g.n + g.v) AS p, 1 + 1000000000 * (v.n + 1) // (g.ln + g.v) AS q FROM c JOIN v USING (lang, term) JOIN g USING (lang, source)),
tv AS (SELECT lang, source, item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM tq WHERE p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pv
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM tv QUALIFY rank <= 200
""",
    "url_fixed_rules": r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM r),
f AS (SELECT * FROM (VALUES ('com', '/en/', 'com/en/'), ('example.com', '/en/7', 'example.com/en/7'), ('net', '/de/', 'net/de/'), ('example.net', '/de/8', 'example.net/de/8'), ('org', '/es/', 'org/es/')) f(h, s, rule)),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM p JOIN f ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT page_id, host, path, rule FROM p LEFT JOIN m USING (page_id)
""",
    "lm_base_scores": r"""
WITH d AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 10 = 0 AS held_out
  FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT t.doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c.c > 0) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))), 3) AS base_score
FROM t LEFT JOIN c USING (w) CROSS JOIN n GROUP BY t.doc_id
""",
    "quality_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM l LEFT JOIN r USING (doc_id)
""",
}
