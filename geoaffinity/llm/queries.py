"""The named queries of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoaffinity.llm import (
    bpe_words,
    context_mixing,
    filter_audit,
    html_crf,
    jaccard_join,
    kmeans_tree,
    mixing,
    quality_rules,
    spelling,
    suffix_dedup,
    token_counts,
    toxicity,
    winnowing,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_lines(_table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"))


def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.search(_table(spark, folder, "embeddings"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_bpe_codes(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return bpe_words.encode_and_decode(docs, tokenizer("word_bpe_49k.json"))


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents"))


def op8_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.score_texts(_table(spark, folder, "documents"))


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_crf.extract_pages(_table(spark, folder, "pages"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, folder, "documents"))


def op11_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.fingerprint_edits(_table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(_table(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_toxicity": op5_toxicity,
    "op6_bpe_codes": op6_bpe_codes,
    "op7_source_mix": op7_source_mix,
    "op8_context_mixing": op8_context_mixing,
    "op9_main_text": op9_main_text,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_winnowing": op11_winnowing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}

#: The others are models, searches or codes that SQL cannot express; see tests/llm.
LLM_ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM base),
worded AS (
  SELECT r, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM lines),
counted AS (
  SELECT r, line, low, len(w) AS n,
    len(list_filter(w, lambda x: list_contains(['|', '||', '>', '>>', '/', '//', '::', '»', '›', '•', '·', '→', '«'], x))) AS separators
  FROM worded WHERE len(w) > 0),
judged AS (
  SELECT r, line, n, CASE
    WHEN separators >= 3 AND 10 * separators >= n THEN 'navigation'
    WHEN regexp_matches(low, 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|cookie settings|use cookies|uses cookies|accept cookies|accept all cookies|enable javascript|javascript is disabled|javascript is required|lorem ipsum|subscribe to our newsletter|sign up for our newsletter|click here to|skip to content|skip to main content|back to top|powered by|copyright \(c\)|permission is hereby granted|licensed under the|spdx-license-identifier|without warranty of any kind|redistribution and use in source') THEN 'boilerplate'
    WHEN 3 * len(regexp_extract_all(line, '[#*$%&|<>]')) > n THEN 'punctuation'
    WHEN NOT regexp_matches(line, '[\p{L}\p{N}]') THEN 'punctuation'
    WHEN n > 200 AND NOT regexp_matches(line, '[.!?…:;,。！？；：，،۔؟।]') THEN 'punctuation'
    END AS rule
  FROM counted),
by_line AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (rule = 'navigation') AS n_navigation, count(*) FILTER (rule = 'boilerplate') AS n_boilerplate,
    count(*) FILTER (rule = 'punctuation') AS n_punctuation, coalesce(sum(n) FILTER (rule IS NOT NULL), 0) AS lost_words
  FROM judged GROUP BY r),
grams AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM base WHERE len(w) > 5),
placed AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS g FROM grams),
again AS (SELECT r, p FROM placed QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
by_gram AS (SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM again, range(0, 5) AS t(k) GROUP BY r),
numbers AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_navigation, 0)::BIGINT AS n_navigation, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate,
    coalesce(n_punctuation, 0)::BIGINT AS n_punctuation, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM base LEFT JOIN by_line USING (r) LEFT JOIN by_gram USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM numbers""",
    "op10_jaccard_join": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN links l ON r.other = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) m ON s.doc_id = m.doc_id""",
    "op13_filter_audit": r"""
WITH facts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS mask
  FROM facts),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN marks ON masks.doc_id = marks.doc_id
  GROUP BY part, mask),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
rows AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM rows""",
}
