"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import chat, embed_dedup, host_rules, langid, lm_score, mixing, packing, simhash, token_count, toxicity
from sparkweft.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_embed_dedup": op1_embed_dedup,
    "op2_packing": op2_packing,
    "op3_chat": op3_chat,
    "op4_mixing": op4_mixing,
    "op5_host_rules": op5_host_rules,
    "op6_langid": op6_langid,
    "op7_token_count": op7_token_count,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_lm_score": op10_lm_score,
}

_CHAT_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos FROM conversations),
p AS (
  SELECT *, string_agg(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-') || chr(2), '')
    OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
whole AS (SELECT conv_id, n_turns, prefix FROM p WHERE pos = n_turns),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.prefix = w.prefix) GROUP BY n_turns, prefix)
SELECT conv_id, (pos - 1) // 64 AS part, k.n_turns, k.n_copies,
  string_agg('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
    || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
    || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept k USING (conv_id) GROUP BY ALL
"""

_HOST_SQL = """
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (
  SELECT doc_id, host, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, words FROM w),
g AS (SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram
  FROM m, LATERAL (SELECT unnest(range(1, n_words - 1)) AS i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 3) t(k) GROUP BY doc_id),
d AS (
  SELECT doc_id, host, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n.n, 0) > 50 * n_words AS base_failed
  FROM m LEFT JOIN n USING (doc_id)),
h AS (SELECT host, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM d GROUP BY host),
s AS (
  SELECT greatest(least(sum(failed) / sum(docs), 0.999), 0.001) AS mean, avg((failed / docs) ** 2) - avg(failed / docs) ** 2 AS spread,
    avg(1.0::DOUBLE / docs) AS noise FROM h),
prior AS (SELECT mean, greatest(least(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * noise, 1e-6) - 1, 1000.0), 2.0) AS k FROM s),
v AS (SELECT host, round((failed + mean * k) / (docs + k), 9) AS host_rate FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate < 0.5 AS kept, d.host, host_rate
FROM d JOIN v ON d.host IS NOT DISTINCT FROM v.host
"""

ORACLES = {
    "op3_chat": _CHAT_SQL,
    "op5_host_rules": _HOST_SQL,
    "op4_mixing": """
WITH sizes AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
rate AS (
  SELECT source, round(w / (SELECT sum(w) FROM sizes) * (SELECT sum(n) FROM sizes) / n, 9) AS r FROM sizes),
cdf AS (
  SELECT source, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rate, range(0, 400) t(k) WHERE k <= r + 12 * sqrt(r) + 24),
keyed AS (
  SELECT *, md5(concat_ws('|', coalesce(md5(doc_id::VARCHAR), '-'), coalesce(md5(text), '-'), coalesce(md5(lang), '-'),
    coalesce(md5(source), '-'), coalesce(md5(n_chars::VARCHAR), '-'))) AS row_key FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY row_key) AS number FROM keyed),
drawn AS (
  SELECT *, ('0x' || substr(md5(concat('42|', row_key, '|', number, '|1')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM numbered),
times AS (
  SELECT d.row_key, d.number, count(*) AS t FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u
  GROUP BY ALL)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, k AS copy_no,
  ('0x' || substr(md5(concat('42|order|', row_key, '|', number, '|', k)), 1, 13))::BIGINT AS mix_key
FROM drawn d JOIN times USING (row_key, number), LATERAL (SELECT unnest(range(1, t + 1)) AS k)
""",
}
