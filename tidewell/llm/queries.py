"""The queries over the corpus operators, each with its production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import chat_format, embedding_dedup, language_id, lm_scoring, mixing, packing, quality_rules, simhash_dedup, suffix_dedup, toxicity
from tidewell.llm.common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.conversations(table(spark, sf_dir, "conversations"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_language_id, op3_packing, op4_quality_rules, op5_simhash_near_dedup, op6_chat_format, op7_lm_scoring, op8_mixing, op9_suffix_dedup, op10_toxicity)}

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT r, unnest(range(1, greatest(len(words) - 3, 1)::BIGINT)) AS i, words FROM w),
x AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS win FROM g),
y AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM x),
z AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM y WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(j - i, 5)))::BIGINT AS n_repeat_words FROM z GROUP BY r),
lu AS (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM w),
lt AS (SELECT r, k, line, trim(line, E' \t\n\x0b\f\r') AS bare FROM lu),
lf AS (SELECT r, k, line, bare, bare <> '' AND (
    NOT contains('.!?:;,…。！？"''”’»)]', right(bare, 1))
    OR length(bare) - length(translate(bare, '!?#*$%&|<>=~_^@\/{}[]+', '')) > 0.2 * length(bare)
    OR (length(bare) - length(translate(bare, '|»>·', '')) >= 2 AND (length(bare) - length(translate(bare, '|»>·', ''))) * 25 > length(bare))
    OR regexp_matches(bare, '^(?i)({MENU})[.!:]?$') OR regexp_matches(bare, '(?i)({BOILER})')) AS bad FROM lt),
la AS (SELECT r, count(*) FILTER (bare <> '') AS n_lines, count(DISTINCT line) FILTER (bare <> '') AS n_distinct,
    count(*) FILTER (bad) AS n_removed_lines, coalesce(sum(length(translate(line, E' \t\n\x0b\f\r', ''))) FILTER (NOT bad), 0) AS kept_chars FROM lf GROUP BY r),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (n_lines - n_distinct)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, n_removed_lines::BIGINT AS n_removed_lines, kept_chars
    FROM w JOIN la USING (r) LEFT JOIN rep USING (r)),
c AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND kept_chars > 0 AND word_chars - kept_chars <= 0.3 * word_chars AS kept, n_lines, n_removed_lines FROM c
"""

ORACLES: dict[str, str] = {"op4_quality_rules": _OP4.replace("{MENU}", quality_rules.MENU).replace("{BOILER}", quality_rules.BOILERPLATE)}
