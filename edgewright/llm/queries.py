"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, mixing, quality_model, quality_rules, ranked_search, secrets, simhash, suffix_dedup, token_store, toxicity, url_filter, vector_codes
from .work import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenized(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    every = [
        op1_mixing, op2_suffix_dedup, op3_quality_rules, op4_url_filter, op5_licenses, op6_simhash, op7_secrets, op8_decontaminate, op9_quality, op10_tokens,
        op11_toxicity, op12_vector_codes, op13_ranked_search,
    ]
    return {f.__name__: f for f in every}


RULES_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words)),
windows AS (SELECT doc_id, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, i, z IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS hit FROM windows),
covered AS (SELECT doc_id, count(*) FILTER (WHERE hit OR coalesce(a, false) OR coalesce(b, false)) AS n FROM
            (SELECT doc_id, hit, lag(hit, 1) OVER p AS a, lag(hit, 2) OVER p AS b FROM often WINDOW p AS (PARTITION BY doc_id ORDER BY i)) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM
          (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits FROM words),
base AS (SELECT c.*, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
         FROM counts c LEFT JOIN lines USING (doc_id) LEFT JOIN covered v USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                                OR 2 * n_upper > word_chars OR 3 * n_digits > word_chars) AS kept
FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": RULES_SQL, "op5_licenses": licenses.scanned_sql(), "op12_vector_codes": vector_codes.coded_sql(), "op13_ranked_search": ranked_search.RANKED_SQL}
