"""Queries of those columns of operators 6 and 10 that SQL can express, by the same operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .divergence import op6_distribution_divergence
from .media import op10_media_columns


def quality_base_counts(spark, sf_dir: str) -> DataFrame:
    return op6_distribution_divergence(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def media_payloads(spark, sf_dir: str) -> DataFrame:
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


BASE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS t(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
PAYLOAD_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, n AS n_bytes, greatest(64, 64 * ((n + 63) // 64)) AS payload_bytes, sha256(text || repeat(chr(0), CAST(greatest(64, 64 * ((n + 63) // 64)) - n AS BIGINT))) AS payload_sha256 FROM d
"""
