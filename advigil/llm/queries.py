"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from advigil.llm import (
    bm25_search,
    contamination,
    conversation_repair,
    line_dedup,
    mixing,
    near_duplicates,
    posting_lists,
    quality,
    secret_scan,
    source_divergence,
    surrogates,
    toxicity,
    warc_derivatives,
)
from advigil.llm.statements import OP11_CONVERSATION_REPAIR, OP13_SOURCE_DIVERGENCE
from advigil.session import prepare

# The key of a query has to be fixed for its result to be; a real one is a secret of the caller.
SURROGATE_KEY = "surrogates-1"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc_derivatives.page_derivatives(_table(spark, folder, "pages"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_report(_table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, folder, "documents"), distance=None)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated_pairs(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.with_surrogates(_table(spark, folder, "documents"), SURROGATE_KEY)


def op8_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return bm25_search.similar_documents(_table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repaired_conversations(_table(spark, folder, "conversations"))


def op12_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return posting_lists.nearest_vectors(_table(spark, folder, "embeddings"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_surrogates": op7_surrogates,
    "op8_bm25": op8_bm25,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_posting_lists": op12_posting_lists,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op2_mixing": r"""
        WITH sized AS (
            SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources
        ), ordered AS (
            SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM weighed
        ), summed AS (
            SELECT *,
                sum(cap) OVER up_to - cap AS cap_before, sum(weight) OVER up_to - weight AS weight_before,
                sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
            FROM ordered WINDOW up_to AS (ORDER BY ratio, place ROWS UNBOUNDED PRECEDING)
        ), marked AS (
            SELECT *, ratio <= CAST(words - cap_before AS DOUBLE) / CAST(weights - weight_before AS DOUBLE) AS held FROM summed
        ), shared AS (
            SELECT *,
                words - coalesce(sum(cap) FILTER (WHERE held) OVER (), 0) AS rest,
                greatest(weights - coalesce(sum(weight) FILTER (WHERE held) OVER (), 0), 1) AS rest_weight
            FROM marked
        ), targets AS (
            SELECT source, source_size, CASE WHEN held THEN CAST(cap AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target FROM shared
        ), rated AS (
            SELECT s.doc_id, s.size, t.source_size, t.target,
                CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
                CAST(('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(CAST(s.doc_id AS VARCHAR), ''), coalesce(s.text, ''))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ), drawn AS (
            SELECT *, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM rated
        )
        SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM drawn
    """,
    "op8_bm25": r"""
        WITH tokens AS (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents
        ), tf AS (
            SELECT doc_id, w, count(*) AS c FROM tokens GROUP BY ALL
        ), sizes AS (
            SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 0) AS dl FROM documents
        ), stats AS (
            SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS mean FROM sizes
        ), df AS (
            SELECT w, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY w
        ), scored AS (
            SELECT q.doc_id AS query_id, d.doc_id,
                round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
            FROM tf q JOIN tf d ON q.w = d.w JOIN df ON df.w = q.w JOIN sizes ON sizes.doc_id = d.doc_id CROSS JOIN stats
            WHERE q.doc_id % 50 = 0 GROUP BY ALL
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op11_conversation_repair": OP11_CONVERSATION_REPAIR,
    "op13_source_divergence": OP13_SOURCE_DIVERGENCE,
}
