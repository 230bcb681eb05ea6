"""Queries of this subpackage's operators over the tables of a data directory, and their SQL where it is feasible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import companies, languages, leaks, neardup, pii, tokens, topn
from eventloom.session import cut_lineage, table


def company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, rec_id, company) of both event tables."""
    events = table(spark, sf_dir, "standard_events").select(F.lit("standard_events").alias("tab"), F.col("row_id").alias("rec_id"), "company")
    raw = table(spark, sf_dir, "enterprise_raw_events").select(F.lit("enterprise_raw_events").alias("tab"), F.col("raw_id").alias("rec_id"), "company")
    return events.unionByName(raw)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_of_products(table(spark, sf_dir, "standard_events"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.map_records(company_records(spark, sf_dir), table(spark, sf_dir, "enterprise_pool"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_labels(languages.field_segments(table(spark, sf_dir, "standard_events")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "standard_events")
    mapping = cut_lineage(companies.match_names(events.select("company"), table(spark, sf_dir, "enterprise_pool")))
    return neardup.event_pairs(events, mapping)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars) of the documents that leak nothing, their characters counted."""
    docs = table(spark, sf_dir, "documents")
    kept = leaks.remove_leaked(docs, leaks.find_leaks(docs, table(spark, sf_dir, "eval_items")))
    return kept.select("doc_id", F.length("text").alias("n_chars"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.distinct_finds(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_clean": p8_clean, "p9_found": p9_found}


def oracle_sql() -> dict[str, str]:
    blank = r"[\s\x{00A0}\x{3000}]+"
    return {
        "p1_found": rf"""
            WITH saves AS (
              SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY row_id DESC) AS s FROM standard_events),
            ranked AS (
              SELECT lower(trim(regexp_replace(module, '{blank}', ' ', 'g'))) AS module, product, row_id,
                     row_number() OVER (PARTITION BY lower(trim(regexp_replace(module, '{blank}', ' ', 'g'))), product
                                        ORDER BY importance_score DESC, row_id) AS rank_no
              FROM saves
              WHERE (s = 1 OR event_id IS NULL) AND importance_score IS NOT NULL AND NOT isnan(importance_score)
                AND length(trim(regexp_replace(product, '{blank}', ' ', 'g'))) > 0)
            SELECT module, product, CAST(rank_no AS INTEGER) AS rank_no, row_id FROM ranked WHERE rank_no <= 5""",
    }
