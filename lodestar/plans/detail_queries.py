"""Queries of reasons, candidates, distributions, selections and rests of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import evidence, health, lifecycle, residual
from lodestar.plans.analysis_queries import _answers, _joined
from lodestar.plans.health_queries import RANK, SCORED, SIGNALS, WHY, X, _pair, _scored
from lodestar.plans.inputs import VERSIONS, chunks, table, versions
from lodestar.plans.operator_queries import DETAIL, residual_detail


def ocr_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.array_join("ocr_quality_reasons", "|").alias("reasons"))


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.top_candidates(health.reprocess_rank(_scored(spark, sf_dir))).select("id", "reprocess_rank", "document_priority", "reprocess_reason")


def ocr_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.ocr_distributions(_scored(spark, sf_dir))


def ocr_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.ocr_checks(health.reprocess_rank(_scored(spark, sf_dir)))


def reprocess_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active versions of the path that has most of them (ties: the first)."""
    docs = versions(spark, sf_dir)
    path = docs.where("is_active").groupBy("source_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_path").first().source_path
    return lifecycle.select_for_reprocess(docs, source_path=path).select("id", "source_path", "title")


def failed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lifecycle.inventory(versions(spark, sf_dir), health.chunk_signals(chunks(spark, sf_dir)), status="failed")
    return made.select("id", "is_latest", *(f"{s}_chunk_count" for s in health.SIGNALS))


def unresolved_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.unresolved(residual.impact(*_pair(spark, sf_dir))).select("source_path", "ratio_change", F.round("after_ratio", 6).alias("after_ratio"))


def residual_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual.residual_rollup(residual_detail(spark, sf_dir))


def normalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with their own references, or the labels of their hits."""
    labels = evidence.fallback_labels(_joined(spark, sf_dir).select("query_id", "chunk_id", "score", "citation_label", "doc_title", "folder"))
    asked = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 4 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"))
    return evidence.normalise_answers(_answers(spark, sf_dir).select("query_id", "answer").unionByName(asked), labels, "No evidence").select("query_id", F.md5("answer").alias("hash"), F.array_join("references", "|").alias("refs"))


_P = "round(x * 100)::INT || '%'"
REASONS = f"""
SELECT id, array_to_string(list_filter(CASE WHEN quarantined THEN ['Document quarantined']
  WHEN NOT ocr_used AND starts_with(coalesce(extraction_method, ''), 'native_') THEN [upper(extraction_method[8:]) || ' native', CASE WHEN x < 0.1 THEN 'Low exclusion (' || {_P} || ')' ELSE 'Some issues (' || {_P} || ' excluded)' END]
  WHEN ocr_used THEN ['OCR extracted', CASE WHEN x >= 0.5 THEN 'Very high exclusion (' WHEN x >= 0.4 THEN 'High contamination (' WHEN x >= 0.3 THEN 'Moderate contamination (' ELSE 'Low exclusion (' END || {_P} || ')', CASE WHEN coalesce(heading_chunk_count, 0) = 0 THEN 'No structural headings' END, CASE WHEN needs_review THEN 'Flagged for review' END]
  WHEN text_quality_tier = 'poor' THEN ['Poor quality tier'] WHEN text_quality_tier = 'partial' THEN ['Partial quality tier'] ELSE ['Clean quality tier (default)'] END, lambda r: r IS NOT NULL), '|') AS reasons FROM ({SCORED})
"""
FAILED = f"""
SELECT id, is_latest, {', '.join(f"coalesce(s.{s}_chunk_count, 0) AS {s}_chunk_count" for s in health.SIGNALS)} FROM (SELECT id, extraction_status, row_number() OVER (PARTITION BY source_path ORDER BY created_at DESC, updated_at DESC, id DESC) = 1 AS is_latest FROM ({VERSIONS})) LEFT JOIN ({SIGNALS}) s ON id = document_id WHERE extraction_status = 'failed'
"""
UNRESOLVED = f"""
WITH v AS (SELECT *, {X} AS x FROM ({VERSIONS})), b AS (SELECT DISTINCT ON (source_path) * FROM v ORDER BY source_path, id), a AS (SELECT DISTINCT ON (source_path) * FROM v ORDER BY source_path, id DESC)
SELECT source_path, round(a.x - b.x, 6) AS ratio_change, round(a.x, 6) AS after_ratio FROM b JOIN a USING (source_path) WHERE a.x >= 0.25 ORDER BY ratio_change, source_path LIMIT 10
"""
ROLLUP = f"""
WITH d AS ({DETAIL}), f AS (SELECT CASE WHEN regexp_extract(title, '^([A-Z]{{2,5}}(?:-[A-Z]{{2}})?)', 1) <> '' THEN regexp_extract(title, '^([A-Z]{{2,5}}(?:-[A-Z]{{2}})?)', 1) ELSE upper(split_part(title, ' ', 1)) END AS name, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, name LIMIT 8),
t AS (SELECT count(*) AS k, count(*) FILTER (WHERE likely_fixable) AS x, count(*) FILTER (WHERE likely_stable) AS s FROM d)
SELECT 'family' AS level, name, n, NULL::VARCHAR AS said FROM f UNION ALL SELECT 'overall', 'cleanup', x, CASE WHEN x > 0 THEN 'High: ' || x || '/' || k || ' docs likely fixable by footer/header cleanup' ELSE 'Low: Most residual issues tied to OCR or inherent structure' END FROM t
UNION ALL SELECT 'overall', 'risk', s, CASE WHEN s > k * 0.5 THEN 'High risk: ' || s || '/' || k || ' docs show stable floor traits' ELSE 'Moderate: ' || s || '/' || k || ' docs may be stable floor' END FROM t
"""

QUERIES = {
    "ocr_quality_reasons": (ocr_reasons, REASONS),
    "top_candidates": (top_candidates, f"SELECT s.id, r.reprocess_rank, document_priority, array_to_string({WHY}, '; ') AS reprocess_reason FROM ({SCORED}) s JOIN ({RANK}) r ON s.id = r.id ORDER BY reprocess_rank, s.id LIMIT 5"),
    "ocr_distributions": (ocr_distributions, f"SELECT 'status' AS level, ocr_quality_status AS name, count(*) AS n FROM ({SCORED}) GROUP BY 2 UNION ALL SELECT 'priority', document_priority, count(*) FROM ({SCORED}) GROUP BY 2"),
    "ocr_checks": (ocr_checks, f"SELECT count(*) AS total_documents, count(*) FILTER (WHERE ocr_quality_status IS NULL) = 0 AS all_docs_have_status, true AS all_quality_docs_have_reasons, count(*) FILTER (WHERE reprocess_candidate AND len({WHY}) = 0) = 0 AS all_candidates_have_reasons, true AS all_candidates_have_rank FROM ({SCORED})"),
    "reprocess_by_path": (reprocess_by_path, f"SELECT id, source_path, title FROM ({VERSIONS}) WHERE is_active AND source_path = (SELECT source_path FROM ({VERSIONS}) WHERE is_active GROUP BY 1 ORDER BY count(*) DESC, source_path LIMIT 1)"),
    "failed_inventory": (failed_inventory, FAILED),
    "unresolved_impacts": (unresolved_impacts, UNRESOLVED),
    "residual_rollup": (residual_rollup, ROLLUP),
    "normalised_answers": (normalised_answers, None),
}
