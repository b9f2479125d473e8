"""Queries over versions and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import health, lifecycle, residual
from lodestar.plans.inputs import CHUNKS, VERSIONS, chunks, versions

NONE = "array<string>"


def doc_chunk_stats(spark, sf_dir):
    return lifecycle.doc_chunk_stats(chunks(spark, sf_dir))


def invariants(spark, sf_dir):
    docs = versions(spark, sf_dir).where("is_active").select("id")
    return lifecycle.invariant_violations(chunks(spark, sf_dir), docs)


def chunk_uniqueness(spark, sf_dir):
    return lifecycle.uniqueness_violations(chunks(spark, sf_dir), ["document_id", "chunk_hash"])


def chunk_signals(spark, sf_dir):
    return health.chunk_signals(chunks(spark, sf_dir))


def inventory(spark, sf_dir):
    out = lifecycle.inventory(versions(spark, sf_dir), health.chunk_signals(chunks(spark, sf_dir)).withColumnsRenamed({f"{s}_chunk_count": f"n_{s}" for s in health.SIGNALS}), source_type="pdf")
    return out.select("id", "is_latest", *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in health.SIGNALS])


SIGNALS = f"SELECT document_id, {', '.join(f'''count(*) FILTER (WHERE section_type = '{s}') AS {s}_chunk_count''' for s in health.SIGNALS)} FROM ({CHUNKS}) GROUP BY document_id"


def quarantined_chunks(spark, sf_dir):
    out = lifecycle.quarantine_chunks(chunks(spark, sf_dir), versions(spark, sf_dir))
    return out.groupBy("document_id").agg(F.count_if("retrieval_excluded").alias("excluded"))


def health_metrics(spark, sf_dir):
    return health.health_derived(health.health_metrics(versions(spark, sf_dir), chunks(spark, sf_dir)))


HEALTH = f"""
WITH v AS ({VERSIONS}), m AS (SELECT
  count(*) FILTER (WHERE is_active) AS active_docs, count(*) FILTER (WHERE NOT is_active) AS inactive_versions,
  count(*) FILTER (WHERE is_active AND extraction_status = 'completed') AS active_completed, count(*) FILTER (WHERE is_active AND extraction_status = 'pending') AS active_pending,
  count(*) FILTER (WHERE is_active AND extraction_status = 'failed') AS active_failed, count(*) FILTER (WHERE NOT is_active AND extraction_status = 'failed') AS historical_failed,
  coalesce(sum(chunk_count) FILTER (WHERE is_active), 0)::BIGINT AS active_chunks_total,
  count(*) FILTER (WHERE is_active AND extraction_status = 'completed' AND chunk_count = 0) AS active_zero_text_docs,
  round(coalesce(avg(chunk_count) FILTER (WHERE is_active AND chunk_count > 0), 0), 1) AS active_avg_chunks_per_doc,
  count(*) FILTER (WHERE is_active AND source_missing) AS active_source_missing, count(*) FILTER (WHERE is_active AND ocr_used) AS active_ocr_used,
  count(*) FILTER (WHERE is_active AND quarantined) AS active_quarantined, count(*) FILTER (WHERE is_active AND needs_review) AS active_needs_review,
  count(*) FILTER (WHERE is_active AND text_quality_tier = 'good') AS active_good, count(*) FILTER (WHERE is_active AND text_quality_tier = 'partial') AS active_partial,
  count(*) FILTER (WHERE is_active AND text_quality_tier = 'poor') AS active_poor, count(*) FILTER (WHERE is_active AND text_quality_tier IS NULL) AS active_unclassified,
  count(*) FILTER (WHERE is_active AND extraction_method IN ('ocr', 'native_pdfjs')) AS active_fallback_extractions,
  coalesce(sum(excluded_chunk_count) FILTER (WHERE is_active), 0)::BIGINT AS active_excluded_chunks_total FROM v),
h AS (SELECT count(DISTINCT document_id) AS active_docs_with_structural_headings FROM ({CHUNKS}) WHERE section_type = 'appendix' AND document_id IN (SELECT id FROM v WHERE is_active))
SELECT *, round(CASE WHEN active_docs > 0 THEN active_fallback_extractions / active_docs ELSE 0 END * 100, 1) AS fallback_percent,
  round(CASE WHEN active_chunks_total > 0 THEN active_excluded_chunks_total / active_chunks_total ELSE 0 END * 100, 1) AS excluded_percent,
  active_docs + inactive_versions AS total_versions, active_good + active_partial + active_poor + active_unclassified AS quality_total,
  active_good + active_partial + active_poor + active_unclassified = active_docs AS quality_reconciles FROM m, h
"""


def _reasons(spark, sf_dir):
    return health.quality_reasons(versions(spark, sf_dir))


def quality_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).select("id", F.array_join("quality_reasons", "|").alias("reasons"))


R = {
    "Weak headings": "source_type IN ('pdf', 'docx', 'txt') AND chunk_count > 0 AND heading_chunk_count = 0",
    "OCR used": "ocr_used",
    "High excluded chunk ratio": "chunk_count > 0 AND excluded_chunk_count / chunk_count >= 0.25",
    "Fallback extraction": "extraction_method IN ('ocr', 'native_pdfjs')",
    "Sparse text": "chunk_count BETWEEN 1 AND 3",
    "Low chunk density": "source_type <> 'xlsx' AND chunk_count BETWEEN 1 AND 8",
    "Table-heavy": "source_type = 'xlsx' OR (chunk_count > 0 AND table_chunk_count / chunk_count >= 0.5)",
    "Low structure confidence": None,
    "Appendix-heavy / list-heavy": "chunk_count > 0 AND (appendix_chunk_count + list_chunk_count) / chunk_count >= 0.45",
    "Needs review": "needs_review",
    "Unclassified inputs": "text_quality_tier IS NULL",
    "Quarantined": "quarantined",
    "Source missing": "source_missing",
}
OTHERS = " OR ".join(f"({c})" for c in R.values() if c)
LOW = f"text_quality_score < 0.75 OR (coalesce(text_quality_tier = 'partial', false) AND NOT ({OTHERS}))"
REASON_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c or LOW} THEN '{k}' END" for k, c in R.items()) + "], lambda x: x IS NOT NULL)"


def reason_summary(spark, sf_dir):
    return health.reason_summary(_reasons(spark, sf_dir))


REASON_SUMMARY = f"SELECT coalesce(text_quality_tier, 'unclassified') AS tier, reason, count(*) AS n FROM (SELECT text_quality_tier, unnest({REASON_LIST}) AS reason FROM ({VERSIONS}) WHERE is_active) GROUP BY 1, 2"


def top_partial_reasons(spark, sf_dir):
    return health.top_reasons(health.reason_summary(_reasons(spark, sf_dir)))


def facet_values(spark, sf_dir):
    return lifecycle.facet_values(_reasons(spark, sf_dir), "quality_reasons")


def facet_filter(spark, sf_dir):
    docs = lifecycle.with_latest_flag(_reasons(spark, sf_dir))
    return lifecycle.facet_filter(docs, active=True, latest_only=True, tier="unclassified", reason="OCR used").select("id")


def _scored(spark, sf_dir):
    return health.reprocess_candidate(health.document_priority(health.ocr_quality(versions(spark, sf_dir), noisy=0.4), high=r"^LOP-[A-Z]+|^EOP|MANUAL|GUIDELINES"))


X = "(CASE WHEN chunk_count > 0 THEN excluded_chunk_count / chunk_count ELSE 0 END)"
SCORED = f"""
SELECT *, ocr_quality_status IN ('ocr_noisy', 'ocr_mixed') AND {X} > 0.15 AND (document_priority = 'high' OR ocr_quality_status = 'ocr_noisy') AS reprocess_candidate FROM (
SELECT *, {X} AS x, CASE WHEN quarantined THEN 'ocr_unusable'
  WHEN NOT ocr_used AND extraction_method LIKE 'native\\_%' ESCAPE '\\' THEN CASE WHEN {X} < 0.1 THEN 'native_clean' ELSE 'ocr_mixed' END
  WHEN ocr_used THEN CASE WHEN {X} >= 0.5 THEN 'ocr_unusable' WHEN {X} >= 0.4 THEN 'ocr_noisy' WHEN {X} >= 0.3 THEN 'ocr_mixed' ELSE 'ocr_clean' END
  WHEN text_quality_tier = 'poor' THEN 'ocr_noisy' WHEN text_quality_tier = 'partial' THEN 'ocr_mixed' ELSE 'ocr_clean' END AS ocr_quality_status,
  CASE WHEN NOT is_active THEN 'low' WHEN regexp_matches(upper(title), '^LOP-[A-Z]+|^EOP|MANUAL|GUIDELINES') THEN 'high'
  WHEN coalesce(text_quality_tier = 'partial', false) OR heading_chunk_count > 0 THEN 'medium' ELSE 'low' END AS document_priority FROM ({VERSIONS}))
"""


def ocr_quality(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "ocr_quality_status", "document_priority", "reprocess_candidate", "reprocess_reason")


WHY = f"""list_filter([CASE WHEN document_priority = 'high' THEN 'High-value document' END, CASE WHEN document_priority = 'medium' THEN 'Core operational document' END,
  CASE WHEN ocr_quality_status = 'ocr_noisy' THEN 'Significant OCR contamination' END, CASE WHEN ocr_quality_status = 'ocr_mixed' THEN 'Moderate OCR contamination' END,
  CASE WHEN x > 0.3 THEN round(x * 100)::INT || '% excluded chunks' END, CASE WHEN heading_chunk_count = 0 THEN 'Weak structure' END], lambda r: r IS NOT NULL)"""


def reprocess_rank(spark, sf_dir):
    return health.reprocess_rank(_scored(spark, sf_dir)).where("reprocess_candidate").select("id", "reprocess_rank")


RANK = f"""
SELECT id, row_number() OVER (ORDER BY CASE document_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, round(-x, 9), id) AS reprocess_rank
FROM ({SCORED}) WHERE reprocess_candidate
"""


def ocr_summary(spark, sf_dir):
    return health.ocr_summary(_scored(spark, sf_dir))


def ocr_reconciliation(spark, sf_dir):
    return health.ocr_reconciliation(_scored(spark, sf_dir))


def chunk_sizes(spark, sf_dir):
    return health.chunk_size_histogram(chunks(spark, sf_dir))


BUCKET = "CASE WHEN token_count < 20 THEN '<20' WHEN token_count < 50 THEN '20-49' WHEN token_count < 100 THEN '50-99' WHEN token_count < 200 THEN '100-199' WHEN token_count < 500 THEN '200-499' ELSE '>=500' END"


def compare_versions(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return health.compare_versions(c, c.where("NOT retrieval_excluded"))


def _one(where: str, name: str) -> str:
    return f"SELECT round(count(*) FILTER (WHERE token_count < 50) / count(*), 4) AS {name}_under_50, round(count(*) FILTER (WHERE token_count < 20) / count(*), 4) AS {name}_under_20, round(avg(token_count), 2) AS {name}_mean FROM ({CHUNKS}) WHERE {where}"


def smallest_chunks(spark, sf_dir):
    return health.smallest_chunks(chunks(spark, sf_dir))


def small_by_type(spark, sf_dir):
    return health.small_by_type(chunks(spark, sf_dir))


def yield_report(spark, sf_dir):
    return health.yield_report(chunks(spark, sf_dir)).withColumn("document_id", F.coalesce("document_id", F.lit(-1)))


YIELD = f"SELECT coalesce(document_id, -1) AS document_id, grouping(document_id)::INT AS is_total, count(*) AS chunks, count(*) FILTER (WHERE token_count < 20) AS under_20, count(*) FILTER (WHERE token_count < 50) AS under_50, round(avg(token_count), 2) AS mean_tokens FROM ({CHUNKS}) GROUP BY ROLLUP (document_id)"


def residual_cohort(spark, sf_dir):
    return residual.residual_cohort(versions(spark, sf_dir)).select("id", F.round("excluded_ratio", 6).alias("excluded_ratio"))


def exclusion_report(spark, sf_dir):
    return residual.exclusion_report(chunks(spark, sf_dir))


EXCLUSION = rf"""
WITH e AS (SELECT document_id, CASE WHEN is_boilerplate THEN 'boilerplate'
    WHEN regexp_matches(content, '\x{{FFFD}}{{2,}}|\?{{4,}}|\b[0OIl]{{8,}}\b') OR alnum = 0 OR sym / (alnum + sym) > 0.55 THEN 'ocr_garbage'
    WHEN regexp_matches(content, '(?i)controlled copy|uncontrolled|page\s+\d+\s+of') THEN 'header_footer' WHEN section_type = 'table' THEN 'table_noise'
    WHEN regexp_matches(content, '\.{{4,}}') THEN 'table_of_contents' WHEN section_type = 'heading' THEN 'heading_fragment' WHEN token_count < 10 THEN 'short_fragment'
    WHEN section_type = 'note' THEN 'list_fragment' WHEN section_type = 'appendix' THEN 'appendix_body' ELSE 'other' END AS category
  FROM (SELECT *, len(regexp_extract_all(content, '[A-Za-z0-9]')) AS alnum, len(regexp_extract_all(content, '[^\sA-Za-z0-9]')) AS sym FROM ({CHUNKS})) WHERE retrieval_excluded),
n AS (SELECT document_id, category, count(*) AS n FROM e GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, category)::INT AS rank FROM n) WHERE rank <= 4
"""


def _pair(spark, sf_dir):
    v = lifecycle.distinct_on(versions(spark, sf_dir), ["source_path"], [F.asc("id")])
    w = lifecycle.distinct_on(versions(spark, sf_dir), ["source_path"], [F.desc("id")])
    return v, w


def impact_summary(spark, sf_dir):
    return residual.impact_summary(residual.impact(*_pair(spark, sf_dir)))


IMPACT = f"""
WITH v AS (SELECT *, {X} AS x FROM ({VERSIONS})), b AS (SELECT DISTINCT ON (source_path) * FROM v ORDER BY source_path, id), a AS (SELECT DISTINCT ON (source_path) * FROM v ORDER BY source_path, id DESC),
j AS (SELECT round(a.x - b.x, 6) AS d, a.heading_chunk_count - b.heading_chunk_count AS h, a.x AS r FROM b JOIN a USING (source_path))
SELECT count(*) AS documents, count(*) FILTER (WHERE d < 0) AS improved, count(*) FILTER (WHERE h > 0) AS more_headings, count(*) FILTER (WHERE r >= 0.25) AS unresolved, round(avg(d), 6) AS mean_change FROM j
"""


QUERIES = {
    "doc_chunk_stats": (doc_chunk_stats, f"SELECT document_id, count(*) AS chunk_count, count(*) FILTER (WHERE retrieval_excluded) AS excluded_chunk_count, count(*) FILTER (WHERE is_boilerplate) AS boilerplate_chunk_count, count(*) FILTER (WHERE retrieval_downranked) AS downranked_chunk_count FROM ({CHUNKS}) GROUP BY document_id"),
    "invariant_violations": (invariants, f"SELECT chunk_id, 'excluded_embedded' AS violation FROM ({CHUNKS}) WHERE retrieval_excluded AND embedding_status = 'embedded' UNION ALL SELECT chunk_id, 'orphan' FROM ({CHUNKS}) WHERE document_id NOT IN (SELECT id FROM ({VERSIONS}) WHERE is_active)"),
    "chunk_uniqueness": (chunk_uniqueness, f"SELECT document_id, chunk_hash, count(*) AS n_rows FROM ({CHUNKS}) GROUP BY 1, 2 HAVING count(*) > 1"),
    "chunk_signals": (chunk_signals, SIGNALS),
    "inventory": (inventory, f"SELECT id, is_latest, {', '.join(f'coalesce({s}_chunk_count, 0) AS n_{s}' for s in health.SIGNALS)} FROM (SELECT id, source_type, row_number() OVER (PARTITION BY source_path ORDER BY created_at DESC, updated_at DESC, id DESC) = 1 AS is_latest FROM ({VERSIONS})) LEFT JOIN ({SIGNALS}) ON id = document_id WHERE source_type = 'pdf'"),
    "quarantined_chunks": (quarantined_chunks, f"SELECT document_id, count(*) FILTER (WHERE retrieval_excluded OR document_id IN (SELECT id FROM ({VERSIONS}) WHERE quarantined)) AS excluded FROM ({CHUNKS}) GROUP BY document_id"),
    "health_metrics": (health_metrics, HEALTH),
    "quality_reasons": (quality_reasons, f"SELECT id, array_to_string({REASON_LIST}, '|') AS reasons FROM ({VERSIONS})"),
    "reason_summary": (reason_summary, REASON_SUMMARY),
    "top_partial_reasons": (top_partial_reasons, f"SELECT * FROM ({REASON_SUMMARY}) WHERE tier = 'partial' ORDER BY n DESC, reason LIMIT 5"),
    "facet_values": (facet_values, f"SELECT DISTINCT unnest({REASON_LIST}) AS value FROM ({VERSIONS})"),
    "facet_filter": (facet_filter, f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY created_at DESC, updated_at DESC, id DESC) = 1 AS latest FROM ({VERSIONS})) WHERE is_active AND latest AND text_quality_tier IS NULL AND ocr_used"),
    "ocr_quality": (ocr_quality, f"SELECT id, ocr_quality_status, document_priority, reprocess_candidate, CASE WHEN reprocess_candidate THEN array_to_string({WHY}, '; ') ELSE '' END AS reprocess_reason FROM ({SCORED})"),
    "reprocess_rank": (reprocess_rank, RANK),
    "ocr_summary": (ocr_summary, f"SELECT {', '.join(f'''count(*) FILTER (WHERE is_active AND ocr_quality_status = '{s}') AS {s}''' for s in ('native_clean', 'ocr_clean', 'ocr_mixed', 'ocr_noisy', 'ocr_unusable'))}, count(*) FILTER (WHERE is_active AND reprocess_candidate) AS candidates FROM ({SCORED})"),
    "ocr_reconciliation": (ocr_reconciliation, f"SELECT ocr_quality_status, count(*) AS n, count(*) FILTER (WHERE text_quality_tier IS NULL) AS no_tier, count(*) FILTER (WHERE document_priority IS NULL) AS no_priority, min(id) AS sample_id FROM ({SCORED}) GROUP BY 1"),
    "chunk_size_histogram": (chunk_sizes, f"SELECT {BUCKET} AS bucket, count(*) AS n, round(avg(token_count), 2) AS mean_tokens FROM ({CHUNKS}) GROUP BY 1"),
    "compare_versions": (compare_versions, f"SELECT *, after_under_50 < 0.15 AND after_under_20 < 0.02 AND after_mean > 150 AS accepted FROM ({_one('true', 'before')}), ({_one('NOT retrieval_excluded', 'after')})"),
    "smallest_chunks": (smallest_chunks, f"SELECT chunk_id, section_type, token_count FROM ({CHUNKS}) ORDER BY token_count, chunk_id LIMIT 20"),
    "small_by_type": (small_by_type, f"SELECT section_type, count(*) AS n FROM ({CHUNKS}) WHERE token_count < 50 GROUP BY 1"),
    "yield_report": (yield_report, YIELD),
    "residual_cohort": (residual_cohort, f"SELECT id, round({X}, 6) AS excluded_ratio FROM ({VERSIONS}) WHERE is_active AND text_quality_tier = 'partial' AND {X} >= 0.25 ORDER BY {X} DESC, id LIMIT 20"),
    "exclusion_report": (exclusion_report, EXCLUSION),
    "impact_summary": (impact_summary, IMPACT),
}
