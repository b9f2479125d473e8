"""Queries of the structural and exclusion reports, over all partial documents and all their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import structural
from lodestar.plans.health_queries import EXCLUSION
from lodestar.plans.inputs import CHUNKS, chunks, table

#: Read by both engines.
DOCS = """
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN concat('LOP-AB ', doc_id % 7) WHEN 1 THEN concat('SOP 10', doc_id % 3, ' manual') WHEN 2 THEN '' ELSE concat('Title_', doc_id % 9, ' x') END AS title, concat('docs/', doc_id) AS source_path,
  CASE WHEN doc_id % 6 = 0 THEN 'xlsx' ELSE 'PDF' END AS source_type, doc_id % 13 <> 0 AS is_active, CASE doc_id % 5 WHEN 0 THEN 'good' WHEN 4 THEN NULL ELSE 'partial' END AS text_quality_tier,
  (doc_id % 100) / 100.0E0 AS text_quality_score, CASE doc_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'native_pdf' END AS extraction_method, doc_id % 7 = 0 AS ocr_used,
  n AS chunk_count, x AS excluded_chunk_count, 0 AS heading_chunk_count, 0 AS table_chunk_count, 0 AS list_chunk_count, doc_id % 2 = 0 AS weak, doc_id % 3 = 0 AS sparse
FROM {documents} LEFT JOIN (SELECT document_id, count(*) AS n, count(CASE WHEN retrieval_excluded THEN 1 END) AS x FROM {chunks} GROUP BY 1) ON document_id = doc_id
"""
MARKED = """
SELECT document_id, chunk_index, CASE WHEN section_type = 'note' THEN 'list' ELSE section_type END AS section_type, section_title, token_count, retrieval_excluded, is_boilerplate,
  CASE chunk_index % 17 WHEN 1 THEN 'broken_structure' WHEN 4 THEN 'short_fragment_noise' WHEN 6 THEN 'table_noise' WHEN 9 THEN 'ocr_garbage' WHEN 11 THEN 'metadata_block' END AS exclusion_tag,
  CASE WHEN chunk_index % 19 = 3 THEN concat(content, ' Page 3 of  9') WHEN chunk_index % 8 = 6 THEN concat(' 1.2 ', content) ELSE content END AS content
FROM {chunks}
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(DOCS, documents=table(spark, sf_dir, "documents"), chunks=chunks(spark, sf_dir))
    reasons = F.array_compact(F.array(F.when(F.col("weak"), "weak headings"), F.when(F.col("sparse"), "Sparse text")))
    return made.withColumn("quality_reasons", reasons)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.per_document(_docs(spark, sf_dir), spark.sql(MARKED, chunks=chunks(spark, sf_dir)), cohort=None)


def structural_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [F.round(f"score_{p}", 6).alias(p) for p in structural.PATTERNS]
    return _report(spark, sf_dir).select("id", "family", "excluded_ratio", "dominant_failure", "heading_ratio", "weak_heading_signal", "likely_messy", "avg_chunk_tokens", *scores)


def structural_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.structural_levels(_report(spark, sf_dir))


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("is_active AND text_quality_tier = 'partial'")


def exclusion_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.exclusion_levels(chunks(spark, sf_dir), _cohort(spark, sf_dir))


def exclusion_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _cohort(spark, sf_dir)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), ",")
    made = structural.exclusion_documents(structural.exclusion_levels(chunks(spark, sf_dir), docs), docs)
    return made.withColumns({c: joined(c) for c in ("dominant_exclusions", "section_types")})


_DOCS = DOCS.format(documents="documents", chunks=f"({CHUNKS})")
_SCORES = {
    "weak_heading_detection": "(CASE WHEN h = 0 THEN 2.5 ELSE 0 END + like_h * 0.7 + CASE WHEN weak THEN 2 ELSE 0 END)",
    "broken_section_boundary": "(broken * 0.6 + short * 0.35 + u * 2 + CASE WHEN n > 0 AND h = 0 THEN 0.5 ELSE 0 END)",
    "multi_column_fragmentation": "(CASE WHEN pdf THEN 1 ELSE 0 END + u * 1.8 + broken * 0.2 + CASE WHEN fallback THEN 0.5 ELSE 0 END)",
    "ocr_body_contamination": "(CASE WHEN ocr_used OR fallback THEN 1.2 ELSE 0 END + dirty * 0.9 + garbage * 0.7)",
    "table_schema_loss": "(noise * 0.8 + CASE WHEN t > 0 AND h <= 1 THEN 0.8 ELSE 0 END)",
    "split_procedure_fragment": "(short * 0.75 + l * 0.15 + broken * 0.25)",
    "footer_header_body_mix": "(dirty * 1.1 + meta * 0.25)",
    "diagram_caption_fragmentation": "(CASE WHEN pdf THEN 0.3 ELSE 0 END + CASE WHEN n > 0 AND h = 0 AND t = 0 THEN 0.4 ELSE 0 END)",
    "sparse_extraction": "(CASE WHEN n <= 3 THEN 3 WHEN n <= 8 THEN 1.5 ELSE 0 END + CASE WHEN sparse THEN 1 ELSE 0 END)",
    "layout_order_error": "(CASE WHEN pdf THEN 1 ELSE 0 END + u * 1.3 + CASE WHEN fallback THEN 0.8 ELSE 0 END)",
}
_REPORT = rf"""
m AS ({MARKED.format(chunks=f"({CHUNKS})")}), d AS (SELECT * FROM ({_DOCS}) WHERE is_active AND text_quality_tier = 'partial'),
a AS (SELECT document_id, count(*) FILTER (WHERE section_type = 'heading') AS h, count(*) FILTER (WHERE section_type = 'table') AS t, count(*) FILTER (WHERE section_type = 'list') AS l, count(*) FILTER (WHERE section_title IS NULL) AS un, round(avg(token_count), 2) AS tok,
  count(*) FILTER (WHERE exclusion_tag = 'broken_structure') AS broken, count(*) FILTER (WHERE exclusion_tag = 'short_fragment_noise') AS short, count(*) FILTER (WHERE exclusion_tag = 'table_noise') AS noise, count(*) FILTER (WHERE exclusion_tag = 'ocr_garbage') AS garbage,
  count(*) FILTER (WHERE exclusion_tag = 'metadata_block') AS meta, count(*) FILTER (WHERE regexp_matches(content, '(?i)(CONTROLLED COPY|IF THIS LINE IS GREEN|THIS DOCUMENT IS UNCONTROLLED|Page\s+[0-9]+\s+of\s+[0-9]+)')) AS dirty,
  count(*) FILTER (WHERE section_type = 'paragraph' AND regexp_matches(content, '^\s*\d+(\.\d+)*\s+[A-Za-z]')) AS like_h FROM m GROUP BY 1),
j AS (SELECT id, title, text_quality_score AS q, ocr_used, weak, sparse, lower(source_type) = 'pdf' AS pdf, coalesce(extraction_method IN ('ocr', 'native_pdfjs'), false) AS fallback, coalesce(chunk_count, 0) AS n, coalesce(excluded_chunk_count, 0) AS x,
  coalesce(h, 0) AS h, coalesce(t, 0) AS t, coalesce(l, 0) AS l, coalesce(un, 0) / greatest(coalesce(chunk_count, 0), 1) AS u, coalesce(tok, 0) AS tok, coalesce(broken, 0) AS broken, coalesce(short, 0) AS short, coalesce(noise, 0) AS noise, coalesce(garbage, 0) AS garbage, coalesce(meta, 0) AS meta, coalesce(dirty, 0) AS dirty, coalesce(like_h, 0) AS like_h
  FROM d LEFT JOIN a ON document_id = id),
s AS (SELECT *, round(x / greatest(n, 1), 4) AS excluded_ratio, {", ".join(f"{v}::DOUBLE AS s{i}" for i, v in enumerate(_SCORES.values()))} FROM j),
r AS (SELECT *, list_extract([{", ".join(f"'{k}'" for k in _SCORES)}], list_position([{", ".join(f"s{i}" for i in range(10))}], greatest({", ".join(f"s{i}" for i in range(10))}))) AS dominant_failure,
  CASE WHEN regexp_matches(title, '(?i)^(LOP|SOP)-[A-Z]{{2}}\b') THEN upper(title[:6]) ELSE coalesce(nullif(regexp_replace(string_split_regex(trim(title), '\s+')[1], '[^A-Za-z0-9-]', '', 'g'), ''), 'unknown') END AS family,
  (n <= 4 AND (fallback OR ocr_used)) OR (garbage >= 2 AND q < 0.55) AS likely_messy FROM s)
"""
#: The categories of the corpus query's SQL, with the chunks' types beside them.
_CATEGORIES = EXCLUSION.partition("\nn AS (")[0].strip().removeprefix("WITH ").replace("SELECT document_id, CASE", "SELECT document_id, section_type, CASE", 1).removesuffix(",")
_LEVELS = rf"""
{_CATEGORIES}, d AS (SELECT * FROM ({_DOCS}) WHERE is_active AND text_quality_tier = 'partial'),
k AS (SELECT document_id, category, coalesce(section_type, 'unknown') AS section_type, CASE WHEN regexp_matches(title, '(?i)^[A-Z]{{2,4}}[\s-]*\d{{3}}') THEN upper(regexp_replace(regexp_extract(title, '(?i)^([A-Z]{{2,4}}[\s-]*\d{{3}})', 1), '\s+', ' ', 'g'))
  WHEN regexp_matches(title, '(?i)^[A-Z]{{2,4}}\b') THEN upper(regexp_extract(title, '(?i)^([A-Z]{{2,4}})\b', 1)) ELSE 'OTHER' END AS family FROM e JOIN d ON id = document_id),
levels AS (SELECT 'document_category' AS level, document_id, category AS name, count(*) AS n FROM k GROUP BY 2, 3 UNION ALL SELECT 'document_type', document_id, section_type, count(*) FROM k GROUP BY 2, 3
  UNION ALL SELECT 'category', NULL, category, count(*) FROM k GROUP BY 3 UNION ALL SELECT * FROM (SELECT 'family', NULL, family, count(*) AS n FROM k GROUP BY 3 ORDER BY n DESC, family LIMIT 10))
"""
QUERIES = {
    "structural_failures": (structural_failures, f"WITH {_REPORT} SELECT id, family, excluded_ratio, dominant_failure, round(h / greatest(n, 1), 4) AS heading_ratio, h = 0 OR like_h >= 2 AS weak_heading_signal, likely_messy, tok AS avg_chunk_tokens, {', '.join(f'round(s{i}, 6) AS {k}' for i, k in enumerate(_SCORES))} FROM r"),
    "structural_levels": (structural_levels, f"""WITH {_REPORT}, p AS (SELECT unnest([{", ".join(f"'{k}'" for k in _SCORES)}]) AS name, unnest(range(10)) AS place),
      g AS (SELECT name, place, count(id) AS documents, floor((2 * sum(round(excluded_ratio * 10000)::BIGINT) + count(id)) / nullif(2 * count(id), 0)) / 10000 AS a, count(*) FILTER (WHERE likely_messy) AS messy FROM p LEFT JOIN r ON dominant_failure = name GROUP BY 1, 2)
      SELECT 'pattern' AS level, name, documents, a AS avg_excluded_ratio, messy, coalesce(name IN (SELECT name FROM g WHERE place IN (0, 1, 4, 5, 6) ORDER BY documents DESC, place LIMIT 3), false) AS fixable FROM g
      UNION ALL SELECT 'family', family, count(*), floor((2 * sum(round(excluded_ratio * 10000)::BIGINT) + count(*)) / (2 * count(*))) / 10000, count(*) FILTER (WHERE likely_messy), false FROM r GROUP BY 2 UNION ALL SELECT 'cohort', 'all', count(*), floor((2 * sum(round(excluded_ratio * 10000)::BIGINT) + count(*)) / (2 * count(*))) / 10000, count(*) FILTER (WHERE likely_messy), false FROM r"""),
    "exclusion_levels": (exclusion_levels, f"WITH {_LEVELS} SELECT * FROM levels"),
    "exclusion_documents": (exclusion_documents, f"""WITH {_LEVELS}, o AS (SELECT *, row_number() OVER (PARTITION BY level, document_id ORDER BY n DESC, name) AS r FROM levels WHERE document_id IS NOT NULL),
      g AS (SELECT document_id, string_agg(name || '=' || n, ',' ORDER BY r) FILTER (WHERE level = 'document_category' AND r <= 4) AS dominant_exclusions, string_agg(name || '=' || n, ',' ORDER BY r) FILTER (WHERE level = 'document_type') AS section_types FROM o GROUP BY 1)
      SELECT id, title, source_type, coalesce(chunk_count, 0) AS total_chunks, coalesce(chunk_count, 0) - coalesce(excluded_chunk_count, 0) AS included_chunks, coalesce(excluded_chunk_count, 0) AS excluded_chunks, dominant_exclusions, section_types FROM d LEFT JOIN g ON document_id = id"""),
}
