"""Queries of the completeness audit. Lines of `documents` get numbered titles and cite appendices, so that every rule has cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import completeness
from lodestar.plans.inputs import CHUNKS, chunks, table

ENTRIES = """
SELECT document_id, chunk_id, page_number,
  CASE WHEN k % 11 = 4 THEN concat((k + document_id) % 17, '.', k % 5, '.2 ', substr(content, 1, 20)) WHEN k % 7 = 2 THEN concat((k + 3) % 17, CASE WHEN k % 2 = 0 THEN '. ' ELSE ') ' END, 'Part')
    WHEN k % 23 = 5 THEN 'Table of Contents' ELSE section_title END AS section_title,
  CASE WHEN k % 4 = 1 THEN concat(content, ' See Appendix ', k % 19, '.', document_id % 3, CASE WHEN k % 3 = 0 THEN '.1' ELSE '' END, '.') WHEN k % 9 = 7 THEN concat(content, ' appendix  B', k % 4, '.1, Appendix b', k % 3, '.1')
    WHEN k % 13 = 6 THEN concat('Entry 3.1 ..... ', k, ' appendix 18.1') ELSE content END AS content
FROM (SELECT *, chunk_index AS k FROM {chunks})
"""

#: Read by both engines.
FILES = """
SELECT doc_id AS id, concat('Title ', doc_id % 40) AS title, concat('docs/', doc_id, '.pdf') AS source_path, CASE doc_id % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'partial' WHEN 2 THEN 'poor' WHEN 3 THEN 'good' END AS text_quality_tier,
  doc_id % 3 = 0 AS needs_review, doc_id % 29 = 0 AS quarantined, coalesce(n, 0) AS chunk_count
FROM {documents} LEFT JOIN (SELECT document_id, count(*) AS n FROM {chunks} GROUP BY 1) ON document_id = doc_id
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENTRIES, chunks=chunks(spark, sf_dir))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.audit(files(spark, sf_dir), entries(spark, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES, documents=table(spark, sf_dir, "documents"), chunks=chunks(spark, sf_dir))


def completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("numbered_headings_found", "appendix_references", "missing_referenced_appendices", "reasons")
    return audited(spark, sf_dir).withColumns({c: F.array_join(c, "|") for c in lists})


def audit_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = completeness.audit_status(files(spark, sf_dir), audited(spark, sf_dir))
    return made.select("id", "needs_review", "extraction_completeness_status", "extraction_completeness_score")


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.audit_summary(audited(spark, sf_dir))


def audit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.audit_lists(audited(spark, sf_dir)).select("risk", "document_id", "risk_score", F.array_join("missing_referenced_appendices", "|").alias("missing"), F.size("reasons").alias("n_reasons"))


_ENTRIES = ENTRIES.replace("{chunks}", f"({CHUNKS})")
_KEY = "array_to_string(list_transform(string_split({0}, '.'), lambda p: lower(regexp_extract(p, '^[A-Za-z]?')) || lpad(length(regexp_replace(p, '^[A-Za-z]?0*', ''))::VARCHAR, 6, '0') || regexp_replace(p, '^[A-Za-z]?0*', '')), ' ')"
_NUMBER = r"'\b\d{1,2}(?:\.\d{1,3}){0,3}\b'"
_BLANKS = " || ".join(["' '", *(f"chr({c})" for c in (9, 10, 11, 12, 13, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))])

#: Written from the rules: every reference meets every heading and the joined text of its document.
AUDIT = rf"""
c AS (SELECT document_id AS d, page_number, coalesce(section_title, '') AS t, coalesce(content, '') AS x FROM ({_ENTRIES})),
cited AS (SELECT d, r[1] AS ref, lower(r[1]) AS path FROM (SELECT d, unnest(list_transform(regexp_extract_all(x, '(?i)\bappendix[\s\x{{A0}}]+[A-Z]?\d+\.\d+(?:\.\d+){{0,3}}\b'), lambda m: [regexp_extract(m, '(?i)appendix[\s\x{{A0}}]+(.*)', 1)])) AS r
  FROM c WHERE NOT contains(lower(t), 'table of contents') AND NOT contains(lower(x), 'table of contents') AND NOT regexp_matches(x, '\.{{4,}}\s*\d+'))),
refs AS (SELECT d, ref, path, sum(count(*)) OVER (PARTITION BY d, path) AS mentions FROM cited GROUP BY 1, 2, 3),
heads AS (SELECT DISTINCT d, lower(trim(t, {_BLANKS})) AS h FROM c WHERE trim(t, {_BLANKS}) <> ''),
corpus AS (SELECT d, lower(string_agg(t || chr(10) || x, chr(10))) AS s FROM c GROUP BY 1),
seen AS (SELECT r.d, r.ref, r.path, mentions, coalesce(bool_or(starts_with(h, path || ' ') OR starts_with(h, path || chr(9)) OR h = path OR starts_with(h, path || '.')), false) AS present,
  coalesce(bool_or(starts_with(h, string_split(path, '.')[1] || '.')), false) AS related FROM refs r LEFT JOIN heads USING (d) GROUP BY 1, 2, 3, 4),
judged AS (SELECT seen.*, NOT present AND NOT (mentions <= 1 AND related) AND (length(s) - length(replace(s, 'appendix ' || path, ''))) / length('appendix ' || path) < 2 AS missing FROM seen JOIN corpus USING (d)),
lists AS (SELECT d, list(ref ORDER BY {_KEY.format("path")}, path, ref <> path, ref) AS appendix_references, coalesce(list(ref ORDER BY {_KEY.format("path")}, path, ref <> path, ref) FILTER (WHERE missing), []) AS missing_referenced_appendices FROM judged GROUP BY 1),
numbers AS (SELECT DISTINCT d, unnest(regexp_extract_all(CASE WHEN trim(t, {_BLANKS}) <> '' THEN t ELSE '' END, {_NUMBER}) || regexp_extract_all(x, {_NUMBER})) AS n FROM c),
placed AS (SELECT d, n, row_number() OVER (PARTITION BY d ORDER BY {_KEY.format("n")}, n) AS k FROM numbers),
numbered AS (SELECT d, max(k) AS n_numbers, list(n ORDER BY k) FILTER (WHERE k <= 120) AS found FROM placed GROUP BY 1),
counts AS (SELECT d, count(DISTINCT page_number) AS pages_seen, sum(length(x))::BIGINT AS chars, count(DISTINCT CASE WHEN trim(t, {_BLANKS}) <> '' THEN trim(t, {_BLANKS}) END) AS heads FROM c GROUP BY 1),
files AS ({FILES.format(documents="documents", chunks=f"({CHUNKS})")}),
base AS (SELECT f.* RENAME (id AS document_id), coalesce(pages_seen, 0) AS pages_seen, coalesce(chars, 0) AS extracted_char_count, coalesce(heads, 0) AS heading_count, coalesce(n_numbers, 0) AS n_numbers,
  coalesce(found, []) AS numbered_headings_found, coalesce(appendix_references, []) AS appendix_references, coalesce(missing_referenced_appendices, []) AS missing_referenced_appendices,
  CASE WHEN chunk_count > 0 THEN floor(coalesce(chars, 0) / chunk_count + 0.5)::BIGINT ELSE 0 END AS avg_chars_per_chunk
  FROM files f LEFT JOIN counts ON counts.d = id LEFT JOIN numbered ON numbered.d = id LEFT JOIN lists ON lists.d = id),
scored AS (SELECT *, (CASE WHEN quarantined THEN 8 ELSE 0 END + CASE WHEN needs_review THEN 2 ELSE 0 END + CASE text_quality_tier WHEN 'poor' THEN 4 WHEN 'partial' THEN 1 ELSE 0 END + CASE WHEN chunk_count <= 5 THEN 2 ELSE 0 END
  + CASE WHEN avg_chars_per_chunk < 220 THEN 1 ELSE 0 END + CASE WHEN len(missing_referenced_appendices) > 0 THEN 4 ELSE 0 END + CASE WHEN n_numbers < 8 AND chunk_count > 40 THEN 1 ELSE 0 END)::INT AS risk_score,
  list_filter([CASE WHEN quarantined THEN 'Document is quarantined' END, CASE WHEN needs_review THEN 'Document is marked needs_review' END, CASE WHEN text_quality_tier = 'poor' THEN 'Text quality tier is poor' END,
    CASE WHEN text_quality_tier = 'partial' THEN 'Text quality tier is partial' END, CASE WHEN chunk_count <= 5 THEN 'Very low chunk count' END, CASE WHEN avg_chars_per_chunk < 220 THEN 'Low average characters per chunk' END,
    CASE WHEN len(missing_referenced_appendices) > 0 THEN 'Missing appendix content for refs: ' || array_to_string(missing_referenced_appendices, ', ') END,
    CASE WHEN n_numbers < 8 AND chunk_count > 40 THEN 'Low numbered-section detection compared to chunk volume' END], lambda r: r IS NOT NULL) AS reasons FROM base),
audited AS (SELECT *, CASE WHEN risk_score >= 7 THEN 'high' WHEN risk_score >= 4 THEN 'medium' ELSE 'low' END AS risk FROM scored)
"""

QUERIES = {
    "completeness_audit": (completeness_audit, f"WITH {AUDIT} SELECT * REPLACE (array_to_string(numbered_headings_found, '|') AS numbered_headings_found, array_to_string(appendix_references, '|') AS appendix_references, array_to_string(missing_referenced_appendices, '|') AS missing_referenced_appendices, array_to_string(reasons, '|') AS reasons) FROM audited"),
    "audit_statuses": (audit_statuses, f"WITH {AUDIT} SELECT document_id AS id, CASE WHEN risk = 'low' AND risk_score <= 1 AND coalesce(text_quality_tier, '') <> 'poor' THEN false ELSE needs_review END AS needs_review, CASE risk WHEN 'high' THEN 'suspect' WHEN 'medium' THEN 'partial' ELSE 'complete' END AS extraction_completeness_status, risk_score AS extraction_completeness_score FROM audited"),
    "audit_counts": (audit_counts, f"WITH {AUDIT} SELECT count(*) AS total_docs, count(*) FILTER (WHERE risk = 'high') AS high_risk, count(*) FILTER (WHERE risk = 'medium') AS medium_risk, count(*) FILTER (WHERE risk = 'low') AS low_risk FROM audited"),
    "audit_lists": (audit_lists, f"WITH {AUDIT} SELECT risk, document_id, risk_score, array_to_string(missing_referenced_appendices, '|') AS missing, len(reasons)::INT AS n_reasons FROM audited WHERE risk = 'high' OR document_id IN (SELECT document_id FROM audited WHERE risk = 'medium' ORDER BY risk_score DESC, title, document_id LIMIT 30)"),
}
