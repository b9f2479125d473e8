"""Queries over documents, sections and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import patterns as P
from lodestar.functions import text as T
from lodestar.operators import lifecycle, normalise, text_quality
from lodestar.plans.inputs import SECTIONS, VERSIONS, sections, table, versions


def q(text: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def repeated_blocks_by_source(spark: SparkSession, sf_dir: str, at_least: int = 3) -> DataFrame:
    """The flagship: which share of each source's blocks recurs in `at_least` documents or more."""
    secs = sections(spark, sf_dir).select("doc_id", "source", T.boilerplate_hash(F.col("content")).alias("h"))
    # One pass over the text: sections by (block, source, document), then by (block, source); a block's documents are a sum over its sources.
    each = secs.groupBy("h", "source", "doc_id").agg(F.count("*").alias("n"))
    blocks = each.groupBy("h", "source").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    whole = blocks.withColumn("docs", F.sum("docs").over(Window.partitionBy("h")))
    return (
        whole.groupBy("source")
        .agg(F.sum("n").alias("sections"), F.sum(F.when(F.col("docs") >= at_least, F.col("n")).otherwise(0)).alias("repeated"), F.count_if(F.col("docs") >= at_least).alias("blocks"))
        .withColumn("share", F.round(F.col("repeated") / F.col("sections"), 6))
    )


def _hash(col: str) -> str:
    out = f"lower({col})"
    for p in P.HASH_STRIPS:
        out = f"regexp_replace({out}, {q(p)}, '', 'g')"
    return f"sha256(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


REPEATED = f"""
WITH secs AS (SELECT *, {_hash('content')} AS h FROM ({SECTIONS})),
counts AS (SELECT h, count(DISTINCT doc_id) AS docs FROM secs GROUP BY h)
SELECT source, count(*) AS sections, count(*) FILTER (WHERE docs >= 3) AS repeated,
  count(DISTINCT CASE WHEN docs >= 3 THEN secs.h END) AS blocks, round(count(*) FILTER (WHERE docs >= 3) / count(*), 6) AS share
FROM secs JOIN counts USING (h) GROUP BY source
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def content_hash(spark, sf_dir):
    return lifecycle.with_version_hash(_docs(spark, sf_dir), "text").select("doc_id", "version_hash")


def doc_identity(spark, sf_dir):
    files = versions(spark, sf_dir).select("id", F.concat("title", F.lit("."), "source_type").alias("filename"))
    return lifecycle.with_doc_identity(files).select("id", "title", "source_type", "normalised_title")


def paragraph_sections(spark, sf_dir):
    from lodestar.sources import corpus

    return corpus.paragraph_sections(_docs(spark, sf_dir), sep="\n")


def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


STRIP = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a)
SELECT page_id, trim(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS text FROM b
"""


def heading_levels(spark, sf_dir):
    return sections(spark, sf_dir).select("doc_id", "pos", T.heading_level(F.col("content")).alias("heading_level"), T.is_heading_like(F.col("content")).alias("heading_like"))


HEADING = rf"""
SELECT doc_id, pos, CASE WHEN regexp_extract(content, '^\s*(\d+(?:\.\d+)*)', 1) = '' THEN 1
  ELSE len(string_split(regexp_extract(content, '^\s*(\d+(?:\.\d+)*)', 1), '.')) END::INT AS heading_level,
  regexp_matches(content, {q(P.HEADING_NUMBERED)}) OR regexp_matches(content, {q(P.HEADING_KEYWORD)}) AS heading_like
FROM ({SECTIONS})
"""


def text_quality_scores(spark, sf_dir):
    found = text_quality.assess_text_quality(_docs(spark, sf_dir))
    signals = ("printable_ratio", "mean_token_score", "dictionary_hit_rate", "pages_with_text")
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in signals])


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS n, length(regexp_replace(text, '\s+', '', 'g')) AS chars,
  list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w <> '')) AS ws FROM d)
SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - len(regexp_extract_all(text, {q(P.UNPRINTABLE)}))) / length(text) ELSE 0 END, 6) AS printable_ratio,
  round(CASE WHEN n = 0 THEN 0 WHEN chars / n BETWEEN 3 AND 8 THEN 1 WHEN chars / n < 3 THEN chars / n / 3 ELSE greatest(0, 1 - (chars / n - 8) / 4) END, 6) AS mean_token_score,
  round(CASE WHEN len(ws) > 0 THEN len(list_intersect(ws, [{', '.join(map(q, P.COMMON_WORDS))}])) / len(ws) ELSE 0 END, 6) AS dictionary_hit_rate,
  CASE WHEN length(text) > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS pages_with_text
FROM t
"""


def suspicious_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(T.suspicious_rate(F.coalesce("text", F.lit(""))), 6).alias("suspicious_rate"))


def classified_sections(spark, sf_dir):
    cols = ["doc_id", "pos", "section_type", "section_type_confidence", "retrieval_excluded", "retrieval_downranked", "exclusion_tag"]
    return normalise.classify_sections(sections(spark, sf_dir)).select(*cols)


def boilerplate_fingerprints(spark, sf_dir):
    return normalise.fingerprints(sections(spark, sf_dir)).where("occurrence_count >= 2").select("boilerplate_hash", "occurrence_count")


FINGERPRINTS = f"SELECT h AS boilerplate_hash, count(*) AS occurrence_count FROM (SELECT {_hash('content')} AS h FROM ({SECTIONS})) GROUP BY h HAVING count(*) >= 2"


def protected_rules(spark, sf_dir):
    c = F.col("content")
    return sections(spark, sf_dir).select("doc_id", "pos", T.is_protected(c).alias("protected"), T.rule_boilerplate(c).alias("rule"), T.is_low_information(c).alias("low_information"))


PROTECTED = f"""
SELECT doc_id, pos, {' OR '.join(f'regexp_matches(content, {q(p)})' for p in P.PROTECTED)} AS protected,
  coalesce({', '.join(f'CASE WHEN regexp_matches(content, {q(p)}) THEN {q(label)} END' for p, label in P.BOILERPLATE_RULES)}) AS rule,
  len(list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> ''))) < 10 AS low_information
FROM ({SECTIONS})
"""


def suppressed_sections(spark, sf_dir):
    out = normalise.suppress_boilerplate(sections(spark, sf_dir).withColumns({"section_type": F.col("type"), "retrieval_excluded": F.lit(False), "exclusion_tag": F.lit(None).cast("string")}), threshold=3)
    return out.select("doc_id", "pos", "is_boilerplate", "suppressed_by")


SUPPRESSED = f"""
WITH s AS (SELECT *, {_hash('content')} AS h FROM ({SECTIONS})), n AS (SELECT h, count(*) AS n FROM s GROUP BY h),
p AS ({PROTECTED}),
j AS (SELECT s.doc_id, s.pos, CASE WHEN protected THEN NULL WHEN rule IS NOT NULL THEN 'rule:' || rule WHEN n >= 3 AND low_information THEN 'corpus' END AS suppressed_by
  FROM s JOIN n USING (h) JOIN p ON s.doc_id = p.doc_id AND s.pos = p.pos)
SELECT doc_id, pos, suppressed_by IS NOT NULL AS is_boilerplate, suppressed_by FROM j
"""


def _typed(spark, sf_dir):
    return sections(spark, sf_dir).withColumns({"section_type": F.col("type"), "retrieval_excluded": F.pmod("pos", F.lit(4)) == 1, "exclusion_tag": F.lit(None).cast("string")})


TYPED = f"SELECT *, type AS section_type, pos % 4 = 1 AS retrieval_excluded FROM ({SECTIONS})"


def deduped_sections(spark, sf_dir):
    return normalise.dedupe_within_doc(_typed(spark, sf_dir)).select("doc_id", "pos", "is_duplicate", "retrieval_excluded")


DEDUPED = f"""
WITH p AS (SELECT *, last_value(CASE WHEN section_type = 'heading' THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM ({TYPED})),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(trim(lower(content)), '\\s+', ' ', 'g'), section_type, parent ORDER BY pos) AS k FROM p)
SELECT doc_id, pos, k > 1 AND section_type NOT IN ('heading', 'procedure_step', 'warning', 'table') AS is_duplicate,
  retrieval_excluded OR (k > 1 AND section_type NOT IN ('heading', 'procedure_step', 'warning', 'table')) AS retrieval_excluded FROM k
"""


def kept_headings(spark, sf_dir):
    return normalise.drop_empty_headings(_typed(spark, sf_dir)).select("doc_id", "pos")


KEPT_HEADINGS = f"""
WITH t AS ({TYPED}),
n AS (SELECT a.doc_id, a.pos, min(b.pos) AS nxt FROM t a LEFT JOIN t b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.section_type = 'heading' AND b.level <= a.level
  WHERE a.section_type = 'heading' GROUP BY a.doc_id, a.pos),
c AS (SELECT n.doc_id, n.pos, count(b.pos) AS kids FROM n LEFT JOIN t b ON b.doc_id = n.doc_id AND b.pos > n.pos AND (n.nxt IS NULL OR b.pos < n.nxt)
  AND b.section_type <> 'heading' AND NOT b.retrieval_excluded GROUP BY n.doc_id, n.pos)
SELECT t.doc_id, t.pos FROM t LEFT JOIN c USING (doc_id, pos) WHERE t.section_type <> 'heading' OR kids > 0
"""


def merged_sections(spark, sf_dir):
    return normalise.merge_tiny(_typed(spark, sf_dir)).select("doc_id", "pos", "content", "n_merged")


def short_policy(spark, sf_dir):
    return normalise.short_content_policy(_typed(spark, sf_dir)).select("doc_id", "pos", "retained_short", "dropped_short", "retrieval_excluded")


def normalised_stats(spark, sf_dir):
    secs = sections(spark, sf_dir)
    return normalise.sanity_warnings(normalise.normalise_stats(secs, normalise.normalise(secs, threshold=3)))


def meaningful_short(spark, sf_dir):
    c = F.col("content")
    return sections(spark, sf_dir).select("doc_id", "pos", T.is_ocr_garbage(c).alias("garbage"), T.is_valuable_broken(c).alias("valuable"), F.size(T.imperative_verbs(c)).alias("verbs"), T.is_reference_list(c).alias("reference_list"))


SHORT = rf"""
WITH s AS (SELECT doc_id, pos, content, len(regexp_extract_all(content, '\S+')) AS n, len(regexp_extract_all(content, '[A-Za-z0-9]')) AS alnum,
  len(regexp_extract_all(content, '[^\sA-Za-z0-9]')) AS sym FROM ({SECTIONS}))
SELECT doc_id, pos, regexp_matches(content, {q(P.OCR_GARBAGE)}) OR alnum = 0 OR sym / (alnum + sym) > 0.55 AS garbage,
  n <= 50 AND ((regexp_matches(content, {q(P.EQUIPMENT_SPEC)}) AND n >= 3) OR (regexp_matches(content, {q(P.BROKEN_SETTING)}) AND regexp_matches(content, '\b\d+'))
    OR (regexp_matches(content, {q(P.SAFETY)}) AND n >= 3) OR (regexp_matches(content, {q(P.STEP_SIGNAL)}) AND regexp_matches(content, {q(P.SHORT_PROCEDURE)}))
    OR (regexp_matches(content, {q(P.BROKEN_RESULT)}) AND regexp_matches(content, '\b\d+'))) AS valuable,
  len(list_filter(string_split_regex(lower(content), '[\s,;:.!?()\[\]{{}}]+'), lambda w: list_contains([{', '.join(map(q, P.IMPERATIVE_VERBS))}], w)))::INT AS verbs,
  regexp_matches(content, {q(P.LIST_START)}) AND regexp_matches(content, {q(P.LIST_SIGNAL)}) AS reference_list
FROM s
"""


def _scan(spark, sf_dir):
    """What a scan finds: the sources that got a version in 2001 or later; the others are gone."""
    return versions(spark, sf_dir).groupBy("source_path").agg(F.max("version_hash").alias("version_hash"), F.max("created_at").alias("last")).where("last >= '2001-01-01'").drop("last")


SCAN = f"SELECT source_path, max(version_hash) AS version_hash FROM ({VERSIONS}) GROUP BY source_path HAVING max(created_at) >= DATE '2001-01-01'"


def detect_changes(spark, sf_dir):
    docs = lifecycle.distinct_on(versions(spark, sf_dir).where("is_active"), ["source_path"], [F.desc("id")])
    return lifecycle.detect_changes(_scan(spark, sf_dir), docs).select("source_path", "change")


CHANGES = f"""
WITH a AS (SELECT source_path, version_hash AS h FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY id DESC) AS k FROM ({VERSIONS}) WHERE is_active) WHERE k = 1)
SELECT s.source_path, CASE WHEN h IS NULL THEN 'new' WHEN h <> version_hash THEN 'changed' ELSE 'unchanged' END AS change FROM ({SCAN}) s LEFT JOIN a USING (source_path)
"""


def superseded(spark, sf_dir):
    out = lifecycle.supersede(versions(spark, sf_dir), _scan(spark, sf_dir), F.lit("2030-01-01").cast("timestamp"))
    return out.groupBy("is_active").agg(F.count("*").alias("n"), F.count("superseded_at").alias("closed"))


SUPERSEDED = f"""
WITH v AS (SELECT v.*, s.source_path IS NOT NULL AND is_active AS closed FROM ({VERSIONS}) v LEFT JOIN ({SCAN}) s USING (source_path))
SELECT is_active AND NOT closed AS is_active, count(*) AS n, count(*) FILTER (WHERE closed) AS closed FROM v GROUP BY 1
"""


def missing_sources(spark, sf_dir):
    return lifecycle.missing_sources(versions(spark, sf_dir), _scan(spark, sf_dir)).select("id", "source_path")


def latest_versions(spark, sf_dir):
    return lifecycle.with_latest_flag(versions(spark, sf_dir)).select("id", "is_latest")


def preferred_versions(spark, sf_dir):
    return lifecycle.distinct_on(versions(spark, sf_dir), ["source_path"], [F.desc("is_active"), F.desc("created_at"), F.desc("id")]).select("source_path", "id")


def active_path_violations(spark, sf_dir):
    return lifecycle.uniqueness_violations(versions(spark, sf_dir), ["source_path"], F.col("is_active"))


def domain_violations(spark, sf_dir):
    rules = {"source_type": ["pdf", "docx", "txt"], "extraction_status": ["completed", "pending"], "text_quality_tier": ["good", "partial"]}
    return lifecycle.domain_violations(versions(spark, sf_dir), rules)


DOMAIN = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n_rows FROM ({VERSIONS}) WHERE {c} NOT IN ({vals}) GROUP BY {c}"
    for c, vals in (("source_type", "'pdf', 'docx', 'txt'"), ("extraction_status", "'completed', 'pending'"), ("text_quality_tier", "'good', 'partial'"))
)


def reprocess_selection(spark, sf_dir):
    return lifecycle.select_for_reprocess(versions(spark, sf_dir), source_type="pdf", contains="LOP").select("id", "source_path")


def run_summary(spark, sf_dir):
    docs = versions(spark, sf_dir)
    changes = lifecycle.detect_changes(_scan(spark, sf_dir), lifecycle.distinct_on(docs.where("is_active"), ["source_path"], [F.desc("id")]))
    return lifecycle.run_summary(changes, docs.select(F.col("extraction_status").alias("status")), docs)


RUN_SUMMARY = f"""
SELECT * FROM (SELECT count(*) AS scanned, count(*) FILTER (WHERE change <> 'unchanged') AS processed, count(*) FILTER (WHERE change = 'unchanged') AS skipped FROM ({CHANGES})),
  (SELECT count(*) FILTER (WHERE extraction_status = 'failed') AS failed FROM ({VERSIONS})),
  (SELECT count(DISTINCT source_path) AS active_documents, sum(chunk_count)::BIGINT AS total_chunks, sum(excluded_chunk_count)::BIGINT AS excluded_chunks,
    count(*) FILTER (WHERE needs_review) AS needs_review, count(*) FILTER (WHERE quarantined) AS quarantined FROM ({VERSIONS}) WHERE is_active)
"""

QUERIES = {
    "repeated_blocks_by_source": (repeated_blocks_by_source, REPEATED),
    "content_hash": (content_hash, "SELECT doc_id, sha256(text) AS version_hash FROM documents"),
    "doc_identity": (
        doc_identity,
        f"SELECT id, regexp_replace(f, '\\.[^.]+$', '') AS title, lower(regexp_extract(f, '\\.([^.]+)$', 1)) AS source_type, trim(regexp_replace(lower(regexp_replace(f, '\\.[^.]+$', '')), '[^a-z0-9]+', ' ', 'g')) AS normalised_title FROM (SELECT id, title || '.' || source_type AS f FROM ({VERSIONS}))",
    ),
    "paragraph_sections": (
        paragraph_sections,
        "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INT AS pos, content, 'paragraph' AS type FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents) WHERE content <> ''",
    ),
    "strip_html": (strip_html, STRIP),
    "heading_levels": (heading_levels, HEADING),
    "text_quality_scores": (text_quality_scores, QUALITY),
    "suspicious_tokens": (suspicious_tokens, None),
    "classified_sections": (classified_sections, None),
    "boilerplate_fingerprints": (boilerplate_fingerprints, FINGERPRINTS),
    "protected_rules": (protected_rules, PROTECTED),
    "suppressed_sections": (suppressed_sections, SUPPRESSED),
    "deduped_sections": (deduped_sections, DEDUPED),
    "kept_headings": (kept_headings, KEPT_HEADINGS),
    "merged_sections": (merged_sections, None),
    "short_policy": (short_policy, None),
    "fragment_tests": (meaningful_short, SHORT),
    "normalised_stats": (normalised_stats, None),
    "detect_changes": (detect_changes, CHANGES),
    "superseded": (superseded, SUPERSEDED),
    "missing_sources": (missing_sources, f"SELECT id, source_path FROM ({VERSIONS}) WHERE is_active AND source_path NOT IN (SELECT source_path FROM ({SCAN}))"),
    "latest_versions": (latest_versions, f"SELECT id, row_number() OVER (PARTITION BY source_path ORDER BY created_at DESC, updated_at DESC, id DESC) = 1 AS is_latest FROM ({VERSIONS})"),
    "preferred_versions": (preferred_versions, f"SELECT DISTINCT ON (source_path) source_path, id FROM ({VERSIONS}) ORDER BY source_path, is_active DESC, created_at DESC, id DESC"),
    "active_path_violations": (active_path_violations, f"SELECT source_path, count(*) AS n_rows FROM ({VERSIONS}) WHERE is_active GROUP BY source_path HAVING count(*) > 1"),
    "domain_violations": (domain_violations, DOMAIN),
    "reprocess_selection": (reprocess_selection, f"SELECT id, source_path FROM ({VERSIONS}) WHERE is_active AND source_type = 'pdf' AND (contains(lower(title), 'lop') OR contains(lower(source_path), 'lop'))"),
    "run_summary": (run_summary, RUN_SUMMARY),
}
