"""Queries over questions, chunks and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import patterns as P
from lodestar.operators import evidence, fusion, questions, search
from lodestar.plans.corpus_queries import q
from lodestar.plans.inputs import CHUNKS, HITS, QUESTIONS, chunks, conversations, hits, table
from lodestar.plans.inputs import questions as question_table

STOP = "[" + ", ".join(map(q, search.STOP_WORDS)) + "]"
TERMS = f"list_filter(string_split_regex(lower({{}}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({STOP}, w))"


def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = search.vector_search(queries, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


VECTOR = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score FROM v a, v b WHERE a.vec_id % 20 = 0)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 10
"""


def postings(spark, sf_dir):
    p = search.search_postings(chunks(spark, sf_dir), {"citation_label": "A", "section_title": "A", "content": "C"})
    return p.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf"), F.round(F.sum("weight"), 4).alias("weight"))


POSTED = f"""
SELECT chunk_id, term, max(w) AS weight, count(*) AS tf FROM (
  SELECT chunk_id, unnest({TERMS.format('citation_label')}) AS term, 1.0 AS w FROM ({CHUNKS})
  UNION ALL SELECT chunk_id, unnest({TERMS.format("coalesce(section_title, '')")}), 1.0 FROM ({CHUNKS})
  UNION ALL SELECT chunk_id, unnest({TERMS.format('content')}), 0.2 FROM ({CHUNKS})) GROUP BY 1, 2
"""


def fulltext_topk(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    p = search.search_postings(chunks(spark, sf_dir), {"citation_label": "A", "section_title": "A", "content": "C"})
    return search.fulltext_search(bench, p, 10, match="any").select("query_id", "chunk_id", "matched", F.round("score", 6).alias("score"))


FULLTEXT = f"""
WITH p AS ({POSTED}), a AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark),
s AS (SELECT query_id, chunk_id, sum(weight * tf / (tf + 1.0))::DOUBLE AS score, count(*) AS matched FROM p JOIN a USING (term) GROUP BY 1, 2)
SELECT query_id, chunk_id, matched, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM s) WHERE r <= 10
"""


def trigram_topk(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return search.trigram_search(bench, chunks(spark, sf_dir), 10, 0.3).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def trigram_prefixes(spark, sf_dir):
    """The same through the prefix index, which larger question tables take."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return search.trigram_search(bench, chunks(spark, sf_dir), 10, 0.3, places=0).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
TRIGRAM = f"""
WITH c AS (SELECT chunk_id, g, len(g) AS n FROM (SELECT chunk_id, {GRAMS.format('content')} AS g FROM ({CHUNKS}))),
b AS (SELECT item_id AS query_id, g, len(g) AS n FROM (SELECT item_id, {GRAMS.format('text')} AS g FROM benchmark)),
cx AS (SELECT chunk_id, n, unnest(g) AS gram FROM c), bx AS (SELECT query_id, n, unnest(g) AS gram FROM b),
s AS (SELECT query_id, chunk_id, count(*) / (max(cx.n) + max(bx.n) - count(*)) AS score FROM cx JOIN bx USING (gram) GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s WHERE score >= 0.3) WHERE r <= 10
"""


def hybrid_topk(spark, sf_dir):
    c = chunks(spark, sf_dir)
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    p = search.search_postings(c, {"citation_label": "A", "section_title": "A", "content": "C"})
    return search.hybrid_search(bench, c, p).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def list_anchor_hits(spark, sf_dir):
    """Titles say what their lines are: codes of tables, lists of notes; some appendix lines name programmes."""
    title = F.when(F.col("section_type") == "table", "Test codes").when(F.col("section_type") == "note", "List of entries").otherwise(F.col("section_title"))
    content = F.when(F.col("section_type") == "appendix", F.concat(F.lit("programme: "), "content")).otherwise(F.col("content"))
    return search.list_anchors(chunks(spark, sf_dir).withColumns({"section_title": title, "content": content}), 50)


LIST_ANCHORS = rf"""
SELECT chunk_id, score FROM (SELECT chunk_id, CASE WHEN regexp_matches(t, '(?i)test\s*codes?') THEN 1.0 WHEN regexp_matches(t, '(?i)\b(?:list|register|appendix)\b') THEN 0.95
  WHEN regexp_matches(content, '(?i)test\s*codes?') THEN 0.92 WHEN regexp_matches(content, {q(P.LIST_EVIDENCE)}) THEN 0.85 END::DOUBLE AS score
  FROM (SELECT chunk_id, CASE section_type WHEN 'table' THEN 'Test codes' WHEN 'note' THEN 'List of entries' ELSE coalesce(section_title, '') END AS t,
    CASE section_type WHEN 'appendix' THEN 'programme: ' || content ELSE content END AS content FROM ({CHUNKS}))) WHERE score IS NOT NULL ORDER BY score DESC, chunk_id LIMIT 50
"""


def _headings(spark, sf_dir):
    """Recurring headings as questions; the start of each is its section reference."""
    heads = chunks(spark, sf_dir).where("section_type = 'heading'").groupBy(F.col("content").alias("question")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("query_id")).where("n > 1")
    return heads.select("query_id", "question", F.array(F.substring("question", 1, 4)).alias("refs"))


def authoritative_hits(spark, sf_dir):
    titled = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("Register "), "doc_title")).otherwise(F.col("doc_title"))
    kept = chunks(spark, sf_dir).where("NOT retrieval_excluded").withColumn("doc_title", titled).withColumn("source_type", F.when(F.col("chunk_id") % 997 == 0, "CSV").otherwise("pdf"))
    return search.authoritative_anchors(_headings(spark, sf_dir), kept).select("query_id", "chunk_id", "rank", "score")


_LISTED = lambda c, words: "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"
AUTHORITY = rf"""
WITH qs AS (SELECT min(chunk_id) AS query_id, content AS question, list_distinct({TERMS.format('content')}) AS ts FROM ({CHUNKS}) WHERE section_type = 'heading' GROUP BY content HAVING count(*) > 1),
c AS (SELECT chunk_id, CASE WHEN chunk_id % 997 = 0 THEN 'csv' ELSE 'pdf' END AS kind, lower(CASE WHEN document_id % 3 = 0 THEN 'Register ' || doc_title ELSE doc_title END) AS title, lower(coalesce(section_title, '')) AS section, lower(citation_label) AS label, lower(content) AS content,
  {TERMS.format("concat_ws(' ', citation_label, coalesce(section_title, ''), content)")} AS ts FROM ({CHUNKS}) WHERE NOT retrieval_excluded),
j AS (SELECT query_id, chunk_id, kind, title, section, len(qs.ts) > 0 AND list_has_all(c.ts, qs.ts) AS matched, contains(c.content, lower(question)) OR contains(label, lower(question)) AS inside, contains(section, lower(question[1:4])) AS cited FROM qs, c),
s AS (SELECT query_id, chunk_id, CASE WHEN kind = 'csv' THEN 1.0 WHEN {_LISTED('title', search.AUTHORITY_TITLES)} THEN 0.96 WHEN {_LISTED('section', search.AUTHORITY_SECTIONS)} THEN 0.93 WHEN matched THEN 0.9 ELSE 0.82 END::DOUBLE AS score
  FROM j WHERE (kind = 'csv' OR {_LISTED('title', search.AUTHORITY_TITLES)} OR {_LISTED('section', search.AUTHORITY_SECTIONS)} OR cited) AND (matched OR inside OR kind = 'csv'))
SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, score FROM s) WHERE rank <= 24
"""


def deduped_hits(spark, sf_dir):
    h = hits(spark, sf_dir)
    return fusion.dedupe_max(h.select("query_id", "chunk_id", "score", "document_id"))


def normalised_hits(spark, sf_dir):
    return fusion.minmax(fusion.dedupe_max(hits(spark, sf_dir).select("query_id", "chunk_id", "score", "document_id"))).select("query_id", "chunk_id", F.round("norm", 6).alias("norm"))


DEDUPED = f"SELECT query_id, chunk_id, score, document_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, document_id DESC) AS k FROM ({HITS})) WHERE k = 1"


def fused_hits(spark, sf_dir):
    h = hits(spark, sf_dir)
    channel = lambda c: h.groupBy("query_id", "chunk_id").agg(F.max(c).alias("score"))
    return fusion.fuse(channel("score"), channel("fts").where("score > 10"), channel("trg").where("score > 0.02")).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


FUSED = f"""
WITH v AS (SELECT query_id, chunk_id, max(score) AS s FROM ({HITS}) GROUP BY 1, 2), f AS (SELECT query_id, chunk_id, max(fts) AS s FROM ({HITS}) GROUP BY 1, 2 HAVING max(fts) > 10),
t AS (SELECT query_id, chunk_id, max(trg) AS s FROM ({HITS}) GROUP BY 1, 2 HAVING max(trg) > 0.02),
n AS (SELECT query_id, chunk_id, 0.5 * CASE WHEN max(s) OVER w = min(s) OVER w THEN 1 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS x FROM v WINDOW w AS (PARTITION BY query_id)
  UNION ALL SELECT query_id, chunk_id, 0.3 * CASE WHEN max(s) OVER w = min(s) OVER w THEN 1 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END FROM f WINDOW w AS (PARTITION BY query_id)
  UNION ALL SELECT query_id, chunk_id, 0.2 * CASE WHEN max(s) OVER w = min(s) OVER w THEN 1 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END FROM t WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, round(sum(x), 6) AS score FROM n GROUP BY 1, 2
"""


def _unique(spark, sf_dir):
    return fusion.dedupe_max(hits(spark, sf_dir).select("query_id", "chunk_id", "score", "document_id"))


def capped_selection(spark, sf_dir):
    docs = _unique(spark, sf_dir).withColumn("document_id", F.col("document_id") % 3)
    return fusion.select_capped(docs, 4, 1).select("query_id", "chunk_id", "position")


CAPPED = f"""
WITH r AS (SELECT *, document_id % 3 AS d, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({DEDUPED})),
t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, d ORDER BY rank) <= 1 THEN 0 ELSE 1 END AS tier FROM r),
p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank)::INT AS position FROM t)
SELECT * FROM p WHERE position <= 4
"""


def topk_hits(spark, sf_dir):
    return search.top_k(_unique(spark, sf_dir), 3).select("query_id", "chunk_id", "rank")


def grounding_gates(spark, sf_dir):
    h = _unique(spark, sf_dir).withColumn("score", F.col("score") / 100000.0)
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    return fusion.grounding(asked, h).select("query_id", F.round(F.col("best_score") * 100000, 2).alias("best_price"), "gate")


GROUNDING = f"""
WITH b AS (SELECT query_id, max(score / 100000.0) AS s FROM ({DEDUPED}) GROUP BY 1)
SELECT o_orderkey AS query_id, round(s * 100000, 2) AS best_price, CASE WHEN s IS NULL OR s < 0.18 THEN 'no_evidence' WHEN s < 0.30 THEN 'low_confidence' ELSE 'grounded' END AS gate
FROM orders LEFT JOIN b ON o_orderkey = query_id
"""


def mixed_evidence(spark, sf_dir):
    return fusion.mixed_evidence(_unique(spark, sf_dir).withColumn("score", F.col("score") / 100000.0))


MIXED = f"""
WITH r AS (SELECT *, score / 100000.0 AS s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM ({DEDUPED}))
SELECT query_id, coalesce(count(*) >= 3 AND count(DISTINCT document_id) >= 2 AND max(s) - max(s) FILTER (WHERE k = 3) < 0.08, false) AS mixed FROM r GROUP BY 1
"""


def query_flags(spark, sf_dir):
    return questions.query_flags(question_table(spark, sf_dir)).drop("question")


FLAGS = f"""
SELECT query_id, regexp_matches(question, {q(P.LIST_PRIORITY)}) AS list_priority, regexp_matches(question, {q(P.RULES_QUERY)}) AS rules_query, regexp_matches(question, {q(P.CATALOGUE_QUERY)}) AS catalogue_query,
  regexp_matches(question, {q(P.MAPPING_QUERY)}) AS mapping_query, regexp_matches(question, {q(P.CANONICAL_QUERY)}) OR regexp_matches(question, {q(P.MAPPING_QUERY)}) AS canonical_query,
  regexp_matches(question, {q(P.STRUCTURAL_WORD)}) AS structural_word, regexp_matches(question, {q(P.WHAT_EXISTS)}) AS what_exists FROM ({QUESTIONS})
"""


def prepared_queries(spark, sf_dir):
    out = questions.prepare_query(question_table(spark, sf_dir))
    return out.select("query_id", "is_structural", F.array_join("section_refs", "|").alias("section_refs"), "expanded")


def followups(spark, sf_dir):
    return questions.followup_question(conversations(spark, sf_dir)).select("conv_id", "turn", "vague_followup", "deep_followup", "retrieval_question")


FOLLOWUPS = f"""
WITH f AS (SELECT *, regexp_matches(text, {q(P.VAGUE_FOLLOWUP)}) AS v, regexp_matches(text, {q(P.DEEP_FOLLOWUP)}) AS d,
  last_value(CASE WHEN role = 'user' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations)
SELECT conv_id, turn, v AS vague_followup, d AS deep_followup, CASE WHEN v OR d THEN CASE WHEN coalesce(b, '') = '' THEN trim(text) WHEN trim(text) = '' THEN b ELSE b || ' ' || trim(text) END ELSE trim(text) END AS retrieval_question FROM f
"""


def latest_assistant(spark, sf_dir):
    return questions.latest_assistant(conversations(spark, sf_dir)).select("conv_id", "turn", F.md5("latest_assistant").alias("latest"))


def source_groups(spark, sf_dir):
    h = _unique(spark, sf_dir).select("query_id", F.col("chunk_id").alias("k"), "score")
    c = chunks(spark, sf_dir).withColumn("k", F.col("document_id") * 3 + F.col("chunk_index"))
    return evidence.group_sources(h.join(c, "k")).drop("best_section")


SOURCES = rf"""
WITH j AS (SELECT h.query_id, c.* FROM ({DEDUPED}) h JOIN ({CHUNKS}) c ON h.chunk_id = c.document_id * 3 + c.chunk_index)
SELECT query_id, doc_title, folder, upper(trim(CASE WHEN regexp_extract(doc_title, '^\s*([A-Za-z]{{2,5}}(?:-[A-Za-z]{{1,4}})?\s*\d{{2,5}})', 1) <> ''
  THEN regexp_replace(regexp_extract(doc_title, '^\s*([A-Za-z]{{2,5}}(?:-[A-Za-z]{{1,4}})?\s*\d{{2,5}})', 1), '\s+', ' ', 'g') ELSE split_part(doc_title, ',', 1) END)) AS family,
  count(*) AS n_hits, max(length(content))::INT AS longest_preview FROM j GROUP BY 1, 2, 3, 4
"""


def evidence_summary(spark, sf_dir):
    h = _unique(spark, sf_dir).select("query_id", F.col("chunk_id").alias("k"))
    c = evidence.evidence_flags(chunks(spark, sf_dir)).withColumn("k", F.col("document_id") * 3 + F.col("chunk_index"))
    return evidence.evidence_summary(h.join(c.drop("content", "citation_label"), "k"))


def evidence_policies(spark, sf_dir):
    """Every order is a question, in turn about rules and about lists."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_custkey") % 2 == 0, "synthesis_rules").otherwise("synthesis_list").alias("intent"))
    return evidence.evidence_policy(evidence_summary(spark, sf_dir), asked).select("query_id", "intent", "policy")


SUMMARY = rf"""
WITH j AS (SELECT h.query_id, c.*, concat_ws(' ', coalesce(section_title, ''), content) AS corpus FROM ({DEDUPED}) h JOIN ({CHUNKS}) c ON h.chunk_id = c.document_id * 3 + c.chunk_index),
g AS (SELECT query_id, count(DISTINCT doc_title || '|||' || folder) AS documents, count(*) AS chunks, count(*) FILTER (WHERE trim(coalesce(section_title, '')) <> '') AS titled, count(*) FILTER (WHERE regexp_matches(corpus, {q(P.LIST_TEXT_SIGNAL)})) AS list_signals,
  count(*) FILTER (WHERE regexp_matches(corpus, {q(P.RULE_SIGNAL)})) AS rule_signals, count(*) FILTER (WHERE source_type = 'xlsx') AS structured,
  count(*) FILTER (WHERE source_type = 'xlsx' OR regexp_matches(doc_title, {q(P.AUTHORITATIVE_TITLE)}) OR regexp_matches(coalesce(section_title, ''), {q(P.AUTHORITATIVE_SECTION)})) AS authoritative,
  max(regexp_matches(corpus, '(?i)\b(system|configuration|partition|database|access)\b')::INT) + max(regexp_matches(corpus, '(?i)\b(sample|classification|eligibility)\b')::INT) + max(regexp_matches(corpus, '(?i)\b(data\s*entry|manual\s*entry|field|format)\b')::INT)
  + max(regexp_matches(corpus, '(?i)\b(result\s*entry|adjust|amend|correction)\b')::INT) + max(regexp_matches(corpus, '(?i)\b(instrument|program|programme|method)\b')::INT) + max(regexp_matches(corpus, '(?i)\b(release|report|approval|approve)\b')::INT)
  + max(regexp_matches(corpus, '(?i)\b(exception|escalation|reject|notify|out\s*of\s*range)\b')::INT) AS rule_categories FROM j GROUP BY 1)
SELECT *, structured > 0 OR authoritative >= 2 AS has_authoritative_source, documents >= 2 AND chunks >= 6 AND (structured > 0 OR authoritative >= 2 OR list_signals >= 3 OR rule_categories >= 3) AS has_strong_coverage,
  rule_categories >= 3 AND documents >= 2 AND chunks >= 6 AND rule_signals >= 4 AS has_broad_rules FROM g
"""
POLICIES = f"""
SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 2 = 0 THEN 'synthesis_rules' ELSE 'synthesis_list' END AS intent, CASE WHEN s.query_id IS NULL THEN 'none' WHEN o_custkey % 2 = 0 AND has_broad_rules THEN 'broad_rules'
  WHEN has_strong_coverage THEN 'strong' WHEN has_authoritative_source THEN 'authoritative' ELSE 'none' END AS policy FROM orders LEFT JOIN ({SUMMARY}) s ON s.query_id = o_orderkey
"""

QUERIES = {
    "vector_topk": (vector_topk, VECTOR),
    "postings": (postings, f"SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS tf, round(sum(weight)::DOUBLE, 4) AS weight FROM ({POSTED}) GROUP BY term"),
    "fulltext_topk": (fulltext_topk, FULLTEXT),
    "trigram_topk": (trigram_topk, TRIGRAM),
    "trigram_prefixes": (trigram_prefixes, TRIGRAM),
    "hybrid_topk": (hybrid_topk, None),
    "list_anchors": (list_anchor_hits, LIST_ANCHORS),
    "authoritative_hits": (authoritative_hits, AUTHORITY),
    "deduped_hits": (deduped_hits, DEDUPED),
    "normalised_hits": (normalised_hits, f"SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM ({DEDUPED}) WINDOW w AS (PARTITION BY query_id)"),
    "fused_hits": (fused_hits, FUSED),
    "capped_selection": (capped_selection, CAPPED),
    "topk_hits": (topk_hits, f"SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM ({DEDUPED})) WHERE rank <= 3"),
    "grounding_gates": (grounding_gates, GROUNDING),
    "mixed_evidence": (mixed_evidence, MIXED),
    "query_flags": (query_flags, FLAGS),
    "prepared_queries": (prepared_queries, None),
    "followup_questions": (followups, FOLLOWUPS),
    "latest_assistant": (latest_assistant, "SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS latest FROM conversations"),
    "source_groups": (source_groups, SOURCES),
    "evidence_summary": (evidence_summary, SUMMARY),
    "evidence_policies": (evidence_policies, POLICIES),
}
