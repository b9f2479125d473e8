"""Queries over single operators: lifecycle steps, boosts, question preparation, evaluation and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import patterns as P
from lodestar.operators import chunking, embedding, evidence, fusion, health, intents, lifecycle, questions, residual, search, text_quality
from lodestar.plans.analysis_queries import ANSWERS, JOINED, _answers, _joined
from lodestar.plans.corpus_queries import q
from lodestar.plans.health_queries import SCORED, _scored
from lodestar.plans.inputs import CHUNKS, HITS, QUESTIONS, VERSIONS, chunks, conversations, hits, table, versions
from lodestar.plans.inputs import questions as question_table
from lodestar.plans.search_queries import DEDUPED, GRAMS, MIXED, POSTED, TERMS, _unique

NOW = "2030-01-01 00:00:00"

#: The newest version of every path, as a scan of the sources would find it.
NEWEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY id DESC) AS _k FROM ({VERSIONS})) WHERE _k = 1"


def _newest(spark, sf_dir):
    return lifecycle.distinct_on(versions(spark, sf_dir), ["source_path"], [F.desc("id")])


def touched_versions(spark, sf_dir):
    out = lifecycle.touch_seen(versions(spark, sf_dir), _newest(spark, sf_dir).where("is_active"), F.lit(NOW).cast("timestamp"))
    return out.select("id", (F.col("last_seen_at") == F.lit(NOW).cast("timestamp")).alias("seen_now"))


TOUCHED = f"SELECT v.id, v.is_active AND n.source_path IS NOT NULL AS seen_now FROM ({VERSIONS}) v LEFT JOIN (SELECT source_path FROM ({NEWEST}) WHERE is_active) n USING (source_path)"


def appended_versions(spark, sf_dir):
    new = _newest(spark, sf_dir).where("NOT is_active").select("source_path", "title", "version_hash")
    out = lifecycle.append_versions(versions(spark, sf_dir), new, F.lit(NOW).cast("timestamp"))
    return out.groupBy("folder", "is_active").agg(F.count("*").alias("n"), F.count("chunk_count").alias("known"))


APPENDED = f"""
WITH a AS (SELECT folder, is_active, chunk_count FROM ({VERSIONS}) UNION ALL SELECT NULL, true, NULL FROM ({NEWEST}) WHERE NOT is_active)
SELECT folder, is_active, count(*) AS n, count(chunk_count) AS known FROM a GROUP BY 1, 2
"""


def removed_versions(spark, sf_dir):
    v = versions(spark, sf_dir)
    return lifecycle.remove(v, v.join(_newest(spark, sf_dir), "id", "left_anti")).select("id", "is_active")


REMOVED = f"SELECT v.id, v.is_active AND n.id IS NOT NULL AS is_active FROM ({VERSIONS}) v LEFT JOIN ({NEWEST}) n USING (id)"


def marked_missing(spark, sf_dir):
    return lifecycle.mark_missing(versions(spark, sf_dir), _newest(spark, sf_dir).where("is_active")).groupBy("source_missing").agg(F.count("*").alias("n"))


MISSING = f"SELECT v.is_active AND n.source_path IS NULL AS source_missing, count(*) AS n FROM ({VERSIONS}) v LEFT JOIN (SELECT source_path FROM ({NEWEST}) WHERE is_active) n USING (source_path) GROUP BY 1"


def routed_extractions(spark, sf_dir):
    docs = versions(spark, sf_dir).select("id", F.col("text_quality_tier").alias("native_tier"), (F.col("chunk_count") * 5).alias("native_chars"), F.when(F.col("ocr_used"), F.when(F.col("id") % 2 == 0, "poor").otherwise("good")).alias("ocr_tier"))
    return text_quality.route_extraction(docs).select("id", "route", "final_tier", "needs_review", "quarantined")


ROUTED = f"""
WITH d AS (SELECT id, text_quality_tier AS native_tier, chunk_count * 5 AS native_chars, CASE WHEN ocr_used THEN CASE WHEN id % 2 = 0 THEN 'poor' ELSE 'good' END END AS ocr_tier FROM ({VERSIONS}))
SELECT id, CASE WHEN (native_chars < 100 OR native_tier = 'poor') AND ocr_tier IS NULL THEN 'ocr_queue' WHEN ocr_tier IS NOT NULL THEN 'ocr' ELSE 'native' END AS route,
  coalesce(ocr_tier, native_tier) AS final_tier, coalesce(ocr_tier, native_tier) IN ('partial', 'poor') AS needs_review, coalesce(ocr_tier = 'poor', false) AS quarantined FROM d
"""


def extraction_methods(spark, sf_dir):
    v = versions(spark, sf_dir).withColumn("kind", F.when(F.col("source_type") == "txt", "image").otherwise(F.col("source_type")))
    return v.select(text_quality.extraction_method(F.col("kind"), F.col("ocr_used"), F.col("needs_review")).alias("method")).groupBy("method").agg(F.count("*").alias("n"))


METHODS = f"""
WITH v AS (SELECT *, CASE WHEN source_type = 'txt' THEN 'image' ELSE source_type END AS kind FROM ({VERSIONS}))
SELECT CASE WHEN ocr_used AND kind = 'image' THEN 'ocr_image' WHEN ocr_used THEN 'ocr' WHEN needs_review THEN 'native_' || kind || 'js' ELSE 'native_' || kind END AS method, count(*) AS n FROM v GROUP BY 1
"""


def ocr_confidences(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("double") / 53).alias("confidence"))
    return text_quality.ocr_confidence(pages)


CONFIDENCES = "SELECT l_orderkey AS doc_id, round(avg(CASE WHEN l_tax > 0 THEN CAST(l_quantity AS DOUBLE) / 53 ELSE 0 END), 2) AS ocr_confidence FROM lineitem GROUP BY 1"


def searchable_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir).drop("doc_title", "folder", "source_type")
    return search.searchable(c, versions(spark, sf_dir)).select("chunk_id", "doc_title", "folder", "source_type")


SEARCHABLE = f"SELECT chunk_id, title AS doc_title, v.folder, v.source_type FROM ({CHUNKS}) c JOIN ({VERSIONS}) v ON v.id = c.document_id WHERE v.is_active AND NOT retrieval_excluded"


def _short_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("question"))


SHORT = "SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS question FROM benchmark"


def fulltext_all_terms(spark, sf_dir):
    p = search.search_postings(chunks(spark, sf_dir), {"citation_label": "A", "section_title": "A", "content": "C"})
    return search.fulltext_search(_short_questions(spark, sf_dir), p, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


ALL_TERMS = f"""
WITH p AS ({POSTED}), a AS (SELECT DISTINCT query_id, unnest({TERMS.format('question')}) AS term FROM ({SHORT})), n AS (SELECT query_id, count(*) AS n FROM a GROUP BY 1),
s AS (SELECT query_id, chunk_id, sum(weight * tf / (tf + 1.0))::DOUBLE AS score, count(*) AS matched FROM p JOIN a USING (term) GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM s JOIN n USING (query_id) WHERE matched = n.n) WHERE r <= 10
"""


def _trigram_fields(spark, sf_dir):
    return search.trigram_search(_short_questions(spark, sf_dir), chunks(spark, sf_dir), 25, 0.3, search.TEXT_COLUMNS)


def trigram_fields(spark, sf_dir):
    """The greatest of content, label and section title counts."""
    return _trigram_fields(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


FIELD_SCORES = f"""
WITH b AS (SELECT query_id, g, len(g) AS n FROM (SELECT query_id, {GRAMS.format('question')} AS g FROM ({SHORT}))), bx AS (SELECT query_id, n, unnest(g) AS gram FROM b),
c AS (SELECT chunk_id, f, g, len(g) AS n FROM (SELECT chunk_id, unnest([1, 2, 3]) AS f, unnest([{GRAMS.format('content')}, {GRAMS.format('citation_label')}, {GRAMS.format("coalesce(section_title, '')")}]) AS g FROM ({CHUNKS}))),
cx AS (SELECT chunk_id, f, n, unnest(g) AS gram FROM c),
s AS (SELECT query_id, chunk_id, f, count(*) / (max(cx.n) + max(bx.n) - count(*)) AS score FROM cx JOIN bx USING (gram) GROUP BY 1, 2, 3),
m AS (SELECT query_id, chunk_id, max(score) AS score FROM s WHERE score >= 0.3 GROUP BY 1, 2)
SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM m) WHERE r <= 25
"""


def hybrid_text_only(spark, sf_dir):
    """Without question vectors: the degraded mode over text channels."""
    c = chunks(spark, sf_dir)
    p = search.search_postings(c, {"citation_label": "A", "section_title": "A", "content": "C"})
    return search.hybrid_search(_short_questions(spark, sf_dir), c, p).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


HYBRID = f"""
WITH p AS ({POSTED}), a AS (SELECT DISTINCT query_id, unnest({TERMS.format('question')}) AS term FROM ({SHORT})),
s AS (SELECT query_id, chunk_id, round(sum(weight * tf / (tf + 1.0))::DOUBLE, 9) AS score FROM p JOIN a USING (term) GROUP BY 1, 2),
f AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 25), t AS ({FIELD_SCORES}),
u AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS f, 0.0 AS t FROM f WINDOW w AS (PARTITION BY query_id)
  UNION ALL SELECT query_id, chunk_id, 0.0, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END FROM t WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT query_id, chunk_id, {P.CHANNEL_WEIGHTS[1]} * max(f)::DOUBLE + {P.CHANNEL_WEIGHTS[2]} * max(t)::DOUBLE AS score FROM u GROUP BY 1, 2)
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM z) WHERE rank <= 8
"""


def hybrid_vectors(spark, sf_dir):
    """All three channels over searchable chunks, with title admissions; the vectors are the stand-in model's."""
    asked = _short_questions(spark, sf_dir)
    kept = embedding.embed(chunks(spark, sf_dir).where("NOT retrieval_excluded"))
    vectors = embedding.embed(asked.select("query_id", F.col("question").alias("content"), F.lit(False).alias("retrieval_excluded"))).select("query_id", "embedding")
    p = search.search_postings(kept, {"citation_label": "A", "section_title": "A", "content": "C"})
    refs = asked.select("query_id", F.concat(F.lit("Title "), F.col("query_id") % 40).alias("ref"))
    return search.hybrid_search(asked, kept, p, vectors=vectors, refs=refs).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _as_hits(spark, sf_dir):
    """Chunks as hits of a question a document: entities are the first words of the line and of its title."""
    # The two engines see word ends beside accented letters differently, so those become a plain letter.
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "x")
    c = chunks(spark, sf_dir).withColumns({"content": plain("content"), "section_title": plain("section_title")})
    return c.select(
        F.col("document_id").alias("query_id"), "chunk_id", "document_id", "content", F.substring("content", 1, 60).alias("content_preview"), "section_title", "doc_title", "source_type", "retrieval_downranked",
        F.col("token_count").cast("double").alias("score"), F.regexp_extract("content", "^([A-Za-z]+) ", 1).alias("system_a"), F.regexp_extract(F.coalesce("section_title", F.lit("")), " ([a-z]{4,}) ", 1).alias("system_b"),
    )


_PLAIN = r"(SELECT * REPLACE (regexp_replace(content, '[^\x00-\x7F]', 'x', 'g') AS content, regexp_replace(section_title, '[^\x00-\x7F]', 'x', 'g') AS section_title) FROM ({}))".format(CHUNKS)
AS_HITS = f"""
SELECT document_id AS query_id, chunk_id, content, coalesce(section_title, '') || ' ' || substr(content, 1, 60) || ' ' || content AS corpus, coalesce(section_title, '') AS section, doc_title, source_type, retrieval_downranked,
  token_count::DOUBLE AS score, regexp_extract(content, '^([A-Za-z]+) ', 1) AS a, regexp_extract(coalesce(section_title, ''), ' ([a-z]{{4,}}) ', 1) AS b FROM {_PLAIN}
"""


def boost_factors(spark, sf_dir):
    h = _as_hits(spark, sf_dir)
    corpus = fusion.corpus_of()
    made = h.withColumns(
        {
            "rules": fusion.rules_factor(corpus), "structured": fusion.structured_factor(F.col("source_type")),
            "interaction": F.round(fusion.interaction_factor(corpus, F.col("section_title"), F.col("system_a"), F.col("system_b"), F.lit(False)), 6),
            "registry": fusion.registry_factor(F.col("content"), F.col("doc_title"), F.col("source_type")),
        }
    )
    return fusion.apply_downrank(made).select("chunk_id", "rules", "structured", "interaction", "registry", "score")


BOOSTS = rf"""
WITH h AS ({AS_HITS}), m AS (SELECT *, a <> '' AND regexp_matches(corpus, '(?i)\b' || a || '\b') AS has_a, b <> '' AND regexp_matches(corpus, '(?i)\b' || b || '\b') AS has_b, regexp_matches(corpus, {q(P.MECHANISM)}) AS mech FROM h)
SELECT chunk_id, CASE WHEN regexp_matches(corpus, {q(P.RULE_SIGNAL)}) THEN 1.08 ELSE 1.0 END::DOUBLE AS rules, CASE WHEN source_type = 'xlsx' THEN 1.12 ELSE 1.0 END::DOUBLE AS structured,
  round((CASE WHEN mech THEN 1.15 ELSE 1 END * CASE WHEN regexp_matches(section, {q(P.SETUP_SECTION)}) THEN 1.08 ELSE 1 END * CASE WHEN regexp_matches(corpus, {q(P.TRANSFER_VERB)}) THEN 1.12 ELSE 1 END
    * CASE WHEN regexp_matches(corpus, {q(P.DEPENDENCY)}) THEN 1.1 ELSE 1 END * CASE WHEN has_a AND has_b THEN 1.4 ELSE 1 END * CASE WHEN has_a <> has_b AND NOT mech THEN 0.7 ELSE 1 END)::DOUBLE, 6) AS interaction,
  greatest(1.0, CASE WHEN regexp_matches(content, '(?i)canonical|master|register|mapping|code|list|lookup') AND source_type = 'xlsx' THEN 1.14 ELSE 1.0 END,
    CASE WHEN regexp_matches(content, '(?i)interaction|integrat|flow|interface|report|export|billing|analytics') AND regexp_matches(doc_title, '(?i)manual|procedure') THEN 1.06 ELSE 1.0 END,
    CASE WHEN regexp_matches(doc_title, '(?i)reference|register|mapping|matrix|appendix') THEN 1.08 ELSE 1.0 END)::DOUBLE AS registry,
  score * CASE WHEN retrieval_downranked THEN 0.5 ELSE 1.0 END AS score FROM m
"""


def preserved_authority(spark, sf_dir):
    """A question's best structured hit enters its selection of three where it has none."""
    h = _as_hits(spark, sf_dir).withColumn("query_id", F.col("query_id") % 50)
    kept = fusion.preserve_authoritative(fusion.select_capped(h, 3, 1), h, 3)
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_or(F.col("source_type") == "xlsx").alias("has_structured"))


PRESERVED = f"""
WITH h AS (SELECT *, query_id % 50 AS qid FROM ({AS_HITS})), n AS (SELECT qid, least(count(*), 3) AS n, bool_or(source_type = 'xlsx') AS any_structured FROM h GROUP BY 1)
SELECT qid AS query_id, n, any_structured AS has_structured FROM n
"""


def evidence_misses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    refs = d.select(F.col("doc_id").alias("query_id"), F.array(F.when(F.col("lang") == "en", F.substring("text", 1, 12)).otherwise("no such reference")).alias("refs"))
    return fusion.evidence_miss(refs, _as_hits(spark, sf_dir).withColumn("citation_label", F.lit("")))


MISSES = f"""
WITH h AS (SELECT *, lower(section || chr(10) || chr(10) || substr(content, 1, 60) || chr(10) || content) AS c FROM ({AS_HITS})),
r AS (SELECT doc_id AS query_id, CASE WHEN lang = 'en' THEN lower(substr(text, 1, 12)) ELSE 'no such reference' END AS ref FROM documents)
SELECT r.query_id, NOT bool_or(coalesce(contains(c, ref) OR regexp_matches(c, {q(P.LIST_EVIDENCE)}), false)) AS miss FROM r LEFT JOIN h USING (query_id) GROUP BY 1
"""


def escalations(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Explain ").otherwise("Show "), "o_orderpriority").alias("question"),
        F.when(F.col("o_orderkey") % 4 == 0, "synthesis_rules").otherwise("standard").alias("intent"), F.when(F.col("o_orderkey") % 4 == 0, "synthesis").otherwise("standard").alias("mode"), (F.col("o_custkey") % 5 == 0).alias("quality"),
    )
    out = fusion.escalation_reasons(asked, _unique(spark, sf_dir).withColumn("score", F.col("score") / 100000.0))
    return out.select("query_id", F.array_join("reasons", "|").alias("reasons"))


ESCALATIONS = f"""
WITH b AS (SELECT query_id, max(score / 100000.0) AS s FROM ({DEDUPED}) GROUP BY 1), m AS ({MIXED})
SELECT o_orderkey AS query_id, concat_ws('|', CASE WHEN o_custkey % 5 = 0 THEN 'quality_mode_requested' END, CASE WHEN coalesce(s, 0) < 0.30 THEN 'low_grounded_score' END,
  CASE WHEN o_orderkey % 4 = 0 THEN 'synthesis_or_canonical_query' END, CASE WHEN o_orderkey % 4 = 0 THEN 'cross_document_synthesis' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'complex_query_pattern' END, CASE WHEN mixed THEN 'mixed_evidence' END) AS reasons
FROM orders LEFT JOIN b ON b.query_id = o_orderkey LEFT JOIN m ON m.query_id = o_orderkey
"""


def structural_lookups(spark, sf_dir):
    asked = question_table(spark, sf_dir).withColumn("question", F.concat(F.when(F.col("query_id") % 3 == 0, "List of section 4.2 ").when(F.col("query_id") % 3 == 1, "Appendix on ").otherwise(""), "question"))
    return questions.expand_structural(asked).select("query_id", F.md5("lookup").alias("lookup"))


LOOKUPS = rf"""
WITH t AS (SELECT query_id, trim(CASE query_id % 3 WHEN 0 THEN 'List of section 4.2 ' WHEN 1 THEN 'Appendix on ' ELSE '' END || question) AS x FROM ({QUESTIONS})),
r AS (SELECT *, regexp_extract(lower(x), '\b\d+\.\d+(?:\.\d+){{0,3}}\b') AS ref, regexp_matches(x, '(?i)\b(?:list|full list|codes?|test\s*codes?)\b') AS ls FROM t)
SELECT query_id, md5(CASE WHEN regexp_matches(x, '(?i)\b(?:appendix|section)\b') OR ref <> '' THEN concat_ws(' ', x, CASE WHEN ref <> '' THEN 'appendix ' || ref || ' section ' || ref END,
  CASE WHEN ls THEN 'codes entries' END, 'appendix') ELSE x END) AS lookup FROM r
"""


def entity_mentions(spark, sf_dir):
    """The registry's names are the first two and the first five words of each benchmark text."""
    bench = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    registry = bench.select(F.concat(F.lit("item "), "item_id").alias("canonical"), F.explode(F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (2, 5)])).alias("alias"), F.lit(False).alias("broad"))
    found = questions.entity_mentions(question_table(spark, sf_dir), registry.distinct())
    return found.select("query_id", F.array_join("mentions", "|").alias("mentions"))


_NORM = "array_to_string(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), ' ')"
MENTIONS = f"""
WITH b AS (SELECT 'item ' || item_id AS canonical, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM benchmark),
g AS (SELECT DISTINCT canonical, array_to_string(ws[1:unnest([2, 5])], ' ') AS alias FROM b), x AS (SELECT query_id, ' ' || {_NORM.format('question')} || ' ' AS t FROM ({QUESTIONS})),
f AS (SELECT query_id, canonical, min(length(t[1:instr(t, ' ' || alias || ' ')]) - length(replace(t[1:instr(t, ' ' || alias || ' ')], ' ', ''))) AS place FROM x JOIN g ON contains(t, ' ' || alias || ' ') GROUP BY 1, 2)
SELECT x.query_id, string_agg(canonical, '|' ORDER BY place, canonical) AS mentions FROM x LEFT JOIN f USING (query_id) GROUP BY 1
"""


def search_texts(spark, sf_dir):
    asked = question_table(spark, sf_dir).where("question IS NOT NULL")
    words = F.filter(F.split(F.lower("question"), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    registry = asked.select(F.get(words, 0).alias("canonical"), F.get(words, 1).alias("alias")).where("canonical IS NOT NULL AND alias IS NOT NULL").distinct()
    q_ = intents.classify(asked).withColumns({"mode": questions.retrieval_mode(F.col("intent")), "mentions": F.slice(words, 1, 1), "system_a": F.lit(None).cast("string"), "system_b": F.lit(None).cast("string"), "hint_terms": F.array().cast("array<string>")})
    return questions.search_text(questions.expand_registry(q_, registry)).select("query_id", "mode", F.md5("search_text").alias("search_text"))


def _marked(spark, sf_dir):
    """Every assistant turn carries a context named after the turn; those of every fourth conversation are malformed."""
    mark = F.concat(F.lit('<!--ctx:{"system_a": "s'), F.col("turn").cast("string"), F.when(F.col("conv_id") % 4 == 3, F.lit('}-->')).otherwise(F.lit('", "hint_terms": ["h"]}-->')))
    return conversations(spark, sf_dir).withColumn("text", F.when(F.col("role") == "assistant", F.concat("text", mark)).otherwise(F.col("text")))


def latest_contexts(spark, sf_dir):
    return questions.latest_context(_marked(spark, sf_dir)).select("conv_id", "turn", F.col("context.system_a").alias("system_a"))


CONTEXTS = "SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' AND conv_id % 4 <> 3 AND text IS NOT NULL THEN 's' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS system_a FROM conversations"


def inherited_modes(spark, sf_dir):
    return questions.inherit_mode(_marked(spark, sf_dir)).groupBy("role", "inherited_mode").agg(F.count("*").alias("n"))


INHERITED = f"""
WITH c AS ({CONTEXTS.replace('SELECT conv_id, turn,', 'SELECT *,')}), l AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT role, CASE WHEN role = 'user' AND (system_a IS NOT NULL OR coalesce(regexp_matches(before, '(?i)how these systems interact|interaction between'), false))
  AND (regexp_matches(text, {q(P.VAGUE_FOLLOWUP)}) OR regexp_matches(text, {q(P.DEEP_FOLLOWUP)})) THEN 'interaction' END AS inherited_mode, count(*) AS n FROM l GROUP BY 1, 2
"""


def citations(spark, sf_dir):
    return evidence.cite(_joined(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("citation_label").alias("first_label"), F.round(F.max("score"), 2).alias("best"))




def image_previews(spark, sf_dir):
    h = _joined(spark, sf_dir).withColumn("source_type", F.when(F.col("source_type") == "xlsx", "image").otherwise(F.col("source_type")))
    return evidence.image_previews(h).groupBy("document_id").agg(F.count("*").alias("questions"))


def shown_sources(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("query_id", evidence.should_show_sources(F.col("answer"), F.col("n_sources")).alias("shown"))


SHOWN = f"SELECT query_id, n_sources > 0 AND trim(coalesce(answer, '')) <> '' AND NOT regexp_matches(answer, '(?i)no (?:relevant )?(?:evidence|information) (?:was )?found') AS shown FROM ({ANSWERS})"


def answer_styles(spark, sf_dir):
    return questions.answer_style(question_table(spark, sf_dir)).groupBy("answer_style").agg(F.count("*").alias("n"))


STYLES = f"SELECT CASE WHEN regexp_matches(question, {q(P.DETAILED_WORDS)}) THEN 'detailed' WHEN regexp_matches(question, {q(P.CONCISE_WORDS)}) THEN 'concise' ELSE 'standard' END AS answer_style, count(*) AS n FROM ({QUESTIONS}) GROUP BY 1"


def last_run(spark, sf_dir):
    return health.last_run(versions(spark, sf_dir).select(F.col("created_at").alias("started_at"))).select(F.date_format("last_ingest_run", "yyyy-MM-dd").alias("last_ingest_run"))


def version_comparison(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return health.compare_versions(c, c.where("NOT retrieval_excluded"))


_SHARES = "round(count(*) FILTER (WHERE token_count < 50) / count(*), 4) AS {0}_under_50, round(count(*) FILTER (WHERE token_count < 20) / count(*), 4) AS {0}_under_20, round(avg(token_count), 2) AS {0}_mean"
COMPARED = f"""
SELECT *, after_under_50 < 0.15 AND after_under_20 < 0.02 AND after_mean > 150 AS accepted
FROM (SELECT {_SHARES.format('before')} FROM ({CHUNKS})), (SELECT {_SHARES.format('after')} FROM ({CHUNKS}) WHERE NOT retrieval_excluded)
"""


def small_by_type(spark, sf_dir):
    return health.small_by_type(chunks(spark, sf_dir))


def _cycles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(
        F.count("*").alias("documents"), F.count_if(F.col("l_returnflag") == "R").alias("material"), (-F.avg(F.col("l_discount").cast("double"))).alias("mean_delta"),
        F.avg((F.col("l_tax") > 0.06).cast("double")).alias("junk_share"), F.max("l_linenumber").alias("max_sources"), (F.sum("l_linenumber") % 2 == 0).alias("reconciles"),
    )


_CYCLES = "SELECT l_suppkey, count(*) AS documents, count(*) FILTER (WHERE l_returnflag = 'R') AS material, -avg(CAST(l_discount AS DOUBLE)) AS mean_delta, avg((l_tax > 0.06)::INT)::DOUBLE AS junk_share, max(l_linenumber) AS max_sources, sum(l_linenumber) % 2 = 0 AS reconciles FROM lineitem GROUP BY 1"


def cycle_rollup(spark, sf_dir):
    return residual.cycle_rollup(_cycles(spark, sf_dir))


ROLLUP = f"SELECT count(*) AS cycles, sum(documents)::BIGINT AS documents, sum(material)::BIGINT AS material, round(sum(mean_delta * documents) / sum(documents), 6) AS weighted_delta FROM ({_CYCLES})"


def source_hits(spark, sf_dir):
    """Hits cite customers' manuals by the start of their titles, and notes and procedures whole."""
    name = F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("Site manual "), "c_custkey")).when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("LOP-AB "), "c_custkey", F.lit(".PDF, p. 1"))).otherwise(F.concat(F.lit("notes: "), "c_custkey"))
    return residual.source_hits(table(spark, sf_dir, "customer").select(name.alias("doc_title")), versions(spark, sf_dir).select("id", "title"))


SOURCE_HITS = rf"""
WITH t AS (SELECT trim(regexp_replace(lower(CASE c_custkey % 4 WHEN 1 THEN 'Site manual ' || c_custkey WHEN 0 THEN 'LOP-AB ' || c_custkey || '.PDF, p. 1' ELSE 'notes: ' || c_custkey END), '[^a-z0-9]+', ' ', 'g')) AS h FROM customer),
d AS (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM ({VERSIONS})), u AS (SELECT DISTINCT t FROM d),
n AS (SELECT u.t, count(*) AS n FROM u JOIN t ON contains(u.t, h) OR contains(h, u.t) GROUP BY 1)
SELECT id, coalesce(n, 0) AS hits FROM d LEFT JOIN n USING (t)
"""


def text_quality_tiers(spark, sf_dir):
    made = text_quality.assess_text_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.round("text_quality_score", 6).alias("text_quality_score"), "text_quality_tier")


def _excluded_kinds(spark, sf_dir):
    kind = F.when(F.col("section_type") == "heading", "broken").when(F.col("token_count") < 10, "short_noise").otherwise("table")
    return chunks(spark, sf_dir).groupBy(F.col("document_id").alias("id"), residual.exclusion_category_from_tag(kind).alias("category")).agg(F.count("*").alias("n"))


def residual_drivers(spark, sf_dir):
    docs = health.quality_reasons(versions(spark, sf_dir)).withColumn("excluded_ratio", health.excluded_ratio())
    return residual.residual_drivers(docs, _excluded_kinds(spark, sf_dir)).select("id", F.array_join("residual_drivers", "|").alias("drivers"))


DRIVERS = f"""
WITH c AS (SELECT document_id AS id, count(*) FILTER (WHERE section_type = 'heading') AS broken, count(*) FILTER (WHERE section_type <> 'heading' AND token_count < 10) AS short FROM ({CHUNKS}) GROUP BY 1),
v AS (SELECT id, CASE WHEN chunk_count > 0 THEN excluded_chunk_count / chunk_count ELSE 0 END AS x, coalesce(broken, 0) AS b, coalesce(short, 0) AS s FROM ({VERSIONS}) LEFT JOIN c USING (id)),
d AS (SELECT id, x, concat_ws('|', CASE WHEN x >= 0.25 THEN 'High excluded chunk ratio' END, CASE WHEN b > 2 THEN 'broken_structure' END, CASE WHEN s > 3 THEN 'short_fragment_noise' END) AS named FROM v)
SELECT id, CASE WHEN named <> '' THEN named WHEN x > 0.25 THEN 'elevated_exclusion' ELSE '' END AS drivers FROM d
"""


def residual_detail(spark, sf_dir):
    """First and latest version of every path."""
    failure = F.when(F.col("heading_chunk_count") == 0, "missing_headings").otherwise("contamination")
    view = lambda order: lifecycle.distinct_on(versions(spark, sf_dir), ["source_path"], [order]).select("title", health.excluded_ratio().alias("excluded_ratio"), failure.alias("dominant_failure"), "ocr_used")
    return residual.residual_detail(view(F.asc("id")), view(F.desc("id"))).select("title", "improved", "likely_fixable", "likely_stable", "risk_notes")


DETAIL = f"""
WITH v AS (SELECT *, CASE WHEN chunk_count > 0 THEN excluded_chunk_count / chunk_count ELSE 0 END AS x, heading_chunk_count > 0 AS mixed FROM ({VERSIONS})),
b AS (SELECT DISTINCT ON (source_path) * FROM v ORDER BY source_path, id), a AS (SELECT DISTINCT ON (source_path) * FROM v ORDER BY source_path, id DESC)
SELECT a.title, a.x < b.x AS improved, a.mixed AND NOT a.ocr_used AS likely_fixable, a.x > 0.28 AND a.mixed AND a.ocr_used AS likely_stable,
  concat_ws('; ', CASE WHEN a.ocr_used AND a.mixed THEN 'OCR with mixed footers' END, CASE WHEN a.x > 0.29 THEN 'High excluded ratio' END, CASE WHEN NOT a.x < b.x THEN 'Did not improve' END,
    CASE WHEN a.mixed AND NOT a.ocr_used THEN 'Good candidate for footer cleanup' END) AS risk_notes FROM a JOIN b USING (title)
"""


HINTS = "setup interface import export"


def fallback_hits(spark, sf_dir):
    """Questions whose text hits show no mechanism are asked again with hints, and both lists merge."""
    c = chunks(spark, sf_dir)
    p = search.search_postings(c, {"citation_label": "A", "section_title": "A", "content": "C"})
    ask = lambda asked: search.fulltext_search(asked, p, 10, "any").select("query_id", "chunk_id", "score")
    asked = _short_questions(spark, sf_dir)
    found = ask(asked)
    mechanism = F.regexp_replace("content", r"[^\x00-\x7F]", "x").rlike(P.MECHANISM)
    seen = found.join(c.select("chunk_id", mechanism.alias("_m")), "chunk_id").groupBy("query_id").agg(F.bool_or("_m").alias("has_mechanism"))
    return search.with_fallback(asked, found, seen, ask, HINTS).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


FALLBACK = rf"""
WITH p AS ({POSTED}), s AS ({SHORT}), a AS (SELECT DISTINCT query_id, unnest({TERMS.format('question')}) AS term FROM s),
f AS (SELECT query_id, chunk_id, round(sum(weight * tf / (tf + 1.0))::DOUBLE, 9) AS score FROM p JOIN a USING (term) GROUP BY 1, 2),
h AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM f) WHERE r <= 10),
m AS (SELECT query_id FROM h JOIN ({CHUNKS}) c USING (chunk_id) GROUP BY 1 HAVING bool_or(regexp_matches(regexp_replace(content, '[^\x00-\x7F]', 'x', 'g'), {q(P.MECHANISM)}))),
b AS (SELECT DISTINCT query_id, unnest({TERMS.format(f"question || ' {HINTS}'")}) AS term FROM s WHERE query_id NOT IN (SELECT query_id FROM m)),
g AS (SELECT query_id, chunk_id, round(sum(weight * tf / (tf + 1.0))::DOUBLE, 9) AS score FROM p JOIN b USING (term) GROUP BY 1, 2),
k AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM g) WHERE r <= 10)
SELECT query_id, chunk_id, round(max(score), 6) AS score FROM (SELECT * FROM h UNION ALL SELECT * FROM k) GROUP BY 1, 2
"""


def answer_checks(spark, sf_dir):
    return evidence.answer_checks(_answers(spark, sf_dir)).select("query_id", "visible_tokens", F.array_join("failures", "|").alias("failures"))


CHECKED = rf"""
SELECT query_id, n AS visible_tokens, concat_ws('|', CASE WHEN trim(v) = '' THEN 'empty' END, CASE WHEN n > 0 AND n < 5 THEN 'too_short' END, CASE WHEN n_sources = 0 THEN 'no_sources' END,
  CASE WHEN NOT contains(answer, '[Source: ') THEN 'no_citations' END, CASE WHEN regexp_matches(v, '(?i)controlled copy|as an ai') THEN 'boilerplate' END) AS failures
FROM (SELECT *, len(regexp_extract_all(v, '\S+')) AS n FROM (SELECT *, regexp_replace(answer, '<!--.*?-->|\[Source: [^\]]*\]', '', 'g') AS v FROM ({ANSWERS})))
"""


def acceptance(spark, sf_dir):
    return evidence.acceptance(evidence.answer_checks(_answers(spark, sf_dir)))


ACCEPTED = f"SELECT bool_and(n_sources <= 24) AS within_source_cap, bool_and(visible_tokens > 0) AS all_non_empty, round(avg(CASE WHEN failures = '' THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS pass_rate FROM ({CHECKED}) JOIN ({ANSWERS}) USING (query_id)"


def uncovered_categories(spark, sf_dir):
    a = _answers(spark, sf_dir)
    needed = table(spark, sf_dir, "nation").select(F.concat(F.lit("category "), "n_nationkey").alias("category"))
    return evidence.uncovered(needed, a)


UNCOVERED = f"SELECT DISTINCT 'category ' || n_nationkey AS category FROM nation WHERE 'category ' || n_nationkey NOT IN (SELECT category FROM ({ANSWERS}))"


def golden_report(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.array(F.concat(F.lit("title "), F.col("o_orderkey") % 7)).alias("expected_docs"))
    return evidence.golden_report(asked, _joined(spark, sf_dir)).select("query_id", F.array_join("titles", "|").alias("titles"), "downranked", "expected_found")


GOLDEN = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM ({JOINED})),
g AS (SELECT query_id, string_agg(doc_title, '|' ORDER BY r) AS titles, count(*) FILTER (WHERE retrieval_downranked) AS downranked, bool_or(contains(lower(doc_title), 'title ' || (query_id % 7))) AS found FROM t WHERE r <= 3 GROUP BY 1)
SELECT o_orderkey AS query_id, titles, coalesce(downranked, 0) AS downranked, coalesce(found, false) AS expected_found FROM orders LEFT JOIN g ON g.query_id = o_orderkey
"""


def style_checks(spark, sf_dir):
    turns = conversations(spark, sf_dir).where("role = 'assistant' AND text IS NOT NULL")
    mode = lambda k, n: turns.select(F.col("conv_id").alias("case"), F.lit(k).alias("mode"), F.substring("text", 1, n).alias("answer"), F.lit(1).alias("n_sources"))
    runs = mode("concise", 40).unionByName(mode("standard", 80)).unionByName(mode("detailed", 100000))
    return evidence.style_checks(runs).select("case", "ordered", "standard_near_concise", "grounded")


QUERIES = {
    "touched_versions": (touched_versions, TOUCHED),
    "appended_versions": (appended_versions, APPENDED),
    "removed_versions": (removed_versions, REMOVED),
    "marked_missing": (marked_missing, MISSING),
    "routed_extractions": (routed_extractions, ROUTED),
    "extraction_methods": (extraction_methods, METHODS),
    "ocr_confidences": (ocr_confidences, CONFIDENCES),
    "searchable_chunks": (searchable_chunks, SEARCHABLE),
    "fulltext_all_terms": (fulltext_all_terms, ALL_TERMS),
    "trigram_fields": (trigram_fields, f"SELECT query_id, chunk_id, round(score, 6) AS score FROM ({FIELD_SCORES})"),
    "hybrid_text_only": (hybrid_text_only, HYBRID),
    "hybrid_vectors": (hybrid_vectors, None),
    "boost_factors": (boost_factors, BOOSTS),
    "preserved_authority": (preserved_authority, PRESERVED),
    "evidence_misses": (evidence_misses, MISSES),
    "escalations": (escalations, ESCALATIONS),
    "structural_lookups": (structural_lookups, LOOKUPS),
    "entity_mentions": (entity_mentions, MENTIONS),
    "search_texts": (search_texts, None),
    "latest_contexts": (latest_contexts, CONTEXTS),
    "inherited_modes": (inherited_modes, INHERITED),
    "citations": (citations, f"SELECT query_id, count(*) AS n, min(citation_label) AS first_label, round(max(score), 2) AS best FROM ({JOINED}) GROUP BY 1"),
    "image_previews": (image_previews, f"SELECT document_id, count(DISTINCT query_id) AS questions FROM ({JOINED}) WHERE source_type = 'xlsx' GROUP BY 1"),
    "shown_sources": (shown_sources, SHOWN),
    "answer_styles": (answer_styles, STYLES),
    "last_run": (last_run, f"SELECT strftime(max(created_at), '%Y-%m-%d') AS last_ingest_run FROM ({VERSIONS})"),
    "version_comparison": (version_comparison, COMPARED),
    "small_by_type": (small_by_type, f"SELECT section_type, count(*) AS n FROM ({CHUNKS}) WHERE token_count < 50 GROUP BY 1"),
    "cycle_rollup": (cycle_rollup, ROLLUP),
    "source_hits": (source_hits, SOURCE_HITS),
    "text_quality_tiers": (text_quality_tiers, None),
    "residual_drivers": (residual_drivers, DRIVERS),
    "residual_detail": (residual_detail, DETAIL),
    "fallback_hits": (fallback_hits, FALLBACK),
    "answer_checks": (answer_checks, CHECKED),
    "acceptance": (acceptance, ACCEPTED),
    "uncovered_categories": (uncovered_categories, UNCOVERED),
    "golden_report": (golden_report, GOLDEN),
    "style_checks": (style_checks, None),
}
