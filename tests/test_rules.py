"""Rules on small hand-made rows."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import patterns as P
from lodestar.functions import text as T
from lodestar.operators import chunking, evidence, fusion, health, intents, lifecycle, normalise, questions, residual, search, structure, text_quality
from lodestar.sources import corpus

SECTION = "doc_id long, pos long, content string, type string, title string, level int"


def secs(spark, rows):
    return spark.createDataFrame([(1, k, c, t, None, lv) for k, (c, t, lv) in enumerate(rows)], SECTION)


def test_heading_stack_closes_same_and_deeper_levels(spark):
    rows = [("A", "heading", 1), ("B", "heading", 2), ("x", "paragraph", None), ("C", "heading", 2), ("D", "heading", 3), ("E", "heading", 1), ("y", "paragraph", None)]
    got = [r.heading_stack for r in normalise.with_heading_stack(secs(spark, rows)).orderBy("pos").collect()]
    assert got == [["A"], ["A", "B"], ["A", "B"], ["A", "C"], ["A", "C", "D"], ["E"], ["E"]]


def test_classification_order(spark):
    rows = [
        ("Page 3 of 9", "paragraph", None), ("????? ?????", "paragraph", None), ("WARNING hot surface", "paragraph", None), ("1. Open the valve and record it", "paragraph", None),
        ("code | limit\n1 | 2", "table", None), ("3 | 4\n5 | 6", "table", None), ("- result codes", "list", None), ("Check the seal then verify the label", "paragraph", None),
        ("Revision history", "heading", 1), ("Changed the wording in several places", "paragraph", None), ("Forms", "heading", 1), ("N/A", "paragraph", None), ("Overview", "heading", 1), ("Nothing special here today", "paragraph", None),
    ]
    got = [(r.section_type, r.retrieval_excluded) for r in normalise.classify_sections(secs(spark, rows)).orderBy("pos").collect()]
    assert got == [
        ("footer_header", True), ("metadata_only", True), ("warning", False), ("procedure_step", False), ("table", False), ("table", True), ("note", False), ("instruction_block", False),
        ("revision_history", False), ("revision_history", False), ("heading", False), ("form_stub", True), ("heading", False), ("paragraph", False),
    ]


def typed(spark, rows):
    return spark.createDataFrame([(1, k, c, t, None, 1, t, x, None) for k, (c, t, x) in enumerate(rows)], SECTION + ", section_type string, retrieval_excluded boolean, exclusion_tag string")


def test_tiny_sections_merge_until_full(spark):
    rows = [("a " * 20, "paragraph", False), ("b " * 20, "paragraph", False), ("c " * 20, "paragraph", False), ("d " * 20, "paragraph", False), ("w", "warning", False), ("e", "paragraph", False), ("f", "paragraph", True)]
    got = [(r.pos, r.n_merged) for r in normalise.merge_tiny(typed(spark, rows)).orderBy("pos").collect()]
    assert got == [(0, 3), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_duplicates_are_excluded_once_per_heading(spark):
    rows = [("H", "heading", False), ("same text", "paragraph", False), ("Same  text", "paragraph", False), ("K", "heading", False), ("same text", "paragraph", False)]
    got = [r.is_duplicate for r in normalise.dedupe_within_doc(typed(spark, rows)).orderBy("pos").collect()]
    assert got == [False, False, True, False, False]


def test_dedupe_is_idempotent(spark, sf_dir):
    from lodestar.plans.inputs import sections

    once = normalise.dedupe_within_doc(sections(spark, sf_dir).withColumns({"section_type": F.col("type"), "retrieval_excluded": F.lit(False), "exclusion_tag": F.lit(None).cast("string")}))
    kept = once.where("NOT is_duplicate").drop("is_duplicate")
    assert normalise.dedupe_within_doc(kept).where("is_duplicate").count() == 0


def test_isolated_short_content_goes_unless_it_is_worth_keeping(spark):
    rows = [("H", "heading", False), ("stray words", "paragraph", False), ("K", "heading", False), ("Maximum capacity number 5 model", "paragraph", False), ("L", "heading", False), ("x " * 30, "paragraph", False), ("tail bit", "paragraph", False)]
    out = normalise.short_content_policy(typed(spark, rows)).orderBy("pos").collect()
    assert [r.dropped_short for r in out] == [False, True, False, False, False, False, False]
    assert out[3].retained_short


def test_prose_composition(spark):
    flags = {"retrieval_downranked": F.lit(False), "is_boilerplate": F.lit(False)}
    rows = [("1 Setup", "heading", False), ("a " * 300, "paragraph", False), ("b " * 300, "paragraph", False), ("c " * 300, "paragraph", False), ("t | u", "table", False), ("x " * 10, "paragraph", True), ("y " * 10, "paragraph", False), (("Long sentence number one here. " * 300).strip(), "paragraph", False)]
    out = chunking.compose_prose(typed(spark, rows).withColumns(flags)).orderBy("pos", "part").collect()
    kinds = [(r.pos, r.part, len(r.content.split())) for r in out]
    assert [k[:2] for k in kinds[:5]] == [(0, 0), (3, 0), (4, 0), (5, 0), (6, 0)] and kinds[0][2] == 602
    long = [r for r in out if r.pos == 7]
    assert len(long) == 3 and all(len(r.content.split()) <= 800 for r in long)
    assert long[1].content.split()[:5] == long[0].content.split()[-120:-115]
    assert all(r.section_title == "1 Setup" for r in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(20, 60), st.integers(0, 19))
def test_split_pieces_stay_small_and_lose_nothing(sizes, most, overlap):
    text = " ".join("W" + "a " * (n - 1) + "end." for n in sizes)
    got = chunking.split_text(text, most, overlap)
    longest = max((len(s.split()) for s in text.split(". ")), default=0)
    assert all(len(p.split()) <= max(most, max(overlap, longest) + longest) for p in got)
    assert set(" ".join(got).split()) == set(text.split())


def test_guardrails_and_reindex(spark):
    rows = [(1, 0, 0, "tiny", "paragraph", False), (1, 1, 0, "tiny", "table", False), (1, 2, 0, "Big one goes on. " * 400, "paragraph", False), (1, 3, 0, "tiny", "paragraph", True)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, part int, content string, section_type string, retrieval_excluded boolean")
    out = chunking.guardrails(df).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in out] == list(range(len(out))) and out[0].section_type == "table" and out[-1].pos == 3 and len(out) == 4


PAGE = """13.2.1
MICROBIOLOGY TEST CODES
Some body text that runs
over two lines.

CONTROLLED COPY
Follow these steps:
- first item
- second item

name | code | limit
alpha | 1 | 2
beta | 3 | 4

TEMP
"""


def test_structure_of_a_page(spark):
    pages = spark.createDataFrame([(1, 1, PAGE)], "doc_id long, page int, text string")
    out = [(r.type, r.content, r.level) for r in structure.detect_sections(pages).orderBy("pos").collect()]
    assert out[0] == ("heading", "13.2.1 MICROBIOLOGY TEST CODES", 3)
    assert out[1][:2] == ("paragraph", "Some body text that runs\nover two lines.")
    assert out[2][0] == "list" and out[2][1].split("\n")[-1] == "- second item"
    assert out[3][0] == "table" and out[4] == ("paragraph", "TEMP", None)
    assert "table" not in {r.type for r in structure.detect_sections(pages, "ocr").collect()}


def test_extraction_routing(spark):
    df = spark.createDataFrame([(1, "good", 500, None), (2, "partial", 500, None), (3, "good", 50, None), (4, "poor", 500, "good"), (5, "poor", 500, "poor")], "id long, native_tier string, native_chars long, ocr_tier string")
    got = [(r.route, r.needs_review, r.quarantined) for r in text_quality.route_extraction(df).orderBy("id").collect()]
    assert got == [("native", False, False), ("native", True, False), ("ocr_queue", False, False), ("ocr", False, False), ("ocr", True, True)]


def test_intents(spark):
    asked = {
        "What is the boiling point?": "standard",
        "Show section 13.2.1": "structural",
        "List all test codes": "synthesis_list",
        "What are the validation rules for release?": "synthesis_rules",
        "How does the sorter integrate with the database?": "interaction_explanation",
        "Which tests are performed for which client": "canonical_lookup",
        "master register in section 4.1": "canonical_lookup",
    }
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    got = {r.question: r.intent for r in intents.classify(df).collect()}
    assert got == asked


def test_entities_come_in_order_and_hide_each_other(spark):
    registry = spark.createDataFrame([("Big Box", "big box", False), ("Box", "box", False), ("Lake", "lake", False), ("Reports", "report", True)], "canonical string, alias string, broad boolean")
    q = spark.createDataFrame([(1, "report from the lake to big box"), (2, "report only"), (3, "nothing")], "query_id long, question string")
    got = {r.query_id: r.mentions for r in questions.entity_mentions(q, registry, hides=(("Big Box", "Box"),)).collect()}
    assert got == {1: ["Lake", "Big Box"], 2: ["Reports"], 3: None}


def test_context_markers(spark):
    good = '<!--ctx:{"system_a": "A", "system_b": "B", "hint_terms": ["x"]}-->'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one " + good), (1, 2, "assistant", "two <!--ctx:{broken}-->"), (1, 3, "user", "tell me more")]
    out = questions.inherit_mode(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert out[3].context.system_a == "A" and out[3].context.document_ids == [] and out[1].context is None
    assert out[3].inherited_mode == "interaction" and out[0].inherited_mode is None


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, document_id long, score double, source_type string, doc_title string, section_title string, content string, content_preview string")


def test_greedy_interaction_selection(spark):
    both, one, none = "alpha sends to beta over the interface", "alpha interface import", "unrelated words"
    rows = [(1, k, k % 3, 1.0 - k / 100, "pdf", "t", None, both if k < 4 else one if k < 7 else none, "") for k in range(14)]
    h = hits(spark, rows).withColumns({"system_a": F.lit("alpha"), "system_b": F.lit("beta")})
    out = fusion.select_interaction(h, target=8, hard_cap=20, per_doc=3, low_signal=2)
    d = fusion.interaction_diagnostics(out).first()
    assert d.total_sources == 8 and d.tier1 == 4 and d.tier2 == 3 and d.tier3 == 1 and d.has_mechanism
    assert max(r["count"] for r in out.groupBy("document_id").count().collect()) <= 3


def test_authoritative_source_is_preserved(spark):
    rows = [(1, k, k, 1.0 - k / 100, "pdf", "t", None, "c", "") for k in range(6)] + [(1, 99, 99, 0.1, "xlsx", "t", None, "c", "")]
    h = hits(spark, rows)
    out = fusion.preserve_authoritative(fusion.select_capped(h, 4, 2), h, 4).orderBy("position").collect()
    assert [r.chunk_id for r in out] == [0, 1, 2, 99]


def test_capped_selection_backfills(spark):
    rows = [(1, k, 7 if k < 5 else k, 1.0 - k / 100, "pdf", "t", None, "c", "") for k in range(7)]
    assert [r.chunk_id for r in fusion.select_capped(hits(spark, rows), 5, 2).orderBy("position").collect()] == [0, 1, 5, 6, 2]


def test_section_anchors_scores(spark):
    c = spark.createDataFrame([(1, "13.2 Codes", "x", "y"), (2, "see 13.2", "x", "y"), (3, None, "doc 13.2", "y"), (4, None, "x", "in 13.2 it says"), (5, "13.22 No", "x", "y")], "chunk_id long, section_title string, citation_label string, content string")
    refs = spark.createDataFrame([(1, "13.2")], "query_id long, ref string")
    assert {r.chunk_id: r.score for r in search.section_anchors(refs, c, 9).collect()} == {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.8}


def test_citations(spark):
    a = spark.createDataFrame([(1, "It is so [Source: A, 1] . And [Source: B, 2].", ["x"])], "query_id long, answer string, z array<string>")
    h = spark.createDataFrame([(1, "A, 1")], "query_id long, citation_label string")
    r = evidence.validate_citations(a, h).first()
    assert r.valid == ["A, 1"] and r.unknown == ["B, 2"]
    assert evidence.normalise_answers(a).first().answer == "It is so. And.\n\nReferences:\n- [Source: A, 1]\n- [Source: B, 2]"


def test_previews_do_not_contain_each_other(spark):
    rows = [(1, k, 1, 1.0, "pdf", "t", None, c, "") for k, c in enumerate(["abcdef ghi", "abcdef", "other", "ghi", "more of it", "last"])]
    r = evidence.group_preview(hits(spark, rows).withColumn("folder", F.lit("f"))).first()
    assert r.preview == "abcdef ghi … more of it … other"


def test_previews_take_texts_that_are_given_beside_the_hits(spark):
    rows = [(q, k, 1, 1.0, "pdf", "t", None, "x" * n, "") for q in (1, 2, 3) for k, n in ((1, 5), (2, 9), (3, 7)) if (q, k) != (3, 2)]
    texts = spark.createDataFrame([(1, " one "), (2, "one two"), (3, "three")], "chunk_id long, content string")
    got = {r.query_id: r.preview for r in evidence.group_preview(hits(spark, rows).withColumn("folder", F.lit("f")), texts=texts).collect()}
    assert got == {1: "one two … three", 2: "one two … three", 3: "three … one"}


def test_titles_are_never_sent_to_every_task(spark):
    docs = spark.createDataFrame([(k, f"Site manual {k}") for k in range(30)], "id long, title string")
    plan = residual.source_hits(docs.select(F.col("title").alias("doc_title")), docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_lines_keep_the_digits_at_their_ends(spark):
    text = "\n".join(f"\t{i} step {i} " for i in range(12))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert df.select(T.trimmed_lines(F.col("text"))).first()[0] == [f"{i} step {i}" for i in range(12)]
    assert [r.text for r in corpus.split_pages(df, "\n").orderBy("page").collect()] == [f"{i} step {i}" for i in range(12)]
    answer = F.lit("a [Source: 0 alpha 0] b [Source: doc 1, part 1]")
    assert spark.range(1).select(evidence.cited_labels(answer)).first()[0] == ["0 alpha 0", "doc 1, part 1"]


def test_source_hits_count_equal_holding_and_held_titles(spark):
    docs = [(1, "Site Manual 12 v2.docx"), (2, "a"), (3, "--"), (4, "zz9"), (5, None), (6, "manual")]
    hits = ["site manual 12", "SITE manual 12 V2 docx (copy)", "Manual", "?!", "  ", "ab", "site manual 12", None]
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    want = {i: sum(norm(t) in norm(h) or norm(h) in norm(t) for h in hits if h and h.strip()) if t is not None else 0 for i, t in docs}
    out = residual.source_hits(spark.createDataFrame([(h,) for h in hits], "doc_title string"), spark.createDataFrame(docs, "id long, title string"))
    assert {r.id: r.hits for r in out.collect()} == want
    none = spark.createDataFrame([], "doc_title string")
    assert {r.hits for r in residual.source_hits(none, spark.createDataFrame(docs, "id long, title string")).collect()} == {0}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab c", max_size=7), min_size=1, max_size=12), st.lists(st.text("ab c", max_size=7), min_size=1, max_size=12))
def test_contained_equals_all_pairs(spark, needles, texts):
    out = residual.contained(spark.createDataFrame([(n,) for n in set(needles)], "needle string"), spark.createDataFrame([(t,) for t in set(texts)], "text string"))
    assert sorted(map(tuple, out.collect())) == sorted((n, t) for n in set(needles) for t in set(texts) if n and n in t)


HIT = "query_id long, document_id long, chunk_id long, score double, citation_label string, section_title string, content string"


def test_synthesis_context_takes_list_lines_in_order(spark):
    rows = [
        (1, 7, 1, 0.5, "late", "S", "- one\n2) two\nno list\nsample type X\n* four"), (1, 7, 2, 0.9, "early", "", "the 120 samples\n- one"),
        (1, 8, 3, 0.8, "x", None, None), (1, 9, 4, 0.95, "y", "T", "plain"),
    ]
    out = evidence.synthesis_context(spark.createDataFrame(rows, HIT)).orderBy("rank").collect()
    assert [(r.document_id, r.labels, r.sections, r.snippets) for r in out] == [
        (7, ["early", "late"], ["S"], ["the 120 samples", "- one", "2) two", "sample type X"]), (9, ["y"], ["T"], []), (8, ["x"], [], []),
    ]


def test_operating_frame_lists(spark):
    rows = [(1, 7, 1, 0.5, "a", "Reports", "When the sample is 10 ready, go. Manual entry is the fallback; on failure retry."), (1, 7, 2, 0.9, "b", None, "The LIMS is the source of truth. Rules engine determines status.")]
    out = evidence.operating_frame(spark.createDataFrame(rows, HIT), names={"source_of_truth": r"\bLIMS\b"}).first()
    assert out.source_of_truth == ["source of truth", "LIMS"] and out.decision_engine == ["Rules engine", "determines"]
    assert out.trigger_events == ["When the sample is 10 ready, go", "on failure retry"] and out.data_objects == ["status", "Reports"]
    assert out.failure_points == ["failure", "retry"] and out.fallback_paths == ["Manual entry", "fallback"]
    assert out.execution_layer == [] and out.integration_mechanism == []


def test_text_quality_equals_a_plain_count(spark, sf_dir):
    def plain(text):
        tokens = re.findall(r"\S+", text, re.A)
        printable = (len(text) - len(re.findall(r"[^A-Za-z0-9 \t\n\r.,:;'\"()/-]", text))) / len(text) if text else 0.0
        mean = sum(map(len, tokens)) / len(tokens) if tokens else 0.0
        by_length = 0.0 if not tokens else 1.0 if 3 <= mean <= 8 else mean / 3 if mean < 3 else max(0.0, 1 - (mean - 8) / 4)
        known = {re.sub("[^a-z]", "", t.lower()) for t in tokens} - {""}
        hit = len(known & set(P.COMMON_WORDS)) / len(known) if known else 0.0
        odd = run = 0
        for t in tokens:
            if any(re.search(p, t, re.A) for p in P.SUSPICIOUS) or re.fullmatch(r"(.)\1{2,}", t):
                odd, run = odd + 1, 0
            elif len(t) == 1:
                odd, run = odd + (run >= 2), run + 1
            else:
                run = 0
        score = 0.25 * printable + 0.2 * by_length + 0.25 * hit + 0.15 * (len(text) > 50) + 0.15 * (1 - (odd / len(tokens) if tokens else 0.0))
        return round(score, 6), "good" if score > 0.8 else "partial" if score >= 0.4 else "poor"

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b c d e !!! aaa x1y2 12345"), (-4, "w" * 70)], "doc_id long, text string")
    out = text_quality.assess_text_quality(docs.unionByName(extra)).select("text", "text_quality_score", "text_quality_tier").collect()
    for r in out:
        score, tier = plain(r.text or "")
        assert abs(r.text_quality_score - score) < 2e-6 and r.text_quality_tier == tier, r.text


def test_contained_meets_long_texts_by_wanted_runs_alone(spark):
    texts = ["a long line with valve check in it", "valve", "x" * 400 + "valve check", "nothing of it", "VALVE CHECK"]
    made = residual.contained(spark.createDataFrame([("valve check",), ("it",), ("lin",)], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(map(tuple, made.collect())) == sorted((n, t) for n in ("valve check", "it", "lin") for t in texts if n in t)
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()
