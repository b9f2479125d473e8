"""The structural report on hand-made documents."""

from pyspark.sql import functions as F

from lodestar.operators import structural

DOC = (
    "id long, title string, source_path string, source_type string, is_active boolean, text_quality_tier string, text_quality_score double, extraction_method string, ocr_used boolean, quality_reasons array<string>,"
    " chunk_count long, excluded_chunk_count long, heading_chunk_count long, table_chunk_count long, list_chunk_count long"
)
CHUNK = "document_id long, section_type string, section_title string, content string, token_count long, retrieval_excluded boolean, exclusion_tag string"


def report(spark, docs, chunks, **options):
    return {r.id: r for r in structural.per_document(spark.createDataFrame(docs, DOC), spark.createDataFrame(chunks, CHUNK), **options).collect()}


def doc(i, title="LOP-RR 001", kind="pdf", tier="partial", score=0.5, method=None, ocr=False, reasons=(), n=10, x=5, active=True):
    return (i, title, f"p{i}", kind, active, tier, score, method, ocr, list(reasons), n, x, 1, 0, 0)


def test_scores_add_up_and_the_first_of_equals_wins(spark):
    chunks = [(1, "paragraph", None, "1.2 Valve check", 4, True, "broken_structure"), (1, "paragraph", None, "Page 3 of 9 controlled copy", 4, True, "ocr_garbage"), (1, "table", "t", None, 4, False, "table_noise"), (1, "list", "t", "x", 5, False, None)]
    row = report(spark, [doc(1, method="ocr", reasons=["weak HEADINGS", "Table-heavy"], n=4, x=2)], chunks)[1]
    near = lambda got, want: abs(got - want) < 1e-9
    assert near(row.score_weak_heading_detection, 2.5 + 0.7 + 2) and near(row.score_broken_section_boundary, 0.6 + 0.5 * 2 + 0.5)
    assert near(row.score_ocr_body_contamination, 1.2 + 0.9 + 0.7) and near(row.score_table_schema_loss, 0.8 + 0.8 + 0.5) and near(row.score_sparse_extraction, 1.5)
    assert near(row.score_layout_order_error, 1 + 0.5 * 1.3 + 0.8) and near(row.score_footer_header_body_mix, 1.1)
    assert row.dominant_failure == "weak_heading_detection" and row.likely_messy and row.weak_heading_signal and row.avg_chunk_tokens == 4.25
    none = report(spark, [doc(2, kind="docx", n=20, x=0)], [(2, "heading", "t", "x", 1, False, None)] * 20)[2]
    assert none.score_weak_heading_detection == none.score_layout_order_error == 0 and none.dominant_failure == "weak_heading_detection"


def test_scores_equal_in_tenths_are_equal(spark):
    """2.5 + 4 * 0.7 and 1.2 + 3 * 0.9 + 2 * 0.7 are both 5.3, though not as sums of doubles."""
    rows = [("paragraph", "1.2 Valve check", None)] * 4 + [("table", "controlled copy", "ocr_garbage")] * 2 + [("table", "controlled copy", None)]
    chunks = [(1, kind, "t", content, 4, False, tag) for kind, content, tag in rows]
    row = report(spark, [doc(1, method="ocr", n=7, x=0)], chunks)[1]
    assert row.score_weak_heading_detection == row.score_ocr_body_contamination == 5.3 and row.dominant_failure == "weak_heading_detection"


def test_mean_tokens_round_as_their_sql(spark):
    """2639 / 40 = 65.975 is below its half as a double times 100."""
    chunks = [(1, "paragraph", "t", "x", 65 if k else 104, False, None) for k in range(40)]
    assert report(spark, [doc(1, n=40, x=0)], chunks)[1].avg_chunk_tokens == 65.97


def test_cohort_order_and_documents_without_chunks(spark):
    docs = [doc(1, x=5, score=0.9), doc(2, x=5, score=0.1), doc(3, x=9), doc(4, x=5, score=None), doc(5, tier="good", x=9), doc(6, active=False, x=9), doc(7, n=0, x=0)]
    assert set(report(spark, docs, [], cohort=3)) == {3, 2, 1}
    rows = report(spark, docs, [], cohort=None)
    assert set(rows) == {1, 2, 3, 4, 7} and rows[7].excluded_ratio == 0 and rows[1].heading_chunks == 1 and rows[1].untitled_ratio == 0
    assert set(report(spark, docs, [], cohort=None, paths=spark.createDataFrame([("p3",), ("p5",)], "source_path string"))) == {3}


def test_families(spark):
    titles = ["lop-rr 001 x", "LOP-RRX 1", "SOP-ab", "  Manual: one", "", "???"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k long, t string").select("k", structural.family(F.col("t")).alias("f"), structural.exclusion_family(F.col("t")).alias("e")).orderBy("k").collect()
    assert [r.f for r in got] == ["LOP-RR", "LOP-RRX", "SOP-AB", "Manual", "unknown", "unknown"]
    codes = spark.createDataFrame([("AB 123 x",), ("abc-  007",), ("LOP-RR 001",), ("Abcde",), ("x",)], "t string").select(structural.exclusion_family(F.col("t")).alias("e")).collect()
    assert [r.e for r in codes] == ["AB 123", "ABC- 007", "LOP", "OTHER", "OTHER"]


def test_levels_hold_every_pattern_and_mark_three(spark):
    rows = spark.createDataFrame([(1, "A", "sparse_extraction", 0.5, True), (2, "A", "layout_order_error", 0.25, False), (3, "B", "table_schema_loss", 0.0, False)], "id long, family string, dominant_failure string, excluded_ratio double, likely_messy boolean")
    got = {(r.level, r.name): r for r in structural.structural_levels(rows).collect()}
    assert sum(level == "pattern" for level, _ in got) == 10 and got["pattern", "weak_heading_detection"].documents == 0
    assert {name for (level, name), r in got.items() if r.fixable} == {"table_schema_loss", "weak_heading_detection", "broken_section_boundary"}
    assert got["cohort", "all"].avg_excluded_ratio == 0.25 and got["cohort", "all"].messy == 1 and got["family", "A"].documents == 2


def test_levels_count_equal_scores_under_the_first_pattern(spark):
    rows = [("paragraph", "1.2 Valve check", None)] * 4 + [("table", "controlled copy", "ocr_garbage")] * 2 + [("table", "controlled copy", None)]
    chunks = spark.createDataFrame([(1, kind, "t", content, 4, False, tag) for kind, content, tag in rows], CHUNK)
    found = structural.per_document(spark.createDataFrame([doc(1, method="ocr", n=7, x=0)], DOC), chunks, cohort=None)
    assert {r.name for r in structural.structural_levels(found).where("level = 'pattern' AND documents = 1").collect()} == {"weak_heading_detection"}
