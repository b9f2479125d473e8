"""The completeness audit on hand-made documents."""

import pytest

from lodestar.operators import completeness

DOC = "id long, title string, source_path string, text_quality_tier string, needs_review boolean, quarantined boolean, chunk_count long"
CHUNK = "document_id long, page_number long, section_title string, content string"


def audit(spark, chunks, tier="good", review=False, quarantined=False, count=12):
    docs = spark.createDataFrame([(1, "t", "p", tier, review, quarantined, count)], DOC)
    return completeness.audit(docs, spark.createDataFrame([(1, page, title, content) for page, title, content in chunks], CHUNK)).first()


CITE = "Numbers are listed in Appendix 13.2.1 with all codes."


@pytest.mark.parametrize(
    ("chunks", "missing"),
    [
        ([(1, "7.2 Release", CITE), (2, "7.2.1 More", "x")], ["13.2.1"]),  # cited once, nothing else
        ([(1, "7.2 Release", CITE), (2, "13.2.1 Codes", "x")], []),  # own heading
        ([(1, "7.2 Release", CITE), (2, " 13.2.1 ", "x")], []),
        ([(1, "7.2 Release", CITE), (2, "13.2.1\tCodes", None)], []),
        ([(1, None, CITE), (2, "13.2.1.4 Deep", "x")], []),  # child
        ([(1, None, CITE), (2, "13.9 Other", "x")], []),  # cited once, family is there
        ([(1, None, CITE), (2, "13. Other", "x")], []),
        ([(1, None, CITE), (2, "13 Other", "x")], ["13.2.1"]),
        ([(1, None, CITE), (2, "13.2.1) Codes", "see Appendix  13.2.1")], ["13.2.1"]),  # two citations, one with two blanks; no heading by the rule
        ([(1, None, CITE), (2, None, "as in APPENDIX 13.2.1, too")], []),  # said twice
        ([(1, None, CITE), (2, None, "appendix 13.2.15")], ["13.2.15"]),  # the marker of 13.2.1 stands in 13.2.15 too
        ([(1, "Table of contents", CITE), (2, None, "Appendix 4.1 Foo ..... 9")], []),  # contents don't cite
        ([(1, None, "Appendix B2.10, appendix b2.9 and Appendix 2.1"), (2, "b2.10.1", "")], ["2.1"]),  # the family of b2.9 is there
    ],
)
def test_missing_appendices(spark, chunks, missing):
    assert audit(spark, chunks).missing_referenced_appendices == missing


def test_numbers_are_in_numeric_order_and_bounded(spark):
    row = audit(spark, [(1, "10.2 x", "see 9.10 and 9.9, 2 of 12 in v1.2345 or 1a; 01 and 100"), (1, "10.2 x", "9.9"), (None, None, None)])
    assert row.numbered_headings_found == ["01", "1", "2", "9.9", "9.10", "10.2", "12"] or row.numbered_headings_found == ["01", "2", "9.9", "9.10", "10.2", "12"]
    assert (row.pages_seen, row.heading_count) == (1, 1)
    many = audit(spark, [(k, None, f"{k}.{j}") for k in range(20) for j in range(20)])
    assert len(many.numbered_headings_found) == 120 and many.numbered_headings_found[-1] == "5.19"


def test_risk_adds_up(spark):
    long = "word " * 100
    assert audit(spark, [(1, None, long)] * 12).risk_score == 0
    row = audit(spark, [(1, None, CITE)], tier="poor", review=True, quarantined=True, count=3)
    assert row.risk_score == 8 + 2 + 4 + 2 + 1 + 4 and row.risk == "high" and len(row.reasons) == 6
    assert row.reasons[-1] == "Missing appendix content for refs: 13.2.1"
    row = audit(spark, [(1, None, long)] * 30, tier="partial", count=41)
    assert (row.risk_score, row.risk, row.reasons) == (2, "low", ["Text quality tier is partial", "Low numbered-section detection compared to chunk volume"])
    row = audit(spark, [], tier=None, count=0)
    assert (row.risk_score, row.extracted_char_count, row.avg_chars_per_chunk, row.appendix_references) == (3, 0, 0, [])


def test_status_clears_reviews_of_complete_documents_only(spark):
    docs = spark.createDataFrame([(k, "t", "p", tier, True, False, 12) for k, tier in enumerate(("good", "poor", None, "good"))], DOC)
    audited = spark.createDataFrame([(0, "low", 1, [], []), (1, "low", 1, [], []), (2, "medium", 4, ["r"], ["1.1"])], "document_id long, risk string, risk_score int, reasons array<string>, missing_referenced_appendices array<string>")
    rows = {r.id: r for r in completeness.audit_status(docs, audited).collect()}
    assert [rows[k].needs_review for k in range(4)] == [False, True, True, True]
    assert [rows[k].extraction_completeness_status for k in range(4)] == ["complete", "complete", "partial", None]
