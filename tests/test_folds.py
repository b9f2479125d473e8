"""Folds over sorted rows of a key."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.functions import patterns as P
from lodestar.functions import text as T
from lodestar.operators import chunking, fusion
from lodestar.operators.shared import folded
from lodestar.plans import catalog


def test_keys_longer_than_a_batch_and_many_in_one(spark):
    rows = [(k, i, (k * 7 + i * 3) % 11) for k in range(40) for i in range(k % 9)] + [(None, i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, i long, x long")
    schema = StructType([StructField("k", LongType()), StructField("i", LongType()), StructField("total", LongType())])

    def fold(group):
        total, out = 0, []
        for k, i, x in group:
            total += x
            if i % 2 == 0:
                out.append((k, i, total))
        return out

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = folded(df, [F.desc("i")], fold, schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: (r[0] is not None, r)
    groups = {k: sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]) for k in {r[0] for r in rows}}
    assert sorted(map(tuple, got), key=key) == sorted((r for g in groups.values() for r in fold(g)), key=key)


def test_selection_takes_tiers_that_hits_have(spark):
    kind = "query_id long, chunk_id long, document_id long, score double, interaction_tier int, has_mechanism boolean, has_transfer boolean, has_setup boolean"
    rows = [(1, k, k, 1.0 - k / 100, 1 if k == 5 else 2 if k in (3, 4) else 3, k == 4, False, False) for k in range(8)]
    out = fusion.select_interaction(spark.createDataFrame(rows, kind), target=4).orderBy("position").collect()
    assert [(r.chunk_id, r.position) for r in out] == [(5, 1), (4, 2), (3, 3), (0, 4)]


def test_sections_are_made_once_for_their_chunks(spark):
    rows = [(d, i, f"words of line {i} in {d}", "heading" if i % 3 == 0 else "paragraph", "note" if i == 4 else None, i == 5, False, False) for d in range(3) for i in range(7)]
    secs = spark.createDataFrame(rows, "doc_id long, pos long, content string, type string, section_type string, retrieval_excluded boolean, retrieval_downranked boolean, is_boilerplate boolean")
    made = chunking.compose_prose(secs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Scan") == 1
    got = [(r.pos, r.part, r.section_types, r.retrieval_excluded) for r in made.where("doc_id = 1").orderBy("pos").collect()]
    assert got == [(0, 0, [None] * 4, False), (4, 0, ["note"], False), (5, 0, [None], True), (6, 0, [None], False)]


def test_characters_are_counted_by_code_points(spark):
    texts = ["", "  ", "plain words", "#" * 11 + "a" * 9, "#" * 12 + "a" * 9, "\U0001f600" * 5 + "abcd", "\U0001f600" * 4 + "abcd", "é\t ab é", "1 $", "$$ ß", None, "a????b", "0OIl0OIl"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    alnum, symbols = F.regexp_count(F.trim("t"), F.lit("[A-Za-z0-9]")), F.regexp_count(F.trim("t"), F.lit(r"[^\sA-Za-z0-9]"))
    plain = F.coalesce((F.trim("t") == "") | F.trim("t").rlike(P.OCR_GARBAGE) | (alnum == 0) | (symbols / (alnum + symbols) > 0.55), F.lit(True))
    assert [r.a for r in df.select(T.is_ocr_garbage(F.col("t")).alias("a")).collect()] == [r.b for r in df.select(plain.alias("b")).collect()]


@pytest.mark.parametrize("name", ["interaction_guards", "interaction_selection"])
def test_signals_are_found_below_the_join(spark, sf_dir, name):
    """No text of a chunk goes through the join of hits and chunks."""
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join Inner" in line]
    assert joins and not any("RLIKE" in line for line in plan[: joins[-1]])


def test_lists_are_found_below_the_join(spark, sf_dir):
    plan = catalog.queries()["synthesis_context"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join Inner" in line]
    assert any("regexp_replace" in line for line in plan[joins[-1] :]) and not any("regexp_replace" in line for line in plan[: joins[-1]])
