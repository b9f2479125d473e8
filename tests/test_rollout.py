"""Pilots, waves, cycles and the stop rule on hand-made rows."""

import pytest

from lodestar.operators import rollout

DOC = "id long, title string, folder string, source_path string, ocr_quality_status string, document_priority string, reprocess_candidate boolean, reprocess_reason string, reprocess_rank long, chunk_count long, excluded_chunk_count long"


def docs(spark):
    made = [
        (1, "LOP-A 1", None, "p1", "ocr_mixed", "high", True, None, 2, 10, 1), (2, "Notes", "Operations", "p2", "ocr_noisy", "high", True, None, 2, 10, 5), (3, "Notes", None, "p3", "ocr_mixed", "high", True, "core Manual", None, 10, 9),
        (4, "Notes", None, "p4", "ocr_mixed", "high", True, None, 1, 10, 9), (5, "SOP", None, "p5", "ocr_clean", "high", True, None, 1, 10, 9), (6, "SOP", None, "p6", "ocr_mixed", "medium", True, None, 1, 0, 9),
        (7, "SOP", None, "p7", "ocr_mixed", "high", None, None, 1, 10, 9), (8, "SOP", None, "p8", "ocr_mixed", "low", True, None, 0, 10, 9), (9, "SOP", None, "p9", "ocr_mixed", None, True, None, 3, 10, 9),
    ]
    return spark.createDataFrame(made, DOC)


def test_selections(spark):
    ids = lambda df: [r.id for r in df.collect()]
    done = spark.createDataFrame([("p4",), ("p4",), ("none",)], "source_path string")
    assert ids(rollout.select_pilot(docs(spark), 1)) == [2, 1, 3]
    assert ids(rollout.select_wave(docs(spark), done, 1)) == [6, 2, 1, 3]
    assert ids(rollout.select_wave(docs(spark), done, 99, offset=1)) == [2, 1, 3]
    assert ids(rollout.select_batch(docs(spark), done)) == [8, 6, 2, 1, 9, 3]


DELTA = "wave string, excluded_ratio_before double, excluded_ratio_after double, status_before string, status_after string, retrieval_improved boolean, document_priority string"


def test_outcomes_need_both_gains(spark):
    rows = [("a", 0.5, 0.4, "ocr_mixed", "ocr_mixed", True, "high"), ("a", 0.5, 0.49, "ocr_noisy", "ocr_mixed", True, None), ("a", 0.5, 0.5, "ocr_mixed", "ocr_noisy", False, "low"), ("b", 0.9, 0.5, "x", "ocr_clean", False, "high"), ("b", 0.9, 0.5, None, "native_clean", True, "high"), ("c", 0.5, 0.5, "ocr_mixed", "ocr_mixed", True, "high")]
    deltas = spark.createDataFrame(rows, DELTA)
    made = {r.wave: r for r in rollout.outcomes(deltas, ("wave",)).collect()}
    assert (made["a"].material_docs, made["a"].retrieval_docs, made["a"].worthwhile, made["a"].avg_ratio_delta) == (2, 2, True, -0.0367)
    assert made["a"].recommendation.startswith("proceed") and made["b"].recommendation.startswith("refine") and made["c"].recommendation.startswith("stop")
    assert made["b"].material_docs == 2 and not made["b"].worthwhile and made["b"].avg_status_movement == 4.5
    assert {r.wave: r.material_docs for r in rollout.outcomes(deltas, ("wave",), "changed").collect()} == {"a": 3, "b": 2, "c": 0}
    none = rollout.outcomes(deltas.limit(0)).first()
    assert (none.documents, none.avg_ratio_delta, none.worthwhile) == (0, 0.0, False)
    waves = {r.wave: r for r in rollout.wave_summaries(rollout.outcomes(deltas, ("wave",)), rollout.outcomes(deltas.where("wave = 'a'"))).collect()}
    assert (waves["b"].recommendation, waves["b"].results_consistent, waves["b"].wave_improvement_rate, waves["b"].pilot_improvement_rate) == ("refine_and_retry", False, 1.0, 0.667)
    assert waves["a"].results_consistent and waves["c"].recommendation == "stop_rollout_gains_flattened"
    cycle = {r.wave: r for r in rollout.cycle_metrics(deltas, ("wave",)).collect()}
    assert (cycle["a"].ratio_improvement, cycle["a"].retrieval_rate, cycle["a"].low_priority_share) == (0.0367, 0.6667, 0.6667)


@pytest.mark.parametrize(
    ("row", "reasons"),
    [
        ((0.05, 0.7, 0.2, 3, 4, 24, True), []),
        ((0.05, 0.7, 0.2, None, None, None, None), []),
        ((0.0104, 0.5, 0.61, 3, 5, 25, False), ["ratio improvement 0.010 below threshold 0.020", "retrieval improvement 0.500 below threshold 0.600", "low priority share 0.610 above threshold 0.500", "junk chunk spike detected", "source spam risk detected", "ingest reconciliation failed"]),
    ],
)
def test_stop_rule(spark, row, reasons):
    df = spark.createDataFrame([row], "ratio_improvement double, retrieval_rate double, low_priority_share double, unusable_before long, unusable_after long, most_sources long, reconciles boolean")
    got = rollout.stop_decision(df, 0.02, 0.6, 0.5).first()
    assert got.stop_reasons == reasons and got.stop == bool(reasons)


def test_retrieval_impact_keeps_questions_of_one_side(spark):
    kind = "document_id long, query_id long, hits long, answer_chars long"
    before = spark.createDataFrame([(1, 1, 2, 100), (1, 2, 2, 100), (2, 1, 0, 10), (3, 1, 5, 10)], kind)
    after = spark.createDataFrame([(1, 1, 2, 140), (1, 2, 2, 141), (2, 1, 0, 10), (4, 9, 1, 0)], kind)
    got = {r.document_id: (r.improved, r.queries, r.improved_queries) for r in rollout.retrieval_impact(before, after).collect()}
    assert got == {1: (True, 2, 1), 2: (False, 1, 0), 3: (False, 1, 0), 4: (True, 1, 1)}
