"""Queries of pilots, waves and cycles: every path's first and latest version are its before and after, folders are the waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import health, lifecycle, residual, rollout
from lodestar.plans.health_queries import SCORED, _scored
from lodestar.plans.inputs import VERSIONS, table, versions

RATIO, RETRIEVAL, LOW = 0.02, 0.6, 0.5


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.reprocess_rank(_scored(spark, sf_dir)).where("is_active")


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where("quarantined").select("source_path")


def reprocess_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.select_pilot(_ranked(spark, sf_dir)).select("id", "reprocess_rank")


def reprocess_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.select_wave(_ranked(spark, sf_dir), _done(spark, sf_dir), n=20, offset=5).select("id", "reprocess_rank")


def reprocess_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.select_batch(_ranked(spark, sf_dir), _done(spark, sf_dir), n=50).select("id", "reprocess_rank")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a path with two versions or one; retrieval improved where the later id leaves a rest."""
    docs = _scored(spark, sf_dir).withColumn("excluded_ratio", health.excluded_ratio())
    side = lambda order, p: lifecycle.distinct_on(docs, ["source_path"], [order]).select("source_path", "folder", "id", F.col("excluded_ratio").alias(f"excluded_ratio_{p}"), F.col("ocr_quality_status").alias(f"status_{p}"), "document_priority")
    before, after = side(F.asc("id"), "before"), side(F.desc("id"), "after")
    made = before.drop("folder", "document_priority").withColumnRenamed("id", "first_id").join(after, "source_path")
    return made.withColumn("retrieval_improved", F.col("id") % 3 != 0)


def quality_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _scored(spark, sf_dir)
    first, last = (lifecycle.distinct_on(docs, ["source_path"], [order]) for order in (F.asc("id"), F.desc("id")))
    return residual.quality_deltas(first, last).select("source_path", "status_before", "status_after", "delta")


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.outcomes(deltas(spark, sf_dir))


def outcome_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollout.outcomes(deltas(spark, sf_dir), ("folder",), "changed")


def wave_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deltas(spark, sf_dir)
    return rollout.wave_summaries(rollout.outcomes(made, ("folder",)), rollout.outcomes(made.where("folder = 'folder0'")))


def stop_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = deltas(spark, sf_dir)
    counts = made.groupBy("folder").agg(
        F.count_if(F.col("status_before") == "ocr_unusable").alias("unusable_before"), F.count_if(F.col("status_after") == "ocr_unusable").alias("unusable_after"),
        F.max(F.col("id") % 26).alias("most_sources"), (F.sum("id") % 3 != 0).alias("reconciles"),
    )
    decided = rollout.stop_decision(rollout.cycle_metrics(made, ("folder",)).join(counts, "folder"), RATIO, RETRIEVAL, LOW)
    return decided.select("folder", "ratio_improvement", "retrieval_rate", "low_priority_share", "stop", F.array_join("stop_reasons", "|").alias("stop_reasons"))


def retrieval_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents, orders as questions; returned lines are missing before, accepted ones after."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("query_id"), "l_returnflag", "l_linenumber", "l_quantity")
    side = lambda gone, h, c: lines.where(F.col("l_returnflag") != gone).groupBy("document_id", "query_id").agg(F.max(h).cast("double").alias("hits"), F.max(c).cast("double").alias("answer_chars"))
    return rollout.retrieval_impact(side("R", "l_linenumber", "l_quantity"), side("A", "l_quantity", "l_linenumber"))


_RANKED = f"""
r AS (SELECT id, row_number() OVER (ORDER BY CASE document_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, round(-x, 9), id) AS k FROM ({SCORED}) WHERE reprocess_candidate),
d AS (SELECT s.*, k FROM ({SCORED}) s JOIN r USING (id) WHERE is_active AND ocr_quality_status IN ('ocr_mixed', 'ocr_noisy'))
"""
_REST = f"source_path NOT IN (SELECT source_path FROM ({VERSIONS}) WHERE quarantined)"
_SCORE = "CASE {0} WHEN 'native_clean' THEN 5 WHEN 'ocr_clean' THEN 4 WHEN 'ocr_mixed' THEN 3 WHEN 'ocr_noisy' THEN 2 WHEN 'ocr_unusable' THEN 1 ELSE 0 END"
_DELTAS = f"""
s AS ({SCORED}), f AS (SELECT DISTINCT ON (source_path) * FROM s ORDER BY source_path, id), l AS (SELECT DISTINCT ON (source_path) * FROM s ORDER BY source_path, id DESC),
e AS (SELECT l.id, source_path, l.folder, f.x AS b, l.x AS a, f.ocr_quality_status AS sb, l.ocr_quality_status AS sa, l.document_priority AS p, l.id % 3 <> 0 AS better FROM f JOIN l USING (source_path))
"""


def _outcomes(by: str, where: str = "true", improved: bool = True) -> str:
    status = f"{_SCORE.format('sa')} > {_SCORE.format('sb')}" if improved else "sa IS DISTINCT FROM sb"
    return f"""SELECT *, m >= greatest(2, ceil(documents * 0.3::DOUBLE)) AND r >= greatest(2, ceil(documents * 0.3::DOUBLE)) AS worthwhile FROM (SELECT {by} count(*) AS documents, count(*) FILTER (WHERE b - a >= 0.05 OR {status}) AS m, count(*) FILTER (WHERE better) AS r,
      avg(a - b) AS raw, round(avg({_SCORE.format('sa')} - {_SCORE.format('sb')}), 4) AS movement FROM e WHERE {where} {'GROUP BY ALL' if by else ''})"""


_SHOWN = "documents, m AS material_docs, r AS retrieval_docs, movement AS avg_status_movement, round(raw, 4) AS avg_ratio_delta, worthwhile"
_VERDICT = "CASE WHEN worthwhile THEN 'proceed_to_next_10_20_candidates' WHEN raw < -0.02 THEN 'refine_reocr_method_and_rerun_pilot' ELSE 'stop_broader_rollout_gains_too_small' END AS recommendation"

QUERIES = {
    "reprocess_pilot": (reprocess_pilot, f"WITH {_RANKED} SELECT id, k AS reprocess_rank FROM d WHERE document_priority = 'high' AND regexp_matches(concat_ws(' ', title, folder), '(?i)(lop|eop|manual|operation|sop)') ORDER BY k, id LIMIT 8"),
    "reprocess_wave": (reprocess_wave, f"WITH {_RANKED} SELECT id, k AS reprocess_rank FROM d WHERE document_priority IN ('high', 'medium') AND {_REST} ORDER BY k, id LIMIT 20 OFFSET 5"),
    "reprocess_batch": (reprocess_batch, f"WITH {_RANKED} SELECT id, k AS reprocess_rank FROM d WHERE {_REST} ORDER BY k, id LIMIT 20"),
    "quality_deltas": (quality_deltas, f"WITH {_DELTAS} SELECT source_path, sb AS status_before, sa AS status_after, round(a - b, 6) AS delta FROM e"),
    "outcome_summary": (outcome_summary, f"WITH {_DELTAS} SELECT {_SHOWN}, {_VERDICT} FROM ({_outcomes('')})"),
    "outcome_changes": (outcome_changes, f"WITH {_DELTAS} SELECT folder, {_SHOWN}, {_VERDICT} FROM ({_outcomes('folder,', improved=False)})"),
    "wave_summary": (wave_summary, f"""WITH {_DELTAS}, w AS ({_outcomes('folder,')}), p AS ({_outcomes('', "folder = 'folder0'")})
      SELECT w.folder, w.documents, w.m AS material_docs, w.r AS retrieval_docs, w.movement AS avg_status_movement, round(w.raw, 4) AS avg_ratio_delta, w.worthwhile,
        CASE WHEN w.worthwhile THEN 'continue_to_next_wave' WHEN round(w.raw, 4) < -0.02 THEN 'refine_and_retry' ELSE 'stop_rollout_gains_flattened' END AS recommendation,
        round(p.raw, 4) AS pilot_ratio_delta, round(p.m / p.documents, 3) AS pilot_improvement_rate, round(w.m / greatest(1, w.documents), 3) AS wave_improvement_rate, abs(round(w.raw, 4) - round(p.raw, 4)) < 0.1 AS results_consistent FROM w, p"""),
    "stop_decisions": (stop_decisions, f"""WITH {_DELTAS}, c AS (SELECT folder, greatest(0, -round(avg(a - b), 4)) AS i, round(count(*) FILTER (WHERE better) / count(*), 4) AS r, round(count(*) FILTER (WHERE coalesce(p, 'low') = 'low') / count(*), 4) AS w,
        count(*) FILTER (WHERE sb = 'ocr_unusable') AS ub, count(*) FILTER (WHERE sa = 'ocr_unusable') AS ua, max(id % 26) AS most, sum(id) % 3 <> 0 AS ok FROM e GROUP BY 1),
      t AS (SELECT *, concat_ws('|', CASE WHEN i < {RATIO} THEN printf('ratio improvement %.3f below threshold {RATIO:.3f}', round(i, 3)) END, CASE WHEN r < {RETRIEVAL} THEN printf('retrieval improvement %.3f below threshold {RETRIEVAL:.3f}', round(r, 3)) END,
        CASE WHEN w > {LOW} THEN printf('low priority share %.3f above threshold {LOW:.3f}', round(w, 3)) END, CASE WHEN ua > ub + 1 THEN 'junk chunk spike detected' END, CASE WHEN most > 24 THEN 'source spam risk detected' END, CASE WHEN NOT ok THEN 'ingest reconciliation failed' END) AS why FROM c)
      SELECT folder, i::DOUBLE AS ratio_improvement, r AS retrieval_rate, w AS low_priority_share, why <> '' AS stop, why AS stop_reasons FROM t"""),
    "retrieval_impacts": (retrieval_impacts, """WITH b AS (SELECT l_suppkey AS document_id, l_orderkey AS query_id, max(l_linenumber) AS h, max(l_quantity) AS c FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
      a AS (SELECT l_suppkey AS document_id, l_orderkey AS query_id, max(l_quantity) AS h, max(l_linenumber) AS c FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
      j AS (SELECT document_id, coalesce(a.h, 0) > coalesce(b.h, 0) OR coalesce(a.c, 0) > coalesce(b.c, 0) + 40 AS better FROM b FULL JOIN a USING (document_id, query_id))
      SELECT document_id, bool_or(better) AS improved, count(*) AS queries, count(*) FILTER (WHERE better) AS improved_queries FROM j GROUP BY 1"""),
}
