"""Re-processing in pilots, waves and continuous cycles: which documents, what came of it, and when to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.health import excluded_ratio

#: Statuses that are taken up, the words of core manuals, and the score of a status (others: 0). Fixed values.
OPEN_STATUSES = ("ocr_mixed", "ocr_noisy")
CORE_MANUAL = "(?i)(lop|eop|manual|operation|sop)"
STATUS_SCORE = {"native_clean": 5, "ocr_clean": 4, "ocr_mixed": 3, "ocr_noisy": 2, "ocr_unusable": 1}
MOST_SOURCES = 24


def _chosen(docs: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """By rank (none: last), then the greater excluded ratio, then id."""
    order = [F.asc_nulls_last("reprocess_rank"), F.desc("excluded_ratio"), F.asc("id")]
    return docs.withColumn("excluded_ratio", excluded_ratio()).orderBy(*order).offset(offset).limit(n)


def candidates(docs: DataFrame, priorities: tuple[str, ...] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Mixed and noisy candidates of the given priorities whose path isn't in `done`."""
    pool = docs.where(F.coalesce("reprocess_candidate", F.lit(False)) & F.col("ocr_quality_status").isin(*OPEN_STATUSES))
    if priorities:
        pool = pool.where(F.col("document_priority").isin(*priorities))
    return pool if done is None else pool.join(done.select("source_path").distinct(), "source_path", "left_anti")


def select_pilot(docs: DataFrame, n: int = 8) -> DataFrame:
    """High-priority core manuals (by title, folder or reason); n is held to 5..10."""
    said = F.concat_ws(" ", "title", F.coalesce("folder", F.lit("")), F.coalesce("reprocess_reason", F.lit("")))
    return _chosen(candidates(docs, ("high",)).where(said.rlike(CORE_MANUAL)), max(5, min(10, n)))


def select_wave(docs: DataFrame, done: DataFrame, n: int = 20, offset: int = 0) -> DataFrame:
    """High and medium priority, not yet processed; n is held to 5..20."""
    return _chosen(candidates(docs, ("high", "medium"), done), max(5, min(20, n)), offset)


def select_batch(docs: DataFrame, done: DataFrame, n: int = 20) -> DataFrame:
    """The next of any priority, not yet processed; n is held to 5..20."""
    return _chosen(candidates(docs, None, done), max(5, min(20, n)))


def status_score(status: Column) -> Column:
    return F.coalesce(*(F.when(status == s, k) for s, k in STATUS_SCORE.items()), F.lit(0))


def outcomes(deltas: DataFrame, by: tuple[str, ...] = (), material: str = "improved") -> DataFrame:
    """What came of each group `by` of deltas(excluded_ratio_before, excluded_ratio_after, status_before, status_after, retrieval_improved).

    Material is a ratio that fell by 0.05 or a better status ("improved") or any other one ("changed"). Worthwhile
    takes both material and retrieval gains, each in two documents and in 30 % at least.
    """
    drop = F.col("excluded_ratio_before") - F.col("excluded_ratio_after")
    moved = status_score(F.col("status_after")) - status_score(F.col("status_before"))
    status = moved > 0 if material == "improved" else ~F.col("status_before").eqNullSafe(F.col("status_after"))
    out = deltas.groupBy(*by).agg(
        F.count("*").alias("documents"),
        F.count_if(F.coalesce(drop >= 0.05, F.lit(False)) | status).alias("material_docs"),
        F.count_if("retrieval_improved").alias("retrieval_docs"),
        F.coalesce(F.avg(-drop), F.lit(0.0)).alias("_delta"),
        F.coalesce(F.round(F.avg(moved), 4), F.lit(0.0)).alias("avg_status_movement"),
    )
    enough = F.greatest(F.lit(2), F.ceil(F.col("documents") * F.lit(0.3)))
    worthwhile = (F.col("material_docs") >= enough) & (F.col("retrieval_docs") >= enough)
    verdict = F.when(worthwhile, "proceed_to_next_10_20_candidates").when(F.col("_delta") < -0.02, "refine_reocr_method_and_rerun_pilot").otherwise("stop_broader_rollout_gains_too_small")
    return out.withColumns({"avg_ratio_delta": F.round("_delta", 4), "worthwhile": worthwhile, "recommendation": verdict}).drop("_delta")


def wave_summaries(waves: DataFrame, pilot: DataFrame | None = None) -> DataFrame:
    """`outcomes` of waves with their own recommendation and, beside the one row of a pilot's, both rates and whether results agree."""
    delta = F.col("avg_ratio_delta")
    verdict = F.when(F.col("worthwhile"), "continue_to_next_wave").when(delta < -0.02, "refine_and_retry").otherwise("stop_rollout_gains_flattened")
    out = waves.withColumn("recommendation", verdict)
    if pilot is None:
        return out
    base = pilot.select(F.col("avg_ratio_delta").alias("pilot_ratio_delta"), F.round(T.ratio(F.col("material_docs"), F.col("documents")), 3).alias("pilot_improvement_rate"))
    rate = F.round(F.col("material_docs") / F.greatest(F.lit(1), F.col("documents")), 3)
    joined = out.crossJoin(F.broadcast(base.limit(1)))  # one row
    return joined.withColumns({"wave_improvement_rate": rate, "results_consistent": F.abs(delta - F.col("pilot_ratio_delta")) < 0.1})


def retrieval_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, query_id, hits, answer_chars) twice: improved if newly found, found more often, or answered more than 40 characters longer.

    A question that one side lacks has no hits and no answer there.
    """
    side = lambda df, p: df.select("document_id", "query_id", F.col("hits").alias(f"hits_{p}"), F.col("answer_chars").alias(f"chars_{p}"))
    both = side(before, "before").join(side(after, "after"), ["document_id", "query_id"], "full").na.fill(0, ["hits_before", "hits_after", "chars_before", "chars_after"])
    better = (F.col("hits_after") > F.col("hits_before")) | (F.col("chars_after") > F.col("chars_before") + 40)
    return both.groupBy("document_id").agg(F.bool_or(better).alias("improved"), F.count("*").alias("queries"), F.count_if(better).alias("improved_queries"))


def cycle_metrics(deltas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per cycle: ratio improvement, retrieval rate and share of low priority (none counts as low), from deltas with document_priority."""
    low = F.coalesce("document_priority", F.lit("low")) == "low"
    share = lambda n: F.round(T.ratio(n, F.count("*")), 4)
    delta = F.round(F.avg(F.col("excluded_ratio_after") - F.col("excluded_ratio_before")), 4)
    return deltas.groupBy(*by).agg(
        F.count("*").alias("documents"), F.greatest(F.lit(0.0), F.coalesce(-delta, F.lit(0.0))).alias("ratio_improvement"),
        share(F.count_if("retrieval_improved")).alias("retrieval_rate"), share(F.count_if(low)).alias("low_priority_share"),
    )


def stop_decision(metrics: DataFrame, min_ratio_improvement: float, min_retrieval_rate: float, max_low_share: float) -> DataFrame:
    """Adds stop_reasons and stop to `cycle_metrics` with unusable_before, unusable_after, most_sources and reconciles (null: passes)."""
    shown = lambda c: F.format_string("%.3f", F.round(c, 3))
    told = lambda what, c, side, bound: F.concat(F.lit(f"{what} "), shown(F.col(c)), F.lit(f" {side} threshold {bound:.3f}"))
    passes = lambda c: F.coalesce(c, F.lit(True))
    found = F.array_compact(
        F.array(
            F.when(F.col("ratio_improvement") < min_ratio_improvement, told("ratio improvement", "ratio_improvement", "below", min_ratio_improvement)),
            F.when(F.col("retrieval_rate") < min_retrieval_rate, told("retrieval improvement", "retrieval_rate", "below", min_retrieval_rate)),
            F.when(F.col("low_priority_share") > max_low_share, told("low priority share", "low_priority_share", "above", max_low_share)),
            F.when(~passes(F.coalesce("unusable_after", F.lit(0)) <= F.coalesce("unusable_before", F.lit(0)) + 1), "junk chunk spike detected"),
            F.when(~passes(F.col("most_sources") <= MOST_SOURCES), "source spam risk detected"),
            F.when(~passes(F.col("reconciles")), "ingest reconciliation failed"),
        )
    )
    return metrics.withColumn("stop_reasons", found).withColumn("stop", F.size("stop_reasons") > 0)
