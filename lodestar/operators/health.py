"""Corpus health: signals, quality reasons, re-processing candidates, audits and size histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.shared import cut

SIGNALS = ("heading", "table", "appendix", "list")


def chunk_signals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(*[F.count_if(F.col("section_type") == s).alias(f"{s}_chunk_count") for s in SIGNALS])


def health_metrics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts over the versions, and how many active documents have an appendix chunk."""
    on = F.col("is_active")
    n = lambda cond: F.count_if(cond)
    status = lambda s: F.col("extraction_status") == s
    tier = lambda t: F.col("text_quality_tier") == t
    counts = docs.agg(
        n(on).alias("active_docs"), n(~on).alias("inactive_versions"),
        *[n(on & status(s)).alias(f"active_{s}") for s in ("completed", "pending", "failed")],
        n(~on & status("failed")).alias("historical_failed"),
        F.coalesce(F.sum(F.when(on, F.col("chunk_count"))), F.lit(0)).alias("active_chunks_total"),
        n(on & status("completed") & (F.col("chunk_count") == 0)).alias("active_zero_text_docs"),
        F.round(F.coalesce(F.avg(F.when(on & (F.col("chunk_count") > 0), F.col("chunk_count"))), F.lit(0.0)), 1).alias("active_avg_chunks_per_doc"),
        *[n(on & F.col(c)).alias(f"active_{c}") for c in ("source_missing", "ocr_used", "quarantined", "needs_review")],
        *[n(on & tier(t)).alias(f"active_{t}") for t in ("good", "partial", "poor")],
        n(on & F.col("text_quality_tier").isNull()).alias("active_unclassified"),
        n(on & F.col("extraction_method").isin("ocr", "native_pdfjs")).alias("active_fallback_extractions"),
        F.coalesce(F.sum(F.when(on, F.col("excluded_chunk_count"))), F.lit(0)).alias("active_excluded_chunks_total"),
    )
    active = docs.where(on).select(F.col("id").alias("document_id"))
    headed = chunks.where("section_type = 'appendix'").join(active, "document_id", "left_semi").agg(F.count_distinct("document_id").alias("active_docs_with_structural_headings"))
    return counts.crossJoin(headed)  # two single rows


def health_derived(health: DataFrame) -> DataFrame:
    percent = lambda a, b: F.round(T.ratio(F.col(a), F.col(b)) * 100, 1)
    tiers = F.col("active_good") + F.col("active_partial") + F.col("active_poor") + F.col("active_unclassified")
    return health.withColumns(
        {
            "fallback_percent": percent("active_fallback_extractions", "active_docs"),
            "excluded_percent": percent("active_excluded_chunks_total", "active_chunks_total"),
            "total_versions": F.col("active_docs") + F.col("inactive_versions"),
            "quality_total": tiers,
            "quality_reconciles": tiers == F.col("active_docs"),
        }
    )


def last_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("started_at").alias("last_ingest_run"))


def quality_reasons(docs: DataFrame) -> DataFrame:
    """quality_reasons: why a document has its tier, in a fixed order."""
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    n = count("chunk_count")
    some = n > 0
    share = lambda *cols: T.ratio(sum((count(c) for c in cols[1:]), count(cols[0])), n)
    kind, tier, score = F.col("source_type"), F.col("text_quality_tier"), F.col("text_quality_score")
    conditions = {
        "Weak headings": kind.isin("pdf", "docx", "txt") & some & (count("heading_chunk_count") == 0),
        "OCR used": F.col("ocr_used"),
        "High excluded chunk ratio": share("excluded_chunk_count") >= 0.25,
        "Fallback extraction": F.col("extraction_method").isin("ocr", "native_pdfjs"),
        "Sparse text": n.between(1, 3),
        "Low chunk density": (kind != "xlsx") & n.between(1, 8),
        "Table-heavy": (kind == "xlsx") | (some & (share("table_chunk_count") >= 0.5)),
        "Appendix-heavy / list-heavy": some & (share("appendix_chunk_count", "list_chunk_count") >= 0.45),
        "Needs review": F.col("needs_review"),
        "Unclassified inputs": tier.isNull(),
        "Quarantined": F.col("quarantined"),
        "Source missing": F.col("source_missing"),
    }
    held = {k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()}
    none_else = ~F.greatest(*held.values())
    weak = F.coalesce(score < 0.75, F.lit(False)) | (F.coalesce(tier == "partial", F.lit(False)) & none_else)
    order = list(held)
    order.insert(order.index("Appendix-heavy / list-heavy"), "Low structure confidence")
    held["Low structure confidence"] = weak
    return docs.withColumn("quality_reasons", T.reasons(*[(held[k], k) for k in order]))


def reason_summary(docs: DataFrame) -> DataFrame:
    """tier, reason, n over the active documents ("unclassified" for no tier)."""
    return (
        docs.where("is_active")
        .select(F.coalesce("text_quality_tier", F.lit("unclassified")).alias("tier"), F.explode("quality_reasons").alias("reason"))
        .groupBy("tier", "reason")
        .agg(F.count("*").alias("n"))
    )


def top_reasons(summary: DataFrame, n: int = 5, tier: str = "partial") -> DataFrame:
    return summary.where(F.col("tier") == tier).orderBy(F.desc("n"), "reason").limit(n)


def excluded_ratio() -> Column:
    return T.ratio(F.coalesce("excluded_chunk_count", F.lit(0)), F.coalesce("chunk_count", F.lit(0)))


def ocr_quality(docs: DataFrame, noisy: float = 0.50, mixed: float = 0.30, unusable: float = 0.50) -> DataFrame:
    """ocr_quality_status by extraction, excluded share and tier, and ocr_quality_reasons. Bounds are as the rules are coded, so `noisy` is only reached when it is lowered."""
    x = excluded_ratio()
    quarantined, ocr = F.coalesce("quarantined", F.lit(False)), F.coalesce("ocr_used", F.lit(False))
    native = ~ocr & F.coalesce(F.col("extraction_method").startswith("native_"), F.lit(False))
    by_share = lambda *bounds: [(x >= b, status, said) for b, status, said in bounds]
    shares = by_share((unusable, "ocr_unusable", "Very high exclusion"), (noisy, "ocr_noisy", "High contamination"), (mixed, "ocr_mixed", "Moderate contamination"), (0.0, "ocr_clean", "Low exclusion"))
    status = (
        F.when(quarantined, "ocr_unusable")
        .when(native, F.when(x < 0.1, "native_clean").otherwise("ocr_mixed"))
        .when(ocr, F.coalesce(*(F.when(cond, name) for cond, name, _ in shares)))
        .when(F.col("text_quality_tier") == "poor", "ocr_noisy")
        .when(F.col("text_quality_tier") == "partial", "ocr_mixed")
        .otherwise("ocr_clean")
    )
    percent = F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))
    share = lambda said: F.concat(F.lit(f"{said} ("), percent, F.lit(")"))
    flags = T.reasons((F.coalesce("heading_chunk_count", F.lit(0)) == 0, "No structural headings"), (F.coalesce("needs_review", F.lit(False)), "Flagged for review"))
    kind = F.concat(F.upper(F.regexp_replace(F.coalesce("extraction_method", F.lit("")), "^native_", "")), F.lit(" native"))
    reasons = (
        F.when(quarantined, F.array(F.lit("Document quarantined")))
        .when(native, F.array(kind, F.when(x < 0.1, share("Low exclusion")).otherwise(F.concat(F.lit("Some issues ("), percent, F.lit(" excluded)")))))
        .when(ocr, F.concat(F.array(F.lit("OCR extracted"), F.coalesce(*(F.when(cond, share(said)) for cond, _, said in shares))), flags))
        .when(F.col("text_quality_tier") == "poor", F.array(F.lit("Poor quality tier")))
        .when(F.col("text_quality_tier") == "partial", F.array(F.lit("Partial quality tier")))
        .otherwise(F.array(F.lit("Clean quality tier (default)")))
    )
    return docs.withColumns({"ocr_quality_status": status, "ocr_quality_reasons": reasons})


def top_candidates(docs: DataFrame, n: int = 5) -> DataFrame:
    """The first candidates by rank, ties by id."""
    return docs.where("reprocess_candidate").orderBy(F.asc_nulls_last("reprocess_rank"), "id").limit(n)


def ocr_distributions(docs: DataFrame) -> DataFrame:
    """level (status or priority), name, n: no status counts as unassigned, no priority isn't counted."""
    sets = docs.select(F.coalesce("ocr_quality_status", F.lit("unassigned")).alias("status"), F.col("document_priority").alias("priority")).groupingSets([["status"], ["priority"]], "status", "priority")
    counted = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("g") == 1, "status").otherwise("priority").alias("level"), F.coalesce("status", "priority").alias("name"), "n").where("name IS NOT NULL")


def ocr_checks(docs: DataFrame) -> DataFrame:
    """One row: what of scoring is missing, each as a check that holds."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    none = F.size(F.coalesce("ocr_quality_reasons", F.array().cast("array<string>"))) == 0
    candidate = F.coalesce("reprocess_candidate", F.lit(False))
    holds = lambda bad: F.count_if(bad) == 0
    return docs.agg(
        F.count("*").alias("total_documents"),
        holds(blank("ocr_quality_status")).alias("all_docs_have_status"),
        holds(F.col("ocr_quality_status").isin("ocr_mixed", "ocr_noisy", "ocr_unusable") & none).alias("all_quality_docs_have_reasons"),
        holds(candidate & blank("reprocess_reason")).alias("all_candidates_have_reasons"),
        holds(candidate & F.col("reprocess_rank").isNull()).alias("all_candidates_have_rank"),
    )


def document_priority(docs: DataFrame, high: str = r"MANUAL|GUIDELINES") -> DataFrame:
    named = F.upper(F.coalesce("title", F.lit(""))).rlike(high) | F.upper(F.coalesce("folder", F.lit(""))).rlike(high)
    medium = F.coalesce(F.col("text_quality_tier") == "partial", F.lit(False)) | (F.coalesce("heading_chunk_count", F.lit(0)) > 0)
    return docs.withColumn("document_priority", F.when(~F.col("is_active"), "low").when(named, "high").when(medium, "medium").otherwise("low"))


def reprocess_candidate(docs: DataFrame) -> DataFrame:
    """Adds reprocess_candidate and the reasons as text. Needs ocr_quality_status and document_priority."""
    x = excluded_ratio()
    status, priority = F.col("ocr_quality_status"), F.col("document_priority")
    candidate = status.isin("ocr_noisy", "ocr_mixed") & (x > 0.15) & ((priority == "high") | (status == "ocr_noisy"))
    why = T.reasons(
        (priority == "high", "High-value document"),
        (priority == "medium", "Core operational document"),
        (status == "ocr_noisy", "Significant OCR contamination"),
        (status == "ocr_mixed", "Moderate OCR contamination"),
        (x > 0.3, F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("% excluded chunks"))),
        (F.coalesce("heading_chunk_count", F.lit(0)) == 0, "Weak structure"),
    )
    return docs.withColumn("reprocess_candidate", candidate).withColumn("reprocess_reason", F.when(candidate, F.array_join(why, "; ")).otherwise(""))


def reprocess_rank(docs: DataFrame) -> DataFrame:
    """Ranks candidates over the whole corpus by priority, then excluded share, then id.

    One sort by ranges numbers the rows of each partition, and one count a partition, which goes
    to the driver and back, tells where each partition begins.
    """
    spark = docs.sparkSession
    order = F.when(F.col("document_priority") == "high", 0).when(F.col("document_priority") == "medium", 1).otherwise(2)
    keyed = cut(docs.where("reprocess_candidate").select("id", order.alias("_p"), F.round(-excluded_ratio(), 9).alias("_x")))  # read twice, for the ranges and for the sort
    keys = ["_p", "_x", "id"]
    placed = cut(keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).select("id", F.monotonically_increasing_id().alias("_place")))
    part = F.shiftrightunsigned("_place", 33)
    before, starts = 0, [(-1, 0)]
    for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((row.part, before))
        before += row.n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))
    ranks = placed.join(offsets, part == F.col("_part")).select("id", (F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).alias("reprocess_rank"))
    return docs.join(ranks, "id", "left")


def ocr_summary(docs: DataFrame) -> DataFrame:
    statuses = ("native_clean", "ocr_clean", "ocr_mixed", "ocr_noisy", "ocr_unusable")
    on = F.col("is_active")
    return docs.agg(*[F.count_if(on & (F.col("ocr_quality_status") == s)).alias(s) for s in statuses], F.count_if(on & F.col("reprocess_candidate")).alias("candidates"))


SIZE_BUCKETS = ((20, "<20"), (50, "20-49"), (100, "50-99"), (200, "100-199"), (500, "200-499"))


def size_bucket(tokens: Column) -> Column:
    out = F.when(tokens < SIZE_BUCKETS[0][0], SIZE_BUCKETS[0][1])
    for top, name in SIZE_BUCKETS[1:]:
        out = out.when(tokens < top, name)
    return out.otherwise(">=500")


def chunk_size_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(size_bucket(F.col("token_count")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("token_count"), 2).alias("mean_tokens"))


def compare_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Acceptance shares of two chunk tables: below 50 and 20 tokens, the mean, and whether the targets hold."""
    def one(df: DataFrame, name: str) -> DataFrame:
        t = F.col("token_count")
        share = lambda c: F.round(T.ratio(F.count_if(c), F.count("*")), 4)
        return df.agg(share(t < 50).alias(f"{name}_under_50"), share(t < 20).alias(f"{name}_under_20"), F.round(F.avg(t), 2).alias(f"{name}_mean"))

    both = one(before, "before").crossJoin(one(after, "after"))  # two single rows
    return both.withColumn("accepted", (F.col("after_under_50") < 0.15) & (F.col("after_under_20") < 0.02) & (F.col("after_mean") > 150))


def smallest_chunks(chunks: DataFrame, n: int = 20) -> DataFrame:
    return chunks.select("chunk_id", "section_type", "token_count").orderBy("token_count", "chunk_id").limit(n)


def small_by_type(chunks: DataFrame, below: int = 50) -> DataFrame:
    return chunks.where(F.col("token_count") < below).groupBy("section_type").agg(F.count("*").alias("n"))


def yield_report(chunks: DataFrame) -> DataFrame:
    """Chunks, short chunks and mean size by document, with a total row."""
    t = F.col("token_count")
    return chunks.rollup("document_id").agg(F.grouping("document_id").cast("int").alias("is_total"), F.count("*").alias("chunks"), F.count_if(t < 20).alias("under_20"), F.count_if(t < 50).alias("under_50"), F.round(F.avg(t), 2).alias("mean_tokens"))


def ocr_reconciliation(docs: DataFrame) -> DataFrame:
    """Per status: documents, missing fields, and the document with the least id."""
    return docs.groupBy("ocr_quality_status").agg(
        F.count("*").alias("n"), F.count_if(F.col("text_quality_tier").isNull()).alias("no_tier"), F.count_if(F.col("document_priority").isNull()).alias("no_priority"), F.min("id").alias("sample_id")
    )


def reporting_checks(docs: DataFrame, health: DataFrame) -> DataFrame:
    """One row of reconciliation checks between a health row and documents with reasons and the latest flag."""
    on = F.col("is_active")
    tier, some = F.col("text_quality_tier"), F.size("quality_reasons") > 0
    seen = docs.agg(
        F.count_if(on & (tier == "partial")).alias("_p"), F.count_if(on & (tier == "partial") & some).alias("_pr"), F.count_if(on & tier.isNull()).alias("_u"),
        F.count_if(on & tier.isNull() & some).alias("_ur"), F.coalesce(F.sum(F.when(on & (tier == "partial"), F.size("quality_reasons"))), F.lit(0)).alias("_n"),
    )
    h = {c: F.col(c) for c in health.columns}
    return health.crossJoin(seen).select(  # two single rows
        (h["active_docs"] + h["inactive_versions"] == h["total_versions"]).alias("versions_reconcile"),
        (h["quality_total"] == h["active_docs"]).alias("quality_reconciles"),
        h["active_failed"].isNotNull().alias("failed_split_present"),
        (F.when(h["active_docs"] > h["active_good"] + h["active_partial"] + h["active_poor"], h["active_unclassified"] > 0).otherwise(True)).alias("unclassified_present"),
        (F.col("_p") == F.col("_pr")).alias("partial_have_reasons"),
        (F.col("_u") == F.col("_ur")).alias("unclassified_have_reasons"),
        ((F.col("_n") > 0) | (F.col("_p") == 0)).alias("breakdown_present"),
        (F.col("_n") >= F.col("_p")).alias("reason_counts_reconcile"),
    )
