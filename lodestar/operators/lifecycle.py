"""Document versions: change detection, supersession, audits and selections.

A `documents` table holds one row a version; at most one row of a source path is
active. All operators are joins and aggregates keyed by path or id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import reasons


def with_version_hash(df: DataFrame, col: str, out: str = "version_hash") -> DataFrame:
    return df.withColumn(out, F.sha2(F.col(col).cast("binary"), 256))


def with_doc_identity(df: DataFrame, filename: str = "filename") -> DataFrame:
    """title (no extension), source_type (lower-case extension), normalised_title."""
    title = F.regexp_replace(F.col(filename), r"\.[^.]+$", "")
    return df.withColumns(
        {
            "title": title,
            "source_type": F.lower(F.regexp_extract(F.col(filename), r"\.([^.]+)$", 1)),
            "normalised_title": F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " ")),
        }
    )


def detect_changes(scan: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """scan(source_path, version_hash) + `change`: new, changed or unchanged against the active versions."""
    active = documents.where("is_active").select("source_path", F.col("version_hash").alias("_active_hash")).distinct()
    change = (
        F.when(F.col("_active_hash").isNull(), "new")
        .when(F.lit(force) | (F.col("_active_hash") != F.col("version_hash")), "changed")
        .otherwise("unchanged")
    )
    return scan.join(active, "source_path", "left").withColumn("change", change).drop("_active_hash")


def touch_seen(documents: DataFrame, unchanged: DataFrame, ts: Column) -> DataFrame:
    seen = unchanged.select("source_path").distinct().withColumn("_seen", F.lit(True))
    now = F.when(F.col("is_active") & F.col("_seen"), ts).otherwise(F.col("last_seen_at"))
    return documents.join(seen, "source_path", "left").withColumn("last_seen_at", now).drop("_seen")


def supersede(documents: DataFrame, changed: DataFrame, ts: Column) -> DataFrame:
    """Close the active versions of changed paths."""
    paths = changed.select("source_path").distinct().withColumn("_changed", F.lit(True))
    closed = F.col("is_active") & F.coalesce("_changed", F.lit(False))
    return (
        documents.join(paths, "source_path", "left")
        .withColumn("_closed", closed)
        .withColumn("superseded_at", F.when(F.col("_closed"), ts).otherwise(F.col("superseded_at")))
        .withColumn("is_active", F.col("is_active") & ~F.col("_closed"))
        .drop("_changed", "_closed")
    )


def append_versions(documents: DataFrame, new: DataFrame, ts: Column) -> DataFrame:
    """Append one active row a new or changed path; columns the scan doesn't know are null."""
    rows = new.withColumns({"is_active": F.lit(True), "created_at": ts, "updated_at": ts, "last_seen_at": ts})
    return documents.unionByName(rows.select([c for c in rows.columns if c in documents.columns]), allowMissingColumns=True)


def missing_sources(documents: DataFrame, scan: DataFrame) -> DataFrame:
    """Active versions whose path the scan did not see."""
    return documents.where("is_active").join(scan.select("source_path").distinct(), "source_path", "left_anti")


def mark_missing(documents: DataFrame, scan: DataFrame) -> DataFrame:
    seen = scan.select("source_path").distinct().withColumn("_seen", F.lit(True))
    missing = F.col("is_active") & F.col("_seen").isNull()
    return documents.join(seen, "source_path", "left").withColumn("source_missing", missing).drop("_seen")


def with_latest_flag(documents: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_path").orderBy(F.desc("created_at"), F.desc("updated_at"), F.desc("id"))
    return documents.withColumn("is_latest", F.row_number().over(w) == 1)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def uniqueness_violations(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def domain_violations(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """column, value, n_rows: values outside their permitted set; nulls pass."""
    bad = [F.when(~F.col(c).isin(allowed), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, allowed in rules.items()]
    return df.select(F.explode(F.array_compact(F.array(*bad))).alias("_bad")).groupBy("_bad.column", "_bad.value").agg(F.count("*").alias("n_rows"))


def invariant_violations(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunk_id, violation: excluded chunks that were embedded, and chunks of unknown documents."""
    embedded = chunks.where("retrieval_excluded AND embedding_status = 'embedded'").select("chunk_id", F.lit("excluded_embedded").alias("violation"))
    orphan = chunks.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")
    return embedded.unionByName(orphan.select("chunk_id", F.lit("orphan").alias("violation")))


def extraction_status(docs: DataFrame, secs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, status, error from what each document yielded."""
    n_secs = secs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_sections"))
    n_chunks = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    error = F.when(F.coalesce("n_sections", F.lit(0)) == 0, "No content extracted").when(F.coalesce("n_chunks", F.lit(0)) == 0, "Zero chunks produced")
    return (
        docs.select("id").join(n_secs, "id", "left").join(n_chunks, "id", "left")
        .select("id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"))
    )


def doc_chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"),
        F.count_if("retrieval_excluded").alias("excluded_chunk_count"),
        F.count_if("is_boilerplate").alias("boilerplate_chunk_count"),
        F.count_if("retrieval_downranked").alias("downranked_chunk_count"),
    )


def run_summary(changes: DataFrame, status: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: what a run scanned, processed, skipped and failed, and the totals of the active corpus."""
    run = changes.agg(F.count("*").alias("scanned"), F.count_if(F.col("change") != "unchanged").alias("processed"), F.count_if(F.col("change") == "unchanged").alias("skipped"))
    failed = status.agg(F.count_if(F.col("status") == "failed").alias("failed"))
    corpus = documents.where("is_active").agg(
        F.count_distinct("source_path").alias("active_documents"),
        F.sum("chunk_count").alias("total_chunks"),
        F.sum("excluded_chunk_count").alias("excluded_chunks"),
        F.count_if("needs_review").alias("needs_review"),
        F.count_if("quarantined").alias("quarantined"),
    )
    return run.crossJoin(failed).crossJoin(corpus)  # three single rows


def remove(documents: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return documents.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def select_for_reprocess(documents: DataFrame, source_type: str | None = None, contains: str | None = None, limit: int | None = None, doc_id: object = None, source_path: str | None = None) -> DataFrame:
    """Active versions by id, path, type and a part of title or path, in order of title, path and id; without any of them all."""
    out = documents.where("is_active")
    if source_type:
        out = out.where(F.lower("source_type") == source_type.lower())
    if doc_id is not None:
        out = out.where(F.col("id") == doc_id)
    if source_path:
        out = out.where(F.col("source_path") == source_path)
    if contains:
        needle = contains.lower()
        out = out.where(F.lower("title").contains(needle) | F.lower("source_path").contains(needle))
    out = out.orderBy("title", "source_path", "id")
    return out.limit(limit) if limit else out


def inventory(documents: DataFrame, signals: DataFrame, folder: str | None = None, source_type: str | None = None, status: str | None = None) -> DataFrame:
    """Latest flag and chunk signals (0 without chunks) beside each version, of a folder, type and extraction status where given; in `inventory_order`."""
    counts = [c for c in signals.columns if c != "document_id"]
    out = with_latest_flag(documents).drop(*counts).join(signals.withColumnRenamed("document_id", "id"), "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    for column, value in (("folder", folder), ("source_type", source_type), ("extraction_status", status)):
        if value:
            out = out.where(F.col(column) == value)
    return out.orderBy(*inventory_order())


def inventory_order() -> list[Column]:
    """Active and latest versions first, then folder, title and the newer; ties by id."""
    return [F.desc("is_active"), F.desc("is_latest"), F.asc("folder"), F.asc("title"), F.desc("created_at"), F.asc("id")]


def facet_filter(docs: DataFrame, **spec) -> DataFrame:
    """Facets: active, historical, latest_only, review, tier ("unclassified" for none), reason, ocr_status, candidate."""
    tests = {
        "active": lambda v: F.col("is_active") == v,
        "historical": lambda v: ~F.col("is_active") == v,
        "latest_only": lambda v: F.col("is_latest") == v,
        "review": lambda v: F.col("needs_review") == v,
        "tier": lambda v: F.col("text_quality_tier").isNull() if v == "unclassified" else F.col("text_quality_tier") == v,
        "reason": lambda v: F.array_contains("quality_reasons", v),
        "ocr_status": lambda v: F.col("ocr_quality_status") == v,
        "candidate": lambda v: F.col("reprocess_candidate") == v,
    }
    for name, value in spec.items():
        docs = docs.where(tests[name](value))
    return docs


def facet_values(docs: DataFrame, col: str) -> DataFrame:
    return docs.select(F.explode(col).alias("value")).distinct().orderBy("value")


def quarantine_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """All chunks of a quarantined document become excluded."""
    bad = docs.where("quarantined").select(F.col("id").alias("document_id")).distinct().withColumn("_bad", F.lit(True))
    return (
        chunks.join(bad, "document_id", "left")
        .withColumn("retrieval_excluded", F.col("retrieval_excluded") | F.coalesce("_bad", F.lit(False)))
        .drop("_bad")
    )


def review_flags(docs: DataFrame) -> DataFrame:
    return docs.withColumn("flags", reasons((F.col("needs_review"), "review"), (F.col("quarantined"), "quarantined"), (F.col("source_missing"), "missing")))
