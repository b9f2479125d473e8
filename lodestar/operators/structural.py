"""Structural failure report: what is wrong with the layout of partial documents, by document, pattern and family.

Chunks are read once for all counts of a document. Reports come as rows of a level, from one
pass over grouping sets, so that a corpus of any size gives narrow rows to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.residual import exclusion_category

#: What counts as contamination and as a heading in a paragraph; fixed values.
CONTAMINATION = r"(?i)(CONTROLLED COPY|IF THIS LINE IS GREEN|THIS DOCUMENT IS UNCONTROLLED|Page\s+[0-9]+\s+of\s+[0-9]+)"
HEADING_LIKE = r"^\s*\d+(\.\d+)*\s+[A-Za-z]"
#: Tags of excluded chunks, and the count each gives; fixed values.
TAGS = ("broken_structure", "short_fragment_noise", "table_noise", "ocr_garbage", "metadata_block")
#: Patterns in order; the first of equal scores is the dominant one. Fixed values.
PATTERNS = (
    "weak_heading_detection",
    "broken_section_boundary",
    "multi_column_fragmentation",
    "ocr_body_contamination",
    "table_schema_loss",
    "split_procedure_fragment",
    "footer_header_body_mix",
    "diagram_caption_fragmentation",
    "sparse_extraction",
    "layout_order_error",
)
FIXABLE = ("weak_heading_detection", "broken_section_boundary", "split_procedure_fragment", "footer_header_body_mix", "table_schema_loss")


def family(title: Column) -> Column:
    """The upper-case code of two kinds of manuals, else the first word's letters, digits and hyphens."""
    code = F.upper(F.regexp_extract(title, r"(?i)^((?:LOP|SOP)-[A-Z]{2})(?![A-Za-z0-9_])", 1))
    first = F.regexp_replace(F.get(F.split(F.trim(title), r"\s+"), F.lit(0)), "[^A-Za-z0-9-]", "")
    return F.when(code != "", code).when(first != "", first).otherwise("unknown")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Fourteen counts a document; chunks(document_id, section_type, section_title, content, token_count, retrieval_excluded, exclusion_tag)."""
    kind, content = F.col("section_type"), F.coalesce("content", F.lit(""))
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("total_chunks"),
        F.count_if("retrieval_excluded").alias("excluded_chunks"),
        *(F.count_if(kind == k).alias(f"{k}_chunks") for k in ("heading", "table", "list")),
        F.count_if(F.col("section_title").isNull()).alias("untitled_chunks"),
        (F.round(F.avg("token_count") * 100) / 100).alias("avg_chunk_tokens"),  # halves are judged on the double, as the SQL does
        *(F.count_if(F.col("exclusion_tag") == t).alias(f"{t}_chunks") for t in TAGS),
        F.count_if(content.rlike(CONTAMINATION)).alias("contamination_chunks"),
        F.count_if((kind == "paragraph") & content.rlike(HEADING_LIKE)).alias("heading_like_paragraphs"),
    )


def failure_scores() -> dict[str, Column]:
    """The linear score of each pattern over `per_document`'s columns."""
    # Points are whole hundredths until a score is made: sums of tenths as doubles would tell equal scores apart.
    points = lambda *hundredths: sum(hundredths[1:], hundredths[0]) / 100.0
    n = lambda c, each: F.col(c) * F.lit(each)
    given = lambda cond, some: F.when(F.coalesce(cond, F.lit(False)), F.lit(some)).otherwise(0)
    reason = lambda name: F.exists("quality_reasons", lambda r: F.lower(r) == name.lower())
    pdf, chunks, headings = F.lower("source_type") == "pdf", F.col("chunk_count"), F.col("heading_chunks")
    ocr, fallback, untitled = F.col("ocr_used"), F.col("fallback_used"), F.col("untitled_ratio")
    broken, short, bare = "broken_structure_chunks", "short_fragment_noise_chunks", (chunks > 0) & (headings == 0)
    return {
        "weak_heading_detection": points(given(headings == 0, 250), n("heading_like_paragraphs", 70), given(reason("Weak headings"), 200)),
        "broken_section_boundary": points(n(broken, 60), n(short, 35)) + untitled * 2.0 + points(given(bare, 50)),
        "multi_column_fragmentation": points(given(pdf, 100)) + untitled * 1.8 + points(n(broken, 20)) + points(given(fallback, 50)),
        "ocr_body_contamination": points(given(ocr | fallback, 120), n("contamination_chunks", 90), n("ocr_garbage_chunks", 70)),
        "table_schema_loss": points(n("table_noise_chunks", 80), given((F.col("table_chunks") > 0) & (headings <= 1), 80), given(reason("Table-heavy"), 50)),
        "split_procedure_fragment": points(n(short, 75), n("list_chunks", 15), n(broken, 25)),
        "footer_header_body_mix": points(n("contamination_chunks", 110), n("metadata_block_chunks", 25)),
        "diagram_caption_fragmentation": points(given(pdf, 30), given(bare & (F.col("table_chunks") == 0), 40)),
        "sparse_extraction": points(F.when(chunks <= 3, 300).when(chunks <= 8, 150).otherwise(0), given(reason("Sparse text"), 100), given(reason("Low chunk density"), 100)),
        "layout_order_error": points(given(pdf, 100)) + untitled * 1.3 + points(given(fallback, 80)),
    }


def per_document(docs: DataFrame, chunks: DataFrame, cohort: int | None = 20, paths: DataFrame | None = None) -> DataFrame:
    """One row a document of the cohort: active partial documents of the greatest excluded ratio (ties: least quality, then id), or those of `paths`.

    `cohort` None takes them all. Documents without chunks in the table keep the counts they carry themselves.
    """
    pool = docs.where("coalesce(is_active, true) AND text_quality_tier = 'partial'")
    if paths is not None:
        pool = pool.join(paths.select("source_path").distinct(), "source_path", "left_semi")
    positive = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    pool = pool.withColumns({c: positive(c) for c in ("chunk_count", "excluded_chunk_count")})
    pool = pool.withColumn("excluded_ratio", F.round(T.ratio(F.col("excluded_chunk_count"), F.col("chunk_count")), 4))
    if cohort is not None:
        pool = pool.orderBy(F.desc("excluded_ratio"), F.coalesce("text_quality_score", F.lit(1.0)), "id").limit(cohort)
    own = {f"{k}_chunks": F.coalesce(f"{k}_chunks", F.coalesce(f"{k}_chunk_count", F.lit(0))) for k in ("heading", "table", "list")}
    zero = ("untitled_chunks", "avg_chunk_tokens", *(f"{t}_chunks" for t in TAGS), "contamination_chunks", "heading_like_paragraphs")
    found = pool.join(chunk_counts(chunks).withColumnRenamed("document_id", "id"), "id", "left")
    found = found.withColumns(own | {c: F.coalesce(c, F.lit(0)) for c in zero} | {"ocr_used": F.coalesce("ocr_used", F.lit(False)), "fallback_used": F.coalesce(F.col("extraction_method").isin("ocr", "native_pdfjs"), F.lit(False))})
    found = found.withColumn("untitled_ratio", T.ratio(F.col("untitled_chunks"), F.col("chunk_count")))
    found = found.withColumns({f"score_{k}": v for k, v in failure_scores().items()})
    first = F.array_max(F.array(*(F.struct(F.col(f"score_{p}").alias("score"), F.lit(-i).alias("before"), F.lit(p).alias("name")) for i, p in enumerate(PATTERNS))))
    few, poor = (F.col("chunk_count") <= 4) & (F.col("fallback_used") | F.col("ocr_used")), (F.col("ocr_garbage_chunks") >= 2) & F.coalesce(F.col("text_quality_score") < 0.55, F.lit(False))
    return found.withColumns(
        {
            "dominant_failure": first["name"],
            "family": family(F.coalesce("title", F.lit(""))),
            "included_chunk_count": F.col("chunk_count") - F.col("excluded_chunk_count"),
            "heading_ratio": F.round(F.col("heading_chunks") / F.greatest(F.col("chunk_count"), F.lit(1)), 4),
            "weak_heading_signal": (F.col("heading_chunks") == 0) | (F.col("heading_like_paragraphs") >= 2),
            "likely_messy": few | poor,
        }
    )


def structural_levels(report: DataFrame, fixable: int = 3) -> DataFrame:
    """level, name, documents, fixable: families, all ten patterns, and the cohort with its mean excluded ratio; the commonest fixable patterns are marked."""
    sets = report.groupingSets([["family"], ["dominant_failure"], []], "family", "dominant_failure")
    n, total = F.count("*"), F.sum(F.round(F.col("excluded_ratio") * 10_000).cast("long"))
    # halves go up exactly, in whole numbers: ratios have four places
    mean = F.floor((2 * total + n) / (2 * n)) / 10_000
    counted = sets.agg(F.grouping_id().alias("g"), n.alias("documents"), mean.alias("avg_excluded_ratio"), F.count_if("likely_messy").alias("messy"))
    level = F.when(F.col("g") == 1, "family").when(F.col("g") == 2, "pattern").otherwise("cohort")
    rows = counted.select(level.alias("level"), F.coalesce("family", "dominant_failure", F.lit("all")).alias("name"), "documents", "avg_excluded_ratio", "messy")
    every = report.sparkSession.createDataFrame([("pattern", p, i) for i, p in enumerate(PATTERNS)], "level string, name string, place int")
    rows = rows.join(F.broadcast(every), ["level", "name"], "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "messy")})
    best = rows.where(F.col("name").isin(*FIXABLE) & F.col("place").isNotNull()).orderBy(F.desc("documents"), "place").limit(fixable).select("level", "name", F.lit(True).alias("fixable"))
    return rows.join(F.broadcast(best), ["level", "name"], "left").select("level", "name", "documents", "avg_excluded_ratio", "messy", F.coalesce("fixable", F.lit(False)).alias("fixable"))


def exclusion_levels(chunks: DataFrame, docs: DataFrame, families: int = 10) -> DataFrame:
    """level, document_id, name, n of excluded chunks from one pass of grouping sets.

    Levels: document_category, document_type, category, family (the `families` commonest).
    docs(id, title) is the cohort.
    """
    titled = docs.select(F.col("id").alias("document_id"), exclusion_family(F.coalesce("title", F.lit(""))).alias("family"))
    kind = exclusion_category(F.col("content"), F.col("section_type"), F.col("is_boilerplate"))
    rows = chunks.where("retrieval_excluded").join(titled, "document_id").select("document_id", kind.alias("category"), F.coalesce("section_type", F.lit("unknown")).alias("section_type"), "family")
    sets = [["document_id", "category"], ["document_id", "section_type"], ["category"], ["family"]]
    counted = rows.groupingSets(sets, "document_id", "category", "section_type", "family").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    # a bit of the id is set where its column is folded: document_id, category, section_type, family
    level = F.when(F.col("g") == 0b0011, "document_category").when(F.col("g") == 0b0101, "document_type").when(F.col("g") == 0b1011, "category").otherwise("family")
    named = counted.select(level.alias("level"), "document_id", F.coalesce("category", "section_type", "family").alias("name"), "n")
    top = named.where("level = 'family'").orderBy(F.desc("n"), "name").limit(families)
    return named.where("level <> 'family'").unionByName(top)


def exclusion_family(title: Column) -> Column:
    """A code and its number, else the code, else OTHER."""
    numbered = F.regexp_extract(title, r"(?i)^([A-Z]{2,4}[\s-]*\d{3})", 1)
    code = F.regexp_extract(title, r"(?i)^([A-Z]{2,4})(?![A-Za-z0-9_])", 1)
    return F.when(numbered != "", F.upper(F.regexp_replace(numbered, r"\s+", " "))).when(code != "", F.upper(code)).otherwise("OTHER")


def exclusion_documents(levels: DataFrame, docs: DataFrame, top: int = 4) -> DataFrame:
    """The cohort's documents with their `top` commonest categories and all section types, each an array of (name, n) in order of n, then name."""
    ordered = lambda rows: F.transform(F.array_sort(rows), lambda x: F.struct(x["name"].alias("name"), (-x["less"]).alias("n")))
    pick = lambda which: F.collect_list(F.when(F.col("level") == which, F.struct((-F.col("n")).alias("less"), "name")))
    grouped = levels.where("document_id IS NOT NULL").groupBy("document_id").agg(pick("document_category").alias("c"), pick("document_type").alias("t"))
    nested = grouped.select(F.col("document_id").alias("id"), F.slice(ordered(F.col("c")), 1, top).alias("dominant_exclusions"), ordered(F.col("t")).alias("section_types"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = docs.select("id", "title", "source_type", count("chunk_count").alias("total_chunks"), (count("chunk_count") - count("excluded_chunk_count")).alias("included_chunks"), count("excluded_chunk_count").alias("excluded_chunks"))
    return base.join(nested, "id", "left")
