"""Residual, structural and before/after analytics over documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.shared import BROADCAST_ROWS
from lodestar.operators.health import excluded_ratio


def residual_cohort(docs: DataFrame, n: int = 20, ids: DataFrame | None = None, at_least: float = 0.25) -> DataFrame:
    """Active partial documents with the greatest excluded share, or the active versions of the given ids' paths."""
    if ids is not None:
        paths = docs.join(ids.select("id"), "id", "left_semi").select("source_path").distinct()
        return docs.where("is_active").join(paths, "source_path", "left_semi")
    out = docs.where("is_active AND text_quality_tier = 'partial'").withColumn("excluded_ratio", excluded_ratio())
    return out.where(F.col("excluded_ratio") >= at_least).orderBy(F.desc("excluded_ratio"), "id").limit(n)


def exclusion_category(content: Column, kind: Column, boilerplate: Column) -> Column:
    """Why an excluded chunk is excluded, from its content and kind. The first that holds counts."""
    return (
        F.when(boilerplate, "boilerplate")
        .when(T.is_ocr_garbage(content), "ocr_garbage")
        .when(content.rlike(r"(?i)controlled copy|uncontrolled|page\s+\d+\s+of"), "header_footer")
        .when(kind == "table", "table_noise")
        .when(content.rlike(r"\.{4,}"), "table_of_contents")
        .when(kind == "heading", "heading_fragment")
        .when(T.token_count(content) < 10, "short_fragment")
        .when(kind == "note", "list_fragment")
        .when(kind == "appendix", "appendix_body")
        .otherwise("other")
    )


def exclusion_report(chunks: DataFrame, top: int = 4) -> DataFrame:
    """document_id, category, n, rank: each document's commonest exclusion categories."""
    kind = exclusion_category(F.col("content"), F.col("section_type"), F.col("is_boilerplate"))
    counts = chunks.where("retrieval_excluded").withColumn("category", kind).groupBy("document_id", "category").agg(F.count("*").alias("n"))
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), "category")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def title_family(title: Column) -> Column:
    code = F.regexp_extract(title, r"^([A-Z]{2,5}(?:-[A-Z]{2})?)", 1)
    return F.when(code != "", code).otherwise(F.upper(F.substring_index(title, " ", 1)))


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each document of `before` beside the one of `after` with its path, else its title; change of ratio, headings and chunks."""
    slim = lambda df, p: df.select("source_path", "title", excluded_ratio().alias(f"{p}_ratio"), F.col("heading_chunk_count").alias(f"{p}_headings"), F.col("chunk_count").alias(f"{p}_chunks"))
    b, a = slim(before, "before"), slim(after, "after")
    by_path = b.join(a.drop("title"), "source_path", "left")
    titles = a.groupBy("title").agg(*[F.min(c).alias(f"_{c}") for c in ("after_ratio", "after_headings", "after_chunks")])
    out = by_path.join(titles, "title", "left")
    for c in ("after_ratio", "after_headings", "after_chunks"):
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out.withColumns(
        {
            "ratio_change": F.round(F.col("after_ratio") - F.col("before_ratio"), 6),
            "heading_change": F.col("after_headings") - F.col("before_headings"),
            "chunk_change": F.col("after_chunks") - F.col("before_chunks"),
        }
    )


def impact_summary(changes: DataFrame, unresolved: float = 0.25) -> DataFrame:
    return changes.agg(
        F.count("*").alias("documents"), F.count_if(F.col("ratio_change") < 0).alias("improved"), F.count_if(F.col("heading_change") > 0).alias("more_headings"),
        F.count_if(F.col("after_ratio") >= unresolved).alias("unresolved"), F.round(F.avg("ratio_change"), 6).alias("mean_change"),
    )


def quality_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    slim = lambda df, p: df.select("source_path", F.col("ocr_quality_status").alias(f"status_{p}"), excluded_ratio().alias(f"ratio_{p}"))
    return slim(before, "before").join(slim(after, "after"), "source_path", "left").withColumn("delta", F.round(F.col("ratio_after") - F.col("ratio_before"), 6))


def substrings(col: Column, n: int) -> Column:
    """Distinct runs of n characters; none of a shorter text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(col) - (n - 1)), lambda i: F.substring(col, i, n))
    return F.when(F.length(col) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


#: Needles of so many characters meet the texts by runs of that length, shorter ones by runs of three or as they are.
LONG_RUN = 6


def contained(needles: DataFrame, texts: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """(needle, text) for every needle that stands inside a text, both distinct and not empty.

    All runs of three characters of a needle, and all of `LONG_RUN`, are in a text that holds it, so they meet
    by equality on the needle's rarest run of the longest kind it has (needles of one or two: on themselves), and
    `contains` confirms. A needle with a run that no text has meets none. Texts have runs of the
    kinds that needles ask for alone, and their runs carry a hash in the text's place, so a long text is not written once a run.
    Up to `few` runs of needles go to every task, and then no other run is shuffled; more are joined by sorting.
    """
    n = F.length("needle")
    kind = F.when(n < 3, n).when(n < LONG_RUN, 3).otherwise(LONG_RUN)
    needles, texts = needles.where("needle <> ''"), texts.where("text <> ''")
    kinds, most = needles.agg(F.sort_array(F.collect_set(kind)), F.coalesce(F.sum(n), F.lit(0))).first()  # four numbers at most, and a bound of all runs
    way = F.broadcast if most <= few else lambda df: df.hint("merge")
    own = F.when(n < 3, F.array("needle")).when(n < LONG_RUN, substrings(F.col("needle"), 3)).otherwise(substrings(F.col("needle"), LONG_RUN))
    asked = needles.select("needle", F.explode(own).alias("_run"))
    marked = texts.withColumn("_t", F.xxhash64("text"))
    runs = marked.select("_t", F.explode(F.concat(*[substrings(F.col("text"), k) for k in kinds or [1]])).alias("_run"))
    counts = runs.join(way(asked.select("_run").distinct()), "_run", "left_semi").groupBy("_run").agg(F.count("*").alias("_n"))
    rarest = asked.join(way(counts), "_run", "left").groupBy("needle").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), "_run")).alias("_run"))
    pairs = runs.join(way(rarest), "_run").select("needle", "_t").distinct()
    return pairs.hint("merge").join(marked, "_t").where(F.contains("text", "needle")).select("needle", "text")


def source_hits(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """id, hits: how many hits have a title that equals, holds or is held by the document's, both normalised.

    Blank titles of hits don't count; a title without a letter or digit holds nothing
    and stands inside every other. A document without a title has none. There may be as many titles as
    documents, so they are joined by sorting.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    found = hits.where(F.trim("doc_title") != "").groupBy(norm("doc_title").alias("text")).agg(F.count("*").alias("_n"))
    named = docs.select("id", norm("title").alias("_t"))
    titles = named.where(F.col("_t").isNotNull()).select(F.col("_t").alias("needle")).distinct()
    inside = contained(titles, found, 0)
    around = contained(found.select(F.col("text").alias("needle")), titles.select(F.col("needle").alias("text")), 0).select(F.col("text").alias("needle"), F.col("needle").alias("text"))
    counts = inside.unionByName(around).distinct().join(found.hint("merge"), "text").groupBy(F.col("needle").alias("_t")).agg(F.sum("_n").alias("_hits"))
    totals = found.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"), F.coalesce(F.sum(F.when(F.col("text") == "", F.col("_n"))), F.lit(0)).alias("_bare"))  # one row
    hits_of = F.when(F.col("_t").isNull(), 0).when(F.col("_t") == "", F.col("_all")).otherwise(F.coalesce("_hits", F.lit(0)) + F.col("_bare"))
    return named.join(counts.hint("merge"), "_t", "left").crossJoin(F.broadcast(totals)).select("id", hits_of.cast("long").alias("hits"))


def cycle_rollup(cycles: DataFrame) -> DataFrame:
    return cycles.agg(
        F.count("*").alias("cycles"), F.sum("documents").alias("documents"), F.sum("material").alias("material"),
        F.round(F.sum(F.col("mean_delta") * F.col("documents")) / F.sum("documents"), 6).alias("weighted_delta"),
    )


#: Exclusion categories of a reason code, and what must stand in the code or the tag. The first that holds counts.
TAG_CATEGORIES = (
    ("duplicate_boilerplate", "boilerplate"), ("ocr_garbage", "ocr"), ("metadata_block", "metadata"), ("broken_structure", "broken"),
    ("short_fragment_noise", "short.*noise"), ("short_procedure", "short.*procedure"), ("table_reference", "table.*reference"), ("table_noise", "table"),
    ("list_reference", "list"), ("diagram_caption", "diagram|caption"), ("footer_mixed_body", "footer"), ("weak_heading_fragment", "weak"),
)


def exclusion_category_from_tag(tag: Column) -> Column:
    code = F.lower(F.coalesce(tag, F.lit("")))
    return F.coalesce(*[F.when(code.rlike(pattern), name) for name, pattern in TAG_CATEGORIES], F.lit("other_exclusion"))


def residual_drivers(docs: DataFrame, categories: DataFrame) -> DataFrame:
    """docs(id, quality_reasons, excluded_ratio) with categories(id, category, n): what keeps a document partial."""
    wide = categories.groupBy("id").agg(
        F.coalesce(F.sum(F.when(F.col("category") == "broken_structure", F.col("n"))), F.lit(0)).alias("_broken"),
        F.coalesce(F.sum(F.when(F.col("category") == "short_fragment_noise", F.col("n"))), F.lit(0)).alias("_short"),
    )
    named = T.reasons(
        (F.array_contains("quality_reasons", "High excluded chunk ratio"), "High excluded chunk ratio"), (F.col("_broken") > 2, "broken_structure"), (F.col("_short") > 3, "short_fragment_noise")
    )
    out = docs.join(wide, "id", "left").withColumn("_named", named)
    elevated = F.when(F.col("excluded_ratio") > 0.25, F.array(F.lit("elevated_exclusion"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("residual_drivers", F.when(F.size("_named") > 0, F.col("_named")).otherwise(elevated)).drop("_broken", "_short", "_named")


def assess_categories(categories: DataFrame) -> DataFrame:
    """category, n, assessment over the corpus: noise, over-excluded (more than five of a kind worth keeping), minor or unclear."""
    totals = categories.groupBy("category").agg(F.sum("n").alias("n"))
    noise = F.col("category").isin("duplicate_boilerplate", "ocr_garbage", "metadata_block", "table_noise")
    worth = F.col("category").isin("broken_structure", "short_procedure", "table_reference", "list_reference", "footer_mixed_body")
    return totals.withColumn("assessment", F.when(noise, "noise").when(worth & (F.col("n") > 5), "over_excluded").when(F.col("n") <= 5, "minor").otherwise("unclear"))


def residual_detail(before: DataFrame, after: DataFrame) -> DataFrame:
    """By title, (title, excluded_ratio, dominant_failure, ocr_used) twice: what is fixable, what is a floor, and risk notes.

    One row a row of `after`: documents of one title in `before` stand for it with their least ratio.
    """
    b = before.groupBy("title").agg(F.min("excluded_ratio").alias("ratio_before"))
    out = after.join(b, "title")
    mixed = F.col("dominant_failure") == "contamination"
    improved = F.col("excluded_ratio") < F.col("ratio_before")
    fixable = mixed & ~F.col("ocr_used")
    notes = T.reasons(
        (F.col("ocr_used") & mixed, "OCR with mixed footers"), (F.col("excluded_ratio") > 0.29, "High excluded ratio"), (~improved, "Did not improve"), (fixable, "Good candidate for footer cleanup")
    )
    return out.withColumns(
        {
            "improved": improved, "likely_fixable": fixable, "likely_stable": (F.col("excluded_ratio") > 0.28) & mixed & F.col("ocr_used"),
            "risk_notes": F.array_join(notes, "; "),
        }
    )


def residual_rollup(detail: DataFrame, families: int = 8) -> DataFrame:
    """level, name, n and said: the commonest families of `residual_detail`, what cleaning up can do, and the risk that documents stay as they are."""
    named = detail.groupBy(title_family(F.coalesce("title", F.lit(""))).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(families)
    rows = named.select(F.lit("family").alias("level"), "name", "n", F.lit(None).cast("string").alias("said"))
    total = detail.agg(F.count("*").alias("all"), F.count_if("likely_fixable").alias("fixable"), F.count_if("likely_stable").alias("stable"))
    of = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("all").cast("string"))
    cleanup = F.when(F.col("fixable") > 0, F.concat(F.lit("High: "), of("fixable"), F.lit(" docs likely fixable by footer/header cleanup"))).otherwise("Low: Most residual issues tied to OCR or inherent structure")
    risk = F.when(F.col("stable") > F.col("all") * 0.5, F.concat(F.lit("High risk: "), of("stable"), F.lit(" docs show stable floor traits"))).otherwise(F.concat(F.lit("Moderate: "), of("stable"), F.lit(" docs may be stable floor")))
    said = total.select(F.explode(F.array(F.struct(F.lit("cleanup").alias("name"), F.col("fixable").alias("n"), cleanup.alias("said")), F.struct(F.lit("risk").alias("name"), F.col("stable").alias("n"), risk.alias("said")))).alias("s"))
    return rows.unionByName(said.select(F.lit("overall").alias("level"), "s.*"))


def unresolved(changes: DataFrame, above: float = 0.25, n: int = 10) -> DataFrame:
    """Of `impact`'s documents those still at `above` or more, the ones that gained most first."""
    return changes.where(F.col("after_ratio") >= above).orderBy("ratio_change", "source_path").limit(n)


def residual_shallow(docs: DataFrame, n: int = 20, above: float = 0.25) -> DataFrame:
    """From document counters alone: the active partial documents of greatest excluded share, and how far above the bound."""
    pool = docs.where("is_active AND text_quality_tier = 'partial' AND chunk_count > 0").withColumn("excluded_ratio", excluded_ratio())
    return pool.where(F.col("excluded_ratio") > above).withColumn("excess", F.round(F.col("excluded_ratio") - above, 6)).orderBy(F.desc("excluded_ratio"), "id").limit(n)
