"""Completeness audit: numbered references, appendices that are cited but not there, an additive risk.

References and headings are number paths (13.2.1, A4.2). A path's ancestors are its
prefixes, so each heading is spread over the paths that it stands for and every test,
own heading, child heading, family, marker in the text, is an equality join on
(document, path); none compares all headings with all references.

Whether an appendix is missing: no heading begins with its path and a blank, a tab or a dot, or is
that path; if it is cited once at most, no heading of its family (same first number) is
there either; and the text says "appendix <path>" fewer than twice.

Paths are ordered by their numbers, however long, then by their text, small letters first. Lengths are code points.
Null contents are empty, null titles no headings; documents without chunks have zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the rules, and what may follow a heading's path; fixed values.
BLANK = r"[\s   -     　﻿]"
WORD = "[0-9A-Za-z_]"
#: Section numbers and cited appendices; fixed values.
SECTION_NUMBER = rf"(?<!{WORD})\d{{1,2}}(?:\.\d{{1,3}}){{0,3}}(?!{WORD})"
APPENDIX = rf"(?i)(?<!{WORD})appendix{BLANK}+([A-Z]?\d+\.\d+(?:\.\d+){{0,3}})(?!{WORD})"
CONTENTS_TITLE, DOT_LEADER = "table of contents", r"\.{4,}\s*\d+"
PATH = r"[a-z]?\d+(?:\.\d+)*"
MOST_NUMBERS = 120
#: (rule, points, reason) in order; fixed values.
RISKS = (
    ("quarantined", 8, "Document is quarantined"),
    ("needs_review", 2, "Document is marked needs_review"),
    ("text_quality_tier = 'poor'", 4, "Text quality tier is poor"),
    ("text_quality_tier = 'partial'", 1, "Text quality tier is partial"),
    ("chunk_count <= 5", 2, "Very low chunk count"),
    ("avg_chars_per_chunk < 220", 1, "Low average characters per chunk"),
    ("size(missing_referenced_appendices) > 0", 4, "Missing appendix content for refs: "),
    ("n_numbers < 8 AND chunk_count > 40", 1, "Low numbered-section detection compared to chunk volume"),
)
HIGH, MEDIUM = 7, 4


def path_key(path: Column) -> Column:
    """A string that sorts number paths by their numbers: each part's length and digits, after its letter."""
    part = lambda p: F.concat(F.lower(F.regexp_extract(p, "^([A-Za-z]?)", 1)), F.lpad(F.length(F.regexp_replace(p, "^[A-Za-z]?0*", "")).cast("string"), 6, "0"), F.regexp_replace(p, "^[A-Za-z]?0*", ""))
    return F.array_join(F.transform(F.split(path, r"\."), part), " ")


def ancestors(path: Column) -> Column:
    """The path's proper prefixes by whole parts."""
    parts = F.split(path, r"\.")
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def in_contents(title: Column, content: Column) -> Column:
    return F.lower(title).contains(CONTENTS_TITLE) | F.lower(content).contains(CONTENTS_TITLE) | content.rlike(DOT_LEADER)


def cited_appendices(chunks: DataFrame) -> DataFrame:
    """document_id, ref (as written), path (lower case), mentions of that path outside tables of contents."""
    rows = chunks.select("document_id", F.coalesce("section_title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    refs = rows.where(~in_contents(F.col("title"), F.col("content"))).select("document_id", F.explode(F.regexp_extract_all("content", F.lit(APPENDIX), F.lit(1))).alias("ref"))
    counted = refs.groupBy("document_id", "ref").agg(F.count("*").alias("n")).withColumn("path", F.lower("ref"))
    return counted.withColumn("mentions", F.sum("n").over(Window.partitionBy("document_id", "path"))).drop("n")


def missing_appendices(chunks: DataFrame) -> DataFrame:
    """`cited_appendices` with `missing`."""
    cited = cited_appendices(chunks)
    title, content = F.coalesce("section_title", F.lit("")), F.coalesce("content", F.lit(""))
    heading = F.lower(F.regexp_replace(title, rf"^{BLANK}+|{BLANK}+$", ""))
    headings = chunks.select("document_id", F.regexp_extract(heading, f"^({PATH})", 1).alias("path"), F.regexp_extract(heading, rf"^{PATH}(.|$)", 1).alias("next")).where("path <> ''").distinct()
    own = F.when(F.col("next").isin("", " ", "\t", "."), F.array("path")).otherwise(F.array().cast("array<string>"))
    present = headings.select("document_id", F.explode(F.concat(own, ancestors(F.col("path")))).alias("path")).distinct().withColumn("present", F.lit(True))
    family = F.substring_index("path", ".", 1)
    families = headings.where((family != F.col("path")) | (F.col("next") == ".")).select("document_id", family.alias("family")).distinct().withColumn("related", F.lit(True))
    # the text counts every place that goes on with the path, so a marker stands for each prefix of what follows it
    said = F.concat(F.lower(title), F.lit("\n"), F.lower(content))
    marked = chunks.select("document_id", F.explode(F.regexp_extract_all(said, F.lit(f"appendix ({PATH})"), F.lit(1))).alias("t")).groupBy("document_id", "t").agg(F.count("*").alias("n"))
    spread = F.filter(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(F.col("t"), F.lit(1), i)), lambda p: p.rlike(rf"^{PATH}$"))
    markers = marked.select("document_id", F.explode(spread).alias("path"), "n").groupBy("document_id", "path").agg(F.sum("n").alias("markers"))
    on = ["document_id", "path"]
    judged = cited.join(present, on, "left").withColumn("family", family).join(families, ["document_id", "family"], "left").join(markers, on, "left")
    excused = (F.col("mentions") <= 1) & F.col("related").isNotNull()
    missing = F.col("present").isNull() & ~excused & (F.coalesce("markers", F.lit(0)) < 2)
    return judged.select("document_id", "ref", "path", "mentions", missing.alias("missing"))


def _ordered(refs: Column, pick) -> Column:
    return F.transform(F.array_sort(F.filter(refs, pick)), lambda r: r["ref"])


def audit(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document: pages, characters, headings, numbers in order (120 at most), cited and missing appendices, risk and its reasons.

    docs(id, title, source_path, text_quality_tier, needs_review, quarantined, chunk_count).
    """
    title, content = F.coalesce("section_title", F.lit("")), F.coalesce("content", F.lit(""))
    heading = F.regexp_replace(title, rf"^{BLANK}+|{BLANK}+$", "")
    counts = chunks.groupBy("document_id").agg(
        F.count_distinct("page_number").alias("pages_seen"), F.sum(F.length(content)).alias("extracted_char_count"), F.count_distinct(F.when(heading != "", heading)).alias("heading_count")
    )
    both = F.concat(F.regexp_extract_all(F.when(heading != "", title).otherwise(""), F.lit(SECTION_NUMBER), F.lit(0)), F.regexp_extract_all(content, F.lit(SECTION_NUMBER), F.lit(0)))
    numbers = chunks.select("document_id", F.explode(both).alias("number")).distinct().withColumn("key", path_key(F.col("number")))
    in_order = Window.partitionBy("document_id").orderBy("key", "number")
    placed = numbers.withColumn("place", F.row_number().over(in_order))
    first = F.when(F.col("place") <= MOST_NUMBERS, F.struct("place", "number"))
    numbered = placed.groupBy("document_id").agg(F.max("place").alias("n_numbers"), F.transform(F.array_sort(F.collect_list(first)), lambda r: r["number"]).alias("numbered_headings_found"))
    ref = F.struct(path_key(F.col("path")).alias("key"), "path", (F.col("ref") != F.col("path")).alias("capital"), "ref", "missing")
    refs = missing_appendices(chunks).groupBy("document_id").agg(F.collect_list(ref).alias("refs"))
    refs = refs.select("document_id", _ordered(F.col("refs"), lambda r: F.lit(True)).alias("appendix_references"), _ordered(F.col("refs"), lambda r: r["missing"]).alias("missing_referenced_appendices"))
    made = docs.withColumnRenamed("id", "document_id").select("document_id", "title", "source_path", "text_quality_tier", "needs_review", "quarantined", "chunk_count")
    for part in (counts, numbered, refs):
        made = made.join(part, "document_id", "left")
    none = F.array().cast("array<string>")
    made = made.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pages_seen", "extracted_char_count", "heading_count", "n_numbers")})
    made = made.withColumns({c: F.coalesce(c, none) for c in ("numbered_headings_found", "appendix_references", "missing_referenced_appendices")})
    made = made.withColumn("avg_chars_per_chunk", F.when(F.col("chunk_count") > 0, F.floor(F.col("extracted_char_count") / F.col("chunk_count") + 0.5)).otherwise(0))
    holds = {rule: F.coalesce(F.expr(rule), F.lit(False)) for rule, _, _ in RISKS}
    named = lambda reason: F.concat(F.lit(reason), F.array_join("missing_referenced_appendices", ", ")) if reason.endswith(": ") else F.lit(reason)
    reasons = F.array_compact(F.array(*(F.when(holds[rule], named(reason)) for rule, _, reason in RISKS)))
    score = sum((F.when(holds[rule], points).otherwise(0) for rule, points, _ in RISKS), F.lit(0))
    made = made.withColumns({"reasons": reasons, "risk_score": score.cast("int")})
    return made.withColumn("risk", F.when(F.col("risk_score") >= HIGH, "high").when(F.col("risk_score") >= MEDIUM, "medium").otherwise("low"))


def audit_status(docs: DataFrame, audited: DataFrame) -> DataFrame:
    """`docs` with completeness status, score, reasons and missing appendices; needs_review falls where the audit finds next to nothing (risk 1 at most, tier not poor)."""
    status = F.when(F.col("risk") == "high", "suspect").when(F.col("risk") == "medium", "partial").when(F.col("risk").isNotNull(), "complete")
    found = audited.select(F.col("document_id").alias("id"), status.alias("extraction_completeness_status"), F.col("risk_score").alias("extraction_completeness_score"), F.col("reasons").alias("extraction_completeness_reasons"), "missing_referenced_appendices")
    clear = (F.col("extraction_completeness_status") == "complete") & (F.col("extraction_completeness_score") <= 1) & ~F.coalesce(F.col("text_quality_tier") == "poor", F.lit(False))
    return docs.join(found, "id", "left").withColumn("needs_review", F.when(clear, False).otherwise(F.col("needs_review")))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: documents, and how many of each risk."""
    return audited.agg(F.count("*").alias("total_docs"), *(F.count_if(F.col("risk") == r).alias(f"{r}_risk") for r in ("high", "medium", "low")))


def audit_lists(audited: DataFrame, medium: int = 30) -> DataFrame:
    """Documents of high risk, all of them, and the first `medium` ones of medium risk by score, title and id."""
    order = [F.desc("risk_score"), F.asc("title"), F.asc("document_id")]
    columns = ["risk", "document_id", "title", "source_path", "risk_score", "reasons", "missing_referenced_appendices", "chunk_count", "avg_chars_per_chunk"]
    return audited.where("risk = 'high'").select(columns).unionByName(audited.where("risk = 'medium'").orderBy(*order).limit(medium).select(columns))
