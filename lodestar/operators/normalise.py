"""Section normalisation: classify, suppress, merge, drop, de-duplicate, recover.

Sections are rows (doc_id, pos, content, type, title, level). Rules are column
expressions; neighbours are found with windows inside a document; corpus counts
are aggregates joined back. Only the greedy merge of tiny sections is a grouped
fold, bounded by one document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lodestar.functions import patterns as P
from lodestar.functions import text as T
from lodestar.operators.shared import cut, sent


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def with_heading_stack(secs: DataFrame) -> DataFrame:
    """heading_stack: titles of the open headings at each section, outermost first.

    A heading closes those of its own level and deeper. The open heading of level k
    at a section is the last one of level k that no shallower or equal heading
    follows: a running "last" by level and a comparison of positions, no fold.
    """
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    before = by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = [
        F.last(F.when((F.col("type") == "heading") & (level == k), F.struct(F.col("pos").alias("at"), F.col("content").alias("title"))), ignorenulls=True).over(before)
        for k in range(1, 7)
    ]
    out = secs.select("*", *[x.alias(f"_h{k}") for k, x in enumerate(lasts, 1)])
    opened = []
    for k in range(1, 7):
        shallower = [F.coalesce(F.col(f"_h{j}.at"), F.lit(-1)) for j in range(1, k)]
        alive = F.lit(True) if not shallower else F.col(f"_h{k}.at") > (F.greatest(*shallower) if len(shallower) > 1 else shallower[0])
        opened.append(F.when(alive, F.col(f"_h{k}.title")))
    return out.withColumn("heading_stack", F.array_compact(F.array(*opened))).drop(*[f"_h{k}" for k in range(1, 7)])


def under(pattern: str) -> Column:
    """The section's title or any open heading matches; `_path` holds them as one text, parted by a character that no pattern takes for a space."""
    return F.col("_path").rlike(pattern)


def classify_sections(secs: DataFrame) -> DataFrame:
    """Adds section_type, confidence, retrieval_excluded, retrieval_downranked, exclusion_tag. The first rule that holds counts."""
    content = F.coalesce("content", F.lit(""))
    verbs, tokens = F.col("_verbs"), F.col("_tokens")

    def outcome(kind: str, confidence: float, excluded: Column | bool = False, downranked: bool = False, tag: Column | str | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            F.lit(kind).alias("section_type"), F.lit(confidence).alias("section_type_confidence"), lit(excluded).alias("retrieval_excluded"),
            F.lit(downranked).alias("retrieval_downranked"), lit(tag).cast("string").alias("exclusion_tag"),
        )

    reference = T.is_reference_table(content)
    found = (
        F.when(content.rlike(P.FOOTER_HEADER) & T.has_body_beyond_footer(content), outcome("instruction_block", 0.72, tag="broken_structure"))
        .when(content.rlike(P.FOOTER_HEADER), outcome("footer_header", 0.9, True, tag="metadata_block"))
        .when(T.is_ocr_garbage(content), outcome("metadata_only", 0.9, True, tag="ocr_garbage"))
        .when(T.is_empty_content(content) & under(P.FORM_HEADING), outcome("form_stub", 0.9, True, tag="metadata_block"))
        .when((tokens < 10) & T.is_empty_content(content) & under(P.APPENDIX_FORM_HEADING), outcome("form_stub", 0.9, True, tag="metadata_block"))
        .when(content.rlike(P.WARNING_START), outcome("warning", 0.9))
        .when(content.rlike(P.NUMBERED_STEP) & (verbs > 0), outcome("procedure_step", 0.9))
        .when(F.col("type") == "table", outcome("table", 0.95, ~reference, tag=F.when(reference, "table_reference").otherwise("table_noise")))
        .when((F.col("type") == "list") & T.is_reference_list(content), outcome("note", 0.8, tag="list_reference"))
        .when((verbs >= 2) | ((verbs >= 1) & T.has_verb_object(content)), outcome("instruction_block", 0.8))
        .when(under(P.REVISION_HEADING), outcome("revision_history", 0.85, downranked=True))
        .when(under(P.APPENDIX_HEADING), outcome("appendix", 0.8, downranked=True))
        .when(under(P.METADATA_HEADING), outcome("metadata_only", 0.8, downranked=True, tag="metadata_block"))
        .when(F.col("type") == "heading", outcome("heading", 0.95))
        .when((tokens < 100) & under(P.NOTE_HEADING), outcome("note", 0.7))
        .otherwise(outcome("paragraph", 0.5))
    )
    source = secs if "heading_stack" in secs.columns else with_heading_stack(secs)
    path = F.array_join(F.concat(F.array(F.coalesce("title", F.lit(""))), F.col("heading_stack")), "\x01")
    source = source.withColumns({"_path": path, "_verbs": F.size(T.imperative_verbs(content)), "_tokens": T.token_count(content)})
    return source.withColumn("_c", found).select("*", "_c.*").drop("_c", "heading_stack", "_path", "_verbs", "_tokens")


def fingerprints(secs: DataFrame) -> DataFrame:
    """boilerplate_hash, occurrence_count, sample_text: how often each normalised block occurs in the corpus."""
    hashed = secs.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(T.boilerplate_hash(F.col("content")).alias("boilerplate_hash"), F.substring("content", 1, 200).alias("_sample"))
    return hashed.groupBy("boilerplate_hash").agg(F.count("*").alias("occurrence_count"), F.min("_sample").alias("sample_text"))


def suppress_boilerplate(secs: DataFrame, mode: str = "rebuild", threshold: int = 20, domain_terms: str | None = None) -> DataFrame:
    """Sets is_boilerplate, boilerplate_hash, suppressed_by and the exclusion of classified sections.

    Footers and stubs are skipped, protected content is never touched, rules come
    before corpus counts, and those count only when the corpus is rebuilt. Blocks
    that recur are few, so their hashes are counted, cut and sent to the sections,
    whose text never moves; rules run once a row, below the join.
    """
    content = F.coalesce("content", F.lit(""))
    out = secs.withColumns({"boilerplate_hash": T.boilerplate_hash(content), "_rule": T.rule_boilerplate(content)})
    if mode == "rebuild":
        hashed = secs.where(F.trim(content) != "").select(T.boilerplate_hash(F.col("content")).alias("boilerplate_hash"))
        counts = hashed.groupBy("boilerplate_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= threshold)
        out = out.join(sent(cut(counts)), "boilerplate_hash", "left")
    else:
        out = out.withColumn("_n", F.lit(None).cast("long"))
    by = (
        F.when(F.col("section_type").isin("footer_header", "form_stub"), F.lit(None))
        .when(T.is_protected(content, domain_terms), F.lit(None))
        .when(F.col("_rule").isNotNull(), F.concat(F.lit("rule:"), F.col("_rule")))
        .when(F.col("_n").isNotNull() & T.is_low_information(content, domain_terms), "corpus")
    )
    return (
        out.withColumn("suppressed_by", by)
        .withColumn("is_boilerplate", F.col("suppressed_by").isNotNull())
        .withColumn("retrieval_excluded", F.col("retrieval_excluded") | F.col("is_boilerplate"))
        .withColumn("exclusion_tag", F.when(F.col("is_boilerplate"), "duplicate_boilerplate").otherwise(F.col("exclusion_tag")))
        .drop("_n", "_rule")
    )


def with_parent_heading(secs: DataFrame) -> DataFrame:
    """parent_heading: content of the nearest heading section before, in the document."""
    earlier = by_doc().rowsBetween(Window.unboundedPreceding, -1)
    return secs.withColumn("parent_heading", F.last(F.when(F.col("section_type") == "heading", F.col("content")), ignorenulls=True).over(earlier))


MERGEABLE = ("paragraph", "note", "instruction_block", "procedure_step")


def merge_tiny(secs: DataFrame, max_tokens: int = 50) -> DataFrame:
    """Join runs of neighbouring tiny sections under one heading and of one kind, until a run reaches `max_tokens`.

    Where a run may continue is a window comparison; the running length that ends
    it is a fold inside one document.
    """
    w = by_doc()
    tiny = (T.token_count(F.col("content")) < max_tokens) & F.col("section_type").isin(*MERGEABLE)
    marked = with_parent_heading(secs).withColumns({"_tiny": tiny, "_n": T.token_count(F.col("content"))})
    same = lambda c: F.lag(c).over(w).eqNullSafe(F.col(c))
    joins = F.col("_tiny") & F.coalesce(F.lag("_tiny").over(w), F.lit(False)) & same("parent_heading") & same("retrieval_excluded") & same("section_type")
    marked = marked.withColumn("_joins", F.coalesce(joins, F.lit(False)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        heads, lengths = [], []
        for joins, n in zip(pdf["_joins"], pdf["_n"]):
            if joins and lengths and lengths[-1] < max_tokens:
                lengths[-1] += n
                heads.append(heads[-1])
            else:
                lengths.append(n)
                heads.append((heads[-1] if heads else 0) + 1)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "pos": pdf["pos"], "_run": heads})

    runs = marked.select("doc_id", "pos", "_joins", "_n").groupBy("doc_id").applyInPandas(fold, f"doc_id {secs.schema['doc_id'].dataType.simpleString()}, pos {secs.schema['pos'].dataType.simpleString()}, _run long")
    rest = [c for c in secs.columns if c not in ("doc_id", "pos", "content")]
    grouped = marked.join(runs, ["doc_id", "pos"]).groupBy("doc_id", "_run")
    return grouped.agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("content"),
        *[F.min_by(c, "pos").alias(c) for c in rest],
        F.count("*").alias("n_merged"),
    ).drop("_run")


def drop_empty_headings(secs: DataFrame) -> DataFrame:
    """Drop headings with no kept section before the next heading of their level or above.

    The next such heading is the least of six look-aheads, one a level; kept sections
    are counted with a running sum, so no self-join is needed.
    """
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    ahead = by_doc().rowsBetween(1, Window.unboundedFollowing)
    heading = F.col("section_type") == "heading"
    kept = (~heading & ~F.col("retrieval_excluded")).cast("int")
    so_far = F.sum(kept).over(by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = secs.withColumns({"_kept": so_far, "_level": level}).withColumn("_total", F.sum(kept).over(Window.partitionBy("doc_id")))
    nexts = [F.first(F.when(heading & (F.col("_level") == k), F.struct("pos", "_kept")), ignorenulls=True).over(ahead) for k in range(1, 7)]
    marked = marked.select("*", *[x.alias(f"_n{k}") for k, x in enumerate(nexts, 1)])
    candidates = F.array_compact(F.array(*[F.when(F.col("_level") >= k, F.col(f"_n{k}")) for k in range(1, 7)]))
    until = F.coalesce(F.array_min(candidates)["_kept"], F.col("_total"))
    empty = heading & (until - F.col("_kept") <= 0)
    return marked.where(~empty).select(*secs.columns)


def dedupe_within_doc(secs: DataFrame) -> DataFrame:
    """Keep the first section of each (text, type, parent heading) in a document; exclude the rest."""
    exempt = F.col("section_type").isin("heading", "procedure_step", "warning", "table")
    norm = F.regexp_replace(F.trim(F.lower("content")), r"\s+", " ")
    w = Window.partitionBy("doc_id", "_norm", "section_type", "parent_heading").orderBy("pos")
    out = with_parent_heading(secs).withColumn("_norm", norm).withColumn("_copy", F.row_number().over(w))
    dup = ~exempt & (F.col("_copy") > 1)
    return (
        out.withColumn("is_duplicate", dup)
        .withColumn("retrieval_excluded", F.col("retrieval_excluded") | dup)
        .withColumn("exclusion_tag", F.when(dup, "duplicate_boilerplate").otherwise(F.col("exclusion_tag")))
        .drop("_norm", "_copy", "parent_heading")
    )


EXEMPT_SHORT = ("heading", "warning", "procedure_step", "table", "note")


def short_content_policy(secs: DataFrame, min_tokens: int = 20) -> DataFrame:
    """Exclude short sections with no longer neighbour under their heading, unless their kind or content is worth keeping."""
    w = by_doc()
    marked = with_parent_heading(secs).withColumn("_n", T.token_count(F.col("content")))
    near = lambda f: F.coalesce((f("_n").over(w) >= min_tokens) & f("parent_heading").over(w).eqNullSafe(F.col("parent_heading")), F.lit(False))
    isolated = ~near(F.lag) & ~near(F.lead)
    short = (F.col("_n") < min_tokens) & ~F.col("retrieval_excluded") & isolated
    spared = F.col("section_type").isin(*EXEMPT_SHORT) | T.is_heading_like(F.col("content")) | T.is_meaningful_short(F.coalesce("content", F.lit("")), F.col("type"))
    marked = marked.withColumns({"_short": short, "_spared": F.when(short, spared).otherwise(False)})
    return (
        marked.withColumn("retained_short", F.col("_short") & F.col("_spared"))
        .withColumn("dropped_short", F.col("_short") & ~F.col("_spared"))
        .withColumn("retrieval_excluded", F.col("retrieval_excluded") | F.col("dropped_short"))
        .withColumn("exclusion_tag", F.when(F.col("dropped_short"), "short_fragment_noise").otherwise(F.col("exclusion_tag")))
        .drop("_n", "_short", "_spared", "parent_heading")
    )


def recover_fragments(secs: DataFrame) -> DataFrame:
    """Bring back excluded fragments that still hold value, by their tag."""
    content = F.coalesce("content", F.lit(""))
    signal = F.when(
        F.col("retrieval_excluded") & F.col("exclusion_tag").isin("broken_structure", "short_fragment_noise"),
        F.when(T.is_meaningful_short(content, F.col("type")), "meaningful_short").when(T.is_valuable_broken(content), "valuable_broken"),
    )
    return (
        secs.withColumn("recovery_signal", signal)
        .withColumn("retrieval_excluded", F.col("retrieval_excluded") & F.col("recovery_signal").isNull())
    )


def normalise_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document: input, output and what became of the sections."""
    n_in = before.groupBy("doc_id").agg(F.count("*").alias("input_sections"))
    n_out = after.groupBy("doc_id").agg(
        F.count("*").alias("output_sections"),
        F.count_if("retrieval_excluded").alias("excluded"),
        F.count_if("retrieval_downranked").alias("downranked"),
        F.count_if("is_boilerplate").alias("boilerplate"),
        F.count_if("is_duplicate").alias("deduplicated"),
        F.count_if("dropped_short").alias("dropped_short"),
        F.sum(F.when(~F.col("retrieval_excluded"), T.token_count(F.col("content"))).otherwise(0)).alias("kept_tokens"),
    )
    return n_in.join(n_out, "doc_id", "left").na.fill(0)


def sanity_warnings(stats: DataFrame) -> DataFrame:
    """Adds warnings (too much excluded, too little kept, short on average) and needs_review."""
    kept = F.col("output_sections") - F.col("excluded")
    found = T.reasons(
        (T.ratio(F.col("excluded"), F.col("output_sections")) > 0.8, "mostly_excluded"),
        (kept < 3, "few_kept"),
        ((kept > 0) & (T.ratio(F.col("kept_tokens"), kept) < 15), "short_on_average"),
    )
    return stats.withColumn("warnings", found).withColumn("needs_review", (F.size("warnings") > 0) & (F.col("input_sections") > 3))


def normalise(secs: DataFrame, threshold: int = 20) -> DataFrame:
    """The steps in their fixed order, without the merge."""
    out = suppress_boilerplate(classify_sections(secs), threshold=threshold)
    return recover_fragments(short_content_policy(dedupe_within_doc(drop_empty_headings(out))))
