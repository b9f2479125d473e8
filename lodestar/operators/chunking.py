"""Chunk composition: sentences, runs of sections, size limits, labels and records.

Which sections go together is decided by a fold over one document's sections, which
puts their texts together too: sections are made once, and shuffled once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestar.functions import text as T
from lodestar.operators.shared import folded

DISTINCT_TYPES = ("warning", "note")
BREAK_BEFORE = ("procedure_step", "instruction_block")
SIZE_EXEMPT = ("table", "procedure_step", "instruction_block", "warning", "note", "appendix")
SENTENCE_END = r"(?<=\. )(?=[A-Z])|(?<=\n)"


def sentences(col: Column) -> Column:
    """Sentences of a text with their separators; a boundary is ". " before a capital, or a line end."""
    return F.filter(F.split(col, SENTENCE_END), lambda s: s != "")


def is_structural_title(title: Column) -> Column:
    """A title that names a part of a document rather than a table row."""
    t = F.trim(F.coalesce(title, F.lit("")))
    words = T.words(t)
    numeric = F.size(F.filter(words, lambda w: w.rlike(r"\d")))
    row_like = t.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}") | t.rlike(r"\b\d{1,2}:\d{2}\b") | ((F.size(words) >= 8) & (numeric >= 3))
    named = t.rlike(r"^\d+(?:\.\d+)*\s+\S") | t.rlike(r"(?i)^(?:appendix|table|figure|schedule|annex)\b") | (t.rlike(r"^[A-Z][A-Z\s]{5,}$") & (F.size(words) >= 3))
    plain = ~t.rlike(r"\s\d+$") & ~t.rlike("[±≥≤>]") & (F.size(words) >= 2)
    return (t != "") & ~row_like & (named | plain)


def split_text(text: str, most: int, overlap: int) -> list[str]:
    """Pieces of whole sentences of up to `most` words; each begins with the last sentences of the one before.

    These are as many as `overlap` words hold, and one at least; a piece of such a sentence and one more may pass `most`.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    size = 0
    for s in filter(None, re.split(SENTENCE_END, text)):
        n = len(s.split())
        if held and size + n > most:
            out.append("".join(x for x, _ in held).strip())
            tail, size = [], 0
            for x, k in reversed(held):
                if tail and size + k > overlap:
                    break
                tail.insert(0, (x, k))
                size += k
            held = tail
        held.append((s, n))
        size += n
    last = "".join(x for x, _ in held).strip()
    return [*out, last] if last else out


def pieces(most: int, overlap: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", most, overlap))

    return cut


def compose_prose(secs: DataFrame, max_tokens: int = 800, overlap: int = 120) -> DataFrame:
    """Chunks of normalised sections: doc_id, pos, part, content, section_title, section_type, section_types and flags.

    Tables and lists stand alone, and so do warnings and notes; procedures don't join
    other kinds; excluded and kept sections never mix; others join until
    `max_tokens`. A longer section is cut at sentences with an overlap.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when((F.col("type") == "heading") & is_structural_title(F.col("content")), F.col("content"))
    marked = secs.withColumns({"_title": F.last(heading, ignorenulls=True).over(w), "_n": T.token_count(F.col("content"))}).where("_n > 0")
    alone = F.col("type").isin("table", "list") | F.col("section_type").isin(*DISTINCT_TYPES)
    marked = marked.withColumn("_kind", F.when(alone, "alone").when(F.col("_n") > max_tokens, "long").otherwise("join"))

    def run_of(rows: list[tuple]) -> tuple:
        """One chunk of neighbouring rows; flags are those that hold for any of them, the rest is the first one's."""
        some = lambda k: (any(r[k] for r in rows) if any(r[k] is not None for r in rows) else None)
        doc, pos, _, title, section_type, _, _, boilerplate, kind, _ = rows[0]
        return doc, pos, "\n\n".join(r[2] for r in rows), title, section_type, [r[4] for r in rows], some(5), some(6), boilerplate, kind

    def fold(rows: list[tuple]) -> list[tuple]:
        size, first, runs = None, None, []
        for row in rows:
            section_type, excluded, kind, n = row[4], row[5], row[8], row[9]
            fits = kind == "join" and size is not None and size + n <= max_tokens and first[1] == excluded and not (section_type in BREAK_BEFORE and first[0] != section_type)
            if not fits:
                runs.append([])
                size, first = (0, (section_type, excluded)) if kind == "join" else (None, None)
            if size is not None:
                size += n
            runs[-1].append(row)
        return [run_of(r) for r in runs]

    slim = marked.select("doc_id", "pos", "content", F.col("_title").alias("section_title"), "section_type", "retrieval_excluded", "retrieval_downranked", "is_boilerplate", "_kind", "_n")
    schema = StructType([*slim.schema[:5], StructField("section_types", ArrayType(StringType())), *slim.schema[5:9]])
    joined = folded(slim, ["pos"], fold, schema)
    parts = F.when(F.col("_kind") == "long", pieces(max_tokens, overlap)(F.col("content"))).otherwise(F.array(F.trim("content")))
    return joined.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("part", "_text")).withColumn("content", F.col("_text")).drop("_parts", "_text", "_kind")


def reindex(chunks: DataFrame, order: list[str], by: str = "doc_id") -> DataFrame:
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def guardrails(chunks: DataFrame, least: int = 30, most: int = 1000, overlap: int = 120) -> DataFrame:
    """Drop short kept chunks unless their kind or first line spares them, cut those that are too long, number the rest."""
    n = T.token_count(F.col("content"))
    first = F.substring_index(F.col("content"), "\n", 1)
    keep = F.col("retrieval_excluded") | (n >= least) | F.coalesce("section_type", F.lit("")).isin(*SIZE_EXEMPT) | is_structural_title(first)
    cut = F.when(n > most, pieces(most, overlap)(F.col("content"))).otherwise(F.array("content"))
    out = chunks.where(keep).withColumn("_cut", cut).select("*", F.posexplode("_cut").alias("_sub", "_text")).withColumn("content", F.col("_text")).drop("_cut", "_text")
    return reindex(out, ["pos", "part", "_sub"]).drop("_sub")


def citation_label(doc_title: Column, section_title: Column, page: Column, index: Column) -> Column:
    tail = F.when(section_title.isNotNull(), section_title).when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))).otherwise(F.concat(F.lit("chunk "), index.cast("string")))
    return F.concat(doc_title, F.lit(", "), tail)


def finish_chunks(chunks: DataFrame) -> DataFrame:
    """Preview, hash, token count and embedding status."""
    return chunks.withColumns(
        {
            "content_preview": F.substring("content", 1, 200),
            "chunk_hash": F.sha2("content", 256),
            "token_count": T.token_count(F.col("content")),
            "embedding_status": F.when(F.col("retrieval_excluded"), "excluded").otherwise("pending"),
        }
    )


def dedupe_chunks(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """The first chunk of each hash in a document, numbered anew."""
    first = F.row_number().over(Window.partitionBy(by, "chunk_hash").orderBy("chunk_index"))
    return reindex(chunks.withColumn("_copy", first).where("_copy = 1").drop("_copy"), ["chunk_index"], by)


def split_table(content: str, most: int) -> list[str]:
    lines = content.split("\n")
    head, out, held, size = lines[0], [], [], 0
    room = most - len(lines[0].split())
    for line in lines[1:]:
        n = len(line.split())
        if held and size + n > room:
            out.append("\n".join([head, *held]))
            held, size = [], 0
        held.append(line)
        size += n
    return [*out, "\n".join([head, *held])] if held or not out else out


def compose_tables(groups: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """groups(doc_id, sheet, table_no, content, range_ref): tables that fit stay whole, others are cut by rows under their header."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_table(t, max_tokens))

    fits = T.token_count(F.col("content")) <= max_tokens
    out = groups.withColumn("_parts", F.when(fits, F.array("content")).otherwise(cut(F.col("content"))))
    out = out.select("*", F.posexplode("_parts").alias("part", "_text"))
    ref = F.when(F.size("_parts") > 1, F.concat(F.coalesce(F.concat("range_ref", F.lit(" ")), F.lit("")), F.lit("(part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("range_ref"))
    return out.withColumn("range_ref", ref).withColumn("content", F.col("_text")).drop("_parts", "_text")


def repair_titles(chunks: DataFrame, by: str = "document_id") -> DataFrame:
    """A chunk titled by its own first line takes the structural heading of the excluded chunk right before it."""
    w = Window.partitionBy(by).orderBy("chunk_index")
    before = F.lag(F.struct("retrieval_excluded", "content")).over(w)
    own = F.trim(F.substring_index("content", "\n", 1))
    line = F.trim(F.substring_index(before["content"], "\n", 1))
    takes = (F.col("section_title") == own) & before["retrieval_excluded"] & is_structural_title(line) & ~line.rlike(r"\.{4,}|\s\d+$")
    return chunks.withColumn("repaired_title", F.when(takes, line).otherwise(F.col("section_title")))
