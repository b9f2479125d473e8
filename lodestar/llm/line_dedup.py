"""Line dedup by overlapping windows of three lines (operator 5).

Every document's lines are hashed; a window is three lines in a row. A window
is kept where it occurs first in the corpus, in order of document id and line;
each later occurrence covers its three lines, and covered positions are merged
and removed.

Only hashes and positions are shuffled before the one join that brings removed
positions back to the texts. First occurrences come from a map-side combined
minimum, so a window that fills a third of the corpus costs one row a task.

Defined results: a document with fewer lines than a window has none and stays
as it is; a null text stays null, an empty one empty. A document whose lines
are all covered keeps its row with an empty text. Rows that share a document id
are ordered by the hash of their text; rows equal in both are one document and
treated alike. Null ids sort first. Very long texts count with all their lines; an empty table
gives an empty result. Extra columns stay, except that n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, let


def window_hashes(text: Column, width: int = 3) -> Column:
    """One 64-bit hash for each run of `width` lines; empty where there are fewer lines."""
    none = F.array().cast("array<bigint>")
    return let(
        F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line)),
        lambda hashes: F.when(
            F.size(hashes) >= width,
            F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))),
        ).otherwise(none),
    )


def covered_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(_id, _tie, _covered): line positions, from 0, that later occurrences of a window cover."""
    windows = checkpoint(
        docs.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tie"), F.posexplode(window_hashes(F.col(text_col), width)).alias("_pos", "_hash"))
    )
    first = (
        windows.groupBy("_hash")
        .agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_tie", "_pos")).alias("_first"))
        .where("_n > 1")
    )
    later = windows.join(first, "_hash").where(~F.struct("_id", "_tie", "_pos").eqNullSafe(F.col("_first")))
    return (
        later.select("_id", "_tie", F.explode(F.sequence("_pos", F.col("_pos") + (width - 1))).alias("_line"))
        .groupBy("_id", "_tie")
        .agg(F.collect_set("_line").alias("_covered"))
    )


def dedupe_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """The documents with covered lines removed, plus n_lines and n_removed."""
    covered = covered_lines(docs, text_col, id_col, width)
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    whole = docs.select(
        F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"), F.struct(*others).alias("_others")
    )
    joined = whole.join(covered, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tie")), "left")
    kept = let(
        F.split("_text", "\n"),
        lambda lines: F.concat_ws(
            "\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_covered")), lambda i: F.get(lines, i))
        ),
    )
    return joined.select(
        *[F.col("_others")[c].alias(c) for c in others],
        F.when(F.col("_covered").isNull(), F.col("_text")).otherwise(kept).alias(text_col),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(F.split("_text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("_covered").isNull(), 0).otherwise(F.size("_covered")).cast("long").alias("n_removed"),
    )
