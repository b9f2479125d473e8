"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Words of every contract in this subpackage: runs of anything but these seven characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Rows of ids and numbers, or of sets, that a task is worth.
PART_ROWS = 4000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder that all executors share.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a temporary
    folder takes its place in local mode alone: on a cluster executors would write to disks of their own.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """df in partitions of `part_rows` rows on average if `rows` are read for it, but no fewer than cores; never in more than it has, and without a shuffle.

    A task costs 12 kB of disk for its shuffle files and some more in logs, however few rows it has.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // part_rows)))


def settled(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """A checkpoint of df, packed by its rows, and their number; `most` is a bound of it that is known before."""
    out = checkpoint(df if most is None else packed(df, most))
    rows = packed(out).count()
    return packed(out, rows), rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: inside a lambda a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def map_rows(
    df: DataFrame, columns: list[str], schema: str, rows: Callable[..., list[tuple]], arrow_schema: pa.Schema
) -> DataFrame:
    """Arrow batches of `columns` to batches of `schema`; `rows` gets one list a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(*(column.to_pylist() for column in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, field.type) for values, field in zip(made, arrow_schema)], schema=arrow_schema
            )

    return df.select(*columns).mapInArrow(run, schema)


class BoundedCache(dict):
    """A dict that fills itself through `make` and holds at most about 2 x `limit` keys.

    When the young generation is full it becomes the old one, so keys in use
    survive; keys of more than `longest` characters are not kept.
    """

    def __init__(self, make: Callable, limit: int = 200_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
