"""Helpers of the operators: cut lineage, and counts that decide between a broadcast and a shuffle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tables of up to so many narrow rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`, which driver and executors share; a temporary one in local mode alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='lodestar-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of `spark.checkpoint.dir`; a temporary one takes its place in local mode alone."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def sent(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint where it has `limit` rows or fewer; `df` should be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def folded(rows: DataFrame, order: list[str | Column], fold: Callable[[list[tuple]], list[tuple]], schema: StructType) -> DataFrame:
    """`fold` over the rows of each key, the first column, in `order`.

    A task's keys follow each other in its sorted rows, so small groups share an Arrow batch and
    cost no call of their own; a task holds the rows of one key and of one batch.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*out), arrow)], schema=arrow)
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out.extend(fold(held))
                    held = []
                held.append(row)
            if out:
                yield made(out)
        if held and (out := fold(held)):
            yield made(out)

    key = rows.columns[0]
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
