"""Running counts of recurring blocks: keyed state in update mode, and an upsert log that is compacted by key.

The state holds a row a (hash, period). Without `ttl` there is one period, and the state keeps every
hash for good, as the counts are defined. With `ttl` a period is that long,
and once the watermark has passed a period's end by `ttl` its state is dropped; its last
row is in the log by then, so totals lose nothing but rows that come later than
that. Each micro-batch writes the rows that changed and no others, to a
folder named by its number: a batch delivered again overwrites its own folder.

`counts` reads the last row of each (hash, period) and sums them to one row a hash;
`compact` replaces the batches so far by those last rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.text import boilerplate_hash
from lodestar.sources import folders

LOG = "boilerplate_hash string, period timestamp, occurrence_count long, last_seen_at timestamp, number long"


def running_counts(sections: DataFrame, ttl: str | None = None, time_col: str = "ts") -> DataFrame:
    """boilerplate_hash, period, occurrence_count, last_seen_at of a stream of `content` and `time_col`."""
    hashed = sections.withColumn("boilerplate_hash", boilerplate_hash(F.col("content")))
    if ttl:
        hashed = hashed.withWatermark(time_col, ttl)
        period = F.window(time_col, ttl)
        counted = hashed.groupBy("boilerplate_hash", period.alias("w")).agg(F.count("*").alias("occurrence_count"), F.max(time_col).alias("last_seen_at"))
        return counted.select("boilerplate_hash", F.col("w.start").alias("period"), "occurrence_count", "last_seen_at")
    counted = hashed.groupBy("boilerplate_hash").agg(F.count("*").alias("occurrence_count"), F.max(time_col).alias("last_seen_at"))
    return counted.select("boilerplate_hash", F.lit(None).cast("timestamp").alias("period"), "occurrence_count", "last_seen_at")


def start(sections: DataFrame, root: str, ttl: str | None = None, time_col: str = "ts") -> StreamingQuery:
    """Runs until all that is there is read; state and log lie in `root`, a folder that driver and executors share."""

    def log(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/log/batch={number}")

    return (
        running_counts(sections, ttl, time_col).writeStream.outputMode("update").foreachBatch(log)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last micro-batch."""
    return sum(op["numRowsTotal"] for op in (query.lastProgress or {}).get("stateOperators", []))


def _last(spark: SparkSession, root: str) -> tuple[DataFrame, int, list[str]]:
    """The last row of each (hash, period), the greatest batch number that is in it, and the folders that hold it."""
    base = max((int(n.removesuffix(".json")) for n in folders.names(spark, f"{root}/compacted") if n.endswith(".json")), default=-1)
    batches = sorted(int(n.removeprefix("batch=")) for n in folders.names(spark, f"{root}/log") if n.startswith("batch="))
    paths = [f"{root}/log/batch={n}" for n in batches if n > base and folders.exists(spark, f"{root}/log/batch={n}/_SUCCESS")]
    top = max([base, *(int(p.rpartition("=")[2]) for p in paths)])
    if base >= 0:
        paths.insert(0, f"{root}/compacted/{base}")
    rows = spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)
    newest = F.max(F.struct("number", "occurrence_count", "last_seen_at")).alias("r")
    return rows.groupBy("boilerplate_hash", "period").agg(newest).select("boilerplate_hash", "period", "r.occurrence_count", "r.last_seen_at", "r.number"), top, paths


def counts(spark: SparkSession, root: str) -> DataFrame:
    """boilerplate_hash, occurrence_count, last_seen_at: one row a hash."""
    rows, _, _ = _last(spark, root)
    return rows.groupBy("boilerplate_hash").agg(F.sum("occurrence_count").alias("occurrence_count"), F.max("last_seen_at").alias("last_seen_at"))


def compact(spark: SparkSession, root: str) -> int:
    """Puts one folder of last rows in the place of the log so far; how many folders went. No batch may run meanwhile."""
    rows, top, paths = _last(spark, root)
    if len(paths) < 2:
        return 0
    rows.write.mode("overwrite").parquet(f"{root}/compacted/{top}")
    folders.write_once(spark, f"{root}/compacted/{top}.json", {"upto": top})
    for path in paths:  # readers take the new folder from here on
        folders.remove(spark, path)
    return len(paths)
