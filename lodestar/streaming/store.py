"""A table of document versions that takes micro-batches, each in one commit.

Rows lie in buckets by the hash of their path. A batch reads and writes the
buckets it touches and no others: they go to a generation folder of their own, and a
commit record, written last, says which buckets that generation replaces. A bucket's
current rows are those of the last committed generation that holds it. So a write that
fails leaves the table as it was, and a batch delivered again under its
number is known by its record and skipped. One writer at a time.

    root/data/generation=G/bucket=B/*.parquet
    root/commits/G.json        {"stream": ..., "batch": ..., "buckets": [...]}

Batches are (source_path, version_hash, seen_at) and more columns of the table. Of
several sights of a path in one batch the last counts (ties: the greatest hash).
A sight that is older than the active version's last one changes nothing, so late and
repeated rows under new numbers are no-ops too. Null paths and null hashes are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.lifecycle import distinct_on
from lodestar.sources import folders

COLUMNS = "source_path string, version_hash string, is_active boolean, created_at timestamp, last_seen_at timestamp, superseded_at timestamp"


def ingest_batch(documents: DataFrame, batch: DataFrame) -> DataFrame:
    """`documents` after one batch: what changed is superseded, new versions are appended, the rest is touched.

    Times are those of the sights, so the same batch gives the same rows whenever it is applied.
    """
    latest = distinct_on(batch.where("source_path IS NOT NULL AND version_hash IS NOT NULL"), ["source_path"], [F.desc("seen_at"), F.desc("version_hash")])
    seen = latest.select("source_path", F.col("version_hash").alias("_hash"), F.col("seen_at").alias("_seen"))
    active = documents.where("is_active").select("source_path", F.col("version_hash").alias("_active"), F.col("last_seen_at").alias("_last")).distinct()
    known = latest.join(active, "source_path", "left")
    new = known.where("_active IS NULL OR (_active <> version_hash AND seen_at >= _last)")
    times = {"is_active": F.lit(True), "created_at": F.col("seen_at"), "last_seen_at": F.col("seen_at")}
    added = new.withColumns(times).select([c for c in [*new.columns, *times] if c in documents.columns and c not in times] + list(times))

    in_time = F.col("is_active") & (F.col("_seen") >= F.col("last_seen_at"))
    closed, touched = in_time & (F.col("_hash") != F.col("version_hash")), in_time & (F.col("_hash") == F.col("version_hash"))
    kept = documents.join(seen, "source_path", "left").withColumns(
        {
            "is_active": F.col("is_active") & ~F.coalesce(closed, F.lit(False)),
            "superseded_at": F.when(closed, F.col("_seen")).otherwise(F.col("superseded_at")),
            "last_seen_at": F.when(touched, F.col("_seen")).otherwise(F.col("last_seen_at")),
        }
    )
    return kept.select(documents.columns).unionByName(added, allowMissingColumns=True)


@dataclass(frozen=True)
class VersionStore:
    """`columns` is the table's schema, `buckets` is fixed for its life."""

    spark: SparkSession
    root: str
    buckets: int = 256
    columns: str = COLUMNS

    def commits(self) -> list[dict]:
        """Commit records in order, with their `generation`."""
        numbers = sorted(int(name.removesuffix(".json")) for name in folders.names(self.spark, f"{self.root}/commits") if name.endswith(".json"))
        return [{"generation": n, **folders.read_record(self.spark, f"{self.root}/commits/{n}.json")} for n in numbers]

    def bucket(self, path: Column | str = "source_path") -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def current(self, only: list[int] | None = None) -> DataFrame:
        """The table, or the buckets `only`: no other folder is read."""
        places = {b: c["generation"] for c in self.commits() for b in c["buckets"] if only is None or b in only}
        paths = [f"{self.root}/data/generation={g}/bucket={b}" for b, g in sorted(places.items())]
        if not paths:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(*paths)

    def apply(self, batch: DataFrame, stream: str, number: int) -> int | None:
        """Takes batch `number` of `stream`; the new generation, or None where that batch is in the table already."""
        done = self.commits()
        if any(c["stream"] == stream and c["batch"] == number for c in done):
            return None
        generation = done[-1]["generation"] + 1 if done else 0
        batch = batch.persist()
        try:
            touched = sorted(r[0] for r in batch.where("source_path IS NOT NULL AND version_hash IS NOT NULL").select(self.bucket().alias("b")).distinct().collect())  # `buckets` numbers at most
            if touched:
                after = ingest_batch(self.current(touched), batch).withColumn("bucket", self.bucket())
                after.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/generation={generation}")
            folders.write_once(self.spark, f"{self.root}/commits/{generation}.json", {"stream": stream, "batch": number, "buckets": touched})
        finally:
            batch.unpersist()
        return generation

    def vacuum(self) -> int:
        """Removes buckets that later generations replace; how many. No reader may be on an older state."""
        current = {b: c["generation"] for c in self.commits() for b in c["buckets"]}
        old = [(c["generation"], b) for c in self.commits() for b in c["buckets"] if current[b] != c["generation"]]
        for g, b in old:
            folders.remove(self.spark, f"{self.root}/data/generation={g}/bucket={b}")
        return len(old)


def ingest_stream(stream: DataFrame, store: VersionStore, checkpoint: str) -> StreamingQuery:
    """Applies every micro-batch to the store; a new checkpoint is a new stream that goes on with the table as it is."""

    def apply(batch: DataFrame, number: int) -> None:
        # the stream's identity lies in its checkpoint, so that it outlives restarts
        store.apply(batch, folders.read_record(store.spark, f"{checkpoint}/metadata")["id"], number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
