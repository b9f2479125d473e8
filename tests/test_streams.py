"""The version store and the running counts: batches, restarts, failures and repeats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.operators import lifecycle
from lodestar.sources import folders
from lodestar.streaming import fingerprints
from lodestar.streaming.store import COLUMNS, VersionStore, ingest_batch, ingest_stream

SIGHT = "source_path string, version_hash string, seen_at timestamp"


def day(k):
    return dt.datetime(2024, 1, k)


def sights(spark, *rows):
    return spark.createDataFrame([(p, h, day(k)) for p, h, k in rows], SIGHT)


def state(df):
    return sorted((r.source_path, r.version_hash, r.is_active, r.created_at.day, r.last_seen_at.day, r.superseded_at and r.superseded_at.day) for r in df.collect())


def test_version_life(spark):
    empty = spark.createDataFrame([], COLUMNS)
    first = ingest_batch(empty, sights(spark, ("a", "1", 1), ("b", "1", 1), (None, "1", 1), ("c", None, 1)))
    again = ingest_batch(first, sights(spark, ("a", "1", 2), ("b", "1", 1)))
    assert state(again) == [("a", "1", True, 1, 2, None), ("b", "1", True, 1, 1, None)]
    changed = ingest_batch(again, sights(spark, ("a", "2", 3), ("a", "3", 4), ("a", "3", 4)))
    assert state(changed) == [("a", "1", False, 1, 2, 4), ("a", "3", True, 4, 4, None), ("b", "1", True, 1, 1, None)]
    late = ingest_batch(changed, sights(spark, ("a", "1", 2), ("a", "9", 3)))
    assert state(late) == state(changed)
    assert lifecycle.uniqueness_violations(changed, ["source_path"], F.col("is_active")).count() == 0


def test_store_reads_and_writes_touched_buckets_only(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "t"), buckets=16)
    many = sights(spark, *((f"p{k}", "1", 1) for k in range(60)))
    assert store.apply(many, "s", 0) == 0 and store.current().count() == 60
    one = sights(spark, ("p7", "2", 2))
    bucket = one.select(store.bucket()).first()[0]
    assert store.apply(one, "s", 1) == 1
    assert store.commits()[1]["buckets"] == [bucket]
    assert folders.names(spark, f"{store.root}/data/generation=1") == ["_SUCCESS", f"bucket={bucket}"]
    files = store.current([bucket]).inputFiles()
    assert files and all(f"bucket={bucket}/" in f and "generation=1/" in f for f in files)
    assert store.current().count() == 61 and store.vacuum() == 1 and store.current().count() == 61
    assert store.apply(one, "s", 1) is None and store.apply(spark.createDataFrame([], SIGHT), "s", 2) == 2
    assert store.current().count() == 61


def test_failed_write_leaves_the_table_and_is_taken_up_again(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "t"), buckets=4)
    store.apply(sights(spark, ("a", "1", 1)), "s", 0)
    bad = sights(spark, ("a", "2", 2), ("b", "1", 2)).withColumn("version_hash", F.when(F.col("source_path") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("version_hash")))
    with pytest.raises(Exception, match="lost"):
        store.apply(bad, "s", 1)
    # what a writer leaves that dies before its commit
    sights(spark, ("junk", "1", 9)).write.parquet(f"{store.root}/data/generation=1/bucket=0")
    assert state(store.current()) == [("a", "1", True, 1, 1, None)]
    assert store.apply(sights(spark, ("a", "2", 2), ("b", "1", 2)), "s", 1) == 1
    assert state(store.current()) == [("a", "1", False, 1, 1, 2), ("a", "2", True, 2, 2, None), ("b", "1", True, 2, 2, None)]


def test_streams_restart_and_new_checkpoints_go_on(spark, tmp_path):
    store, feed = VersionStore(spark, str(tmp_path / "t"), buckets=4), str(tmp_path / "feed")
    for k, rows in enumerate(([("a", "1", 1)], [("a", "2", 2), ("b", "1", 2)], [("a", "1", 1)])):
        sights(spark, *rows).coalesce(1).write.mode("append").parquet(feed)
        ingest_stream(spark.readStream.schema(SIGHT).parquet(feed), store, str(tmp_path / "cp")).awaitTermination()
    want = [("a", "1", False, 1, 1, 2), ("a", "2", True, 2, 2, None), ("b", "1", True, 2, 2, None)]
    assert state(store.current()) == want and len(store.commits()) == 3
    ingest_stream(spark.readStream.schema(SIGHT).parquet(feed), store, str(tmp_path / "cp2")).awaitTermination()
    assert state(store.current()) == want and {c["batch"] for c in store.commits()} == {0, 1, 2} and len(store.commits()) == 4


@pytest.mark.parametrize(("ttl", "left"), [(None, 5), ("1 day", 3)])
def test_running_counts_over_restarts_and_compaction(spark, tmp_path, ttl, left):
    root, feed = str(tmp_path / "r"), str(tmp_path / "feed")
    rows = [[("x", 1), ("x", 1), ("y", 1)], [("x", 2), ("z", 9)], [("w", 20), ("z", 20), (None, 20)]]
    total: dict = {}
    for k, part in enumerate(rows):
        spark.createDataFrame([(c, day(d)) for c, d in part], "content string, ts timestamp").coalesce(1).write.mode("append").parquet(feed)
        query = fingerprints.start(spark.readStream.schema("content string, ts timestamp").parquet(feed), root, ttl)
        query.awaitTermination()
        for c, d in part:
            n, last = total.get(c, (0, 0))
            total[c] = (n + 1, max(last, d))
        got = sorted((r.occurrence_count, r.last_seen_at.day) for r in fingerprints.counts(spark, root).collect())
        assert got == sorted(total.values())
        if k:
            assert fingerprints.compact(spark, root) > 1
            assert got == sorted((r.occurrence_count, r.last_seen_at.day) for r in fingerprints.counts(spark, root).collect())
    assert fingerprints.compact(spark, root) == 0
    # with a ttl the early periods are gone from the state; without, every hash stays
    assert fingerprints.state_rows(query) == left
