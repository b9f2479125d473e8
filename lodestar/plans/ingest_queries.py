"""Queries that go through stores, sinks and streams in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import embedding
from lodestar.operators.shared import shared_folder
from lodestar.plans.inputs import CHUNKS, VERSIONS, chunks, table, versions
from lodestar.sources import corpus
from lodestar.streaming import fingerprints
from lodestar.streaming.intake import intake_stream
from lodestar.streaming.store import VersionStore, ingest_stream

#: Buckets of the replayed store, a parameter of its size.
BUCKETS = 64


def parts_of(rows: DataFrame, by: Column) -> list[DataFrame]:
    """The rows in the order of `by`, which has a few values: what arrives one after the other."""
    values = [r[0] for r in rows.select(by.alias("v")).distinct().orderBy("v").collect()]
    return [rows.where(by.eqNullSafe(F.lit(v))) for v in values]


def replayed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sights of paths, streamed into a version store in three batches with restarts between; the second is delivered twice."""
    root = shared_folder(spark, "versions")
    sights = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("docs/"), "o_custkey").alias("source_path"), F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("version_hash"), F.col("o_orderdate").cast("timestamp").alias("seen_at")
    )
    store, feed = VersionStore(spark, f"{root}/table", BUCKETS), f"{root}/feed"
    arrivals = parts_of(sights, F.floor(F.year("seen_at") / 3))
    for part in [*arrivals, *arrivals[1:2]]:
        part.write.mode("append").parquet(feed)
        ingest_stream(spark.readStream.schema(sights.schema).parquet(feed), store, f"{root}/state").awaitTermination()
    return store.current()


REPLAYED = """
WITH s AS (SELECT concat('docs/', o_custkey) AS source_path, md5(o_orderstatus || o_orderpriority) AS version_hash, o_orderdate AS seen_at, floor(year(o_orderdate) / 3) AS arrival FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path, arrival ORDER BY seen_at DESC, version_hash DESC) AS k FROM s) WHERE k = 1),
c AS (SELECT *, coalesce(lag(version_hash) OVER w <> version_hash, true) AS begins FROM l WINDOW w AS (PARTITION BY source_path ORDER BY arrival)),
v AS (SELECT *, sum(begins::INT) OVER (PARTITION BY source_path ORDER BY arrival) AS version FROM c),
g AS (SELECT source_path, version, min(version_hash) AS version_hash, min(seen_at) AS created_at, max(seen_at) AS last_seen_at FROM v GROUP BY 1, 2)
SELECT source_path, version_hash, lead(created_at) OVER w IS NULL AS is_active, created_at, last_seen_at, lead(created_at) OVER w AS superseded_at FROM g WINDOW w AS (PARTITION BY source_path ORDER BY version)
"""


def _streamed(spark: SparkSession, sf_dir: str, ttl: str | None) -> DataFrame:
    root = shared_folder(spark, "fingerprints")
    blocks = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("content"))
    for k, part in enumerate(parts_of(blocks, F.floor(F.dayofmonth("ts") / 11))):
        part.write.mode("append").parquet(f"{root}/feed")
        fingerprints.start(spark.readStream.schema(blocks.schema).parquet(f"{root}/feed"), root, ttl).awaitTermination()
        if k == 1:
            fingerprints.compact(spark, root)
    return fingerprints.counts(spark, root)


def streamed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the event stream's blocks by keyed state, over restarts and a compaction of the log."""
    return _streamed(spark, sf_dir, None)


def expiring_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts with state that is dropped once its week lies a week behind."""
    return _streamed(spark, sf_dir, "7 days")


FINGERPRINTS = "SELECT sha256(trim(lower(event_type || ' ' || user_id))) AS boilerplate_hash, count(*) AS occurrence_count, max(ts) AS last_seen_at FROM events GROUP BY 1"

def processed_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of two shapes, written a folder of documents at a time and read back as one set of paths."""
    root = shared_folder(spark, "artifacts")
    docs = versions(spark, sf_dir).where("is_active").select("folder", F.struct("id", "source_path", F.struct("chunk_count").alias("counts")).alias("d"))
    for key, rest in (("selected", 0), ("documents", 1)):
        part = docs.where(F.substring("folder", 7, 1).cast("int") % 2 == rest).groupBy("folder").agg(F.collect_list("d").alias(key))
        corpus.write_report(part, f"{root}/{key}")
    return corpus.processed_paths(spark, [f"{root}/selected", f"{root}/documents"], whole=False)


def golden_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a question set, written and read back through the typed path."""
    root = shared_folder(spark, "questions")
    made = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("lookup").alias("category"), F.array(F.concat(F.lit("doc "), "item_id"), F.lit("any")).alias("expected_docs"))
    corpus.write_report(made, root)
    return corpus.read_queries(spark, root, whole=False).withColumn("expected_docs", F.array_join("expected_docs", "|"))


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the tables: path, bytes and content hash; the listing filters names, lengths decide what is read."""
    return corpus.corpus_scan(spark, sf_dir, pattern="*.parquet").drop("modified_at")


def arriving_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream, ended when all are seen."""
    root = shared_folder(spark, "arrivals")
    files = intake_stream(spark, sf_dir, types=("parquet",))
    files.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(files.schema).parquet(f"{root}/out").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "extension", "bytes", "version_hash")


def rebuilt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table written with its rules asserted, one document in seven dropped, and rebuilt in its place."""
    path = shared_folder(spark, "chunks")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    corpus.write_chunks(chunks(spark, sf_dir).drop("embedding_status"), path, docs)
    left = corpus.drop_document(spark.read.parquet(path), docs.where("id % 7 = 0"))
    rebuilt = corpus.rebuild(left.drop("embedding_status"), path, docs)
    return rebuilt.groupBy("document_id", "embedding_status").agg(F.count("*").alias("n"), F.sum("chunk_index").alias("places"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the stand-in model's vectors that isn't zero."""
    made = embedding.embed(chunks(spark, sf_dir).select("chunk_id", "content", "retrieval_excluded"))
    places = made.select("chunk_id", "embedding_error", F.posexplode_outer("embedding").alias("place", "x"))
    return places.where("x IS NULL OR x <> 0").select("chunk_id", "embedding_error", "place", F.round(F.col("x").cast("double"), 5).alias("x"))


VECTORS = rf"""
WITH c AS (SELECT chunk_id, content, retrieval_excluded FROM ({CHUNKS})),
w AS (SELECT chunk_id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM (SELECT chunk_id, unnest(regexp_split_to_array(lower(content), '[ \t\n\r\f\v]+')) AS word FROM c WHERE NOT retrieval_excluded) WHERE word <> ''),
p AS (SELECT chunk_id, (h % 64)::INT AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2),
n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY chunk_id)) AS norm FROM p)
SELECT chunk_id, NULL::VARCHAR AS embedding_error, place, round((v / norm)::FLOAT::DOUBLE, 5) AS x FROM n WHERE v <> 0 UNION ALL SELECT chunk_id, NULL, NULL, NULL FROM c WHERE retrieval_excluded
"""

QUERIES = {
    "replayed_versions": (replayed_versions, REPLAYED),
    "streamed_fingerprints": (streamed_fingerprints, FINGERPRINTS),
    "expiring_fingerprints": (expiring_fingerprints, FINGERPRINTS),
    "processed_artifacts": (processed_artifacts, f"SELECT DISTINCT source_path FROM ({VERSIONS}) WHERE is_active"),
    "golden_questions": (golden_questions, "SELECT item_id AS query_id, text AS question, 'lookup' AS category, 'doc ' || item_id || '|any' AS expected_docs, NULL::VARCHAR AS expected_behaviour, NULL::VARCHAR AS bad_record FROM benchmark"),
    "table_files": (table_files, None),
    "arriving_files": (arriving_files, None),
    "rebuilt_chunks": (rebuilt_chunks, f"SELECT document_id, CASE WHEN retrieval_excluded THEN 'excluded' ELSE 'embedded' END AS embedding_status, count(*) AS n, sum(chunk_index)::BIGINT AS places FROM ({CHUNKS}) WHERE document_id % 7 <> 0 GROUP BY 1, 2"),
    "chunk_vectors": (chunk_vectors, VECTORS),
}
