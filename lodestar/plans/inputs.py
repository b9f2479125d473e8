"""The engine's tables as derived from the star-schema and text tables, and the same as SQL.

`versions` is a document history from `orders`, `hits` are scored candidates from
`lineitem`, `sections` and `chunks` are lines of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T


#: White space that `functions.text.strip` cuts, for DuckDB's trim.
WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in one file is read by few tasks, so its rows are dealt out first; tables of many files stay as they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


#: Read by both engines.
VERSIONS = """
SELECT o_orderkey AS id, concat('docs/', o_custkey) AS source_path,
  CASE o_custkey % 4 WHEN 0 THEN concat('LOP-AB ', o_custkey, '.pdf') WHEN 1 THEN concat('Site manual ', o_custkey, ' v2.docx')
    ELSE concat('Notes ', o_custkey) END AS title,
  concat('folder', o_custkey % 7) AS folder,
  CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'txt' ELSE 'xlsx' END AS source_type,
  md5(concat(o_orderkey, o_orderpriority)) AS version_hash, o_orderstatus = 'O' AS is_active,
  o_orderdate AS created_at, o_orderdate AS updated_at, o_orderdate AS last_seen_at, CAST(NULL AS TIMESTAMP) AS superseded_at,
  o_orderkey % 41 AS chunk_count, CAST(floor((o_orderkey % 41) * (o_custkey % 10) / 10) AS BIGINT) AS excluded_chunk_count,
  o_orderkey % 3 AS heading_chunk_count, o_orderkey % 23 AS table_chunk_count, o_orderkey % 5 AS appendix_chunk_count, o_orderkey % 7 AS list_chunk_count,
  CASE o_orderkey % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'partial' WHEN 2 THEN 'partial' WHEN 3 THEN 'poor' ELSE NULL END AS text_quality_tier,
  (o_orderkey % 100) / 100.0E0 AS text_quality_score, o_custkey % 3 = 0 AS ocr_used,
  CASE WHEN o_custkey % 3 = 0 THEN 'ocr' WHEN o_custkey % 3 = 1 THEN 'native_pdf' ELSE 'other' END AS extraction_method,
  CASE o_orderkey % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS extraction_status,
  o_orderkey % 11 = 0 AS needs_review, o_orderkey % 29 = 0 AS quarantined, o_orderkey % 31 = 0 AS source_missing
FROM orders
"""

HITS = """
SELECT l_orderkey AS query_id, l_partkey AS chunk_id, l_suppkey AS document_id, max(CAST(l_extendedprice AS DOUBLE)) AS score,
  max(CAST(l_quantity AS DOUBLE)) AS fts, max(CAST(l_discount AS DOUBLE)) AS trg
FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VERSIONS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HITS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines: tables hold a bar, lists start with a mark, lines of up to three words are headings."""
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    content = F.trim("content")
    kind = F.when(content.contains("|"), "table").when(content.rlike(r"^[-*•]"), "list").when(T.token_count(content) <= 3, "heading").otherwise("paragraph")
    return lines.where(content != "").select("doc_id", "source", F.col("pos").cast("long").alias("pos"), content.alias("content"), kind.alias("type"), F.lit(None).cast("string").alias("title"), (1 + F.pmod("pos", F.lit(3))).cast("int").alias("level"))


SECTIONS = r"""
SELECT doc_id, source, pos, trim(content) AS content,
  CASE WHEN contains(content, '|') THEN 'table' WHEN regexp_matches(trim(content), '^[-*•]') THEN 'list'
    WHEN len(regexp_extract_all(content, '\S+')) <= 3 THEN 'heading' ELSE 'paragraph' END AS type,
  NULL::VARCHAR AS title, (1 + pos % 3)::INT AS level
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)
WHERE trim(content) <> ''
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections(spark, sf_dir)
    pos = F.col("pos")
    return s.select(
        (F.col("doc_id") * 100000 + pos).alias("chunk_id"), F.col("doc_id").alias("document_id"), "content", pos.alias("chunk_index"), F.sha2("content", 256).alias("chunk_hash"),
        T.token_count(F.col("content")).alias("token_count"), F.floor(pos / 3).alias("page_number"), F.when(pos % 3 == 1, F.substring("content", 1, 40)).alias("section_title"),
        F.when(F.col("type") == "list", "note").otherwise(F.when(pos % 9 == 4, "appendix").otherwise(F.col("type"))).alias("section_type"),
        (pos % 5 == 2).alias("retrieval_excluded"), (pos % 7 == 3).alias("is_boilerplate"), (pos % 6 == 5).alias("retrieval_downranked"),
        F.when(pos % 5 == 2, F.when(pos % 4 == 0, "embedded").otherwise("excluded")).otherwise("embedded").alias("embedding_status"),
        F.concat(F.lit("doc "), "doc_id", F.lit(", part "), pos).alias("citation_label"), F.concat(F.lit("Title "), F.col("doc_id") % 40).alias("doc_title"),
        F.concat(F.lit("folder"), F.col("doc_id") % 7).alias("folder"), F.when(F.col("doc_id") % 6 == 0, "xlsx").otherwise("pdf").alias("source_type"),
    )


CHUNKS = rf"""
SELECT doc_id * 100000 + pos AS chunk_id, doc_id AS document_id, content, pos AS chunk_index, sha256(content) AS chunk_hash,
  len(regexp_extract_all(content, '\S+')) AS token_count, floor(pos / 3)::BIGINT AS page_number,
  CASE WHEN pos % 3 = 1 THEN substr(content, 1, 40) END AS section_title,
  CASE WHEN type = 'list' THEN 'note' WHEN pos % 9 = 4 THEN 'appendix' ELSE type END AS section_type,
  pos % 5 = 2 AS retrieval_excluded, pos % 7 = 3 AS is_boilerplate, pos % 6 = 5 AS retrieval_downranked,
  CASE WHEN pos % 5 = 2 AND pos % 4 <> 0 THEN 'excluded' ELSE 'embedded' END AS embedding_status,
  'doc ' || doc_id || ', part ' || pos AS citation_label, 'Title ' || (doc_id % 40) AS doc_title,
  'folder' || (doc_id % 7) AS folder, CASE WHEN doc_id % 6 = 0 THEN 'xlsx' ELSE 'pdf' END AS source_type
FROM ({SECTIONS})
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts and user turns."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((1000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return bench.unionByName(turns)


QUESTIONS = """
SELECT item_id AS query_id, text AS question FROM benchmark
UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'
"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
