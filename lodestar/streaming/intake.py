"""File intake with Structured Streaming; the version store and running counts are modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.corpus import HIDDEN, SUPPORTED

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def intake_stream(spark: SparkSession, directory: str, most_bytes: int = 100 * 1024 * 1024, types: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """New files of the given types up to `most_bytes`: path, extension, bytes, version_hash."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(directory)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (
        files.where(F.col("length") <= most_bytes)
        .withColumn("extension", extension)
        .where(F.col("extension").isin(*types) & ~F.regexp_extract("path", r"[^/]+$", 0).rlike(HIDDEN))
        .select("path", "extension", F.col("length").alias("bytes"), F.sha2("content", 256).alias("version_hash"), "modificationTime")
    )
