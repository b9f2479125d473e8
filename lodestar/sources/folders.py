"""Folders of any file system that Spark reaches: renames, removals and small marker files."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _system(spark, path)
    return system.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    system, place = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, place = _system(spark, old)
    if not system.rename(place, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} can't be renamed to {new}")


def write_once(spark: SparkSession, path: str, record: dict) -> None:
    """A small JSON file that appears whole or not at all; fails if it is there already."""
    system, place = _system(spark, path)
    if system.exists(place):
        raise FileExistsError(path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    if not system.rename(draft, place):
        raise FileExistsError(path)


def read_record(spark: SparkSession, path: str) -> dict:
    system, place = _system(spark, path)
    stream = system.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
