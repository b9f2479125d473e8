"""Registered queries and their SQL twins, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import analysis_queries, audit_queries, corpus_queries, detail_queries, health_queries, ingest_queries, intent_queries, operator_queries, report_queries, rollout_queries, search_queries

AREAS = (corpus_queries, health_queries, search_queries, analysis_queries, operator_queries, ingest_queries, audit_queries, report_queries, rollout_queries, intent_queries, detail_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for area in AREAS for name, (q, _) in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, (_, sql) in area.QUERIES.items() if sql}
