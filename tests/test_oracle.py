"""Every registered query that has a SQL twin, on the smallest tables, against DuckDB."""

import duckdb
import pytest

from lodestar.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def cell(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted([cell(r[k]) for k in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = oracle.sql(catalog.oracle_sql()[name])
    rows = df.collect()
    assert rows
    assert table([tuple(r) for r in rows], df.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_names_match():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
