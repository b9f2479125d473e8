"""Queries over documents with empty, blank and null texts, against their SQL."""

import duckdb
import pytest

from lodestar.plans import catalog
from tests.test_oracle import table

TEXTS = ["", None, " ", "\n", "a b\n\nc", "\n\n\n\nx", "a\n \n | \nb\nc | d", "test codes are here\nand a line of words", "\n\n\n\n\n"]


@pytest.mark.parametrize("name", ["evidence_misses", "sheet_tables"])
def test_query_equals_its_sql_on_odd_texts(spark, tmp_path, name):
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate((t, lang) for t in TEXTS for lang in ("en", "de"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, want = catalog.queries()[name](spark, str(tmp_path)), db.sql(catalog.oracle_sql()[name])
    got = df.collect()
    assert got and table([tuple(r) for r in got], df.columns) == table(want.fetchall(), want.columns)
