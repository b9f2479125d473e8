"""File scans, tables, sinks and streams on temporary folders."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.sources import corpus
from lodestar.streaming import intake


def test_scan_routes_and_hides(spark, tmp_path):
    for name in ("a.PDF", "sub/b.txt", "sub/~$lock.docx", ".hidden/c.txt", "d.exe"):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    scan = corpus.corpus_scan(spark, str(tmp_path / "root"))
    rows = {r.source_path: r for r in corpus.route_types(scan).collect()}
    assert set(rows) == {"a.PDF", "sub/b.txt", "d.exe"}
    assert rows["a.PDF"].folder == "root" and rows["sub/b.txt"].folder == "sub" and rows["a.PDF"].supported and not rows["d.exe"].supported
    both = corpus.union_roots({"x": scan, "y": scan})
    assert both.where("source_path = 'y/sub/b.txt'").count() == 1
    stream = intake.intake_stream(spark, str(tmp_path / "root"))
    out = tmp_path / "out"
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.extension for r in spark.read.parquet(str(out)).collect()) == ["pdf", "txt"]


def test_html_blocks(spark):
    html = "<h1>Top</h1><p>one<br>two &amp; three</p><h2>Sub</h2><ol><li>a</li><li> </li><li>b</li></ol><script>'<p>x</p>'</script><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><h1>Next</h1><ul><li>z</li></ul>"
    rows = corpus.html_sections(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r.type, r.content, r.title) for r in rows] == [
        ("heading", "Top", "Top"), ("paragraph", "one\ntwo & three", "Top"), ("heading", "Sub", "Top > Sub"), ("list", "1. a\n2. b", "Top > Sub"), ("table", "k | v\n---\n1 | 2", "Top > Sub"), ("heading", "Next", "Next"), ("list", "- z", "Next"),
    ]


def test_table_groups_and_ranges(spark):
    rows = [(1, "S", 1, ["h", "i"]), (1, "S", 2, ["1", "2"]), (1, "S", 3, [" ", None]), (1, "S", 4, ["", ""]), (1, "S", 5, ["x", "y"]), (1, "T", 2, ["only"])]
    df = spark.createDataFrame(rows, "doc_id long, sheet string, row int, cells array<string>")
    out = corpus.render_table_groups(corpus.table_groups(df)).orderBy("sheet", "table_no").collect()
    assert [(r.table_no, r.range_ref, r.title) for r in out] == [(1, "A1:B2", "S — Table 1"), (2, "A5:B5", "S — Table 2"), (1, "A2:A2", "T")]
    assert out[0].content == "Sheet: S\nColumns: h | i\n---\n1 | 2"
    letters = spark.createDataFrame([(1,), (26,), (27,), (52,), (702,), (703,), (18278,), (18279,)], "n int").select(corpus.column_letter(F.col("n")).alias("c")).collect()
    assert [r.c for r in letters] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ", "AAAA"]


def test_chunk_sink_keeps_excluded_unembedded(spark, tmp_path):
    df = spark.createDataFrame([(1, False, [1.0]), (2, True, [1.0])], "chunk_id long, retrieval_excluded boolean, embedding array<float>")
    corpus.write_chunks(df, str(tmp_path / "c"))
    back = {r.chunk_id: r for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert back[1].embedding_status == "embedded" and back[2].embedding is None


@pytest.mark.parametrize(
    ("row", "told"),
    [((None, False, 1), "without id"), ((9, None, 1), "without id or flag"), ((9, False, 2), "unknown document"), ((9, True, 1), "was embedded")],
)
def test_chunk_sink_asserts_its_rules_and_keeps_the_old_table(spark, tmp_path, row, told):
    path, docs = str(tmp_path / "c"), spark.createDataFrame([(1,)], "id long")
    made = lambda rows: spark.createDataFrame([(*r, "embedded" if not r[1] or r[0] == 9 else "excluded") for r in rows], "chunk_id long, retrieval_excluded boolean, document_id long, embedding_status string")
    good = [(1, False, 1), (2, True, 1)]
    corpus.rebuild(made(good), path, docs)
    with pytest.raises(Exception, match=told):
        corpus.rebuild(made([*good, row]), path, docs)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == [1, 2]
    back = corpus.rebuild(corpus.drop_document(spark.read.parquet(path).where("chunk_id = 1"), spark.createDataFrame([(7,)], "id long")), path, docs)
    assert [r.chunk_id for r in back.collect()] == [1] and not (tmp_path / "c.old").exists() and not (tmp_path / "c.new").exists()


def test_a_rebuild_that_died_between_renames_is_mended(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([(1, False)], "chunk_id long, retrieval_excluded boolean")
    corpus.write_chunks(rows, path + ".old")
    corpus.write_chunks(rows, path + ".new")
    with pytest.raises(Exception, match="lost"):
        corpus.rebuild(rows.withColumn("chunk_id", F.raise_error(F.lit("lost")).cast("long")), path)
    assert spark.read.parquet(path).count() == 1


def test_tables_of_many_rows_stay_whole(spark):
    html = "<table>" + "".join(f"<tr><td>{k}</td></tr>" for k in range(3000)) + "</table><table><tr><td>one</td></tr></table>"
    rows = corpus.html_sections(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [r.content.count("\n") for r in rows] == [3000, 1] and rows[0].content.endswith("\n2999")


def test_selection_files_of_two_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"selected": [{"source_path": "x", "n": {"deep": [1]}}, {"source_path": "y"}, 7, None]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"documents": [{"source_path": "y"}, {"other": 1}], "selected": "none"}))
    (tmp_path / "c.json").write_text('{"documents": [{"source_path": "z"')
    (tmp_path / "d.json").write_text("[1, 2]")
    got = corpus.processed_paths(spark, str(tmp_path))
    assert sorted(r.source_path for r in got.collect()) == ["x", "y"]
    bad = corpus.read_artifacts(spark, str(tmp_path)).where("bad_record IS NOT NULL").collect()
    assert [r.file.rpartition("/")[2] for r in bad] == ["c.json"] and bad[0].bad_record.endswith('"z"')


def test_question_sets_keep_what_is_no_question(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query_id": 1, "question": "one?", "expected_docs": ["a", "b"], "more": {}}, {"query_id": "two"}]))
    (tmp_path / "b.json").write_text(json.dumps({"queries": [{"query_id": 3, "question": "three?", "category": "c"}]}))
    (tmp_path / "c.json").write_text("not json")
    rows = sorted(corpus.read_queries(spark, str(tmp_path)).collect(), key=lambda r: (r.query_id is None, r.query_id or 0, r.bad_record or ""))
    assert [(r.query_id, r.question, r.category, r.expected_docs, r.bad_record) for r in rows] == [
        (1, "one?", None, ["a", "b"], None), (3, "three?", "c", None, None), (None, None, None, None, "not json"), (None, None, None, None, '{"query_id":"two"}'),
    ]


def test_scan_reads_no_file_beyond_the_bound(spark, tmp_path):
    (tmp_path / "root").mkdir()
    for name, size in (("a.txt", 3), ("b.txt", 30), ("c.csv", 2)):
        (tmp_path / "root" / name).write_text("x" * size)
    rows = {r.source_path: r for r in corpus.corpus_scan(spark, str(tmp_path / "root"), most_bytes=10, pattern="*.txt").collect()}
    assert set(rows) == {"a.txt", "b.txt"} and rows["b.txt"].version_hash is None and rows["b.txt"].bytes == 30
    assert rows["a.txt"].version_hash == hashlib.sha256(b"xxx").hexdigest()


def test_files_of_the_tables(spark, sf_dir):
    from lodestar.plans import ingest_queries

    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(sf_dir).glob("*.parquet")}
    assert {r.source_path: (r.bytes, r.version_hash) for r in ingest_queries.table_files(spark, sf_dir).collect()} == want
    assert {r.name: (r.bytes, r.version_hash) for r in ingest_queries.arriving_files(spark, sf_dir).collect()} == want


def test_line_cleaning(spark):
    lines = spark.createDataFrame([("13 . 2 . 1  Codes",), ("Page 3 of 9",), (" 42 ",), ("body CONTROLLED COPY IF THIS LINE IS GREEN text",)], "line string")
    assert [r.line for r in corpus.clean_lines(lines).collect()] == ["13.2.1 Codes", "body text"]
