"""Sources and sinks: file scans, page and table splitting, chunk tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.sources import folders

SUPPORTED = ("pdf", "docx", "txt", "xlsx", "csv", "png", "jpg", "jpeg")
#: Skipped at any level of a path: hidden names and editors' lock files.
HIDDEN = r"(^|/)(\.|~\$)"


def corpus_scan(spark: SparkSession, root: str, with_hash: bool = True, most_bytes: int = 100 * 1024 * 1024, pattern: str = "*") -> DataFrame:
    """source_path, folder, extension, bytes, modified_at (and version_hash) of every file below `root`.

    `pattern` filters names in the listing. Without the hash the content column is pruned, so files aren't
    read; with it, files of more than `most_bytes` aren't either, and have a null hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    if with_hash:  # the bound on lengths reaches the reader, which opens no file beyond it
        large = files.where(F.col("length") > most_bytes).drop("content").withColumn("content", F.lit(None).cast("binary"))
        files = files.where(F.col("length") <= most_bytes).unionByName(large)
    base = root.rstrip("/").rpartition("/")[2]
    relative = F.regexp_replace("path", rf"^.*?/{base}/", "")
    out = files.withColumn("source_path", relative).where(~F.col("source_path").rlike(HIDDEN))
    cols = [
        F.col("source_path"),
        F.when(F.col("source_path").contains("/"), F.substring_index("source_path", "/", 1)).otherwise("root").alias("folder"),
        F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1)).alias("extension"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    ]
    return out.select(*cols, *([F.sha2("content", 256).alias("version_hash")] if with_hash else []))


def union_roots(scans: dict[str, DataFrame]) -> DataFrame:
    """Several roots as one scan, each path behind its prefix."""
    parts = [df.withColumn("source_path", F.concat(F.lit(f"{prefix}/"), "source_path")) for prefix, df in scans.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def route_types(files: DataFrame, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    return files.withColumn("supported", F.col("extension").isin(*supported))


def routing_counts(files: DataFrame) -> DataFrame:
    return route_types(files).groupBy("extension").agg(F.count("*").alias("files"), F.count_if("supported").alias("supported"), F.sum("bytes").alias("bytes"))


def paragraph_sections(docs: DataFrame, sep: str = r"\n\s*\n") -> DataFrame:
    """doc_id, pos, content, type: trimmed, non-empty paragraphs numbered from 0."""
    parts = F.filter(F.transform(F.split("text", sep), T.strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "content"), F.lit("paragraph").alias("type"))


def split_pages(docs: DataFrame, marker: str = "\f") -> DataFrame:
    """doc_id, page (from 1), text."""
    parts = F.filter(F.transform(F.split("text", marker), T.strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("page", "text")).withColumn("page", F.col("page") + 1)


def clean_line(col: Column) -> Column:
    """Footer and watermark noise out, spaces folded, split section numbers joined."""
    out = F.regexp_replace(col, r"(?i)controlled copy if this line is green|page\s+\d+\s+of\s+\d+", "")
    out = F.regexp_replace(out, r"(\d)\s+\.\s+(\d)", "$1.$2")
    out = F.regexp_replace(out, r"(\d)\s+\.\s+(\d)", "$1.$2")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Cleaned lines; those that are nothing but noise go."""
    return lines.withColumn("line", clean_line(F.col("line"))).where(~F.col("line").rlike(r"^\W*\d*\W*$"))


HTML_BLOCK = r"(?is)<(h[1-6]|p|table|ul|ol)\b[^>]*>(.*?)</\1\s*>"


def html_sections(pages: DataFrame) -> DataFrame:
    """page_id, pos, type, level, content, title: headings, paragraphs, tables and lists in order, under their heading path."""
    from lodestar.functions.text import strip_html

    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", "")
    whole = F.regexp_extract_all(clean, F.lit(HTML_BLOCK), F.lit(0))
    blocks = pages.select("page_id", F.posexplode(whole).alias("pos", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<([a-zA-Z0-9]+)", 1))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), strip_html)
    rows = F.filter(F.transform(F.regexp_extract_all("block", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), lambda r: F.array_join(cells(r), " | ")), lambda r: r != "")
    table = F.concat_ws("\n", F.slice(rows, 1, 1), F.when(F.size(rows) > 0, F.lit("---")), F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(0))))
    items = F.filter(F.transform(F.regexp_extract_all("block", F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1)), strip_html), lambda x: x != "")
    listed = F.array_join(F.transform(items, lambda x, i: F.concat(F.when(tag == "ol", F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x)), "\n")
    content = F.when(tag == "table", table).when(tag.isin("ul", "ol"), listed).otherwise(strip_html(F.col("block")))
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "table", "table").when(tag.isin("ul", "ol"), "list").otherwise("paragraph")
    out = blocks.select("page_id", "pos", kind.alias("type"), F.when(kind == "heading", F.substring(tag, 2, 1).cast("int")).alias("level"), content.alias("content")).where("content <> ''")
    from lodestar.operators.normalise import with_heading_stack

    stacked = with_heading_stack(out.withColumnRenamed("page_id", "doc_id")).withColumnRenamed("doc_id", "page_id")
    return stacked.withColumn("title", F.array_join("heading_stack", " > ")).drop("heading_stack")


def table_groups(rows: DataFrame) -> DataFrame:
    """rows(doc_id, sheet, row, cells) without blank rows, with `table_no`: runs of rows between blank ones, from 1."""
    blank = ~F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    w = Window.partitionBy("doc_id", "sheet").orderBy("row")
    marked = rows.withColumn("_blank", blank).withColumn("_island", F.sum(F.col("_blank").cast("int")).over(w)).where(~F.col("_blank"))
    return marked.withColumn("table_no", F.dense_rank().over(w.orderBy("_island"))).drop("_blank", "_island")


def column_letter(n: Column) -> Column:
    """1, 2, ... as A, B, ..., Z, AA, ... for any column of a four-byte number: bijective base 26, at most seven letters."""
    letter = lambda k: F.chr(F.lit(65) + F.pmod(k, F.lit(26)))
    left, out = n.cast("long"), F.lit("")
    for _ in range(7):
        out = F.when(left > 0, F.concat(letter(left - 1), out)).otherwise(out)
        left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0))
    return out


def render_table_groups(groups: DataFrame) -> DataFrame:
    """One text block a table: sheet, columns, a rule, the rows; with its A1-style range."""
    line = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ")
    made = groups.groupBy("doc_id", "sheet", "table_no").agg(
        F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("_r"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.max(F.size("cells")).alias("width")
    )
    n = F.count("*").over(Window.partitionBy("doc_id", "sheet"))
    lines = F.transform("_r", lambda x: x["line"])
    text = F.concat_ws("\n", F.concat(F.lit("Sheet: "), "sheet"), F.concat(F.lit("Columns: "), F.get(lines, 0)), F.lit("---"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))
    ref = F.concat(F.lit("A"), F.col("first_row").cast("string"), F.lit(":"), column_letter(F.col("width")), F.col("last_row").cast("string"))
    title = F.when(n > 1, F.concat("sheet", F.lit(" — Table "), F.col("table_no").cast("string"))).otherwise(F.col("sheet"))
    return made.select("doc_id", "sheet", "table_no", text.alias("content"), ref.alias("range_ref"), title.alias("title"))


def chunks_to_write(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Chunks with the flags that their branch forces; the job fails on a chunk that breaks a rule.

    Rules: an excluded chunk has no vector but for the one that is taken from it here,
    `retrieval_excluded` and `chunk_id` aren't null, and, where `documents` is given, every
    chunk's document is there. They are asserted in the plan that writes, without a pass of their own.
    """
    excluded = F.col("retrieval_excluded")
    status = F.when(excluded, "excluded").otherwise("embedded")
    broken = F.when(F.col("chunk_id").isNull() | excluded.isNull(), "a chunk without id or flag")
    ready = chunks
    if documents is not None:
        known = documents.select(F.col("id").alias("document_id"), F.lit(True).alias("_known")).distinct()
        ready = chunks.join(known, "document_id", "left")
        broken = broken.when(F.col("_known").isNull(), "a chunk of an unknown document")
    if "embedding_status" in chunks.columns:
        broken = broken.when(excluded & (F.col("embedding_status") == "embedded"), "an excluded chunk that was embedded")
    told = F.raise_error(F.concat(broken, F.lit(": "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null"))))
    ready = ready.withColumn("embedding_status", F.when(broken.isNotNull(), told).otherwise(status))
    if "embedding" in chunks.columns:
        ready = ready.withColumn("embedding", F.when(~excluded, F.col("embedding")))
    return ready.select(*chunks.columns, *([] if "embedding_status" in chunks.columns else ["embedding_status"]))


def write_chunks(chunks: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """Embedded and excluded chunks in one write, partitioned by status; nothing is written if a rule is broken."""
    chunks_to_write(chunks, documents).write.mode("overwrite").partitionBy("embedding_status").parquet(path)


def drop_document(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_artifacts(spark: SparkSession, paths: str | list[str], whole: bool = True) -> DataFrame:
    """file, value (variant), bad_record: JSON of any shape, a file or a line a row; what isn't JSON is kept as text."""
    raw = spark.read.text(paths, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).where(F.trim("text") != "")
    return raw.withColumn("value", F.try_parse_json("text")).select("file", "value", F.when(F.col("value").isNull(), F.col("text")).alias("bad_record"))


def exploded(rows: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """`columns` and `item` (variant): the elements of the arrays under each of `keys`, null and other values giving none."""
    out = None
    for key in keys:
        part = rows.select(*columns, F.try_variant_get("value", f"$.{key}", "array<variant>").alias("_items")).select(*columns, F.explode("_items").alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def processed_paths(spark: SparkSession, files: str | list[str], whole: bool = True) -> DataFrame:
    """Distinct source paths from selection artifacts of both shapes, {"selected": [{source_path}]} and {"documents": [...]}; bad records have none."""
    items = exploded(read_artifacts(spark, files, whole), ("selected", "documents"))
    return items.select(F.try_variant_get("item", "$.source_path", "string").alias("source_path")).where("source_path IS NOT NULL").distinct()


QUERY_FIELDS = {"query_id": "long", "question": "string", "category": "string", "expected_docs": "array<string>", "expected_behaviour": "string"}


def read_queries(spark: SparkSession, path: str | list[str], whole: bool = True) -> DataFrame:
    """Question sets, as a list of questions or under "queries": typed fields and, for what is no question, bad_record."""
    rows = read_artifacts(spark, path, whole)
    listed = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.try_variant_get("value", "$.queries", "array<variant>"), F.array("value"))
    items = rows.select("bad_record", F.explode(F.when(F.col("value").isNull(), F.array(F.lit(None).cast("variant"))).otherwise(listed)).alias("item"))
    typed = items.select(*(F.try_variant_get("item", f"$.{name}", kind).alias(name) for name, kind in QUERY_FIELDS.items()), F.coalesce("bad_record", F.to_json("item")).alias("_text"))
    return typed.withColumn("bad_record", F.when(F.col("question").isNull(), F.col("_text"))).drop("_text")


def rebuild(chunks: DataFrame, path: str, documents: DataFrame | None = None) -> DataFrame:
    """Replaces the whole chunk table, which `chunks` may be read from, and reads it back.

    The new table is written beside the old one, and folders are switched only once that
    write has ended well; a write that fails leaves the old table in its place. A run that dies
    between the two renames leaves the old table under `<path>.old`, which the next one puts back first.
    """
    spark, new, old = chunks.sparkSession, f"{path}.new", f"{path}.old"
    if not folders.exists(spark, path) and folders.exists(spark, old):
        folders.rename(spark, old, path)
    folders.remove(spark, new)
    write_chunks(chunks, new, documents)
    folders.remove(spark, old)
    if folders.exists(spark, path):
        folders.rename(spark, path, old)
    folders.rename(spark, new, path)
    folders.remove(spark, old)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)
