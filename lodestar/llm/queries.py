"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, fingerprint, langid, lexicon, licenses, line_dedup, packing, pieces, quality, resample, secret_scan, simhash, spelling
from lodestar.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(documents(spark, sf_dir))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), digests=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan_licenses(docs, licenses.train(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir)).withColumn("host_rate", F.round("host_rate", 6))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(documents(spark, sf_dir))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), digests=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(documents(spark, sf_dir), spelling.drop_some))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resample(documents(spark, sf_dir), target)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    found = {
        f.__name__: f
        for f in (
            op1_token_counts, op2_best_fit_packing, op3_secret_scan, op4_bpe_codec, op5_line_dedup, op6_license_scan,
            op7_quality_rules, op8_simhash, op9_language_id, op10_fingerprints, op11_piece_codec, op12_spelling_variants, op13_importance_resampling,
        )
    }
    return found | {"pipeline": run}


#: A window is named by its three lines' text, so this needs no hash. Rows that share a document id don't occur in the tables.
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM lines)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows
), covered AS (
  SELECT DISTINCT doc_id, p + d AS l FROM firsts, (VALUES (0), (1), (2)) AS t(d) WHERE k > 1
), numbered AS (
  SELECT doc_id, l, ls[l] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS l FROM lines)
), kept AS (
  SELECT n.doc_id, coalesce(string_agg(line, chr(10) ORDER BY n.l) FILTER (WHERE c.l IS NULL), '') AS text,
    count(*) AS n_lines, count(c.l) AS n_removed
  FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.l = c.l GROUP BY n.doc_id
)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

QUALITY = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(ws[p : p + 7], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM words)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - p, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM twice) GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN repeats USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS k, sum(f * f / n) / sum(n) AS s2 FROM hosts
), prior AS (
  SELECT m, CASE WHEN s2 - m * m - m * (1 - m) * k / n > 0 AND m * (1 - m) > 0
    THEN least(greatest(m * (1 - m) / (s2 - m * m - m * (1 - m) * k / n) - 1, 1.0), n) ELSE n END AS strength FROM moments
), rates AS (
  SELECT source, (f + m * strength) / (hosts.n + strength) AS host_rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_rate, 0) <= 0.5 AS kept, round(host_rate, 6) AS host_rate
FROM judged LEFT JOIN rates USING (source)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_DEDUP, "op7_quality_rules": QUALITY}
