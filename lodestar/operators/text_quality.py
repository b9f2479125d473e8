"""Text-quality scores, tiers and extraction routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T


def pages_with_text_ratio(pages: DataFrame, at_least: int = 50) -> DataFrame:
    """doc_id, pages_with_text: share of pages with more than `at_least` characters. pages(doc_id, page, text)."""
    return pages.groupBy("doc_id").agg(F.avg(F.when(F.length("text") > at_least, 1.0).otherwise(0.0)).alias("pages_with_text"))


def quality_score(printable: Column, tokens: Column, dictionary: Column, pages: Column, suspicious: Column) -> Column:
    total = 0.25 * printable + 0.20 * tokens + 0.25 * dictionary + 0.15 * pages + 0.15 * (1.0 - suspicious)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def quality_tier(score: Column) -> Column:
    return F.when(score > 0.8, "good").when(score >= 0.4, "partial").otherwise("poor")


def assess_text_quality(docs: DataFrame, vocabulary: list[str] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Adds the five signals, text_quality_score and text_quality_tier; without pages the text is one page."""
    text = F.coalesce("text", F.lit(""))
    if pages is not None:
        docs = docs.join(pages_with_text_ratio(pages), "doc_id", "left").withColumn("pages_with_text", F.coalesce("pages_with_text", F.lit(0.0)))
    else:
        docs = docs.withColumn("pages_with_text", F.when(F.length(text) > 50, 1.0).otherwise(0.0))
    docs = docs.withColumns(
        {
            "printable_ratio": T.printable_ratio(text),
            "mean_token_score": T.mean_token_score(text),
            "dictionary_hit_rate": T.dictionary_hit_rate(text, vocabulary),
            "suspicious_rate": T.suspicious_rate(text),
        }
    )
    score = quality_score(*[F.col(c) for c in ("printable_ratio", "mean_token_score", "dictionary_hit_rate", "pages_with_text", "suspicious_rate")])
    return docs.withColumn("text_quality_score", score).withColumn("text_quality_tier", quality_tier(F.col("text_quality_score")))


def route_extraction(docs: DataFrame, short: int = 100) -> DataFrame:
    """route, needs_review and quarantined from native_tier, native_chars and ocr_tier (null: not read by OCR)."""
    to_ocr = (F.col("native_chars") < short) | (F.col("native_tier") == "poor")
    tier = F.coalesce("ocr_tier", "native_tier")
    route = F.when(to_ocr & F.col("ocr_tier").isNull(), "ocr_queue").when(F.col("ocr_tier").isNotNull(), "ocr").otherwise("native")
    return docs.withColumns(
        {
            "route": route,
            "final_tier": tier,
            "needs_review": tier.isin("partial", "poor"),
            "quarantined": F.coalesce(F.col("ocr_tier") == "poor", F.lit(False)),
        }
    )


def extraction_method(source_type: Column, ocr_used: Column, fallback: Column) -> Column:
    return F.when(ocr_used & (source_type == "image"), "ocr_image").when(ocr_used, "ocr").when(fallback, F.concat(F.lit("native_"), source_type, F.lit("js"))).otherwise(F.concat(F.lit("native_"), source_type))


def ocr_confidence(pages: DataFrame) -> DataFrame:
    """Mean page confidence to two places; a failed page counts 0."""
    return pages.groupBy("doc_id").agg(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 2).alias("ocr_confidence"))
