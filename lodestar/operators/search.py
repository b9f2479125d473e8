"""Batched search: every operator answers a whole table of questions at once.

Nearest vectors, full text and trigrams have an index each, whose bounds rule out
most pairs; results are exact. Questions go to every task only by packs of a
measured size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lodestar.functions import patterns as P
from lodestar.functions import text as T
from lodestar.operators import fulltext
from lodestar.operators import vectors as angular
from lodestar.operators.shared import cut, sent

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
STOP_WORDS = "a an and are as at be by for from has in is it of on or that the this to was were what when where which with".split()


def searchable(chunks: DataFrame, docs: DataFrame, need_vector: bool = False) -> DataFrame:
    """Chunks of active documents that retrieval may show."""
    active = docs.where("is_active").select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), "folder", "source_type")
    out = chunks.where(~F.col("retrieval_excluded")).join(active, "document_id")
    return out.where(F.col("embedding").isNotNull()) if need_vector else out


def top_k(hits: DataFrame, k: int | Column, score: str = "score", by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k: queries(query_id, embedding) against chunks(chunk_id, embedding), by the angular index of the module `vectors`."""
    return angular.nearest(queries, chunks, k)[0]


def terms(col: Column) -> Column:
    """Lower-case alphanumeric terms without stop words, repeats included."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def search_postings(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(chunk_id, term, weight, tf): `fields` maps a column to its weight class A, B or C; a term takes its best weight."""
    each = [chunks.select("chunk_id", F.explode(terms(F.col(c))).alias("term"), F.lit(WEIGHTS[k]).alias("w")) for c, k in fields.items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.groupBy("chunk_id", "term").agg(F.max("w").alias("weight"), F.count("*").alias("tf"))


def question_terms(queries: DataFrame, col: str = "question") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col(col)))).alias("term"))


def fulltext_search(queries: DataFrame, postings: DataFrame, k: int, match: str = "all") -> DataFrame:
    """Weighted term match; `match` is "all" or "any". Score: sum of weight x tf / (tf + 1); by the slices and bounds of `fulltext`."""
    return fulltext.search(question_terms(queries), postings, k, match)


#: A question table whose matrix of questions by distinct grams has so many places at most goes to every task.
MATRIX_PLACES = 16_000_000
_WORD = re.compile("[a-z0-9]+")


def gram_set(text: str | None) -> set[str]:
    """Distinct trigrams of each word, lower case, padded with two spaces before and one after."""
    return {f"  {w} "[i : i + 3] for w in set(_WORD.findall((text or "").lower())) for i in range(len(w) + 1)}


def trigram_search(queries: DataFrame, chunks: DataFrame, k: int, threshold: float = 0.3, cols: tuple[str, ...] = ("content",), places: int = MATRIX_PLACES) -> DataFrame:
    """Jaccard similarity of trigram sets, shared / (a + b - shared); of several columns the greatest counts.

    While the matrix of questions by their distinct grams has `places` places at most (it is
    measured), tasks multiply it with blocks of their own chunks, and each task keeps
    the `k` best of a question: nothing else is shuffled. Larger question tables
    meet the chunks by the prefixes of their rarest grams. Both ways give the same rows.
    """
    fields = [chunks.select("chunk_id", F.col(c).alias("content")) for c in cols]
    asked = queries.select("query_id", T.trigrams(F.col("question")).alias("_g"))
    size = asked.agg(F.count("*").alias("n")).crossJoin(asked.select(F.explode("_g").alias("g")).agg(F.count_distinct("g").alias("grams"))).first()
    if size.n * size.grams > places:
        found = reduce(DataFrame.unionByName, (prefix_join(queries, one, threshold) for one in fields))
    else:
        rows = asked.where(F.size("_g") > 0).collect()
        found = multiplied(fields, [r.query_id for r in rows], [list(r._g) for r in rows], k, threshold, queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString())
    return top_k(found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def multiplied(fields: list[DataFrame], ids: list, grams: list[list[str]], k: int, threshold: float, query_type: str, chunk_type: str, block: int = 512) -> DataFrame:
    """(query_id, chunk_id, score): the best of each task, by products of 0/1 matrices."""
    place = {g: i for i, g in enumerate(sorted({g for gs in grams for g in gs}))}
    held = np.zeros((len(place), len(ids)), np.float32)
    for j, gs in enumerate(grams):
        held[[place[g] for g in gs], j] = 1
    sizes = held.sum(axis=0)
    shared = fields[0].sparkSession.sparkContext.broadcast((place, held, sizes, ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, sizes, ids = shared.value
        best: pd.DataFrame | None = None
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                own = [gram_set(t) for t in part["content"]]
                mine = np.zeros((len(part), len(place)), np.float32)
                for i, gs in enumerate(own):
                    mine[i, [p for p in map(place.get, gs) if p is not None]] = 1
                both = (mine @ held).astype(np.float64)
                n = np.array([len(gs) for gs in own], np.float64)
                score = both / np.maximum(n[:, None] + sizes[None, :] - both, 1)
                i, j = np.nonzero(score >= threshold)
                new = pd.DataFrame({"query_id": [ids[x] for x in j], "chunk_id": part["chunk_id"].to_numpy()[i], "score": score[i, j]})
                best = new if best is None else pd.concat([best, new])
            if best is not None and len(best) > 4 * k * len(ids):
                best = best.sort_values(["score", "chunk_id"], ascending=[False, True]).groupby("query_id", sort=False).head(k)
        if best is not None and len(best):
            yield best.sort_values(["score", "chunk_id"], ascending=[False, True]).groupby("query_id", sort=False).head(k)

    out = [f.mapInPandas(run, f"query_id {query_type}, chunk_id {chunk_type}, score double") for f in fields]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def ordered_grams(texts: DataFrame, key: str, col: str, rank: dict[str, int]) -> DataFrame:
    """key, n (all distinct grams), grams: the places in `rank` of those that have one, in order."""
    sent, kind = texts.sparkSession.sparkContext.broadcast(rank), texts.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(t) for t in batch.column(1).to_pylist()]
            grams = [sorted(r for r in map(sent.value.get, s) if r is not None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int32()), pa.array(grams, pa.list_(pa.int32()))], [key, "n", "grams"])

    return texts.select(key, col).mapInArrow(run, StructType([StructField(key, kind), StructField("n", IntegerType()), StructField("grams", ArrayType(IntegerType()))]))


def prefixes(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, n, m, place, gram: the first grams of each set that a set as similar as `threshold` must share one of.

    Such a set shares ceil(threshold x n) grams at least, so it can't miss the first m - that + 1 of
    the m ordered ones. Grams without a place are in no question: they would come first, and match nothing.
    """
    least = F.ceil(threshold * F.col("n") - 1e-9)
    m = F.size("grams")
    first = F.slice("grams", F.lit(1), F.greatest(m - least + 1, F.lit(0)).cast("int"))
    return sets.select(key, "n", m.alias("m"), F.posexplode(first).alias("place", "gram"))


def prefix_candidates(asked: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Distinct (query_id, chunk_id) that share a prefix gram and pass the filters of length and position."""
    q = prefixes(asked, "query_id", threshold).withColumnsRenamed({"n": "qn", "m": "qm", "place": "qp"})
    c = prefixes(held, "chunk_id", threshold)
    lengths = (F.col("n") >= threshold * F.col("qn") - 1e-9) & (F.col("n") * threshold <= F.col("qn") + 1e-9)
    # holds for the first gram that two similar sets share, which is enough
    most = F.least(F.col("m") - F.col("place"), F.col("qm") - F.col("qp"))
    positions = most >= threshold / (1 + threshold) * (F.col("n") + F.col("qn")) - 1e-9
    return c.join(q, "gram").where(lengths & positions).select("query_id", "chunk_id").distinct()


def prefix_join(queries: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """The same scores by a set-similarity join: grams in one order of rarity, an index of prefixes, filters, and a check on the whole sets.

    The order has a row a gram of the questions: 37^3 at most, whatever the tables.
    """
    grams = lambda df, col: df.select(F.explode(T.trigrams(F.col(col))).alias("gram"))
    wanted = grams(queries, "question").distinct()
    seen = grams(chunks, "content").join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    order = wanted.join(seen, "gram", "left").orderBy(F.coalesce("n", F.lit(0)), "gram").select("gram").collect()
    rank = {r.gram: i for i, r in enumerate(order)}
    asked, held = cut(ordered_grams(queries, "query_id", "question", rank)), cut(ordered_grams(chunks, "chunk_id", "content", rank))
    pairs = prefix_candidates(asked, held, threshold)
    whole = pairs.join(held, "chunk_id").join(asked.withColumnsRenamed({"n": "qn", "grams": "qgrams"}), "query_id")
    shared = F.size(F.array_intersect("grams", "qgrams"))
    return whole.select("query_id", "chunk_id", (shared / (F.col("n") + F.col("qn") - shared)).alias("score")).where(F.col("score") >= threshold)


def ilike_any(col: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.lower(col).contains(F.lower(p)))


def section_anchors(refs: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """refs(query_id, ref): chunks whose title starts with, holds, whose label or content holds the reference: 1.0, 0.95, 0.9, 0.8.

    The leading number of the reference is the join key where a chunk has one; a
    reference inside a text is found by the chunk's own numbers, so the join stays
    an equality. Only the `k` best chunks of a reference meet its questions: no other can be among theirs.
    """
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(P.SECTION_REF), F.lit(0))
    own = chunks.select(
        "chunk_id",
        F.explode(
            F.concat(
                F.transform(F.filter(F.array(F.regexp_extract(F.coalesce("section_title", F.lit("")), rf"^\s*({P.SECTION_REF})", 1)), lambda x: x != ""), lambda x: F.struct(x.alias("ref"), F.lit(1.0).alias("s"))),
                F.transform(numbers(F.col("section_title")), lambda x: F.struct(x.alias("ref"), F.lit(0.95).alias("s"))),
                F.transform(numbers(F.col("citation_label")), lambda x: F.struct(x.alias("ref"), F.lit(0.9).alias("s"))),
                F.transform(numbers(F.col("content")), lambda x: F.struct(x.alias("ref"), F.lit(0.8).alias("s"))),
            )
        ).alias("_r"),
    ).select("chunk_id", "_r.ref", "_r.s")
    wanted = own.join(refs.select("ref").distinct(), "ref", "left_semi").groupBy("ref", "chunk_id").agg(F.max("s").alias("score"))
    best = top_k(wanted, k, by="ref").drop("rank")
    return top_k(best.join(refs, "ref").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def list_anchor_score(title: Column, content: Column) -> Column:
    return (
        F.when(title.rlike(r"(?i)test\s*codes?"), 1.0)
        .when(title.rlike(r"(?i)\b(?:list|register|appendix)\b"), 0.95)
        .when(content.rlike(r"(?i)test\s*codes?"), 0.92)
        .when(content.rlike(P.LIST_EVIDENCE), 0.85)
    )


def list_anchors(chunks: DataFrame, k: int) -> DataFrame:
    scored = chunks.withColumn("score", list_anchor_score(F.coalesce("section_title", F.lit("")), F.coalesce("content", F.lit("")))).where(F.col("score").isNotNull())
    return scored.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(k)


#: Words in titles and section titles of authoritative sources; fixed values.
AUTHORITY_TITLES = ("list", "code", "appendix", "matrix", "mapping", "register", "reference", "catalog", "catalogue", "lookup")
AUTHORITY_SECTIONS = ("code", "test type", "appendix", "criteria", "rule", "release", "interpretation", "form", "mapping", "register", "reference")
STRUCTURED = ("xlsx", "csv")


def all_terms_pairs(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of chunks that hold every term: asked(query_id, terms), held(chunk_id, terms), both distinct.

    A question meets the chunks of its rarest term alone, and the whole sets decide. Pairs are
    ids until then, so a chunk's terms are never written once a term.
    """
    wanted = asked.select("query_id", F.explode("terms").alias("term"))
    by_term = held.select("chunk_id", F.explode("terms").alias("term"))
    counts = by_term.select("term").join(sent(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    met = by_term.join(sent(cut(rarest)), "term").select("query_id", "chunk_id")
    whole = met.join(held, "chunk_id").join(asked.withColumnRenamed("terms", "asked"), "query_id")
    return whole.where(F.size(F.array_intersect("asked", "terms")) == F.size("asked")).select("query_id", "chunk_id")


def containing_pairs(queries: DataFrame, chunks: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """(query_id, chunk_id) of chunks with the whole question in one of `cols`, case aside; % and _ stand for themselves."""
    from lodestar.operators.residual import contained

    asked = queries.select("query_id", F.lower("question").alias("needle")).where("needle <> ''")
    texts = reduce(DataFrame.unionByName, (chunks.select("chunk_id", F.lower(c).alias("text")).where("text <> ''") for c in cols))
    inside = contained(asked.select("needle").distinct(), texts.select("text").distinct())
    return inside.join(asked, "needle").join(texts, "text").select("query_id", "chunk_id").distinct()


def authoritative_anchors(queries: DataFrame, chunks: DataFrame, k: int = 24) -> DataFrame:
    """query_id, chunk_id, score and rank of authoritative chunks: structured sources (1.0), titles (0.96), section titles (0.93), text matches (0.9), the rest (0.82).

    queries(query_id, question, refs); chunks(chunk_id, source_type, doc_title, section_title, citation_label, content) are searchable ones. Chunks whose section
    title holds one of `refs` are authoritative too. Chunks that aren't structured must hold all terms of the question, or the whole of it in
    content or label. Structured ones stand for every question, so only the `k` first of them meet the questions.
    """
    queries = cut(queries.select("query_id", "question", "refs"))  # read by every way
    lowered = lambda c: F.lower(F.coalesce(c, F.lit("")))
    structured = lowered("source_type").isin(*STRUCTURED)
    patterns = lambda words: F.array(*map(F.lit, words))
    title, section = ilike_any(lowered("doc_title"), patterns(AUTHORITY_TITLES)), ilike_any(lowered("section_title"), patterns(AUTHORITY_SECTIONS))
    first = chunks.where(structured).orderBy("chunk_id").limit(k).select("chunk_id", F.lit(1.0).alias("score"))
    always = queries.select("query_id").crossJoin(F.broadcast(first))  # k rows
    others = chunks.where(~structured).select("chunk_id", "section_title", "citation_label", "content", F.when(title, 0.96).when(section, 0.93).alias("_s"))
    asked = queries.select("query_id", F.array_distinct(terms(F.col("question"))).alias("terms")).where(F.size("terms") > 0)
    text = F.concat_ws(" ", F.coalesce("citation_label", F.lit("")), F.coalesce("section_title", F.lit("")), F.coalesce("content", F.lit("")))
    matched = all_terms_pairs(asked, others.select("chunk_id", F.array_distinct(terms(text)).alias("terms"))).withColumn("_m", F.lit(True))
    held = containing_pairs(queries, others, ("content", "citation_label")).withColumn("_m", F.lit(False))
    pairs = matched.unionByName(held).groupBy("query_id", "chunk_id").agg(F.bool_or("_m").alias("_m"))
    rows = pairs.join(others.select("chunk_id", "section_title", "_s"), "chunk_id").join(queries.select("query_id", "refs"), "query_id")
    admitted = F.col("_s").isNotNull() | ilike_any(lowered("section_title"), F.coalesce("refs", F.array().cast("array<string>")))
    scored = rows.where(admitted).select("query_id", "chunk_id", F.coalesce("_s", F.when(F.col("_m"), 0.9), F.lit(0.82)).alias("score"))
    return top_k(always.unionByName(scored), k)


TEXT_COLUMNS = ("content", "citation_label", "section_title")


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, postings: DataFrame, k: int = 25, final: int = 8, vectors: DataFrame | None = None, threshold: float = 0.3, refs: DataFrame | None = None
) -> DataFrame:
    """Three channels, min-max normalised, fused by weight; without question vectors the text channels stand alone.

    Trigrams score the best of content, label and section title; titles that hold one of `refs` (query_id, ref) are admitted with score 0.
    """
    from lodestar.operators import fusion

    fts = fulltext_search(queries, postings, k, match="any").select("query_id", "chunk_id", "score")
    trg = trigram_search(queries, chunks, k, threshold, TEXT_COLUMNS).select("query_id", "chunk_id", "score")
    if refs is not None:
        trg = fusion.dedupe_max(trg.unionByName(title_admissions(refs, chunks)))
    vec = vector_search(vectors, chunks, k).select("query_id", "chunk_id", "score") if vectors is not None else None
    return top_k(fusion.fuse(vec, fts, trg), final)


def title_admissions(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score 0) of chunks whose section or document title holds a reference as a run of words.

    refs(query_id, ref). Titles are cut into runs of the lengths that references
    have, so that the join is an equality whatever the sizes.
    """
    norm = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9.]+"), lambda w: w != "")
    asked = refs.select("query_id", norm("ref").alias("_w")).where(F.size("_w") > 0).select("query_id", F.array_join("_w", " ").alias("_ref"), F.size("_w").alias("_n")).distinct()
    lengths = [r[0] for r in asked.select("_n").distinct().orderBy("_n").collect()]
    if not lengths:
        return asked.join(chunks.select("chunk_id"), F.lit(False)).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    none = F.array().cast("array<string>")
    spread = lambda w: F.array_distinct(F.concat(*[F.when(F.size(w) >= n, runs(w, n)).otherwise(none) for n in lengths]))
    titled = chunks.select("chunk_id", norm("section_title").alias("_s"), norm("doc_title").alias("_d"))
    keys = titled.select("chunk_id", F.explode(F.array_distinct(F.concat(spread(F.col("_s")), spread(F.col("_d"))))).alias("_ref"))
    return keys.join(asked, "_ref").select("query_id", "chunk_id", F.lit(0.0).alias("score")).distinct()


def with_fallback(queries: DataFrame, hits: DataFrame, diagnostics: DataFrame, retrieve, hints: str) -> DataFrame:
    """Ask again, with hints, the questions that found no mechanism, as a second batch; hits of both, the better score of each chunk.

    `retrieve` maps questions to hits of the columns of `hits`.
    """
    from lodestar.operators import fusion

    again = fusion.without_mechanism(queries, diagnostics).withColumn("question", F.concat_ws(" ", "question", F.lit(hints)))
    return fusion.dedupe_max(hits.unionByName(retrieve(again)))
