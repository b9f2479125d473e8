"""The search indexes against plain scans of everything."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import fulltext, search, vectors

VECTOR = "embedding array<float>"


def plain_nearest(questions, chunks, k):
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        v = [float(np.float32(x)) for x in v]
        n = math.sqrt(sum(x * x for x in v))
        return (v, n) if n else None

    out = []
    for q, qv in questions:
        a = unit(qv)
        if a is None:
            continue
        scored = []
        for c, cv in chunks:
            b = unit(cv)
            if b is not None:
                scored.append((-sum(x * y for x, y in zip(a[0], b[0])) / (a[1] * b[1]), c))
        out += [(q, c, r + 1, round(-s, 9)) for r, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in df.collect())


def clustered(rng, n, centres, width=12, spread=0.05):
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(k, [x + rng.gauss(0, spread) for x in middles[k % centres]]) for k in range(n)]


@pytest.mark.parametrize(("pivots", "block"), [(1024, 256), (5, 7), (1, 3)])
def test_nearest_vectors_are_exact_with_awkward_rows(spark, pivots, block):
    rng = random.Random(pivots)
    rows = [*clustered(rng, 300, 6, 5), *((1000 + k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(40))]
    rows += [(2000, None), (2001, [0.0] * 5), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [float("nan")] + [1.0] * 4), (2004, [float("inf")] + [1.0] * 4)]
    questions = [*rows[:25], *rows[-7:], (3000, [-1.0, -2.0, -3.0, -4.0, -5.0])]
    q = spark.createDataFrame(questions, f"query_id long, {VECTOR}").repartition(3)
    c = spark.createDataFrame(rows, f"chunk_id long, {VECTOR}").withColumn("block", F.lit("extra")).repartition(4)
    assert rows_of(vectors.nearest(q, c, 6, pivots, block)[0]) == plain_nearest(questions, rows, 6)
    few = c.where("chunk_id >= 1037")
    assert rows_of(search.vector_search(q, few, 6)) == plain_nearest(questions, [r for r in rows if r[0] >= 1037], 6)
    assert search.vector_search(q.where("query_id = 2000"), c, 3).count() == 0 and search.vector_search(q, c.limit(0), 3).count() == 0
    named = search.vector_search(q.withColumn("query_id", F.concat(F.lit("q"), "query_id")), c.withColumn("chunk_id", F.concat(F.lit("c"), "chunk_id")), 2)
    assert named.count() == 2 * len({r[0] for r in plain_nearest(questions, rows, 2)})


def test_a_vector_of_another_length_is_told(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0])], f"query_id long, {VECTOR}")
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], f"chunk_id long, {VECTOR}")
    with pytest.raises(Exception, match="another length than 2: 3"):
        search.vector_search(q, c, 1).collect()


def test_clustered_vectors_meet_under_half_of_the_pairs(spark):
    rows = clustered(random.Random(4), 4000, 20)
    c = spark.createDataFrame(rows, f"chunk_id long, {VECTOR}")
    q = c.where("chunk_id % 40 = 0").withColumnRenamed("chunk_id", "query_id")
    hits, index, visits = vectors.nearest(q, c, 10, block=64)
    assert index.pairs(*visits) < 0.2 * 100 * 4000
    assert index.members.agg(F.max("n")).first()[0] <= 2 * 64
    assert rows_of(hits) == plain_nearest([r for r in rows if r[0] % 40 == 0], rows, 10)


def plain_fulltext(questions, postings, k, every):
    out = []
    for q in sorted({q for q, _ in questions}):
        terms, sums, n = {t for x, t in questions if x == q}, {}, {}
        for c, t, w, tf in postings:
            if t in terms:
                sums[c] = sums.get(c, 0) + w * tf / (tf + 1.0)
                n[c] = n.get(c, 0) + 1
        fit = sorted((-round(s, 9), c) for c, s in sums.items() if not every or n[c] == len(terms))
        out += [(q, c, r + 1, -s, n[c]) for r, (s, c) in enumerate(fit[:k])]
    return out


def made_postings(rng, chunks, terms):
    out = [(c, "everywhere", rng.choice([1.0, 0.4, 0.2]), rng.randrange(1, 9)) for c in range(chunks)]
    for c in range(chunks):
        out += [(c, f"t{t}", rng.choice([1.0, 0.4, 0.2]), rng.randrange(1, 9)) for t in range(terms) if rng.random() < 1 / (t + 1)]
    return out


@pytest.mark.parametrize(("match", "slice_chunks", "pack"), [("any", 20_000, 20_000), ("any", 60, 4), ("all", 60, 20_000)])
def test_full_text_is_exact(spark, match, slice_chunks, pack):
    rng = random.Random(slice_chunks)
    postings = made_postings(rng, 400, 12)
    questions = [(q, t) for q in range(12) for t in {"everywhere", "absent", *(f"t{rng.randrange(12)}" for _ in range(q % 5))} if t != "absent" or q % 4 == 1]
    got = fulltext.search(spark.createDataFrame(questions, "query_id long, term string"), spark.createDataFrame(postings, "chunk_id long, term string, weight double, tf long"), 7, match, slice_chunks, pack)
    assert sorted((r.query_id, r.chunk_id, r["rank"], r.score, r.matched) for r in got.collect()) == sorted(plain_fulltext(questions, postings, 7, match == "all"))


def test_bounds_leave_most_of_a_frequent_list():
    rng = random.Random(3)
    n = 20_000
    rare = rng.sample(range(n), 300)
    chunk = np.array([*range(n), *rare])
    term = np.array([0] * n + [1] * 300)
    impact = np.array([0.2 * rng.random() for _ in range(n)] + [0.5 + 0.4 * rng.random() for _ in rare])
    own = fulltext.Slice(chunk, term, impact)
    found, total, matched = own.best([0, 1], 10, False)
    sums = np.zeros(n)
    np.add.at(sums, chunk, impact)
    want = np.argsort(-sums, kind="stable")[:10]
    assert set(want) <= set(found.tolist()) and np.allclose(np.sort(total)[-10:], np.sort(sums)[-10:])
    assert own.read < 1000


def test_a_term_in_every_chunk_is_dealt_evenly(spark):
    postings = spark.range(40_000).select(F.col("id").alias("chunk_id"), F.lit("everywhere").alias("term"), F.lit(1.0).alias("weight"), (1 + F.col("id") % 7).alias("tf"))
    slices = postings.groupBy(F.pmod(F.xxhash64("chunk_id"), F.lit(8))).count().collect()
    sizes = sorted(r["count"] for r in slices)
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    got = fulltext.search(spark.createDataFrame([(1, "everywhere")], "query_id long, term string"), postings, 3, slice_chunks=5000)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [6, 13, 20]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.9])
def test_prefix_index_gives_the_rows_of_the_matrix(spark, threshold):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "gammas", "b", "zz9", "the", "of"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    texts = [(f"c{k}", text(9), text(3)) for k in range(150)] + [("cnull", None, None), ("cempty", "", "-!"), ("csame", "alpha beta", "alpha beta")]
    asked = [(f"q{k}", text(7)) for k in range(25)] + [("qnull", None), ("qempty", "?"), ("qsame", "alpha beta")]
    q, c = spark.createDataFrame(asked, "query_id string, question string"), spark.createDataFrame(texts, "chunk_id string, content string, section_title string")
    score = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = []
    for i, question in asked:
        found = [(-max(score(search.gram_set(question), search.gram_set(t)) for t in fields), j) for j, *fields in texts]
        want += [(i, j, -s) for s, j in sorted(found)[:6] if -s >= threshold and s]
    for places in (0, search.MATRIX_PLACES):
        got = search.trigram_search(q, c, 6, threshold, ("content", "section_title"), places)
        assert sorted((r.query_id, r.chunk_id, r.score) for r in got.collect()) == sorted(want)


def test_prefixes_leave_out_most_pairs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = spark.createDataFrame([(k, " ".join(["the", *rng.sample(words, 6)])) for k in range(300)], "chunk_id long, content string")
    asked = texts.where("chunk_id < 40").toDF("query_id", "question")
    seen = Counter(g for r in texts.collect() for g in search.gram_set(r.content))
    rank = {g: i for i, g in enumerate(sorted(seen, key=lambda g: (seen[g], g)))}
    sets = [search.ordered_grams(df, key, col, rank) for df, key, col in ((asked, "query_id", "question"), (texts, "chunk_id", "content"))]
    assert search.prefix_candidates(*sets, 0.9).count() < 0.05 * 40 * 300


def test_authoritative_anchors_by_rule(spark):
    kind = "chunk_id long, source_type string, doc_title string, section_title string, citation_label string, content string"
    rows = [
        (1, "XLSX", "Notes", None, "l", "unrelated"), (2, "pdf", "Code list", None, "l", "night valve and check"), (3, "pdf", "Code list", None, "l", "night only"), (4, "pdf", "Notes", "Test types", "l", "check of valve at night"),
        (5, "pdf", "Notes", "13.2 x", "l", "valve check"), (6, "pdf", "Notes", "see 4.1 here", "valve", "night check"), (7, "pdf", "Notes", "4.1", None, "xnight valve checky"), (8, "csv", None, None, None, None), (9, "pdf", "Lookup", "4.1", None, "100% of_it"),
    ]
    asked = spark.createDataFrame([(1, "Night valve check", ["4.1"]), (2, "100% of_it", None), (3, "", []), (4, None, None)], "query_id long, question string, refs array<string>")
    got: dict = {}
    for r in search.authoritative_anchors(asked, spark.createDataFrame(rows, kind)).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    assert got == {1: {1: 1.0, 8: 1.0, 2: 0.96, 4: 0.93, 6: 0.9, 7: 0.82}, 2: {1: 1.0, 8: 1.0, 9: 0.96}, 3: {1: 1.0, 8: 1.0}, 4: {1: 1.0, 8: 1.0}}
    assert [(r.query_id, r.chunk_id) for r in search.authoritative_anchors(asked, spark.createDataFrame(rows, kind), 1).orderBy("query_id").collect()] == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_section_anchors_rank_within_a_reference_before_they_meet_questions(spark):
    """Questions with several references and equal scores: the same rows as from all pairs, with a limit below the join."""
    refs = [(q, r) for q in range(6) for r in ("1.1", "2.2", "3.3")[: 1 + q % 3]] + [(9, "8.8")]
    rows = [(c, f"{1 + c % 3}.{1 + c % 3} T" if c % 4 == 0 else f"x {1 + c % 3}.{1 + c % 3}", "", f"in {1 + c % 2}.{1 + c % 2}") for c in range(40)]
    out = search.section_anchors(spark.createDataFrame(refs, "query_id long, ref string"), spark.createDataFrame(rows, "chunk_id long, section_title string, citation_label string, content string"), 5)
    want = set()
    for q in {q for q, _ in refs}:
        score = lambda c, t, text: max([0] + [1.0 if t.startswith(r) else 0.95 if r in t else 0.8 if r in text else 0 for o, r in refs if o == q])
        best = sorted((-score(c, t, text), c) for c, t, _, text in rows if score(c, t, text))[:5]
        want |= {(q, c, -s) for s, c in best}
    assert {(r.query_id, r.chunk_id, r.score) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
