"""Importance resampling, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from lodestar.llm import resample


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, percent=5, least=20):
    bucket = lambda f: crc32(f.encode()) % 10000
    made = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in made for f in fs), Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, n_words, fs in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    drawn = percent * len(fit) // 100
    place = {id(r): k + 1 if k < drawn else None for k, r in enumerate(fit)}
    return [(r[0], r[2], r[3], r[4], place.get(id(r))) for r in out]


def rows_of(df):
    return sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())))


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_whole_tables(spark, sf_dir, documents, awkward, empty, percent):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    for docs in (documents, awkward):
        want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], texts, percent)
        got = resample.resample(docs, target, percent)
        assert rows_of(got) == sorted(map(str, want))
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert resample.resample(empty, target).count() == 0
    assert rows_of(resample.resample(documents, empty, percent)) == sorted(map(str, plain_resample([(r.doc_id, r.text) for r in documents.collect()], [], percent)))


def test_draw_returns_whole_rows(awkward, documents):
    drawn_ids = sorted(str(r.doc_id) for r in resample.resample(awkward, documents, percent=50).collect() if r.rank)
    drawn = resample.draw(awkward, documents, percent=50)
    assert drawn.columns == awkward.columns
    rows = drawn.collect()
    assert sorted(str(r.doc_id) for r in rows) == drawn_ids and len(rows) > 1
    assert all(r.kept == "extra kept" and r.text for r in rows)


def test_blocks_and_joins_leave_no_trace():
    rng = random.Random(9)
    texts = ["".join(rng.choice(["ab", "Cé", "7", " ", ". ", "\x00", "Ü\n", ""]) for _ in range(rng.randrange(40))).encode() for _ in range(60)]
    want = Counter((k, crc32(f.encode()) % 997) for k, t in enumerate(texts) for f in plain_features(t.decode())[1])
    for most, block in ((1, 50_000), (200, 1), (200, 2), (10**6, 3), (10**6, 7)):
        got = Counter()
        for begin, _, data, offsets in resample.joined(texts, most):
            for _, bucket, owner in resample.features(data, offsets, 997, block=block):
                got.update(zip((owner + begin).tolist(), bucket.tolist()))
        assert got == want, (most, block)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, k, 30, 5, 7, 100) for k in (9, 3, 5, 1)] + [(2, 2, 19, 5, 7, 900)]
    df = spark.createDataFrame(rows, "doc_id long, x long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r.rank for r in resample.ranked(df, percent=75).collect()}
    assert got == {1: 1, 3: 2, 5: 3, 9: None, 2: None}


def test_gains_are_floors_of_log_ratios():
    assert resample.log_gains(np.array([3, 0]), np.array([0, 1])).tolist() == [math.floor(1000 * math.log(5 / 12)), math.floor(1000 * math.log(10 / 3))]
