"""Spelling variants, against plain Python over all pairs."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from lodestar.llm import spelling


def plain_counts(rows, least_length=7, every=31):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least_length and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return out


def found(df):
    return {r.word: [r.form, r.root, r.n, r.n_near, r.form_n] for r in df.collect()}


def test_whole_tables(spark, documents, awkward, empty):
    for docs in (documents, awkward):
        want = plain_counts((r.doc_id, r.text) for r in docs.collect())
        words = spelling.word_counts(docs, spelling.drop_some)
        assert {r.word: r.n for r in words.collect()} == want
        assert found(spelling.group_variants(words)) == plain_variants(want)
    assert spelling.group_variants(spelling.word_counts(empty)).count() == 0


@pytest.mark.parametrize(("crowd", "alphabet"), [(1_000, "ab"), (20, "ab"), (3, "abc"), (5, "aéÿ")])
def test_crowded_keys_lose_and_double_no_pair(spark, crowd, alphabet):
    rng = random.Random(crowd)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 12))): 10 ** rng.randrange(4) * 2 for _ in range(250)}
    counts |= {"prefix" + "".join(rng.choice(alphabet) for _ in range(3)): 2 for _ in range(30)}
    counts |= {"a" * k: 2 * k for k in (40, 41, 3000, 3001)} | {"b" + "a" * 3000: 5, "a" * 2999 + "bb": 70_000}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.group_variants(words, crowd=crowd)) == plain_variants(counts)


def test_roots_follow_long_chains(spark):
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx", "abuvwzyx"]
    counts = {w: 2 * 10**k for k, w in enumerate(chain)}
    rows = found(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert all(rows[w][1] == chain[-1] for w in chain) and rows == plain_variants(counts)


def test_tiles_find_every_single_edit():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) for _ in range(200)})
    import numpy as np

    for L in (8, 9):
        own = [w for w in words if len(w) in (L - 1, L)]
        columns = {"key": np.zeros(len(own), np.int64), "L": np.full(len(own), L), "lo": np.zeros(len(own), int), "hi": np.full(len(own), L)}
        got = {own[i]: n for i, (n, _, _) in spelling.compare(own, [1] * len(own), columns).items()}
        want = {w: sum(one_edit(w, v) and max(len(w), len(v)) == L for v in own) for w in own}
        assert got == {w: n for w, n in want.items() if n}
