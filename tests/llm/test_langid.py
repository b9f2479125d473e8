"""The batched mixtures against expectation-maximisation written out for one document."""

import math
import random

import numpy as np
import pytest

from lodestar.llm import langid


def plain_mixture(p, counts, rounds=40):
    """p: a list of rows of probabilities by language."""
    width, n = len(p[0]), sum(counts)
    share = [1 / width] * width
    for _ in range(rounds):
        new = [0.0] * width
        for row, c in zip(p, counts):
            z = sum(a * b for a, b in zip(row, share))
            for k in range(width):
                new[k] += c * share[k] * row[k] / z / n
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
        share = new
        if done:
            break
    return share, sum(c * math.log(sum(a * b for a, b in zip(row, share))) for row, c in zip(p, counts))


def plain_predict(model, text):
    """(language, share, set) by the definition."""
    found = langid.grams(text)
    if found is None:
        return "und", 0.0, []
    p, counts = model.p[found[0]].astype(float).tolist(), found[1].tolist()
    shares, most = plain_mixture(p, counts)
    single = [sum(c * math.log(row[k]) for row, c in zip(p, counts)) for k in range(len(model.langs))]
    best = [single.index(max(single))]
    price, score = model.penalty * math.log(sum(counts) + 1), model.thin * max(single)
    order = sorted(range(len(shares)), key=lambda k: (-shares[k], k))
    if model.thin * most - price > score:
        for size in range(2, sum(s >= model.least_share for s in shares) + 1):
            chosen = sorted(order[:size])
            own, value = plain_mixture([[row[k] for k in chosen] for row in p], counts)
            if model.thin * value - (size - 1) * price > score:
                score = model.thin * value - (size - 1) * price
                best = [chosen[k] for k in sorted(range(size), key=lambda k: (-own[k], k))]
    return model.langs[best[0]], shares[best[0]], [model.langs[k] for k in best]


@pytest.fixture(scope="module")
def fitted(documents):
    rows = documents.where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").collect()
    return langid.train(documents), rows


def test_table_is_that_of_all_rows(fitted):
    model, rows = fitted
    counts = {lang: np.full(langid.BUCKETS, 0.5) for lang in {r.lang for r in rows}}
    for r in rows:
        found = langid.grams(r.text)
        if found:
            counts[r.lang][found[0]] += found[1]
    assert model.langs == sorted(counts)
    for k, lang in enumerate(model.langs):
        assert np.allclose(model.p[:, k], counts[lang] / counts[lang].sum(), rtol=1e-6)


def test_batches_equal_single_documents(fitted, monkeypatch):
    model, rows = fitted
    by = {}
    for r in rows:
        if len(r.text) > 800:
            by.setdefault(r.lang, r.text)
    texts = [r.text[:1500] for r in rows[:40]] + ["", "123 !?", "x", "a b", " à "]
    langs = sorted(by)
    texts += [by[a][:500] + "\n" + by[b][:300] for a in langs for b in langs if a < b] + ["".join(by[k][:400] for k in langs)]
    want = [plain_predict(model, t) for t in texts]
    for together, table in ((1 << 17, 1 << 21), (3000, 5000)):
        monkeypatch.setattr(langid, "TOGETHER", together)
        monkeypatch.setattr(langid, "TABLE", table)
        for text, (lang, share, chosen), got in zip(texts, want, model.predict_all(texts)):
            assert got[0] == lang and got[2] == chosen, text[:80]
            assert abs(got[1] - share) < 2e-3
            assert not chosen or abs(sum(got[3]) - 1) < 1e-6 and len(got[3]) == len(chosen)


def test_many_languages_keep_the_right_ones(fitted):
    """Twenty languages made by permuting letters: sets equal those of the plain expectation-maximisation over all of them."""
    _, rows = fitted
    letters = "abcdefghijklmnopqrstuvwxyz"
    tables = [str.maketrans(letters, "".join(random.Random(k).sample(letters, 26))) for k in range(5)]
    texts, counts = {}, {}
    for n, r in enumerate(rows[:400]):
        name = f"{r.lang}{n % 5}"
        text = r.text.lower().translate(tables[n % 5])
        texts.setdefault(name, []).append(text)
    for name, own in texts.items():
        total = np.bincount(langid.hashed(own)[1], minlength=langid.BUCKETS)
        counts[name] = np.flatnonzero(total), total[total > 0]
    model = langid.Model.fit(counts)
    assert len(model.langs) == 20
    tried = [(name, own[0][:600]) for name, own in texts.items()]
    tried += [(a, texts[a][0][:900] + "\n" + texts[b][0][:500]) for a, b in zip(sorted(texts), sorted(texts)[3:])]
    for (_, text), got in zip(tried, model.predict_all([t for _, t in tried])):
        lang, share, chosen = plain_predict(model, text)
        assert (got[0], got[2]) == (lang, chosen) and abs(got[1] - share) < 2e-3


def test_awkward_rows(awkward, empty):
    found = {str(r.doc_id): r for r in langid.identify_held_out(awkward).collect()}
    assert found["3"].lang_pred == "und" and found["3"].score == 0 and found["3"].langs == [] == found["3"].shares
    assert langid.identify_held_out(awkward).columns == ["doc_id", "held_out", "lang_pred", "score", "langs", "shares"]
    assert langid.identify_held_out(awkward).count() == awkward.count()
    assert all(r.lang_pred == "und" for r in langid.identify(awkward, langid.train(empty)).collect())
    assert langid.identify_held_out(empty).count() == 0
