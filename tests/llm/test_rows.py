"""Operators that read one document at a time."""

import hashlib
import math
import random
import re
from collections import Counter

from lodestar.llm import langid, licenses, secret_scan


def plain_base(text):
    """The base patterns, straight from their definition."""
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def test_base_spans_equal_the_definition(documents, awkward, empty):
    rng = random.Random(1)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", " = ", ":", '"', "AKIA", "ABCDEF012", "deadbeef", "0123456789", "x", "\n", "é", "zK9_/+"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        base, spans = secret_scan.Scanner().spans(text)
        assert [f"{kind}:{a}:{b}" for a, b, kind in base] == plain_base(text), text
        assert set(base) <= set(spans)
    for docs in (documents, awkward):
        texts = {(str(r.doc_id), hashlib.sha256(",".join(plain_base(r.text or "")).encode()).hexdigest()) for r in docs.collect()}
        assert {(str(r.doc_id), r.base_sha256) for r in secret_scan.scan_documents(docs).collect()} == texts
    assert secret_scan.scan_documents(empty).count() == 0


def test_entropy_windows_equal_a_recount():
    rng = random.Random(2)
    for _ in range(300):
        run = "".join(rng.choice("abcdefgh0123456789"[: rng.randrange(2, 18)]) for _ in range(rng.randrange(60)))
        window, bits = rng.choice([5, 8, 20]), rng.choice([1.0, 2.2, 3.0])
        covered = set()
        for i in range(len(run) - window + 1):
            counts = Counter(run[i : i + window])
            if -sum(c / window * math.log2(c / window) for c in counts.values()) >= bits - 1e-9:
                covered |= set(range(i, i + window))
        got = list(secret_scan.entropy_spans(run, window, bits))
        assert {p for a, b in got for p in range(a, b)} == covered
        assert all(b1 < a2 for (_, b1), (a2, _) in zip(got, got[1:])) or len(got) < 2


def test_entropy_finds_keys_and_leaves_words(documents):
    scan = secret_scan.Scanner()
    assert scan.added("key is q8Zr3LmX0vTn5BwK7hYd2JcP9s here")
    for plain in ("antidisestablishmentarianism", "123e4567-e89b-12d3-a456-426614174000", "some_function_name_with_words_only", "EXAMPLEq8Zr3LmX0vTn5BwK7hYd2"):
        assert not scan.added(plain)


def test_redaction_masks_every_span(awkward):
    rows = {r.doc_id: r for r in secret_scan.redact_documents(awkward).collect()}
    assert rows[9].text.count("[REDACTED]") == 3 and "Zx81" not in rows[9].text
    assert rows[3].text is None and rows[1].text.startswith("word0")
    assert rows[9].n_chars == len(rows[9].text)
    assert rows[1]._id == "extra _id"


def test_licences_are_found_and_prose_is_left(spark, documents, awkward, empty):
    classifier = licenses.train(documents)
    shown = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "All rights reserved.": "proprietary",
    }
    for text, family in shown.items():
        assert classifier.classify(text)[0] == family
    assert classifier.classify("Licensed under the Wobbly Community Terms, revision nine.")[0] in ("unknown", "none")
    for text in ("The weather in the valley was good this year.", "Das ist ein ganz normaler Satz.", ""):
        assert classifier.classify(text)[0] == "none"
    want = {r.doc_id: {f for t, f in shown.items() if r.text and t in r.text.split("\n")} for r in documents.collect()}
    for r in licenses.scan_licenses(documents, classifier).collect():
        assert set(filter(None, r.families.split(","))) == want[r.doc_id]
        assert 0 <= r.score <= 1
    rows = {r.doc_id: r for r in licenses.scan_licenses(awkward, classifier).collect()}
    assert rows[-4].families == "apache-2.0" and rows[3].n_paragraphs == 0 and rows[4].families == ""
    assert licenses.scan_licenses(empty, licenses.train(empty)).count() == 0


def test_language_on_held_out_documents(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in langid.identify_held_out(docs).collect()}
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert len(rows) == len(langs) and 0.2 < len(held) / len(rows) < 0.5
    assert sum(rows[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    found = {r.doc_id: r for r in langid.identify_held_out(awkward).collect()}
    assert found[3].lang_pred == found[4].lang_pred == found[8].lang_pred == "und"
    assert langid.identify_held_out(empty).count() == 0


def test_mixture_selects_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    by = {}
    for r in docs.where("length(text) > 3000").orderBy("doc_id").collect():
        by.setdefault(r.lang, r.text[:3000])
    lang, _, chosen = model.predict(by["en"] + "\n" + by["de"])
    assert set(chosen) == {"en", "de"} and lang in chosen
    assert model.predict(by["fr"])[2] == ["fr"]


def test_stretches_add_up(monkeypatch):
    text = "ab cd ef " * 50
    whole = langid.grams(text)
    assert whole is not None and langid.grams("123 !?") is None
    monkeypatch.setattr(langid, "STRETCH", 90)
    parts = langid.grams(text)
    assert abs(int(parts[1].sum()) - int(whole[1].sum())) <= 12
