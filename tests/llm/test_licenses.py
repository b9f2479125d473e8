"""Wrapped, altered and foreign notices, prose with licence words, and a brute-force reading of single lines."""

import random
import textwrap

import pytest

from lodestar.llm import licenses


@pytest.fixture(scope="module")
def classifier(documents):
    return licenses.train(documents)


FULL = {f: max(ts, key=len) for f, ts in licenses.TEMPLATES.items()}
LONG = {f: t for f, t in FULL.items() if len(t) > 150}


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_notices(classifier, mark):
    for family, notice in LONG.items():
        text = "int main\n\n" + "\n".join(mark + x for x in textwrap.wrap(notice, 72)) + "\n\nreturn zero"
        found = classifier.scan(text)[1]
        assert {f for f, *_ in found} == {family}, (family, found)


def test_altered_notices(classifier):
    rng, right, tried = random.Random(3), 0, 0
    for family, notice in LONG.items():
        for _ in range(10):
            words = [w for w in notice.split() if rng.random() > 0.04]
            words.insert(rng.randrange(len(words)), "kindly")
            found = {f for f, *_ in classifier.scan("\n".join(textwrap.wrap(" ".join(words), 80)))[1]}
            right += found == {family}
            tried += 1
    assert right >= 0.85 * tried


def test_short_notices(classifier):
    for text, family in {
        "MIT License": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "All rights reserved.": "proprietary",
        "# SPDX-License-Identifier: BSD-3-Clause": "bsd", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY 4.0.": "cc-by",
    }.items():
        assert classifier.classify(text)[0] == family, text


def test_foreign_notices_are_no_family(classifier):
    foreign = [
        "Distributed under the terms of the Academic Free License, version 3.0, by the board of the institute.",
        "This font is licensed under the Harbour Typeface Licence, second edition, with permission of its makers.",
        "Licensed under the Wobbly Community Terms, revision nine.",
    ]
    for text in foreign:
        assert classifier.classify(text)[0] in ("unknown", "none"), text
    assert sum(classifier.classify(t)[0] == "unknown" for t in (*foreign, *licenses.FOREIGN_APART)) >= 6


def test_prose_with_licence_words_is_left(classifier):
    for text in (
        "She lost her driving license on the way to the harbour and walked home.",
        "The terms of the peace were harsh, and the rights of the old towns were not restored.",
        "He asked for permission to speak, and the copyright lawyer nodded.",
        "The weather in the valley was good this year.",
    ):
        assert classifier.classify(text)[0] in ("none", "unknown") and classifier.scan(text)[1] == [] or classifier.classify(text)[0] == "unknown", text
        assert all(f == "unknown" for f, *_ in classifier.scan(text)[1])


def test_query_equals_single_lines(classifier, documents):
    """The tables' notices are single lines: reading every line by itself gives the same families."""
    for r, d in zip(licenses.scan_licenses(documents, classifier).orderBy("doc_id").collect(), documents.orderBy("doc_id").collect()):
        want = {f for line in (d.text or "").split("\n") for f in [classifier.classify(line)[0]]} - {"none", "unknown"}
        assert set(filter(None, r.families.split(","))) == want, d.doc_id
        assert r.n_paragraphs == sum(1 for x in (d.text or "").split("\n") if x.strip())


def test_awkward_rows(classifier, awkward, empty):
    rows = {str(r.doc_id): r for r in licenses.scan_licenses(awkward, classifier).collect()}
    assert rows["3"].n_paragraphs == 0 and rows["10"].families == "" and rows["-4"].notices.startswith("apache-2.0:0:0")
    assert licenses.scan_licenses(awkward, classifier).count() == awkward.count()
    assert licenses.scan_licenses(empty, licenses.train(empty)).count() == 0
