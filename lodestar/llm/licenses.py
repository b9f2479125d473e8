"""Licence scans by a trained paragraph classifier (operator 6).

A paragraph is a line, or a run of neighbouring lines that is unwrapped: comment
marks go, blank lines end it, and lines far from any licence word take no part.
Paragraphs are classified by multinomial logistic regression over sparse word
n-grams. The classes are the licence families, "unknown" (notices of other
licences, and sentences of several families in one) and "none". The training rows
are the notices below and their sentences, with words dropped, swapped and added,
against a bounded sample of the corpus's own paragraphs and the same with licence
words strewn in. A temperature is fitted on rows kept apart; the probability that
a family needs is fitted on rows kept apart against notices of licences that took
no part in training (`FOREIGN_APART`). A family only counts once the paragraph
also agrees with one of the family's templates: enough of the shorter side's word
trigrams are shared, one of which no other family has.

Lines that name a family are taken first; the lines between are joined into one
paragraph. Neighbouring lines of one family are one finding, and unknown lines that
touch them are its rest.

Defined results: null and empty texts have no paragraphs and no licence. Rows are
mapped one by one, so repeated rows need no rule; equal probabilities go to the
first family in the order below. Extra columns are ignored, whatever their names.
An empty table trains on the templates alone and gives an empty result. Very long
texts are scanned whole, line by line.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import map_rows

#: Notices of each family, from the licences' own public texts (fixed values).
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The MIT License",
        "MIT License",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 2-Clause License",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "Copyright. All rights reserved. No part of this work may be reproduced or distributed without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying is strictly prohibited.",
        "All rights reserved.",
    ),
}
#: Notices of licences outside the families, for the class "unknown" (fixed values).
FOREIGN = (
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "This package may be distributed under the terms of the Artistic License.",
    "Licensed under the Community Source Terms, revision two.",
    "Use of this data is subject to the terms of service of the provider.",
    "You may use this material under the conditions of the house license of the archive.",
)
#: Such notices that only serve to fit the probability a family needs.
FOREIGN_APART = (
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is subject to the provisions of the Zope Public License, Version 2.1.",
    "Licensed under the Open Software License version 3.0.",
    "Permission is granted to reprint this material for classroom use with the written consent of the society.",
    "Licensed under the Wobbly Community Terms.",
    "Redistribution of this dataset is governed by the agreement of the consortium.",
    "The use of this font is covered by the SIL Open Font License.",
)
#: Licence words strewn into ordinary paragraphs, so that they alone make no notice.
CUES = ("licensed", "license", "licence", "copyright", "permission", "redistribute", "rights", "terms")
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
MARKS = re.compile(r"^\s*(?://+|/?\*+/?|#+|--+|;+|%+|<!--|\.\.|'+|REM\b|dnl\b)?\s*")
NONE, UNKNOWN = "none", "unknown"


def words_of(paragraph: str) -> list[str]:
    return WORDS.findall(paragraph.lower())


def sentences_of(notice: str) -> list[str]:
    return [s for s in re.split(r"(?<=[a-zA-Z]{2}[.;:])\s+", notice) if len(words_of(s)) >= 6]


def features(words: list[str], vocabulary: dict[str, int]) -> list[int]:
    """Places of the known word unigrams and bigrams, each once."""
    known = [vocabulary.get(w) for w in words]
    found = {k for k in known if k is not None}
    for i, (a, b) in enumerate(zip(known, known[1:])):
        if a is not None and b is not None and (pair := vocabulary.get(f"{words[i]} {words[i + 1]}")) is not None:
            found.add(pair)
    return sorted(found)


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)} if words else set()


class Templates:
    """Trigrams of every template, and those that one family alone has."""

    def __init__(self) -> None:
        self.of = {f: [trigrams(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}
        homes: dict[tuple[str, ...], set[str]] = {}
        for family, sets in self.of.items():
            for t in set().union(*sets):
                homes.setdefault(t, set()).add(family)
        self.own = {f: {t for t, at in homes.items() if at == {f}} for f in self.of}

    def likeness(self, words: list[str], family: str) -> float:
        """Greatest share of the shorter side's trigrams that a template and the paragraph have in common."""
        mine, best = trigrams(words), 0.0
        if mine.isdisjoint(self.own[family]):
            return 0.0
        for t in self.of[family]:
            both = t & mine
            if not both.isdisjoint(self.own[family]):
                best = max(best, len(both) / min(len(t), len(mine)))
        return best


class Classifier:
    def __init__(self, families: list[str], vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, confirm: float, gate: frozenset[str]) -> None:
        self.families, self.vocabulary, self.weights, self.bias = families, vocabulary, weights, bias
        self.temperature, self.threshold, self.confirm, self.gate = temperature, threshold, confirm, gate
        self.templates = Templates()

    def probabilities(self, places: list[int]) -> np.ndarray:
        z = (self.weights[places].sum(axis=0) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def judge(self, words: list[str]) -> tuple[str, float]:
        """(family, "unknown" or "none"; calibrated probability)."""
        if self.gate.isdisjoint(words):
            return NONE, 1.0
        p = self.probabilities(features(words, self.vocabulary))
        k = int(np.argmax(p[: len(self.families)]))
        if p[k] >= self.threshold and self.templates.likeness(words, self.families[k]) >= self.confirm:
            return self.families[k], float(p[k])
        return (NONE, float(p[-1])) if p[-1] >= 0.5 else (UNKNOWN, float(1 - p[-1]))

    def classify(self, paragraph: str) -> tuple[str, float]:
        return self.judge([w for line in paragraph.split("\n") for w in words_of(MARKS.sub("", line, count=1))])

    def scan(self, text: str, near: int = 3) -> tuple[int, list[tuple[str, float, int, int]]]:
        """Paragraphs, and (family or "unknown", probability, first line, last line) of the notices; lines count from 0."""
        lines = text.split("\n")
        n = sum(1 for x in lines if x.strip())
        if self.gate.isdisjoint(WORDS.findall(text.lower())):
            return n, []
        words = [words_of(MARKS.sub("", x, count=1)) for x in lines]
        cued = [k for k, w in enumerate(words) if not self.gate.isdisjoint(w)]
        found: list[tuple[str, float, int, int]] = []
        while cued:
            run = [cued.pop(0)]
            while cued and cued[0] - run[-1] <= near and all(words[k] for k in range(run[-1], cued[0])):
                run.append(cued.pop(0))
            found += self.run(words, run[0], run[-1])
        return n, found

    def run(self, words: list[list[str]], first: int, last: int) -> list[tuple[str, float, int, int]]:
        """The notices in one run of lines: lines that name a family, then what lies between them as one paragraph."""
        out: list[tuple[str, float, int, int]] = []
        each = [self.judge(words[k]) for k in range(first, last + 1)]
        at = first
        while at <= last:
            end = at
            if each[at - first][0] not in (NONE, UNKNOWN):
                kind, p = each[at - first]
            else:
                while end < last and each[end + 1 - first][0] in (NONE, UNKNOWN):
                    end += 1
                kind, p = self.judge([w for k in range(at, end + 1) for w in words[k]]) if end > at else each[at - first]
                if kind == NONE and any(e[0] == UNKNOWN for e in each[at - first : end + 1 - first]):
                    kind, p = max(e for e in each[at - first : end + 1 - first] if e[0] == UNKNOWN)
            if kind != NONE:
                if out and out[-1][3] == at - 1 and out[-1][0] == kind:
                    out[-1] = (kind, max(p, out[-1][1]), out[-1][2], end)
                elif out and out[-1][3] == at - 1 and kind == UNKNOWN:
                    out[-1] = (*out[-1][:3], end)  # the rest of a notice whose family is known
                elif out and out[-1][3] == at - 1 and out[-1][0] == UNKNOWN:
                    out[-1] = (kind, p, out[-1][2], end)
                    if len(out) > 1 and out[-2][3] == out[-1][2] - 1 and out[-2][0] == kind:
                        out[-2:] = [(kind, max(p, out[-2][1]), out[-2][2], end)]
                else:
                    out.append((kind, p, at, end))
            at = end + 1
        return out


def altered(words: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    out = [w for w in words if len(words) < 4 or rng.random() > 0.06] or list(words)
    for _ in range(rng.randrange(4)):
        out.insert(rng.randrange(len(out) + 1), rng.choice(filler))
    return out


def by_hash(words: set[str], most: int) -> list[str]:
    """The `most` words of least hash: a draw that no alphabet or frequency bends."""
    return sorted(words, key=lambda w: hashlib.md5(w.encode()).digest())[:most]


def fit(background: list[str], variants: int = 16, rounds: int = 200, seed: int = 7, confirm: float = 0.6, filler_words: int = 2000) -> Classifier:
    """Train on altered notices against `background` paragraphs; every fourth row is kept apart for calibration.

    Words put into altered notices are `filler_words` of the background's words at most, drawn by hash; one to
    three licence words are strewn into whole paragraphs of 12 words at least.
    """
    rng = random.Random(seed)
    families, templates = list(TEMPLATES), Templates()
    unknown, none = len(families), len(families) + 1
    plain = [w for w in map(words_of, background) if w and not any(templates.likeness(w, f) >= confirm for f in families)]
    filler = by_hash({w for ws in plain for w in ws}, filler_words) or ["text", "word", "other", "some"]
    rows: list[tuple[list[str], int]] = []
    notices = [(t, k) for k, f in enumerate(families) for t in TEMPLATES[f]] + [(t, unknown) for t in FOREIGN]
    for notice, k in notices:
        for part in {notice, *sentences_of(notice)}:
            words = words_of(part)
            if k < unknown and part != notice and trigrams(words).isdisjoint(templates.own[families[k]]):
                continue
            rows += [(words, k)] + [(altered(words, rng, filler), k) for _ in range(variants)]
    pieces = [words_of(s) for f in families for t in TEMPLATES[f] for s in sentences_of(t)]
    for _ in range(12 * variants):  # sentences of several families in one
        a, b = rng.sample(pieces, 2)
        rows.append((a[: len(a) // 2] + b[len(b) // 2 :], unknown))
    rows += [(w, none) for w in plain]
    for _ in range(20 * variants):  # ordinary words with licence words strewn in
        words = list(rng.choice(plain)) if plain else []
        words += [rng.choice(filler) for _ in range(max(0, 12 - len(words)))]
        for _ in range(rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(CUES))
        rows.append((words, none))
    notice = sorted({w for t, _ in notices for w in words_of(t)})
    pairs = sorted({f"{a} {b}" for t, _ in notices for a, b in zip(words_of(t), words_of(t)[1:])})
    vocabulary = {w: i for i, w in enumerate([*notice, *pairs])}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (words, _) in enumerate(rows):
        x[i, features(words, vocabulary)] = 1
    y = np.array([k for _, k in rows])
    apart = np.arange(len(rows)) % 4 == 3
    n_classes = len(families) + 2
    share = np.bincount(y[~apart], minlength=n_classes).clip(1)
    w, b = np.zeros((len(vocabulary), n_classes), np.float32), np.zeros(n_classes, np.float32)
    xt, tt, wt = x[~apart], np.eye(n_classes, dtype=np.float32)[y[~apart]], ((1 / share[y[~apart]])[:, None] / n_classes).astype(np.float32)
    for _ in range(rounds):
        z = xt @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - tt) * wt
        w -= 4.0 * (xt.T @ g + 1e-5 * w)
        b -= 4.0 * g.sum(axis=0)
    w[np.abs(w) < 1e-4] = 0
    z = (x[apart] @ w + b).astype(float)

    def spread(t: float) -> np.ndarray:
        s = z / t
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=lambda t: -np.log(spread(t)[np.arange(len(z)), y[apart]].clip(1e-12)).mean())
    # A word that few ordinary paragraphs have opens the gate; licence words always do.
    seen: dict[str, int] = {}
    for ws in plain:
        for word in set(ws):
            seen[word] = seen.get(word, 0) + 1
    gate = frozenset(w for w in notice if seen.get(w, 0) * 200 <= len(plain) and len(w) > 2) | set(CUES)
    made = Classifier(families, vocabulary, w, b, temperature, 0.5, confirm, gate)
    known = spread(temperature)[y[apart] < unknown, : len(families)].max(axis=1)
    foreign = [made.probabilities(features(altered(words_of(t), rng, filler), vocabulary))[: len(families)].max() for t in FOREIGN_APART for _ in range(variants)]
    steps = np.arange(0.3, 0.96, 0.05)
    made.threshold = float(max(steps, key=lambda t: ((known >= t).mean() + (np.array(foreign) < t).mean(), -t)))
    return made


_classifiers: dict[str, Classifier] = {}


def classifier_for(content: bytes) -> Classifier:
    key = hashlib.sha256(content).hexdigest()
    if key not in _classifiers:
        _classifiers.clear()
        _classifiers[key] = pickle.loads(content)
    return _classifiers[key]


def train(docs: DataFrame, text_col: str = "text", background: int = 1500, longest: int = 2000) -> Classifier:
    """Fit with `background` distinct lines of at most `longest` characters, those of the least hashes, as ordinary text.

    Both bounds concern the training sample alone. Hashes are cut at the share that the number of distinct lines suggests.
    """
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("_line")).where(F.length("_line").between(1, longest)).select("_line", F.xxhash64("_line").alias("_h"))
    n = max(1, lines.agg(F.approx_count_distinct("_h")).first()[0])
    cut = int(-(2**63) + min(1.0, 2 * background / n) * (2**64 - 1))
    sample = lines.where(F.col("_h") <= min(cut, 2**63 - 1)).distinct().orderBy("_h", "_line").limit(background).collect()
    return fit([row._line for row in sample])


def scan_licenses(docs: DataFrame, classifier: Classifier, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_paragraphs, n_licence, n_unknown, families, score, notices): a narrow map over whole texts.

    `notices` holds "family:first line:last line" of every finding.
    """
    content = docs.sparkSession.sparkContext.broadcast(pickle.dumps(classifier))

    def rows(ids: list, texts: list) -> list:
        own = classifier_for(content.value)
        out: list[list] = [ids, [], [], [], [], [], []]
        for text in texts:
            n, found = own.scan(text) if text else (0, [])
            named = [c for c in found if c[0] != UNKNOWN]
            out[1].append(n)
            out[2].append(len(named))
            out[3].append(len(found) - len(named))
            out[4].append(",".join(sorted({c[0] for c in named})))
            out[5].append(max((c[1] for c in named), default=0.0))
            out[6].append(",".join(f"{c[0]}:{c[2]}:{c[3]}" for c in found))
        return out

    field = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(field)), ("n_paragraphs", pa.int64()), ("n_licence", pa.int64()), ("n_unknown", pa.int64()), ("families", pa.string()), ("score", pa.float64()), ("notices", pa.string())])
    ddl = f"{id_col} {field.simpleString()}, n_paragraphs long, n_licence long, n_unknown long, families string, score double, notices string"
    return map_rows(docs, [id_col, text_col], ddl, rows, schema)
