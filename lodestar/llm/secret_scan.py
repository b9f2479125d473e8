"""Secret scans: base patterns plus sliding-window entropy (operator 3).

Base findings come from three fixed patterns. The method adds spans: candidate
runs of one character class are read through a sliding window whose character
counts are kept up to date one step at a time, so each step costs two table
look-ups; windows whose Shannon entropy reaches the class's threshold are joined
to a span. An allow-list suppresses added spans that are known placeholders,
identifiers such as UUIDs, or words; base spans always stay.

Defined results: null and empty texts have no spans. Positions are code points,
ends exclusive. Rows are mapped one by one, so repeated rows and ties need no
rule; very long texts are read whole by the patterns and a window of fixed size, an
empty table gives an empty result; extra columns of any name are ignored by the scan and kept by
``redact_documents``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import map_rows

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more; a run is matched whole or not at all
HEX = re.compile(r"[0-9a-f]{16,}")  # 16 characters or more, likewise
BASE_KINDS = ("assign", "access", "hex")
#: A text without any of these needs no run of the whole pattern.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12


@dataclass(frozen=True)
class CharacterClass:
    """A kind of candidate: its characters, its shortest run, and the entropy in bits that a window must reach."""

    name: str
    pattern: str
    shortest: int
    window: int
    bits: float


#: Measured on random strings of each class, windows fall below these in under 1 in 50 cases; words seldom reach them.
CLASSES = (
    CharacterClass("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", 20, 20, 3.0),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 24, 3.9),
)
#: Suppressed whole when any of these matches the candidate.
ALLOWED = (
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",  # UUID
    r"[A-Za-z]+",  # a word: no digit and no symbol
    r"[0-9]+",  # a number
    r"[A-Za-z]*(?:[_/-][A-Za-z]*)+",  # an identifier or path of words
    r"(?i:.*(?:example|placeholder|changeme|xxxx).*)",
)


def entropy_spans(run: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined windows of `run` whose entropy is at least `bits`.

    Entropy of a window is log2(w) - sum(c log2 c) / w; moving on by one character
    changes two counts, and so two terms of the sum.
    """
    if len(run) < window:
        return
    terms = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for c in run[:window]:
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += terms[n + 1] - terms[n]
    most = (math.log2(window) - bits) * window + 1e-9
    start, end = (0, window) if total <= most else (-1, -1)
    for i in range(window, len(run)):
        out, new = run[i - window], run[i]
        if out != new:
            n = counts[out]
            counts[out] = n - 1
            total += terms[n - 1] - terms[n]
            n = counts.get(new, 0)
            counts[new] = n + 1
            total += terms[n + 1] - terms[n]
        if total <= most:
            at = i - window + 1
            if start < 0:
                start = at
            elif at > end:
                yield start, end
                start = at
            end = i + 1
    if start >= 0:
        yield start, end


class Scanner:
    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> None:
        self.classes = [(c, re.compile(c.pattern)) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        folded = text.lower()
        if any(word in folded for word in ASSIGN_WORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        order = {kind: k for k, kind in enumerate(BASE_KINDS)}
        return sorted(found, key=lambda x: (x[0], order[x[2]]))

    def added(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for kind, pattern in self.classes:
            for m in pattern.finditer(text):
                run = m.group()
                if self.allowed is None or not self.allowed.fullmatch(run):
                    found += [(m.start() + a, m.start() + b, kind.name) for a, b in entropy_spans(run, kind.window, kind.bits)]
        return found

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans), each as (start, end, kind) by start, then kind as listed."""
        base = self.base(text)
        order = {kind: k for k, kind in enumerate([*BASE_KINDS, *(c.name for c, _ in self.classes)])}
        return base, sorted(base + self.added(text), key=lambda x: (x[0], order[x[2]], x[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scanner: Scanner | None = None) -> DataFrame:
    """One row a document: counts of the base kinds, the digest of the base spans, and all spans. A narrow map."""
    scanner = scanner or Scanner()

    def rows(ids: list, texts: list) -> list:
        out: list[list] = [[] for _ in range(7)]
        for i, text in zip(ids, texts):
            base, spans = scanner.spans(text) if text else ([], [])
            kinds = [kind for *_, kind in base]
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            for column, value in zip(out, (i, *map(kinds.count, BASE_KINDS), digest, listed(spans), len(spans) - len(base))):
                column.append(value)
        return out

    counts = ["n_assign", "n_access", "n_hex"]
    schema = pa.schema([(id_col, to_arrow_type(docs.schema[id_col].dataType)), *((c, pa.int64()) for c in counts), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    ddl = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"
    return map_rows(docs, [id_col, text_col], ddl, rows, schema)


def redact(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """Overlapping spans become one mask."""
    out, done, held = [], 0, -1
    for start, end, _ in spans:
        if start > held:
            if held >= 0:
                out.append(mask)
                done = held
            out.append(text[done:start])
            held = end
        held = max(held, end)
    return text if held < 0 else "".join([*out, mask, text[held:]])


def redact_documents(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]", scanner: Scanner | None = None) -> DataFrame:
    """The same columns with every span masked; n_chars, where it is there, follows the text."""
    scanner = scanner or Scanner()

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: redact(t, scanner.spans(t)[1], mask) if t else t)

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
