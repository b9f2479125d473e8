"""Token counts by heap-and-linked-list byte-pair merging (operator 1).

The merge loop keeps the word as a doubly linked list of symbols and a heap of
adjacent pairs by rank. Every successful pop removes one symbol, so the count
is the number of initial symbols minus the number of merges; the counting path
never builds identifiers.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are
mapped one by one, so repeated rows, ties and clashing extra columns need no
rule; very long texts are counted whole, stretch by stretch; an empty table gives an
empty result. A special token's literal string
inside a text counts as one token, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import BoundedCache, map_rows

#: White space as the tokenizer's regular expressions see it; a fixed value of the format.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: str.split() also breaks at these four, which the tokenizer keeps.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The word pattern in the vocabulary file, a fixed value of the format.
WORD_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in visible}
    hidden = (b for b in range(256) if b not in names)
    names.update({b: chr(256 + k) for k, b in enumerate(hidden)})
    return [names[b] for b in range(256)]


class Merges:
    """Ranks and initial symbols of a byte-level vocabulary file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        self.size = max(vocab.values()) + 1
        self.rank_of, self.merged = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank_of.setdefault(vocab[a] * self.size + vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(alphabet)}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            if all(c in back for c in token):
                self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def symbols(self, word: bytes) -> list[int]:
        out = [self.inner[b] for b in word]
        out[-1] = self.last[word[-1]]
        return out

    def merge(self, symbols: list[int]) -> int:
        """Merge in place; merged-away places become -1. Returns how many symbols are left."""
        n, size, rank_of, merged_of = len(symbols), self.size, self.rank_of.get, self.merged
        ranks = [rank_of(a * size + b, -1) for a, b in zip(symbols, symbols[1:])]
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        ranks.append(-1)  # ranks[i] is that of the pair that begins at i, as it now stands
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            rank = entry >> 32
            if ranks[i] != rank:
                continue
            j = after[i]
            merged = symbols[i] = merged_of[rank]
            symbols[j] = ranks[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                rank = ranks[i] = rank_of(merged * size + symbols[k], -1)
                if rank >= 0:
                    heappush(heap, rank << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                rank = ranks[h] = rank_of(symbols[h] * size + merged, -1)
                if rank >= 0:
                    heappush(heap, rank << 32 | h)
        return left


def lower(text: str) -> str:
    """Character by character: str.lower() alone would look at a sigma's neighbours."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class TokenCounter:
    """Counts tokens of whole texts through two bounded caches: stretches without white space, and words in them."""

    def __init__(self, content: bytes, limit: int = 400_000) -> None:
        self.merges = Merges(content)
        self.stretches = BoundedCache(self._stretch, limit)
        self.words = BoundedCache(self._word, limit // 2)
        self.spaces = re.compile(f"[{SPACES}]+")

    def _word(self, word: str) -> int:
        return self.merges.merge(self.merges.symbols(word.encode("utf-8", "replace")))

    def _stretch(self, stretch: str) -> int:
        """`stretch` is normalised, in lower case and holds no special token."""
        if stretch.isascii():
            if stretch.isalpha():
                return self.words[stretch]
            if stretch[-1] in ".,!?;:" and stretch[:-1].isalpha():
                return self.words[stretch[:-1]] + 1
        return sum(map(self.words.__getitem__, WORD_PIECES.findall(stretch)))

    def _plain(self, text: str) -> int:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = lower(text)
        stretches = text.split() if not SEPARATORS.search(text) else filter(None, self.spaces.split(text))
        return sum(map(self.stretches.__getitem__, stretches))

    def count(self, text: str) -> int:
        specials = self.merges.specials
        if not any(token in text for token in specials):
            return self._plain(text)
        return sum(1 if part in specials else self._plain(part) for part in self.merges.special_split.split(text))


_counters: dict[str, TokenCounter] = {}


def counter_for(content: bytes) -> TokenCounter:
    """One counter a Python worker, kept between tasks."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _counters:
        _counters[key] = TokenCounter(content)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text.

    `vocabulary` is the path of a word-level BPE file on the driver; its content
    (a fixed size of a few MB) goes to the executors once. A narrow map: no shuffle.
    """
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def rows(ids: list, texts: list) -> list:
        counter = counter_for(content.value)
        counts = [counter.count(t) if t else 0 for t in texts]
        sizes = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
        return [ids, sizes, counts, [c > limit for c in counts]]

    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([(id_col, to_arrow_type(docs.schema[id_col].dataType)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return map_rows(docs, [id_col, text_col], f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean", rows, schema)
