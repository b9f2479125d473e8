"""BPE encoding and decoding through a memory-mapped transducer lexicon (operator 4).

Frequent words of the corpus are encoded once and compiled into a minimal
acyclic automaton that shares prefixes and suffixes. Its arcs carry additive
outputs whose sum along a word is the word's entry in a table of identifiers.
The automaton is one flat byte string: tasks write it to a temporary file, map
it, and unlink it, so a lost executor only maps it again. Words outside the
lexicon are merged exactly by heap and linked list.

Defined results: null and empty texts encode to no identifiers and decode to
the empty text. A special token's literal string becomes its identifier, as
the tokenizers library does by default. Rows are mapped one by one, so repeated
rows and ties need no rule; very long texts are encoded whole, stretch by
stretch; extra columns of any name are ignored; an empty table gives an empty result and an
empty lexicon.
"""

from __future__ import annotations

import hashlib
import mmap
import re
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.bpe import SPACES, Merges
from lodestar.llm.common import BoundedCache, checkpoint, map_rows

#: The byte-level split of the format, a fixed value.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: A coarser cut of the same text: every piece lies inside one stretch and depends on nothing outside it.
STRETCHES = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
MAGIC = b"LEX1"
NO_RANK = 1 << 40
SINGLE = [bytes([b]) for b in range(256)]


def compile_lexicon(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """Minimal acyclic transducer over sorted distinct (word, identifiers) pairs, as one byte string.

    Words come in byte order; only the path of the last word is still open, and a
    state is frozen, and merged with an equal one, once the next word leaves it.
    """
    words, ids = [], []
    for word, value in sorted(entries):
        words.append(word)
        ids.append(value)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # frozen: (final, ((byte, state), ...))
    path: list[list] = [[False, []]]  # open states: [final, frozen arcs], the last arc still open

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    def close(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            done = freeze(path.pop())
            path[-1][1].append((word[len(path) - 1], done))

    before = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        close(shared, before)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        before = word
    close(0, before)
    root = freeze(path[0])

    below = []  # words that each state accepts; arcs lead to states frozen earlier
    for final, arcs in states:
        below.append(final + sum(below[to] for _, to in arcs))
    first, labels, targets, outputs = array("I", [0]), bytearray(), array("I"), array("I")
    for final, arcs in states:
        passed = int(final)
        for byte, to in arcs:
            labels.append(byte)
            targets.append(to)
            outputs.append(passed)
            passed += below[to]
        first.append(len(labels))
    final_flags = bytes(final for final, _ in states)
    starts, flat = array("I", [0]), b"".join(ids)
    for value in ids:
        starts.append(starts[-1] + len(value))
    head = struct.pack("<6I", root, len(states), len(labels), len(words), len(flat), 0)
    return b"".join([MAGIC, head, first.tobytes(), targets.tobytes(), outputs.tobytes(), starts.tobytes(), bytes(labels), final_flags, flat])


class Lexicon:
    """Reads a compiled transducer through a memory map."""

    def __init__(self, content: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:4] != MAGIC:
            raise ValueError("not a lexicon")
        self.root, n_states, n_arcs, self.size, n_flat, _ = struct.unpack("<6I", self.map[4:28])
        view, at = memoryview(self.map), 28
        parts = []
        for n in (n_states + 1, n_arcs, n_arcs, self.size + 1):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.outputs, self.starts = parts
        self.labels, self.finals, self.flat = at, at + n_arcs, at + n_arcs + n_states
        self.n_states, self.n_arcs = n_states, n_arcs

    def get(self, word: bytes) -> bytes | None:
        """The word's identifiers as little-endian 32-bit integers, or None if it isn't an entry."""
        state, total, find, labels = self.root, 0, self.map.find, self.labels
        first, outputs, targets = self.first, self.outputs, self.targets
        for byte in word:
            arc = find(SINGLE[byte], labels + first[state], labels + first[state + 1]) - labels
            if arc < 0:
                return None
            total += outputs[arc]
            state = targets[arc]
        if not self.map[self.finals + state]:
            return None
        return self.map[self.flat + self.starts[total] : self.flat + self.starts[total + 1]]


class Codec:
    """Encodes whole texts to identifiers and decodes them."""

    def __init__(self, vocabulary: bytes, lexicon: bytes | None, limit: int = 700_000) -> None:
        self.merges = Merges(vocabulary)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.stretches = BoundedCache(self._stretch, limit)

    def merged(self, piece: str) -> bytes:
        """Exact merges of a piece that the lexicon doesn't hold: short ones by scanning their ranks, long ones by heap."""
        symbols = self.merges.symbols(piece.encode("utf-8", "replace"))
        if len(symbols) > 40:
            self.merges.merge(symbols)
            symbols = [s for s in symbols if s >= 0]
        else:
            size, rank_of, merged_of = self.merges.size, self.merges.rank_of.get, self.merges.merged
            ranks = [rank_of(a * size + b, NO_RANK) for a, b in zip(symbols, symbols[1:])]
            while ranks and (rank := min(ranks)) != NO_RANK:
                i = ranks.index(rank)
                new = symbols[i] = merged_of[rank]
                del symbols[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = rank_of(new * size + symbols[i + 1], NO_RANK)
                if i:
                    ranks[i - 1] = rank_of(symbols[i - 1] * size + new, NO_RANK)
        return array("I", symbols).tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.lexicon is not None and (found := self.lexicon.get(piece.encode("utf-8", "replace"))) is not None:
            return found
        return self.merged(piece)

    def _stretch(self, stretch: str) -> bytes:
        bare = stretch[1:] if stretch[0] == " " else stretch
        if bare.isalpha():  # the common shapes, cut without the pattern
            return self._piece(stretch)
        if bare[-1:] in (".", ",") and bare[:-1].isalpha():
            return self.stretches[stretch[:-1]] + self.stretches[stretch[-1]]
        pieces = PIECES.findall(stretch)
        return self._piece(stretch) if len(pieces) == 1 else b"".join(map(self.stretches.__getitem__, pieces))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.stretches.__getitem__, STRETCHES.findall(text)))

    def encode(self, text: str) -> bytes:
        specials = self.merges.specials
        if not any(token in text for token in specials):
            return self._plain(text)
        return b"".join(
            struct.pack("<I", specials[part]) if part in specials else self._plain(part)
            for part in self.merges.special_split.split(text)
        )

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.merges.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def word_frequencies(docs: DataFrame, text_col: str = "text", held: int = 200_000, longest: int = 48) -> DataFrame:
    """word, n over all whole texts, by lossy counting.

    Each task counts in windows of `held` distinct words; what occurred once in a
    window is not sent on, nor are stretches of more than `longest` characters even
    held, so texts without spaces cost no memory. So a count falls short by one a window at most: no word
    that is frequent anywhere is missed, and the rare ones aren't shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            often = {w: n for w, n in counts.items() if n > 1}
            return pa.RecordBatch.from_arrays([pa.array(often.keys(), pa.string()), pa.array(often.values(), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(w for w in STRETCHES.findall(text) if len(w) <= longest)
                    if len(counts) > held:
                        yield out(counts)
                        counts = Counter()
        yield out(counts)

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: bytes, entries: int = 200_000, longest: int = 48, text_col: str = "text") -> bytes:
    """Compile the most frequent words of the corpus, `entries` at most (words of equal count go in or out together).

    All texts are read; `entries` and `longest` bound the lexicon, and so what
    reaches the driver. A word that misses the cut is merged like any unseen one,
    so the bound changes speed and never results.
    """
    counted = checkpoint(word_frequencies(docs, text_col, longest=longest).where("n > 1"))
    # The least count whose words still fit, from how many words have each count: few rows, where a
    # sorted limit would bring `entries` rows of every partition to the driver.
    sizes = counted.groupBy("n").agg(F.count("*").alias("words"))
    running = sizes.withColumn("total", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = running.where(F.col("total") <= entries).agg(F.min("n").alias("least")).first().least
    top = counted.where(F.col("n") >= least).select("word").collect() if least is not None else []
    codec = Codec(vocabulary, None)
    return compile_lexicon((row.word.encode(), codec.merged(row.word)) for row in top if len(PIECES.findall(row.word)) == 1)


_codecs: dict[tuple[str, str], Codec] = {}


def codec_for(vocabulary: bytes, lexicon: bytes) -> Codec:
    key = (hashlib.sha256(vocabulary).hexdigest(), hashlib.sha256(lexicon).hexdigest())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, lexicon)
    return _codecs[key]


def encode_documents(
    docs: DataFrame, vocabulary: str, entries: int = 200_000, text_col: str = "text", id_col: str = "doc_id", digests: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for every whole text; with `digests`, SHA-256 of both instead."""
    with open(vocabulary, "rb") as file:
        content = file.read()
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((content, build_lexicon(docs, content, entries, text_col=text_col)))

    def rows(ids: list, texts: list) -> list:
        codec = codec_for(*shared.value)
        encoded = [codec.encode(t) if t else b"" for t in texts]
        decoded = [codec.decode(e) for e in encoded]
        counts = [len(e) // 4 for e in encoded]
        if digests:
            return [
                ids, counts, [hashlib.sha256(e).hexdigest() for e in encoded],
                [hashlib.sha256(d.encode("utf-8", "replace")).hexdigest() for d in decoded],
            ]
        return [ids, counts, [memoryview(e).cast("I").tolist() for e in encoded], decoded]

    key = (id_col, to_arrow_type(docs.schema[id_col].dataType))
    kind = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long"
    if digests:
        schema = pa.schema([key, ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        return map_rows(docs, [id_col, text_col], f"{kind}, ids_sha256 string, decoded_sha256 string", rows, schema)
    schema = pa.schema([key, ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])
    return map_rows(docs, [id_col, text_col], f"{kind}, ids array<long>, decoded string", rows, schema)
