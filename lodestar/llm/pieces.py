"""Encoding and decoding with merge-type piece vocabularies (operator 11).

A text becomes characters; an agenda of adjacent pairs, ordered by the score of
the piece they would make and then from left to right, is worked off until no
pair makes a piece. Characters without a piece become their UTF-8 bytes.

A piece can only reach over two neighbours that some longer piece of the vocabulary holds
side by side, so a text falls into parts that are merged by themselves: words
with their mark, and in them runs of such neighbours. Both are kept in bounded caches.
Where a vocabulary has pieces over word marks, texts aren't cut into words and results are the same.

Every Arrow batch is checked against the sentencepiece library: each word that a worker merges
anew is encoded by the library too, texts that aren't cut into words are encoded whole, and
the decoded text is compared with the text (column `agrees`). What is returned is
the agenda's in any case.

Defined results: null and empty texts have no ids and decode to the empty text;
very long texts are merged stretch by stretch, whole; rows are mapped one by
one, so repeated rows, ties and extra columns of any name need no rule (the result has
the id and the named columns alone); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain, groupby
from operator import add

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import BoundedCache, map_rows

#: The character that stands for a space in pieces; a fixed value of the format.
MARK = "▁"
#: So many new words are compared with the library at a time.
FRESH = 10_000
#: Parts of so many characters at most have an agenda without a heap; the rank of pairs that make no piece.
SHORT, NONE = 32, 1 << 32


class PieceCodec:
    """One vocabulary: `encode` by the agenda, `decode` from ids."""

    def __init__(self, content: bytes, limit: int = 300_000) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        size = self.library.get_piece_size()
        if self.library.normalize(" ﬁ  É ") != f"{MARK}{MARK}ﬁ{MARK}{MARK}É{MARK}":
            raise ValueError("only vocabularies that keep texts as they are, after one leading mark, are supported")
        names = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.id_of = {names[i]: i for i in plain}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(self.library.is_byte, self.byte_ids)):
            raise ValueError("only vocabularies with a piece for every byte are supported")
        scores = sorted({self.library.get_score(i) for i in plain}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        self.rank_of = {names[i]: place[self.library.get_score(i)] for i in plain if len(names[i]) > 1}
        self.surface = [b""] * size
        for i in plain:
            self.surface[i] = names[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.surface[self.library.unk_id()] = " ⁇ ".encode()
        self.decimal = [str(i) for i in range(size)]
        self.lead = {i for i in plain if names[i].startswith(MARK)}
        self.silent = {i for i in range(size) if self.library.is_control(i)}
        #: Neighbours that some piece holds: no piece reaches over any others.
        self.pairs = {piece[i : i + 2] for piece in self.rank_of for i in range(len(piece) - 1)}
        self.over_marks = any(pair[0] != MARK and pair[1] == MARK for pair in self.pairs)
        self.words = BoundedCache(self._word, limit)
        self.fresh, self.wrong = [], set()
        self.parts = BoundedCache(lambda part: self.ids(self.merged(list(part))), limit)

    def merged(self, symbols: list[str]) -> list[str]:
        """Works off the agenda: the best-scored adjacent pair first, the leftmost of equals."""
        if len(symbols) <= SHORT:
            return self._merged_short(symbols)
        rank_of, n = self.rank_of.get, len(symbols)
        ranks = list(map(rank_of, map(add, symbols, symbols[1:])))
        agenda = [rank << 32 | i for i, rank in enumerate(ranks) if rank is not None]
        if not agenda:
            return symbols
        heapify(agenda)
        ranks.append(None)  # ranks[i] is that of the pair that begins at i, as it now stands
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = heappop(agenda)
            i = entry & 0xFFFFFFFF
            if ranks[i] != entry >> 32:
                continue
            j = after[i]
            symbol = symbols[i] = symbols[i] + symbols[j]
            symbols[j] = ranks[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks[i] = rank_of(symbol + symbols[k])
                if rank is not None:
                    heappush(agenda, rank << 32 | i)
            else:
                ranks[i] = None
            h = before[i]
            if h >= 0:
                rank = ranks[h] = rank_of(symbols[h] + symbol)
                if rank is not None:
                    heappush(agenda, rank << 32 | h)
        return [s for s in symbols if s]

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """The same with an agenda that is short enough to be looked through: the ranks of all pairs in a row."""
        rank_of = self.rank_of.get
        agenda = [rank_of(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            i = agenda.index(best)
            symbol = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank_of(symbols[i - 1] + symbol, NONE)
            if i < len(agenda):
                agenda[i] = rank_of(symbol + symbols[i + 1], NONE)
        return symbols

    def _stretch(self, stretch: str) -> tuple[int, ...]:
        """Ids of characters in a row, cut where no piece reaches over."""
        pairs, begin, out = self.pairs, 0, []
        for end in range(1, len(stretch)):
            if stretch[end - 1 : end + 1] not in pairs:
                out.extend(self.parts[stretch[begin:end]])
                begin = end
        out.extend(self.parts[stretch[begin:]])
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        core, last = word[:-1], word[-1:]
        if word.isalpha():
            ids = self.ids(self.merged([MARK, *word]))
        elif core.isalpha() and core[-1] + last not in self.pairs:  # a word and the sign behind it
            ids = self.words[core] + self.parts[last]
        else:
            ids = self._stretch(MARK + word)
        self.fresh.append((word, ids))
        if len(self.fresh) >= FRESH:
            self.check()
        return ids

    def check(self) -> None:
        """Compares the words merged since the last check with the library's ids."""
        found = self.library.encode([word for word, _ in self.fresh], add_bos=False, add_eos=False, num_threads=1)
        self.wrong.update(word for (word, ids), other in zip(self.fresh, found) if list(ids) != (other if word else [self.id_of[MARK]]))
        self.fresh = []

    def agrees(self, text: str, ids: list[int]) -> bool:
        """Whether the library gives a text these ids: by its words, which `check` has seen, or whole where it isn't cut into words."""
        if self._by_words(text):
            return not self.wrong or self.wrong.isdisjoint(text.split(" "))
        return ids == self.library.encode(text, add_bos=False, add_eos=False)

    def ids(self, symbols: Iterable[str]) -> tuple[int, ...]:
        out = list(map(self.id_of.get, symbols))
        if None not in out:
            return tuple(out)
        out = []
        for symbol in symbols:
            i = self.id_of.get(symbol)
            if i is None:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                out.append(i)
        return tuple(out)

    def _by_words(self, text: str) -> bool:
        """Whether every mark begins a word of its own, so that no piece reaches from one to the next."""
        return not (self.over_marks or "  " in text or MARK in text or text.startswith(" "))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self._by_words(text):
            return list(self._stretch(MARK + text.replace(" ", MARK)))
        return list(chain.from_iterable(map(self.words.__getitem__, text.split(" "))))

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids: a first mark goes, bytes that are no UTF-8 become U+FFFD one by one, control pieces break runs of bytes."""
        if not self.silent.isdisjoint(ids):
            parts = [list(part) for silent, part in groupby(ids, self.silent.__contains__) if not silent]
        else:
            parts = [ids] if ids else []
        texts = [b"".join(map(self.surface.__getitem__, part)) for part in parts]
        if parts and parts[0][0] in self.lead:
            texts[0] = texts[0][1:]
        return "".join(map(self._text, texts))

    def _text(self, data: bytes) -> str:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return "".join(self._lenient(data))

    @staticmethod
    def _lenient(data: bytes) -> Iterable[str]:
        at = 0
        while at < len(data):
            try:
                yield data[at:].decode()
                return
            except UnicodeDecodeError as error:
                yield data[at : at + error.start].decode() + "�"
                at += error.start + 1


_codecs: dict[str, PieceCodec] = {}


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, ids, decoded, agrees; with `digests`, ids_sha256 and decoded_sha256 stand for ids and decoded.

    `vocabulary` is the path of a model file on the driver; its content (a fixed
    size of half a MB) goes to the executors once. A narrow map: no shuffle.
    """
    with open(vocabulary, "rb") as file:
        data = file.read()
    key, content = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)

    def rows(ids: list, texts: list) -> list:
        if key not in _codecs:  # one a Python worker, kept between tasks
            _codecs[key] = PieceCodec(content.value)
        codec, counts, encoded, decoded, agrees = _codecs[key], [], [], [], []
        for text in texts:
            found = codec.encode(text or "")
            back = codec.decode(found)
            counts.append(len(found))
            same = back == (text or "").replace(MARK, " ")
            agrees.append(same if codec._by_words(text or "") else same and codec.agrees(text, found))
            if digests:
                encoded.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, found)).encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            else:
                encoded.append(found)
                decoded.append(back)
        codec.check()
        if codec.wrong:
            agrees = [ok and codec.agrees(text or "", ()) if codec._by_words(text or "") else ok for ok, text in zip(agrees, texts)]
        return [ids, counts, encoded, decoded, agrees]

    kind = docs.schema[id_col].dataType
    first, second, form = ("ids_sha256", "decoded_sha256", "string") if digests else ("ids", "decoded", "array<int>")
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("n_tokens", pa.int64()), (first, pa.string() if digests else pa.list_(pa.int32())), (second, pa.string()), ("agrees", pa.bool_())])
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind.simpleString()}, n_tokens long, {first} {form}, {second} string, agrees boolean", rows, schema)
