"""Piece vocabularies, against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import sentencepiece

from lodestar.llm import pieces
from tests.llm.test_tokens import odd_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def codec(limit=50):
    return pieces.PieceCodec(open(MODEL, "rb").read(), limit)


def test_ids_and_texts_equal_the_library_on_odd_texts():
    ours, rng = codec(), random.Random(5)
    bits = ["▁", " ", "  ", "\n", "\r\n", "\t", "the", "ing", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "é", "é", "ﬁ", "漢字", "🙂", "\U0001f3fd", "Σ", "=" * 9, " " * 17]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(4000)]
    for text in [*odd_texts(3000), *made, "", " ", "▁", "\n", "a" * 5000, "ab" * 3000, " " * 300]:
        ids = LIBRARY.encode(text)
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == LIBRARY.decode(ids), repr(text)


def test_any_ids_are_decoded_as_the_library_does():
    ours, rng = codec(), random.Random(6)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 259]) for _ in range(rng.randrange(9))]
        assert ours.decode(ids) == LIBRARY.decode(ids), ids


def test_agenda_takes_the_best_pair_and_then_the_leftmost():
    ours = codec()
    rng = random.Random(7)
    for _ in range(500):
        symbols = [rng.choice("▁abtheinrs") for _ in range(rng.randrange(70))]
        plain = list(symbols)
        while True:
            pairs = [(ours.rank_of[a + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a + b in ours.rank_of]
            if not pairs:
                break
            _, i = min(pairs)
            plain[i : i + 2] = [plain[i] + plain[i + 1]]
        assert ours.merged(symbols) == plain


def test_words_and_texts_that_differ_from_the_library_are_told(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "  one"), (4, "")], "doc_id long, text string")
    ours = codec()
    assert ours.encode("one two  ") and ours.encode("one two ") and not ours.check() and not ours.wrong
    ours.id_of["▁two"] = 7
    ours.words.clear()
    ours.words.old = {}
    for text in ("one two", "two", "one"):
        ours.encode(text)
    ours.check()
    assert ours.wrong == {"two"} and not ours.agrees("one two", []) and ours.agrees("one", [])
    assert not ours.agrees("  one", [7]) and ours.agrees("  one", LIBRARY.encode("  one"))
    assert all(r.agrees for r in pieces.encode_documents(docs, MODEL).collect())


def test_whole_tables(documents, awkward, empty):
    for docs in (documents, awkward):
        want = []
        for r in docs.collect():
            ids = LIBRARY.encode(r.text or "")
            want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest(), True))
        got = pieces.encode_documents(docs, MODEL, digests=True).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    assert pieces.encode_documents(empty, MODEL).count() == 0
    rows = {r.doc_id: r for r in pieces.encode_documents(awkward, MODEL).collect()}
    assert rows[3].ids == [] and rows[3].decoded == "" and rows[4].n_tokens == 0
    text = awkward.where("doc_id = 11").first().text
    assert rows[11].decoded == text and rows[11].ids == LIBRARY.encode(text)
