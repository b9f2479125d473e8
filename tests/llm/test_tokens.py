import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe, lexicon

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = "abcdeéΣΟσ sS't're\x1c\x1d\x85\xa0  ́가각\n\t  123½!?;İIßẞ中文ﬁ​﻿🙂"


def odd_texts(n: int):
    rng = random.Random(4)
    for k in range(n):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(40)))
        yield text + "<|endoftext|>" + text if k % 7 == 0 else text


def test_counts_equal_the_library_on_odd_texts():
    library, ours = Tokenizer.from_file(WORD), bpe.TokenCounter(open(WORD, "rb").read(), limit=50)
    for text in odd_texts(3000):
        assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_counts_on_whole_tables(spark, documents, awkward, empty):
    library = Tokenizer.from_file(WORD)
    for docs in (documents, awkward):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        rows = bpe.token_counts(docs, WORD).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert bpe.token_counts(empty, WORD).count() == 0


def test_codec_equals_the_library_on_odd_texts():
    content = open(BYTE, "rb").read()
    plain = lexicon.Codec(content, None)
    words = sorted({w for t in odd_texts(300) for w in lexicon.STRETCHES.findall(t)})
    ours = lexicon.Codec(content, lexicon.compile_lexicon((w.encode(), plain.merged(w)) for w in words[::2]), limit=50)
    library = Tokenizer.from_file(BYTE)
    for text in odd_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        encoded = ours.encode(text)
        assert encoded == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert ours.decode(encoded) == library.decode(ids, skip_special_tokens=False)


def test_codec_on_whole_tables(documents, awkward, empty):
    library = Tokenizer.from_file(BYTE)
    for docs in (documents, awkward):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in lexicon.encode_documents(docs, BYTE, entries=500, digests=True).collect())
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((str(r.doc_id), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want)
    assert lexicon.encode_documents(empty, BYTE, digests=True).count() == 0
    row = lexicon.encode_documents(documents.where("doc_id = 1"), BYTE).first()
    assert row.decoded == documents.where("doc_id = 1").first().text


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_transducer_is_minimal_and_exact(n):
    rng = random.Random(n)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))).encode() for _ in range(n)}
    table = {w: hashlib.md5(w).digest()[: 4 * rng.randrange(1, 4)] for w in words}
    made = lexicon.Lexicon(lexicon.compile_lexicon(table.items()))
    assert all(made.get(w) == v for w, v in table.items())
    assert all(made.get(w + b"x") is None and made.get(w[:-1] + b"d") is None for w in words)
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)} | {b""}
    assert made.n_states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_long_stretches_are_not_counted(spark):
    docs = spark.createDataFrame([("ab " * 5 + "Q" * 60 + " " + "Q" * 60,)], "text string")
    assert {r.word.strip(): r.n for r in lexicon.word_frequencies(docs).collect()} == {"ab": 4}
