"""The pipeline packs tokens, not words."""

import corpus_pipeline
from lodestar.llm import bpe
from lodestar.llm.queries import vocabulary


def test_lengths_are_tokens(spark):
    docs = spark.createDataFrame([(1, "antidisestablishmentarianism " * 40), (2, "z1q9" * 3000), (3, "a b c"), (4, None)], "doc_id long, text string")
    want = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs, vocabulary("word_bpe_49k.json")).collect() if r.n_tokens}
    rows, got = corpus_pipeline.pack(spark, docs, "").collect(), {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == want and got[2] > 1000
    assert all(r.bin_offset + r.n_tokens <= r.bin_capacity for r in rows)
