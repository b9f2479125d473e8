"""The pipeline's quality stage: every rule counts, alone and by host."""

from lodestar.llm import quality

GOOD = " ".join(f"word{k}" for k in range(40))


def kept(spark, rows):
    return {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}


def test_symbols_duplicate_lines_and_word_lengths(spark):
    texts = [
        GOOD,
        " ".join(f"word{k} #" for k in range(30)),
        "\n".join([f"some line {k} of four words" for k in range(12)] + ["short"] * 10),
        " ".join("x" * 30 + str(k) for k in range(30)),
    ]
    assert kept(spark, [(k, t, None) for k, t in enumerate(texts)]) == {0}


def test_failures_of_all_rules_count_for_the_host(spark):
    symbols = " ".join(f"word{k} #" for k in range(30))
    rows = [(k, GOOD, "fine") for k in range(200)] + [(1000 + k, symbols if k < 90 else GOOD, "bad") for k in range(100)]
    assert kept(spark, rows) == set(range(200))
