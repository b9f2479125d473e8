"""The pipeline against a plain version made of the tests' own brute-force parts."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tokenizers import Tokenizer  # noqa: E402

from lodestar.llm import secret_scan  # noqa: E402
from lodestar.llm.queries import vocabulary  # noqa: E402
from tests.llm.test_groups import check_packing, plain_lines, plain_quality  # noqa: E402
from tests.llm.test_near import plain_groups  # noqa: E402


def test_stages_and_columns(spark, awkward, empty):
    from lodestar.llm.common import DOCUMENT_COLUMNS

    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "secret_scan", "packing"]
    for docs in (awkward.select(*DOCUMENT_COLUMNS), empty):
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, "")
            if name != "packing":
                assert docs.columns == DOCUMENT_COLUMNS
        docs.collect()


def plain_kept(rows):
    """Documents that pass all rules, alone and by their host's rate with a beta prior."""
    failed = {}
    for r in rows:
        n, chars, symbols, dup, repeated = plain_quality(r.text)
        lines = sum(1 for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        failed[r.doc_id] = n < 20 or 100 * repeated > 30 * n or 10 * symbols > n or 100 * dup > 30 * lines or not 2 * n <= chars <= 12 * n
    hosts = {}
    for r in rows:
        if r.source is not None:
            n, f = hosts.get(r.source, (0, 0))
            hosts[r.source] = n + 1, f + failed[r.doc_id]
    total, bad = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    mean = bad / total
    chance = mean * (1 - mean)
    spread = sum(f * f / n for n, f in hosts.values()) / total - mean * mean - chance * len(hosts) / total
    strength = min(max(chance / spread - 1, 1.0), total) if spread > 0 and chance > 0 else total
    rate = {h: (f + mean * strength) / (n + strength) for h, (n, f) in hosts.items()}
    return [(r.doc_id, r.text or "") for r in rows if not failed[r.doc_id] and rate.get(r.source, 0) <= 0.5]


def test_run_equals_a_plain_version(spark, sf_dir, documents):
    kept = plain_kept(documents.collect())
    out = plain_lines(set(kept))
    texts = {i: out[i, t] for i, t in kept}
    ids = sorted(texts)
    first = [ids[members[0]] for members in plain_groups([texts[i] for i in ids])]
    scanner, library = secret_scan.Scanner(), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    final = {i: secret_scan.redact(texts[i], scanner.spans(texts[i])[1], "[REDACTED]") for i in first}
    wanted = [(i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in final.items()]
    check_packing(pipeline.run(spark, sf_dir).collect(), wanted, (512, 1024, 2048, 4096, 8192))
