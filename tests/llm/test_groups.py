"""Operators that compare documents, against plain Python over all of them."""

import hashlib
import random
import re
import unicodedata
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from lodestar.llm import fingerprint, line_dedup, packing, quality, simhash


def plain_lines(rows):
    """Rows (id, text) in order of id, then text hash; all distinct."""
    seen, out = {}, {}
    key = lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(r[1].encode(), 42) >> 63 else 0))
    for i, text in sorted(rows, key=key):
        lines = text.split("\n")
        covered = set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if window in seen:
                covered |= {p, p + 1, p + 2}
            seen.setdefault(window, (i, p))
        out[i, text] = "\n".join(x for p, x in enumerate(lines) if p not in covered)
    return out


def test_line_dedup(spark, documents, awkward, empty):
    rng = random.Random(3)
    made = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for k in range(60)]
    for docs in (documents, awkward, spark.createDataFrame(made, "doc_id long, text string")):
        rows = docs.select("doc_id", "text").collect()
        want = plain_lines({(r.doc_id, r.text) for r in rows if r.text is not None})
        got = line_dedup.dedupe_lines(docs)
        out = got.select("doc_id", "text", "n_lines", "n_removed").collect()
        expected = [(str(r.doc_id), want[r.doc_id, r.text] if r.text is not None else None) for r in rows]
        assert sorted(map(str, expected)) == sorted(str((str(r.doc_id), r.text)) for r in out)
        assert all(r.n_removed <= r.n_lines for r in out)
        assert set(docs.columns) <= set(got.columns)
    assert line_dedup.dedupe_lines(empty).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, documents, awkward, empty):
    for docs in (documents, awkward):
        rows = quality.quality_verdicts(docs).collect()
        want = sorted(str((r.doc_id, *plain_quality(r.text))) for r in docs.collect())
        assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
        assert all(not r.kept for r in rows if r.base_failed)
    assert quality.quality_verdicts(empty).count() == 0
    assert quality.keep_good(awkward).columns == awkward.columns


def test_bad_hosts_take_their_documents_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(k, good, "fine") for k in range(200)] + [(1000 + k, "too short" if k < 90 else good, "bad") for k in range(100)]
    rows += [(2000, "short", "tiny"), (2001, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert all(kept[k] for k in range(200)) and not any(kept[1000 + k] for k in range(100))
    assert kept[2001] and not kept[2000]
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, k in kept.items() if k}


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, most=2):
    values, up = sorted(values), {}
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {v: find(v) for v in values}


def check_components(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    roots = plain_roots({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(str((i, f"{f:016x}", least.get(roots[f]))) for i, f in fps)
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want


def test_simhash_components(spark, documents, awkward, empty):
    check_components(documents)
    check_components(awkward)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("2") == 0 and ids.count("1") == 1  # 1 and both rows of 2 are one text


def test_simhash_loses_no_link_in_crowded_variants(spark):
    rng = random.Random(9)
    for crowd in (3, 64):
        values = set()
        for _ in range(6):
            centre = rng.getrandbits(64)
            values |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(60)}
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        table = spark.createDataFrame([(signed(v),) for v in values], "_fp long")
        edges = simhash.links(table, pairs_up_to=crowd)
        back = lambda v: v & (2**64 - 1)
        found = {r.node: r.root for r in simhash.components(edges).collect()}
        got = {}
        for v in values:
            got.setdefault(found.get(signed(v), signed(v)), set()).add(v)
        want = {}
        for v, root in plain_roots(values).items():
            want.setdefault(root, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert all((back(r.u) ^ back(r.v)).bit_count() <= 2 for r in edges.collect())


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    chain = list(range(300))
    rng.shuffle(chain)
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, 1000 + k) for k in range(1, 50)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[k] == 0 for k in range(1, 300)) and all(found[1000 + k] == 1000 for k in range(1, 50))


def test_form_c_is_the_librarys(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.normalize("NFD", chr(c)) != chr(c) or 0x1100 <= c < 0x1200)]
    marks = [c for c in pool if unicodedata.combining(c)]
    plain = list("aeiouAEcnsz ̣̱́̈̄")
    texts = ["".join(rng.choice(rng.choice([pool, marks, plain, plain])) for _ in range(rng.randrange(12))) for _ in range(600)]
    texts += ["각", "각ᆨ", "Å", "̈́", "ཱྀ̧", "plain", "é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(4)
    for r in df.select("x", fingerprint.normal_form_c(F.col("x")).alias("y")).collect():
        assert r.y == unicodedata.normalize("NFC", r.x), ascii(r.x)


def plain_canonical(text):
    folded = unicodedata.normalize("NFD", text or "").upper().replace("ẞ", "SS").lower().replace("ς", "σ")
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", folded)).strip(" ")


def test_canonically_equivalent_texts_share_a_digest(spark):
    """The upper case of U+0345 is a letter: folded first, it would stop the reordering."""
    pairs = [("α\u0345\u0301", "\u1fb4"), ("Å", "A\u030a"), ("\u1e9b\u0323", "\u017f\u0323\u0307"), ("가", "\u1100\u1161"), ("ω\u0345\u0342", "\u1ff7")]
    assert all(unicodedata.normalize("NFC", a) == unicodedata.normalize("NFC", b) for a, b in pairs)
    rows = [(k, x) for k, pair in enumerate(pairs) for x in pair]
    found = {}
    for r in fingerprint.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in found.values()) and len({min(f) for f in found.values()}) == len(pairs)
    texts = [x for _, x in rows] + ["ΑΙ\u0301", "ᾼ\u0301", "ǰ", "ΰ"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert all(r.y == plain_canonical(r.x) for r in df.select("x", fingerprint.canonical(F.col("x")).alias("y")).collect())


def test_edits_and_likeness(documents, awkward, empty):
    for docs in (documents, awkward):
        rows = docs.select("doc_id", "text").distinct().collect()
        signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
        first = {}
        for r in rows:
            if r.doc_id is not None:
                first[r.doc_id] = min(first.get(r.doc_id, (1 << 65, "")), (signed(r.text or ""), r.text or ""))
        ids = sorted(first)
        after = {a: first[b][1] for a, b in zip(ids, ids[1:] + ids[:1])}
        want = {}
        for r in rows:
            text = r.text or ""
            k = len(text) // 4
            edited = text[: len(text) - k] + (after.get(r.doc_id, "")[:k] if k else "")
            want[str(r.doc_id), len(text)] = (hashlib.sha256(edited.encode()).hexdigest(), plain_canonical(text), plain_canonical(edited), plain_canonical(after[r.doc_id]) if r.doc_id in after else None)
        out = fingerprint.edit_likeness(docs).collect()
        assert len(out) == docs.count()
        prints = {}
        for r in out:
            sha, own, edited, following = want[str(r.doc_id), r.n_chars]
            assert r.edited_sha256 == sha
            assert prints.setdefault(own, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
            assert r.near_edited == float(own == edited) and r.near_next == float(following is not None and own == following)
        assert len(set(prints.values())) == len(prints)
        groups = {}
        for r in out:
            groups.setdefault(r.fingerprint, []).append(r)
        for members in groups.values():
            assert {m.group_size for m in members} == {len(members)}
            assert {m.group_id for m in members} == {min((m.doc_id for m in members if m.doc_id is not None), default=None)}
    assert fingerprint.edit_likeness(empty).count() == 0


def check_packing(rows, wanted, capacities):
    assert all(r.bin_capacity in capacities and r.n_tokens > 0 for r in rows)
    totals = {}
    for r in rows:
        totals[str(r.doc_id), r.n_copy if hasattr(r, "n_copy") else r["copy"]] = totals.get((str(r.doc_id), r["copy"]), 0) + r.n_tokens
    assert sorted((i, n) for (i, _), n in totals.items()) == sorted((str(i), n) for i, n in wanted if n)
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in members:
            assert r.bin_offset == end
            end += r.n_tokens
        assert {r.bin_capacity for r in members} == {min(c for c in capacities if c >= end)}
    return bins


def test_packing_places_everything_once(spark, empty):
    rng = random.Random(8)
    wanted = [(k, rng.choice([0, 1, 5, 40, 700, 900, 4100, 8192, 20_000])) for k in range(300)]
    df = spark.createDataFrame(wanted, "doc_id long, n_tokens long")
    rows = packing.pack(df, shard_rows=100).collect()
    bins = check_packing(rows, wanted, packing.LENGTHS)
    used, room = sum(r.n_tokens for r in rows), sum(m[0].bin_capacity for m in bins.values())
    assert used / room > 0.9
    assert packing.pack(empty.select("doc_id", F.lit(1).alias("n_tokens"))).count() == 0
    odd = spark.createDataFrame([(1, None), (1, -3), (2, 7), (2, 7), (None, 9)], "doc_id long, n_tokens long")
    rows = packing.pack(odd).collect()
    assert sorted((str(r.doc_id), r["copy"], r.n_tokens) for r in rows) == [("2", 0, 7), ("2", 1, 7), ("None", 0, 9)]


def test_one_shard_is_best_fit():
    bins, offsets, final = packing.pack_shard([900, 600, 400, 100, 20], (512, 1024), lambda c: c + 64)
    assert bins[0] != bins[1] and bins[2] == bins[1] and bins[3] == bins[0] and bins[4] == bins[0]
    assert final == [1024, 1024] and offsets[3] == 900
    assert packing.pack_shard([30], (512, 1024))[2] == [512]


def test_bytes_are_compared_inside_a_digest(spark, monkeypatch):
    import pytest

    docs = spark.createDataFrame([(1, "one text"), (2, "another"), (3, "One  text")], "doc_id long, text string")
    rows = {r.doc_id: (r.group_id, r.group_size) for r in fingerprint.duplicate_groups(docs).collect()}
    assert rows == {1: (1, 2), 3: (1, 2), 2: (2, 1)}
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.concat(F.lit("d"), F.substring(c, 1, 0)))
    with pytest.raises(Exception, match="one digest holds different texts"):
        fingerprint.duplicate_groups(docs).collect()


def plain_pack(lengths, capacities, cost):
    """Best fit written out: scan all open bins for the least room, all lengths for the least cost by expected token."""
    bins, to_come = [], sorted(lengths, reverse=True)
    while to_come:
        x = to_come.pop(0)
        fitting = [b for b in bins if b["room"] >= x]
        if fitting:
            b = min(fitting, key=lambda b: (b["room"], b["k"]))
        else:
            best = None
            for c in sorted(c for c in capacities if c >= x):
                gap, expected = c - x, 0
                for y in sorted(y for y in to_come if y <= c - x):
                    expected += y
                rate = cost(c) / (x + min(gap, expected))
                if best is None or rate < best[0]:
                    best = (rate, c)
            b = {"room": best[1], "k": len(bins), "items": []}
            bins.append(b)
        b["items"].append(x)
        b["room"] -= x
    return sorted((min(c for c in capacities if c >= sum(b["items"])), sorted(b["items"])) for b in bins)


def test_packing_equals_a_scan_of_all_bins(spark):
    rng = random.Random(11)
    for trial in range(6):
        wanted = [(k, rng.choice([3, 60, 500, 700, 1200, 2500, rng.randrange(1, 8193)])) for k in range(120)]
        rows = packing.pack(spark.createDataFrame(wanted, "doc_id long, n_tokens long")).collect()
        bins = {}
        for r in rows:
            bins.setdefault((r.bin_id, r.bin_capacity), []).append(r.n_tokens)
        got = sorted((c, sorted(items)) for (_, c), items in bins.items())
        assert got == plain_pack([n for _, n in wanted], packing.LENGTHS, packing.sequence_cost), trial


def test_packing_of_documents(spark, awkward, empty):
    """Rows of one id and different lengths are different copies."""
    rows = packing.pack(spark.createDataFrame([(1, 900), (1, 700), (1, 700), (None, 5), (None, 6)], "doc_id long, n_tokens long")).collect()
    assert sorted((str(r.doc_id), r["copy"], r.n_tokens) for r in rows) == [("1", 0, 700), ("1", 1, 700), ("1", 2, 900), ("None", 0, 5), ("None", 1, 6)]
    many = packing.pack(spark.createDataFrame([(1, 3)] * 5000, "doc_id long, n_tokens long")).collect()
    assert sorted(r["copy"] for r in many) == list(range(5000))
    from lodestar.llm import bpe
    from lodestar.llm.queries import vocabulary

    counts = [(r.doc_id, r.n_tokens) for r in bpe.token_counts(awkward, vocabulary("word_bpe_49k.json")).collect()]
    check_packing(packing.pack_documents(awkward, vocabulary("word_bpe_49k.json")).collect(), counts, packing.LENGTHS)
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json")).count() == 0
