"""SimHash near-duplicates through deletion-variant signatures (operator 8).

Fingerprints link when at most two bits differ. Cut into two segments, one of
them then differs in at most one bit, so the two agree on some segment with one
bit left out. Every distinct fingerprint is indexed under its 64 one-wildcard
segment variants; an equality join on the variants gives candidates, which are
verified on all 64 bits.

Copies are folded into distinct fingerprints first. Variants that only two
fingerprints share give their pair from the minimum and maximum, with no join.
Variants shared by more than `pairs_up_to` fingerprints are not paired off:
their fingerprints are grouped by all variants with two wildcards. Such a group
holds at most four fingerprints, any two of which link, so its members are
linked to their minimum and no link is lost. Components come from alternating
large-star and small-star rounds.

Defined results: null and empty texts have no words and the fingerprint zero,
which links like any other. Repeated rows share a fingerprint and a component.
A component's id is its smallest non-null document id (null if all are null).
Very long texts are shingled whole; an empty table gives an empty result.
Extra columns are ignored by the search and kept by ``keep_first``.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import checkpoint, map_rows, packed

SEED = 42
PAIRS_UP_TO = 64
#: Up to so many variant keys (24 bytes each) are sent to every executor; beyond, they are shuffled.
BROADCAST_KEYS = 200_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, as a signed integer: a bit is set if it is in over half the shingles' hashes."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(width)))), len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, _tie, _fp): a narrow map over whole texts. _tie tells rows of one id apart."""

    def rows(ids: list, ties: list, texts: list) -> list:
        return [ids, ties, [fingerprint(t, width) for t in texts]]

    field = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(field)), ("_tie", pa.int64()), ("_fp", pa.int64())])
    inner = docs.select(id_col, F.xxhash64(text_col).alias("_tie"), F.col(text_col).alias("_text"))
    return map_rows(inner, [id_col, "_tie", "_text"], f"{id_col} {field.simpleString()}, _tie long, _fp long", rows, schema)


def variants(fp: Column) -> Column:
    """The 64 one-wildcard variants of both halves: (half, wildcard) above, the half without that bit below."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.array(
        *[
            half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit((h * 32 + i) << 32))
            for h, half in enumerate((low, high))
            for i in range(32)
        ]
    )


def close(a: Column, b: Column, most: int = 2) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def links(distinct: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(u, v), u < v: every pair of fingerprints within two bits, or, inside crowded variants, pairs that connect the same."""
    keyed = distinct.select("_fp", F.explode(variants(F.col("_fp"))).alias("_key"))
    shared = checkpoint(
        keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_fp").alias("_least"), F.max("_fp").alias("_most")).where("_n > 1")
    )
    pairs = shared.where("_n = 2").select(F.col("_least").alias("u"), F.col("_most").alias("v")).where(close(F.col("u"), F.col("v"))).distinct()
    crowded = shared.where("_n > 2").select("_key", "_n")
    if not crowded.head(1):
        return pairs
    small = crowded.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    members = checkpoint(keyed.join(F.broadcast(crowded) if small else crowded, "_key"))
    few = members.where(F.col("_n") <= pairs_up_to)
    within = (
        few.select("_key", F.col("_fp").alias("u"))
        .join(few.select("_key", F.col("_fp").alias("v")), "_key")
        .where((F.col("u") < F.col("v")) & close(F.col("u"), F.col("v")))
        .select("u", "v")
    )
    masks = F.array(*[F.lit(np.int64(np.uint64(~((1 << i) | (1 << j)) & (2**64 - 1)).astype(np.int64)).item()) for i, j in combinations(range(64), 2)])
    dense = members.where(F.col("_n") > pairs_up_to).select("_fp").distinct()
    groups = (
        dense.select("_fp", F.posexplode(masks).alias("_pair", "_mask"))
        .groupBy("_pair", F.col("_fp").bitwiseAND(F.col("_mask")).alias("_rest"))
        .agg(F.collect_set("_fp").alias("_fps"))
        .where(F.size("_fps") > 1)
    )
    stars = groups.select(F.array_min("_fps").alias("u"), F.explode("_fps").alias("v")).where("u < v")
    return pairs.unionByName(within).unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 60, part_rows: int | None = None) -> DataFrame:
    """(node, root): root is the least node that can be reached. Nodes without edges aren't listed. A round's tasks get `part_rows` edges on average, if given."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())

    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        now = state(packed(edges) if part_rows else edges)
        if now == before or now[0] == 0:
            break
        before = now
        pack = (lambda d, n=now[0]: packed(d, n, part_rows)) if part_rows else (lambda d: d)
        edges = pack(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pack(pack(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select("v", "m").toDF("u", "v")
        edges = checkpoint(pack(pack(small.unionByName(least.toDF("u", "v")).where("u <> v")).distinct()))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, _tie, _fp, _root, component_id): one row a document."""
    marked = checkpoint(fingerprints(docs, id_col, text_col, width))
    distinct = checkpoint(marked.groupBy("_fp").agg(F.min(id_col).alias("_id")))
    roots = components(links(distinct.select("_fp")))
    rooted = distinct.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_id", F.coalesce("root", "_fp").alias("_root"))
    named = rooted.groupBy("_root").agg(F.min("_id").alias("component_id"))
    return marked.join(rooted.select("_fp", "_root").join(named, "_root"), "_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): one row a document."""
    return grouped(docs, id_col, text_col, width).select(id_col, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The documents with one of each component left, that of the smallest id; columns stay as they are.

    Rows equal in id and text are numbered, so that one of them stays. The join on
    (id, text hash) sorts by the very keys that the numbering needs.
    """
    keepers = grouped(docs, id_col, text_col, width).groupBy("_root").agg(F.min(F.struct(id_col, "_tie")).alias("_first"))
    keepers = keepers.select(F.col("_first")[id_col].alias("_id"), F.col("_first._tie").alias("_which"))
    whole = docs.select(F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_hash"), F.struct(*docs.columns).alias("_row"))
    kept = whole.join(keepers, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_which")), "left_semi")
    one = Window.partitionBy("_key", "_hash").orderBy("_key")
    return kept.withColumn("_copy", F.row_number().over(one)).where("_copy = 1").select("_row.*")
