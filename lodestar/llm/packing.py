"""Variable-capacity best-fit packing (operator 2).

Pieces are placed longest first into the open bin with the least room that
still takes them. Where none does, a bin is opened at the permitted length whose
expected cost per packed token is least, given what is still to be placed. When
a shard is done every bin is cut down to the least permitted length that holds
its contents.

The work is spread by hash over shards of about `shard_rows` documents, and the
number of shards grows with the input. Texts never take part: only an id and a
length do. A document longer than the greatest length gives whole bins of that
length, which are final at once, and one remainder that is packed.

Defined results: null, negative and zero lengths take no part and return no row.
Rows of one id, equal or not, are packed each for itself and told apart by `copy`
(0, 1, ... by rising length); ties go by length, id, copy and piece. An empty
table gives an empty result. Other columns are ignored, whatever their names; very
long documents give whole bins and one remainder.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Copies of one row are numbered in arrays of so many at most.
BLOCK = 4096


def sequence_cost(length: int, overhead: int = 64, quadratic: float = 1 / 65536) -> float:
    """Cost of one training sequence: a fixed part, a part by token, and attention's square."""
    return overhead + length + quadratic * length * length


def pack_shard(
    lengths: list[int], capacities: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = sequence_cost
) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item (items come longest first), and each bin's final capacity."""
    capacities = tuple(sorted(capacities))
    costs = [cost(c) for c in capacities]
    rising = lengths[::-1]  # rising lengths with running sums: how much of what is to come fits a gap
    sums = [0]
    for x in rising:
        sums.append(sums[-1] + x)
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    fill: list[int] = []
    bins, offsets = [], []
    for k, x in enumerate(lengths):
        at = bisect.bisect_left(open_bins, (x, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            best = None
            to_come = len(lengths) - k - 1
            for c, price in zip(capacities, costs):
                if c < x:
                    continue
                fits = sums[min(to_come, bisect.bisect_right(rising, c - x))]
                rate = price / (x + min(c - x, fits))
                if best is None or rate < best[0]:
                    best = (rate, c)
            room, b = best[1], len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += x
        if room > x:
            bisect.insort(open_bins, (room - x, b))
    final = [capacities[bisect.bisect_left(capacities, f)] for f in fill]
    return bins, offsets, final


def pack(
    lengths: DataFrame,
    id_col: str = "doc_id",
    length_col: str = "n_tokens",
    capacities: tuple[int, ...] = LENGTHS,
    shard_rows: int = 20_000,
    cost: Callable[[int], float] = sequence_cost,
) -> DataFrame:
    """(id, copy, piece, n_tokens, bin_id, bin_capacity, bin_offset), one row for every piece of every document."""
    most = max(capacities)
    kind = lengths.schema[id_col].dataType.simpleString()
    # One row for each length of an id: the lengths before give the number of its first copy.
    before = Window.partitionBy("_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    items = (
        lengths.select(F.col(id_col).alias("_id"), F.col(length_col).cast("long").alias("_n"))
        .where("_n > 0")
        .groupBy("_id", "_n")
        .agg(F.count("*").alias("_copies"))
        .withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
        .select("_id", "_n", "_before", "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {BLOCK}"))).alias("_block"))
        .select("_id", "_n", "_before", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("_copies"), (F.col("_block") + 1) * BLOCK) - 1)).alias("_copy"))
        .select("_id", "_n", (F.col("_before") + F.col("_copy")).alias("_copy"))
    )
    whole = (
        items.where(F.col("_n") > most)
        .select("_id", "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_n div {most} - 1"))).alias("_piece"))
        .select(
            F.col("_id").alias(id_col), F.col("_copy").alias("copy"), F.col("_piece").alias("piece"), F.lit(most).cast("long").alias("n_tokens"),
            F.concat_ws(":", F.lit("whole"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("_copy"), F.col("_piece")).alias("bin_id"),
            F.lit(most).cast("long").alias("bin_capacity"), F.lit(0).cast("long").alias("bin_offset"),
        )
    )
    rest = items.select(
        "_id", "_copy",
        F.expr(f"CASE WHEN _n > {most} THEN _n div {most} ELSE 0L END").alias("_piece"),
        F.expr(f"CASE WHEN _n > {most} THEN _n % {most} ELSE _n END").alias("_n"),
    ).where("_n > 0")
    shards = max(1, -(-lengths.count() // shard_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_id", "_copy"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack_shard(pdf["_n"].tolist(), capacities, cost)
        return pd.DataFrame(
            {
                id_col: pdf["_id"], "copy": pdf["_copy"], "piece": pdf["_piece"], "n_tokens": pdf["_n"],
                "bin_id": [f"shard:{key[0]}:{b}" for b in bins], "bin_capacity": [final[b] for b in bins], "bin_offset": offsets,
            }
        )

    schema = f"{id_col} {kind}, copy long, piece long, n_tokens long, bin_id string, bin_capacity long, bin_offset long"
    packed = (
        rest.withColumn("_shard", F.pmod(F.xxhash64("_id", "_copy", "_n"), F.lit(shards)))
        .groupBy("_shard")
        .applyInPandas(run, schema)
    )
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str, capacities: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Pack whole documents by their token counts."""
    from lodestar.llm.bpe import token_counts
    from lodestar.llm.common import checkpoint

    return pack(checkpoint(token_counts(docs, vocabulary).select("doc_id", "n_tokens")), capacities=capacities)
