"""Target-distribution importance resampling (operator 13).

Every document gets a weight: the sum, over the hashed word n-grams it holds, of the
log ratio of their frequency in a target collection and in all documents. Gumbel noise from
the document's id turns weights into scores, and the highest scores are a
draw without replacement.

Features are counted by batches: the texts of a batch are joined with a separator that
is no word character, one regular-expression pass finds all words, a
searchsorted over the documents' offsets tells each word's document, and n-grams whose
first and last word lie in different documents are masked before the bincount. A
running CRC carries a word's checksum on to its two- and three-word features.

The corpus is read twice: counts need every document before the first weight. Tables
of counts have a fixed size (`buckets`), whatever the corpus; each task adds its
own up before the shuffle. The ranks come from one range-partitioned
sort of the measures, without the texts, and the partitions' counts.

Defined results: null and empty texts have no features, weight 0 and are never drawn; very
long texts are read whole, by blocks of words that overlap by two; equal scores
go to the smaller id (null first), equal ids to the smaller weight and number of features; repeated rows are
documents of their own; a null id takes part in the noise as the empty text; extra columns of any name
are left alone, and `keep` returns them in one column `row`; an empty
table gives an empty result, an empty target gains from counts of 0.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm.common import checkpoint

#: Words as UTF-8 bytes in lower case: digits, a to z, and everything beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = b"\x00"
BUCKETS = 10_000
LONGEST = 3


def joined(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about `most` bytes (at least one text): first index, count, joined bytes in lower case, each text's offset."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < most):
            size += len(texts[end] or b"") + 1
            end += 1
        parts = [text or b"" for text in texts[begin:end]]
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        yield begin, end - begin, BREAK.join(parts).lower(), offsets
        begin = end


def features(data: bytes, offsets: np.ndarray, buckets: int, longest: int = LONGEST, block: int = 50_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n-gram length, bucket, document) arrays for all n-grams that lie in one document, block by block."""
    matches, held, held_at = WORDS.finditer(data), [], np.zeros(0, np.int64)
    while found := list(islice(matches, block)):
        words = held + [m.group() for m in found]
        starts = np.concatenate([held_at, np.fromiter((m.start() for m in found), np.int64, len(found))])
        owner, new = np.searchsorted(offsets, starts, side="right") - 1, len(held)
        spaced, sums = [b" " + w for w in words], list(map(crc32, words))
        for length in range(1, longest + 1):
            if length > 1:
                sums = list(map(crc32, spaced[length - 1 :], sums))
            last = owner[length - 1 :]
            fresh = (np.arange(length - 1, len(words)) >= new) & (owner[: len(last)] == last)
            yield length, np.array(sums, np.int64)[fresh] % buckets, last[fresh]
        rest = max(0, len(words) - longest + 1)
        held, held_at = words[rest:], starts[rest:]


def feature_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket's features occur in all texts. `buckets` sums reach the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in joined(batch.column(0).cast(pa.binary()).to_pylist()):
                for _, bucket, _ in features(data, offsets, buckets, longest):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row.bucket] = row.n
    return out


def log_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket's add-one frequency in the target and in the source."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = ((float(t) + 1.0) * (float(all_source) + n) / ((float(s) + 1.0) * (float(all_target) + n)) for s, t in zip(source, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.float64)


def noise(seed: int, name: str) -> int:
    """floor(1000 times Gumbel noise) of an id."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", longest: int = LONGEST, keep: bool = False) -> DataFrame:
    """id, n_words, n_features, weight, score of every row, and the whole row as `row` if `keep`."""
    buckets, kind = len(gains), docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for begin, count, data, offsets in joined(texts):
                own = slice(begin, begin + count)
                for length, bucket, owner in features(data, offsets, buckets, longest):
                    n = np.bincount(owner, minlength=count)
                    n_features[own] += n
                    n_words[own] += n if length == 1 else 0
                    weight[own] += np.bincount(owner, sent.value[bucket], count).astype(np.int64)
            score = weight + np.array([noise(seed, "" if i is None else str(i)) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(a) for a in (n_words, n_features, weight, score)), *batch.columns[2:]], names)

    names = [id_col, "n_words", "n_features", "weight", "score", *(["row"] if keep else [])]
    rows = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if keep else []
    taken = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text_"), *rows)
    schema = StructType([StructField(id_col, kind), *(StructField(c, LongType()) for c in names[1:5]), *taken.schema.fields[2:]])
    return taken.mapInArrow(run, schema)


def ranked(weighed: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """Adds `rank`: 1, 2, 3... for the floor(percent/100) highest scores of rows with `least_words` words, null for the rest.

    Rows are sorted by ranges and each partition's rows counted; one number a
    partition goes to the driver and back.
    """
    eligible = F.col("n_words") >= least_words
    order = [eligible.desc(), F.desc("score"), F.asc(f"`{id_col}`"), F.asc("weight"), F.asc("n_features")]
    weighed = checkpoint(weighed)  # ranges are sampled before the sort, which would weigh every text twice
    partitions = int(weighed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row's number within its partition is the lower 33 bits
    placed = checkpoint(weighed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(eligible).alias("fit")).orderBy("part").collect()
    drawn, before, run = percent * sum(s.fit for s in sizes) // 100, [(-1, 0)], 0
    for s in sizes:
        before.append((s.part, run))
        run += s.n
    starts = F.broadcast(weighed.sparkSession.createDataFrame(before, "_part long, _before long"))  # a row a partition
    rank = F.col("_before") + within + 1
    return placed.join(starts, part == F.col("_part"), "left").withColumn("rank", F.when(rank <= drawn, rank)).drop("_place", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST, keep: bool = False) -> DataFrame:
    """Every document's id, n_words, n_features, weight, score and rank (null if not drawn); with `keep` its row too."""
    gains = log_gains(feature_counts(docs, buckets=buckets, longest=longest), feature_counts(target, buckets=buckets, longest=longest))
    return ranked(weigh(docs, gains, seed, longest=longest, keep=keep), percent, least_words)


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents alone, with all their columns."""
    return resample(docs, target, keep=True, **options).where("rank IS NOT NULL").select("row.*")
