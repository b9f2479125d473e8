"""Spelling variants: words one edit apart (operator 12).

Two words are near if one inserted, deleted or replaced code point tells them apart, that
is if common prefix plus common suffix reach the longer length minus one. Blocks of
words lie in padded code-point matrices, and each tile, a block against a
block, yields prefix and suffix lengths of all its pairs at once.

Which blocks meet is found by halving. Of a pair whose longer word has L code points, the
common prefix has P of them, 0 <= P < L. For every range lo <= P < hi both
words begin with the same lo code points and end with the same L - hi, which makes an
equality key. A word goes under the lower and the upper half of [0, L) for L its
own length and one more; a key with more than `crowd` words is cut in
halves again, for all its words, down to ranges of one place, whose groups
the alphabet bounds. So a key's words never fill a task however many share it,
no pair is lost, and each is counted under the one key whose range holds its P.

Words then follow their form to the last one by pointer doubling.

Defined results: null and empty texts have no words; very long texts are read whole and
very long words compared whole, in tiles of fewer words; of equally frequent
near words the smallest in code-point order is the form; repeated rows count again; a null
id stands as the empty text; extra columns of any name are left alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word; a fixed value of the contract.
LETTERS = r"a-zA-ZÀ-ÿ"
LEAST_LENGTH = 7
#: Keys of more words than this are cut in halves again.
CROWD = 1_000
#: A block's words and places at most.
BLOCK_WORDS, BLOCK_PLACES = 64, 16_384


def drop_some(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run without one code point where the checksum of id and run is a multiple of `every`."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(
    docs: DataFrame,
    alter: Callable[[Column, Column], Column] | None = None,
    least_length: int = LEAST_LENGTH,
    least_count: int = 2,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """word, n: maximal runs of letters, A to Z in lower case, changed by `alter` of id and run, with `least_length` code points and `least_count` occurrences."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    exploded = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = alter(F.col("id"), F.col("run")) if alter else F.col("run")
    counted = exploded.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the hash of what the words of a range [lo, hi) of places in L share; tiles test the rest."""
    size, tail = F.length("word"), F.col("L") - F.col("hi")
    return rows.withColumn("key", F.xxhash64("L", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), size - tail + 1, tail)))


def _halves(L: Column | str, lo: Column | str, hi: Column | str) -> Column:
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    mid = ((lo + hi) / 2).cast("int")
    state = lambda a, b: F.struct(F.col(L).alias("L") if isinstance(L, str) else L.alias("L"), a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    return F.array(state(lo, mid), state(mid, hi))


def candidate_groups(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n, L, lo, hi, key: groups of `crowd` words at most, or of one place; every near pair is in exactly one whose range holds its P."""
    size = F.length("word")
    first = F.concat(*(_halves((size + more).cast("int"), F.lit(0), size + more) for more in (0, 1)))
    level = _keyed(words.select("word", "n", F.explode(first).alias("s")).select("word", "n", "s.*"))
    settled = []
    while True:
        crowded = checkpoint(level.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("key"))
        if crowded.isEmpty():
            break
        marked = level.join(crowded.withColumn("many", F.lit(True)), "key", "left")
        settled.append(marked.where("many IS NULL").drop("many"))
        again = marked.where("many").select("word", "n", F.explode(_halves("L", "lo", "hi")).alias("s")).select("word", "n", "s.*")
        level = checkpoint(_keyed(again))
    out = level
    for part in settled:
        out = out.unionByName(part)
    return out


class Block:
    """A few words as code-point matrices, padded on the right for prefixes and on the left for suffixes."""

    def __init__(self, words: list[str], at: slice, columns: dict[str, np.ndarray]) -> None:
        self.at, self.n = at, len(words)
        self.sizes = np.fromiter(map(len, words), np.int32, self.n)
        self.width = int(self.sizes.max())
        self.left, self.right = (self._matrix([pad(w, self.width, "\0") for w in words]) for pad in (str.ljust, str.rjust))
        self.key, self.L, self.lo, self.hi = (columns[c][at] for c in ("key", "L", "lo", "hi"))

    def _matrix(self, padded: list[str]) -> np.ndarray:
        return np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).reshape(self.n, self.width)

    def near(self, other: Block) -> tuple[np.ndarray, np.ndarray]:
        """Places in both blocks of the near pairs that share a key and whose common prefix lies in its range."""
        width = min(self.width, other.width)
        shorter, longer = np.minimum.outer(self.sizes, other.sizes), np.maximum.outer(self.sizes, other.sizes)
        prefix = np.minimum(run_length(self.left[:, None, :width] == other.left[None, :, :width]), shorter)
        mine, others = self.right[:, None, ::-1][:, :, :width], other.right[None, :, ::-1][:, :, :width]
        suffix = np.minimum(run_length(mine == others), shorter)
        alike = (self.key[:, None] == other.key) & (self.L[:, None] == other.L) & (self.lo[:, None] == other.lo) & (self.hi[:, None] == other.hi)
        fits = (longer == self.L[:, None]) & (self.lo[:, None] <= prefix) & (prefix < self.hi[:, None]) & (prefix + suffix >= longer - 1)
        found = alike & fits
        if self is other:
            found = np.triu(found, 1)
        return np.nonzero(found)


def run_length(equal: np.ndarray) -> np.ndarray:
    """How many leading places of the last axis are true."""
    first = np.argmin(equal, axis=2)
    return np.where(equal.all(axis=2), equal.shape[2], first)


def blocks_of(words: list[str], columns: dict[str, np.ndarray]) -> list[Block]:
    out, begin, width = [], 0, 0
    for k in range(len(words) + 1):
        grown = max(width, len(words[k])) if k < len(words) else 0
        if k > begin and (k == len(words) or k - begin == BLOCK_WORDS or (k - begin + 1) * grown > BLOCK_PLACES):
            out.append(Block(words[begin:k], slice(begin, k), columns))
            begin, grown = k, len(words[k]) if k < len(words) else 0
        width = grown
    return out


def compare(words: list[str], n: list[int], columns: dict[str, np.ndarray]) -> dict[int, tuple[int, int, str]]:
    """For rows of whole groups in order of key: row -> (near words, largest n of one, the first such word)."""
    blocks, best = blocks_of(words, columns), {}
    for b, block in enumerate(blocks):
        for other in blocks[b:]:
            if other is not block and other.key[0] != block.key[-1]:
                break
            for i, j in zip(*(x.tolist() for x in block.near(other))):
                i, j = i + block.at.start, j + other.at.start
                for a, c in ((i, j), (j, i)):
                    count, most, word = best.get(a, (0, -1, ""))
                    if n[c] > most or n[c] == most and words[c] < word:
                        most, word = n[c], words[c]
                    best[a] = (count + 1, most, word)
    return best


def near_counts(groups: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: how many near words, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = table["key"].to_numpy()
            cut = int(np.flatnonzero(keys == keys[-1])[0])  # the last group may go on
            held = table.slice(cut)
            yield from found(table.slice(0, cut))
        if held is not None:
            yield from found(held)

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        words = table["word"].to_pylist()
        best = compare(words, table["n"].to_pylist(), {c: table[c].to_numpy() for c in ("key", "L", "lo", "hi")})
        rows = [(words[a], *values) for a, values in best.items()]
        if rows:
            word, count, most, form = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(count, pa.int64()), pa.array(most, pa.int64()), pa.array(form, pa.string())], ["word", "n_near", "form_n", "form"])

    dealt = groups.select("key", "L", "lo", "hi", "word", "n").repartition("key").sortWithinPartitions("L", "key")
    parts = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def group_variants(words: DataFrame, ratio: int = 10, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words with counts `n`.

    `form` is the near word of largest n, if that is `ratio` times the word's own or more (`ratio` above 1).
    """
    words = checkpoint(words.select("word", "n"))
    near = near_counts(candidate_groups(words, crowd))
    frequent = F.col("form_n") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(frequent, F.col(c)).alias(c) for c in ("form", "form_n"))
    )
    formed = checkpoint(formed)
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    span = words.agg(F.min("n"), F.max("n")).first()
    # n grows `ratio` times with each step, so that bounds the steps; each round doubles those done
    steps = math.log(span[1] / span[0], ratio) + 1 if span[0] else 0
    done = 1
    while done < steps:
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("on"))
        links = checkpoint(links.join(onward, "to", "left").select("word", F.coalesce("on", "to").alias("to")))
        done *= 2
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
