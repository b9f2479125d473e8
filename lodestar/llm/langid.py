"""Language identification as a mixture of languages (operator 9).

Training adds up hashed character n-grams by language over all labelled
documents; the model is one table of `BUCKETS` rows by language, a size that
doesn't grow with the corpus. For each document, expectation-maximisation
estimates the share of each language in its n-grams, and the set of languages
with the best penalised likelihood is kept; the prediction is the likeliest
language alone, or the one with the greatest share of a set that beats it.

Documents are estimated together, some hundred thousand n-grams at a time: an
n-gram table in the order of the documents, one vector a language, sums by
document with `reduceat`, and documents that have settled leave the table. All
languages take part in every round, however many there are.

Defined results: null texts and texts without a letter are `und` with score 0
and no languages, and so is everything when nothing was learned (an empty table
included). Rows without a language or text teach nothing; repeated rows teach as
often as they occur. Equal shares go to the first language in alphabetical order.
Very long texts are read in stretches of `STRETCH` characters, whose counts are
added, so memory is bounded. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestar.llm.common import map_rows

BUCKETS = 1 << 16
STRETCH = 1 << 20
#: Characters of documents whose n-grams are counted together, and n-grams times languages of one table.
TOGETHER, TABLE = 1 << 17, 1 << 21
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place in `texts`, bucket) of every 2- and 3-gram of letters and word ends; texts are lower-cased."""
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    letter = letter_table()[points]
    keep = letter.copy()  # runs of other characters count as one space
    keep[1:] |= letter[:-1]
    keep[np.cumsum(sizes) - sizes] = True
    points, of = np.where(letter, points, 32)[keep].astype(np.uint64), of[keep]
    two = points[:-1] * np.uint64(0x9E3779B1) + points[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(31) + points[2:] * np.uint64(0xC2B2AE3D) + np.uint64(7)
    pair, triple = of[:-1] == of[1:], of[:-2] == of[2:]
    both = np.concatenate((two[pair], three[triple]))
    both ^= both >> np.uint64(15)
    buckets = ((both * np.uint64(0x2C1B3C6D)) >> np.uint64(12)).astype(np.uint32) & np.uint32(BUCKETS - 1)
    return np.concatenate((of[:-1][pair], of[:-2][triple])), buckets


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of one text and their counts, stretch by stretch; None without a letter."""
    total, lettered = np.zeros(BUCKETS, np.int64), False
    for at in range(0, len(text), STRETCH):
        part = text[at : at + STRETCH].lower()
        lettered = lettered or any(map(str.isalpha, part))
        total += np.bincount(hashed([part])[1], minlength=BUCKETS)
    found = np.flatnonzero(total)
    return (found, total[found]) if lettered else None


def batches_of(texts: list[str], places: list[int]) -> Iterator[list[int]]:
    """Places of texts, in runs of about `TOGETHER` characters."""
    run, held = [], 0
    for k in places:
        run.append(k)
        held += len(texts[k]) + 2
        if held >= TOGETHER or len(run) >= 1 << 15:
            yield run
            run, held = [], 0
    if run:
        yield run


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each text, buckets, counts) of texts with a letter, in their order."""
    if len(texts) == 1:
        buckets, counts = grams(texts[0])
        return np.zeros(1, np.int64), buckets, counts
    of, buckets = hashed([t.lower() for t in texts])
    keys = np.sort((of << np.uint32(16)) | buckets)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    return np.searchsorted(keys[first] >> np.uint32(16), np.arange(len(texts))), keys[first] & np.uint32(0xFFFF), counts


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, bucket, n) over all whole texts; tasks add up before the shuffle, in arrays of fixed size by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts, by = batch.column(0).to_pylist(), batch.column(1).to_pylist(), {}
            for k, (lang, text) in enumerate(zip(langs, texts)):
                if lang is not None and text:
                    by.setdefault(lang, []).append(k)
            for lang, places in by.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for run in batches_of(texts, places):
                    if len(run) == 1:
                        found = grams(texts[run[0]])
                        if found is not None:
                            total[found[0]] += found[1]
                    else:
                        total += np.bincount(hashed([texts[k].lower() for k in run if any(map(str.isalpha, texts[k]))] or [""])[1], minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    return (
        docs.select(lang_col, text_col)
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


def shares_of(p: np.ndarray, counts: np.ndarray, starts: np.ndarray, rounds: int = 40, settled: float = 1e-4) -> np.ndarray:
    """Shares by expectation-maximisation: p(language, n-gram) and counts in the order of documents that begin at `starts`."""
    langs, docs = p.shape[0], len(starts)
    shares, live = np.full((langs, docs), 1 / langs), np.arange(docs)
    sizes = np.diff(np.append(starts, len(counts)))
    total = np.add.reduceat(counts, starts).astype(float)
    now = shares
    for at in range(rounds):
        mixed = np.zeros(len(counts), np.float32)
        for k in range(langs):
            mixed += p[k] * np.repeat(now[k].astype(np.float32), sizes)
        weight = counts / mixed
        new = np.stack([now[k] * np.add.reduceat(weight * p[k], starts) for k in range(langs)]) / total
        moving = np.abs(new - now).max(axis=0) >= settled
        now = new
        if at == rounds - 1 or not moving.any():
            break
        if moving.mean() < 0.7:  # those that have settled leave the table
            shares[:, live[~moving]] = now[:, ~moving]
            rows = np.repeat(moving, sizes)
            p, counts, sizes, total, now, live = p[:, rows], counts[rows], sizes[moving], total[moving], now[:, moving], live[moving]
            starts = np.cumsum(sizes) - sizes
    shares[:, live] = now
    return shares / shares.sum(axis=0)


class Model:
    """Probabilities of buckets by language, as one float32 table (bucket, language)."""

    def __init__(self, langs: list[str], p: np.ndarray, penalty: float = 2.0, least_share: float = 0.05, thin: float = 0.25) -> None:
        self.langs, self.p, self.penalty, self.least_share, self.thin = langs, np.asarray(p, np.float32), penalty, least_share, thin
        self.log_p = np.log(self.p)
        self.rows = np.ascontiguousarray(self.p.T)

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], **options: float) -> Model:
        """From (buckets, counts) by language."""
        langs = sorted(counts)
        p = np.empty((BUCKETS, len(langs)), np.float32)
        for k, lang in enumerate(langs):
            one = np.full(BUCKETS, 0.5)
            one[counts[lang][0]] += counts[lang][1]
            p[:, k] = one / one.sum()
        return cls(langs, p, **options)

    def predict(self, text: str | None) -> tuple[str, float, list[str]]:
        """Language, its share among all languages, and the selected set by falling share."""
        return self.predict_all([text])[0][:3]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        """Language, its share among all languages, and the selected set with its shares, by falling share."""
        out = [(UNKNOWN, 0.0, [], [])] * len(texts)
        if not self.langs:
            return out
        lettered = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for run in batches_of(texts, lettered):
            for k, found in zip(run, self.mixtures(*counted([texts[k] for k in run]))):
                out[k] = found
        return out

    def mixtures(self, starts: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
        width, docs = len(self.langs), len(starts)
        if width == 1:
            return [(self.langs[0], 1.0, list(self.langs), [1.0])] * docs
        if docs > 1 and len(buckets) * width > TABLE:
            half = docs // 2
            cut = starts[half]
            return self.mixtures(starts[:half], buckets[:cut], counts[:cut]) + self.mixtures(starts[half:] - cut, buckets[cut:], counts[cut:])
        sizes = np.diff(np.append(starts, len(counts)))
        n = counts.astype(np.float32)
        total = np.add.reduceat(counts, starts)
        single = np.add.reduceat(self.log_p[buckets] * n[:, None], starts, axis=0, dtype=np.float64)
        best = single.argmax(axis=1)
        shares, most = self.subset(np.tile(np.arange(width), (docs, 1)), np.arange(docs), starts, sizes, buckets, n)
        # n-grams overlap, so the likelihood is thinned before it is held against the penalty for one more share.
        price = self.penalty * np.log(total + 1)
        score = self.thin * single.max(axis=1)
        sets: list[tuple[list[int], list[float]]] = [([int(b)], [1.0]) for b in best]
        able = (shares >= self.least_share).sum(axis=1)
        open_ = np.flatnonzero((self.thin * most - price > score) & (able >= 2))
        ranked = np.argsort(-shares[open_], axis=1, kind="stable") if len(open_) else None
        for size in range(2, int(able[open_].max(initial=1)) + 1):
            these = np.flatnonzero(able[open_] >= size)
            chosen = np.sort(ranked[these, :size], axis=1)
            own, value = self.subset(chosen, open_[these], starts, sizes, buckets, n)
            value = self.thin * value - (size - 1) * price[open_[these]]
            for k, doc in enumerate(open_[these]):
                if value[k] > score[doc]:
                    score[doc] = value[k]
                    by = np.argsort(-own[k], kind="stable")
                    sets[doc] = [int(c) for c in chosen[k][by]], own[k][by].tolist()
        return [(self.langs[s[0]], float(min(1.0, max(0.0, shares[doc, s[0]]))), [self.langs[k] for k in s], each) for doc, (s, each) in enumerate(sets)]

    def subset(
        self, chosen: np.ndarray, these: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: np.ndarray, n: np.ndarray, rounds: int = 40
    ) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihoods of the documents `these`, each over its own `chosen` languages."""
        size = sizes[these]
        begin = np.cumsum(size) - size
        rows = np.repeat(starts[these] - begin, size) + np.arange(size.sum())
        near, n = buckets[rows].astype(np.int64), n[rows]
        # One language after the other, a document's n-grams lie in one row of the table.
        p = np.stack([self.rows.ravel().take(near + np.repeat(chosen[:, k] * BUCKETS, size)) for k in range(chosen.shape[1])])
        own = shares_of(p, n, begin, rounds)
        mixed = sum(p[k] * np.repeat(own[k], size) for k in range(len(p)))
        return own.T, np.add.reduceat(np.log(mixed) * n, begin)


_models: dict[str, Model] = {}


def model_for(content: tuple[list[str], bytes]) -> Model:
    langs, table = content
    key = hashlib.sha256(table).hexdigest() + ",".join(langs)
    if key not in _models:
        _models.clear()
        _models[key] = Model(langs, np.frombuffer(table, np.float32).reshape(BUCKETS, len(langs)))
    return _models[key]


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts over all rows of `docs`. One row a language reaches the driver, with two arrays of `BUCKETS` places at most."""
    rows = gram_counts(docs, lang_col, text_col).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("found"))
    table = rows.select("lang", F.col("found.bucket").cast("array<int>").alias("bucket"), F.col("found.n").alias("n")).toArrow()
    arrays = zip(*(table.column(c) for c in ("lang", "bucket", "n")))
    return Model.fit({lang.as_py(): (bucket.values.to_numpy(), n.values.to_numpy()) for lang, bucket, n in arrays})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, langs, shares): a narrow map that sees the text alone."""
    content = docs.sparkSession.sparkContext.broadcast((model.langs, model.p.tobytes()))
    options = {k: getattr(model, k) for k in ("penalty", "least_share", "thin")}

    def rows(ids: list, texts: list) -> list:
        mine = model_for(content.value)
        mine.__dict__.update(options)
        return [ids, *map(list, zip(*mine.predict_all(texts)))] if ids else [[]] * 5

    field = docs.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(field)), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
    spec = f"{id_col} {field.simpleString()}, lang_pred string, score double, langs array<string>, shares array<double>"
    return map_rows(docs, [id_col, text_col], spec, rows, schema)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    model = train(docs.where(~is_held_out()).where(F.col("lang").isNotNull()))
    return identify(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "langs", "shares")
