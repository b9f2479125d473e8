"""Quality rules with host-level verdicts, in DataFrame functions alone (operator 7).

Each document gets its counts from its own text. Rule failures are summed by
host (the source), the hosts' failure rates are shrunk with a beta prior whose
mean and strength come from the hosts themselves, and a host whose shrunk rate
passes a limit takes its other documents with it. The operator's verdicts have the base
rules alone; `keep_good` also fails documents by symbols, duplicate lines and mean
word length, and counts these failures by host too.

Counts are computed in one narrow pass and checkpointed without the text; the
sums by host combine before the shuffle, so a host with a third of the rows
costs one row a task.

Defined results: a null or empty text has no words and fails the base rules.
Documents without a source belong to no host and are judged alone. Repeated
rows count as often as they occur. Very long texts are counted whole; an empty table gives an empty
result. Extra columns stay; a column named like a result is replaced. Ties can't matter: nothing is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE_CLASS, checkpoint, let

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Up to so many hosts are joined by broadcast; beyond, by a shuffle that adaptive execution splits where it is uneven.
BROADCAST_HOSTS = 100_000


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside `width`-word windows that occur twice or more in the text, by 64-bit window hashes.

    Most texts repeat none, which one distinct count shows. Else the (hash, place)
    pairs are sorted, equal neighbours mark their places, and the places' windows
    are joined: n log n in the words.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            marked = F.transform(
                s,
                lambda x, k: F.when(
                    F.get(s, k + 1)["h"].eqNullSafe(x["h"]) | ((k > 0) & F.get(s, F.greatest(k - 1, F.lit(0)))["h"].eqNullSafe(x["h"])), x["i"]
                ),
            )
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        joined = lambda p: F.aggregate(
            p,
            F.struct(F.lit(-width).alias("at"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(width), i - a["at"])).alias("n")),
            lambda a: a["n"],
        )
        return let(pairs, lambda s: let(places(s), joined))

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        return F.when(F.size(w) <= width, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        )

    return let(words, counted)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The five counts of every whole text, and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    rest = [c for c in docs.columns if c not in [*COUNTS, "base_failed", "_n_lines"]]
    return (
        docs.select(*rest, counted.alias("_counted"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), dup.alias("_lines"))
        .select(*rest, "_counted.n_words", "_counted.word_chars", "n_symbols", F.col("_lines.dup").alias("n_dup_lines"), "_counted.n_repeat_words", F.col("_lines.n").alias("_n_lines"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def any_failed() -> Column:
    """The base rules, over one symbol in ten words, over 30 % duplicate lines, or a mean word length outside 2 to 12."""
    return (
        F.col("base_failed")
        | (10 * F.col("n_symbols") > F.col("n_words"))
        | (100 * F.col("n_dup_lines") > 30 * F.col("_n_lines"))
        | ~F.col("word_chars").between(2 * F.col("n_words"), 12 * F.col("n_words"))
    )


def host_rates(counts: DataFrame, host_col: str = "source") -> DataFrame:
    """_host, n_docs, n_failed, host_rate: failure rates shrunk by the beta prior that the hosts' own rates suggest.

    Moments weigh a host by its documents. Where the hosts don't differ more than
    chance would have it, the prior is as strong as all documents together.
    """
    hosts = counts.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("_host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    p = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.sum("n_docs").alias("_n"), F.sum("n_failed").alias("_f"), F.count("*").alias("_k"),
        F.sum(F.col("n_failed") * p).alias("_fp"),
    )
    mean = F.col("_f") / F.col("_n")
    chance = mean * (1 - mean)
    spread = F.col("_fp") / F.col("_n") - mean * mean - chance * F.col("_k") / F.col("_n")
    prior = moments.select(
        mean.alias("_mean"),
        F.when((spread > 0) & (chance > 0), F.least(F.greatest(chance / spread - 1, F.lit(1.0)), F.col("_n").cast("double")))
        .otherwise(F.col("_n").cast("double"))
        .alias("_strength"),
    )
    # One row a side: the moments are a single row.
    return hosts.crossJoin(F.broadcast(prior)).select(
        "_host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("_mean") * F.col("_strength")) / (F.col("n_docs") + F.col("_strength"))).alias("host_rate")
    )


def with_verdicts(counts: DataFrame, hosts: DataFrame, host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """Adds host_rate and kept."""
    hosts = checkpoint(hosts.select("_host", "host_rate"))
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    kept = [c for c in counts.columns if c not in ("host_rate", "kept")]
    return (
        counts.select(*kept)
        .join(F.broadcast(hosts) if small else hosts, F.col(host_col) == F.col("_host"), "left")
        .select(*kept, "host_rate", (~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= limit)).alias("kept"))
    )


def quality_verdicts(docs: DataFrame, host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept and host_rate for every document."""
    counts = checkpoint(text_counts(docs.select("doc_id", host_col, "text")).select("doc_id", host_col, *COUNTS, "base_failed"))
    return with_verdicts(counts, host_rates(counts, host_col), host_col, limit).drop(host_col)


def keep_good(docs: DataFrame, host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns.

    All rules count here, alone and by host. The verdict is computed beside the text in a second narrow pass, so texts are
    never shuffled: only the hosts' sums are.
    """
    hosts = host_rates(text_counts(docs.select(host_col, "text")).select(host_col, any_failed().alias("base_failed")), host_col)
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.col(host_col).alias("_source"))
    return with_verdicts(text_counts(inner).withColumn("base_failed", any_failed()), hosts, "_source", limit).where("kept").select("_row.*")
