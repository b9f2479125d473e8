"""Canonical exact digests in DataFrame functions alone (operator 10).

A text is put in Unicode normal form C, case-folded, put in form C again (folding
can leave it) and has its white space folded; the digest is two chained 64-bit xxhashes of the result. Documents are
grouped by digest, and inside a group that holds more than one document the
bytes are compared: its least and greatest canonical text must be equal.

Form C is reached with built-in functions: one pattern, derived from the
Unicode tables, tells whether a text could change at all (it can't unless it
holds combining characters or characters with a canonical mapping of their
own). Only such texts are cut into clusters, decomposed, reordered and composed.

Defined results: a null text counts as empty; empty texts are equal to each
other and to texts of white space alone. Rows that share an id are separate
documents; the one whose text has the least hash is "the next document" of the
id before, and the rows of an id share their next document. Rows without an id
have no next document: nothing replaces their last quarter. A single document
is its own next one. Extra columns are ignored. An empty table gives an empty
result. Very long texts take part whole: all work is inside the row.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import checkpoint, let

#: Up to so many digests of repeated texts are sent to every executor; beyond, they are shuffled.
BROADCAST_DIGESTS = 200_000

#: Hangul syllables are composed by arithmetic; fixed values of the Unicode standard.
HANGUL, LEADING, VOWEL, TRAILING = 0xAC00, 0x1100, 0x1161, 0x11A7
VOWELS, TRAILERS = 21, 28


@cache
def tables() -> tuple[str, str, dict[str, str], dict[str, str], dict[str, int]]:
    """(quick-check class, extending class, decompositions, compositions, combining classes), from the Unicode tables."""
    apart, together, order = {}, {}, {}
    for c in map(chr, range(0x110000)):
        if HANGUL <= ord(c) < HANGUL + 11172 or 0xD800 <= ord(c) < 0xE000:
            continue
        full = unicodedata.normalize("NFD", c)
        if full != c:
            apart[c] = full
            pair = unicodedata.decomposition(c).split()
            if len(pair) == 2 and unicodedata.normalize("NFC", c) == c:
                together["".join(chr(int(p, 16)) for p in pair)] = c
        if unicodedata.combining(c):
            order[c] = unicodedata.combining(c)
    jamo = {chr(c) for c in (*range(VOWEL, VOWEL + VOWELS), *range(TRAILING + 1, TRAILING + TRAILERS))}
    extending = set(order) | {c for c in apart if unicodedata.combining(apart[c][0])} | {pair[1] for pair in together} | jamo
    changing = extending | {c for c in apart if unicodedata.normalize("NFC", c) != c}

    def as_class(chars: set[str]) -> str:
        points, runs = sorted(map(ord, chars)), []
        for p in points:
            if runs and p == runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)

    return as_class(changing), as_class(extending), apart, together, order


def literal_map(values: dict) -> Column:
    """One string literal, which the optimizer folds to a map once a plan."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in values.items() if k not in "\x01\x02")), F.lit("\x02"), F.lit("\x01"))


def code_point(c: Column) -> Column:
    return F.ascii(c)


def from_code_point(n: Column) -> Column:
    """A character of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def composed(cluster: Column, apart: Column, together: Column, order: Column) -> Column:
    """Form C of one cluster: a character and those that extend it."""
    text = lambda c: c.cast("string")

    def split_hangul(c: Column) -> Column:
        n = code_point(c) - HANGUL
        tail = n % TRAILERS
        return F.when(
            (n >= 0) & (n < 11172),
            F.concat(
                from_code_point(LEADING + F.floor(n / (VOWELS * TRAILERS))),
                from_code_point(VOWEL + F.floor(n % (VOWELS * TRAILERS) / TRAILERS)),
                F.when(tail > 0, from_code_point(TRAILING + tail)).otherwise(""),
            ),
        ).otherwise(F.coalesce(F.element_at(apart, c), c))

    pieces = F.split(F.array_join(F.transform(F.split(cluster, ""), split_hangul), ""), "")
    classed = F.transform(F.filter(pieces, lambda c: c != ""), lambda c, i: F.struct(F.coalesce(F.element_at(order, c).cast("int"), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))

    # Runs of non-zero classes are put in order: each mark carries the place of the last starter before it.
    def placed(p: Column) -> Column:
        starts = F.transform(p, lambda x: F.when(x["k"] == 0, x["i"]).otherwise(F.array_max(F.transform(F.filter(F.slice(p, 1, x["i"] + 1), lambda y: y["k"] == 0), lambda y: y["i"]))))
        return F.array_sort(F.transform(F.arrays_zip(p.alias("p"), starts.alias("s")), lambda z: F.struct(F.coalesce(z["s"], F.lit(-1)).alias("s"), z["p"]["k"].alias("k"), z["p"]["i"].alias("i"), z["p"]["c"].alias("c"))))

    def pair(a: Column, b: Column) -> Column:
        first, second = code_point(a), code_point(b)
        lead, vowel, tail = first - LEADING, second - VOWEL, second - TRAILING
        open_syllable = (first >= HANGUL) & (first < HANGUL + 11172) & ((first - HANGUL) % TRAILERS == 0)
        return (
            F.when((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < VOWELS), from_code_point(HANGUL + (lead * VOWELS + vowel) * TRAILERS))
            .when(open_syllable & (tail > 0) & (tail < TRAILERS), from_code_point(first + tail))
            .otherwise(F.element_at(together, F.concat(a, b)))
        )

    def step(state: Column, x: Column) -> Column:
        free = (state["held"] == "") | ((x["k"] > state["last"]) & (state["last"] > 0))
        made = F.when((state["starter"] != "") & free, pair(state["starter"], x["c"]))
        return let(
            made,
            lambda m: F.when(m.isNotNull(), F.struct(state["out"].alias("out"), m.alias("starter"), state["held"].alias("held"), state["last"].alias("last")))
            .when(
                x["k"] == 0,
                F.struct(F.concat(state["out"], state["starter"], state["held"]).alias("out"), x["c"].alias("starter"), F.lit("").alias("held"), F.lit(0).alias("last")),
            )
            .otherwise(F.struct(state["out"].alias("out"), state["starter"].alias("starter"), F.concat(state["held"], x["c"]).alias("held"), x["k"].alias("last"))),
        )

    zero = F.struct(text(F.lit("")).alias("out"), text(F.lit("")).alias("starter"), text(F.lit("")).alias("held"), F.lit(0).alias("last"))
    return let(classed, lambda p: let(placed(p), lambda ordered: F.aggregate(ordered, zero, step, lambda s: F.concat(s["out"], s["starter"], s["held"]))))


#: Nothing below U+0300 can change, nor can Han characters of the main blocks or Hangul syllables. The
#: engine tries a class's parts from the left, so most characters never meet the long list of ranges.
COMMON = r"\x{300}-\x{10FFFF}&&[^\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]&&"


def normal_form_c(text: Column) -> Column:
    changing, extending, apart, together, order = tables()
    changing = f"{COMMON}[{changing}]"
    maps = F.struct(literal_map(apart).alias("a"), literal_map(together).alias("t"), literal_map(order).alias("o"))
    clusters = F.regexp_extract_all(text, F.lit(f"(?s)[^{extending}]?[{extending}]*"), F.lit(0))
    slow = let(
        maps,
        lambda m: F.array_join(F.transform(F.filter(clusters, lambda c: c != ""), lambda c: F.when(c.rlike(f"[{changing}]"), composed(c, m["a"], m["t"], m["o"])).otherwise(c)), ""),
    )
    return F.when(text.rlike(f"[{changing}]"), slow).otherwise(text)


def canonical(text: Column) -> Column:
    """In form C, case-folded, in form C again, white space folded; null as empty.

    Without the first step a mark whose upper case is a letter would stop the reordering of those around it.
    """
    # The step between keeps the optimizer from reading lower(upper(x)) as lower(x), which would lose "ß" = "ss".
    upper = F.replace(F.upper(normal_form_c(F.coalesce(text, F.lit("")))), F.lit("ẞ"), F.lit("SS"))
    folded = F.replace(F.lower(upper), F.lit("ς"), F.lit("σ"))
    return let(folded, lambda x: F.trim(F.regexp_replace(normal_form_c(x), r"(?U)\s+", " ")))


def digest(canonical_text: Column) -> Column:
    """128 bits in hexadecimal: the second hash is seeded with a first one of a constant."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return let(canonical_text, lambda c: F.concat(half(F.xxhash64(c)), half(F.xxhash64(F.lit("wide"), c))))


def group_table(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fingerprint, group_id, group_size) of `marked` (_id, fingerprint), after the byte comparison.

    Only digests are shuffled for most documents. Where a digest occurs more than
    once, its least and greatest canonical text are compared (combined in each
    task first, so a third of all rows in one group costs one row a task). Should
    a digest ever hold different texts, the run stops rather than join them.
    """
    groups = checkpoint(marked.groupBy("fingerprint").agg(F.min("_id").alias("group_id"), F.count("*").alias("group_size")))
    texts = docs.select(canonical(F.col(text_col)).alias("_text")).withColumn("fingerprint", digest(F.col("_text")))
    repeated = groups.where("group_size > 1").select("fingerprint")
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    compared = texts.join(repeated, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most"))
    same = compared.select(F.col("fingerprint"), F.assert_true(F.col("_least") == F.col("_most"), "one digest holds different texts").alias("_checked"))
    if same.where(F.col("_checked").isNotNull()).count():  # runs the comparison; assert_true gives null
        raise AssertionError
    return groups


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id, group_size): documents of equal canonical bytes share a group, named by its least id."""
    marked = checkpoint(docs.select(F.col(id_col).alias("_id"), digest(canonical(F.col(text_col))).alias("fingerprint")))
    return marked.join(group_table(docs, marked, id_col, text_col), "fingerprint").select(F.col("_id").alias(id_col), "fingerprint", "group_id", "group_size")


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(_id, _next): each distinct id and the one that follows, the last followed by the first.

    Ids alone are range-partitioned; each partition pairs its own, and the last id
    of each is joined to the first of the next that has any. One row a partition
    is gathered for that.
    """
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    parts = checkpoint(ids.repartitionByRange("_id").withColumn("_part", F.spark_partition_id()))
    inner = parts.withColumn("_next", F.lead("_id").over(Window.partitionBy("_part").orderBy("_id")))
    ends = parts.groupBy("_part").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    ring = Window.orderBy("_part")
    seams = ends.withColumn("_after", F.coalesce(F.lead("_first").over(ring), F.min("_first").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return inner.join(F.broadcast(seams.select(F.col("_last").alias("_id"), "_after")), "_id", "left").select("_id", F.coalesce("_next", "_after").alias("_next"))


def edited_documents(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, _text, _edited): each text, and the same with its last quarter taken from the next document's start.

    The texts are shuffled once by id (both joins use one exchange); what travels
    on to the document before is no longer than a quarter of that document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    need = docs.groupBy(F.col(id_col).alias("_id")).agg(F.floor(F.max(F.length(text)) / 4).cast("int").alias("_need"))
    asks = checkpoint(pairs.join(need, "_id").select(F.col("_next").alias("_id"), F.col("_id").alias("_asker"), "_need"))
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), text.alias("_text"))
    heads = (
        whole.join(asks, "_id")
        .select(F.col("_asker").alias("_id"), F.struct(F.xxhash64("_text"), F.expr("substring(_text, 1, _need)").alias("head")).alias("_head"))
        .groupBy("_id")
        .agg(F.min("_head")["head"].alias("_head"))
    )
    joined = whole.join(heads, "_id", "left").unionByName(
        docs.where(F.col(id_col).isNull()).select(F.col(id_col).alias("_id"), text.alias("_text"), F.lit("").alias("_head"))
    )
    quarter = "cast(floor(length(_text) / 4) as int)"
    edited = F.concat(F.expr(f"substring(_text, 1, length(_text) - {quarter})"), F.expr(f"substring(coalesce(_head, ''), 1, {quarter})"))
    return joined.select("_id", F.xxhash64("_text").alias("_hash"), "_text", edited.alias("_edited"))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of every text and its edited text, their likeness, that to the next document, and the group of equals.

    An exact digest is alike (1.0) or not (0.0).
    """
    pairs = checkpoint(next_ids(docs, id_col))
    own = edited_documents(docs, pairs, id_col, text_col).select(
        "_id", "_hash", F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        digest(canonical(F.col("_text"))).alias("fingerprint"), digest(canonical(F.col("_edited"))).alias("edited_fingerprint"),
    )
    own = checkpoint(own)
    first = own.groupBy(F.col("_id").alias("_next")).agg(F.min_by("fingerprint", F.struct("_hash", "fingerprint")).alias("_next_fingerprint"))
    nexts = pairs.join(first, "_next").select(F.col("_id").alias("_key"), "_next_fingerprint")
    groups = group_table(docs, own.select("_id", "fingerprint"), id_col, text_col)
    alike = lambda other: F.coalesce(F.col("fingerprint") == other, F.lit(False)).cast("double")
    return (
        own.join(nexts, F.col("_id") == F.col("_key"), "left")
        .join(groups, "fingerprint", "left")
        .select(
            F.col("_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            alike(F.col("edited_fingerprint")).alias("near_edited"), alike(F.col("_next_fingerprint")).alias("near_next"), "group_id", "group_size",
        )
    )
