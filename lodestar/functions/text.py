"""Column expressions over text. All run on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import patterns as P


def any_match(col: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col.rlike(p) for p in patterns])


def strip(col: Column) -> Column:
    """A text without white space at its ends. One argument, so that array functions can take it (`F.trim` would take the place in the array as characters to cut)."""
    return F.btrim(col, F.lit(" \t\n\r\f\v"))


def words(col: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"\s+"), lambda w: w != "")


def token_count(col: Column, how: str = "words") -> Column:
    """Tokens of a text; `how` is "words" or "quarters" (characters / 4, rounded up)."""
    if how == "words":
        return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"\S+")).cast("long")
    return F.ceil(F.length(F.coalesce(col, F.lit(""))) / 4)


def trimmed_lines(col: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), "\n"), strip), lambda x: x != "")


def strip_html(col: Column) -> Column:
    """Text of an HTML fragment: scripts and styles go, <br> breaks the line, six entities are decoded."""
    out = F.regexp_replace(col, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def heading_level(col: Column) -> Column:
    """Depth of a leading number such as 13.2.1; 1 without one."""
    number = F.regexp_extract(col, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def is_heading_like(col: Column) -> Column:
    first = F.trim(F.substring_index(F.coalesce(col, F.lit("")), "\n", 1))
    return (first != "") & (first.rlike(P.HEADING_NUMBERED) | first.rlike(P.HEADING_KEYWORD))


def is_ocr_garbage(col: Column) -> Column:
    text = F.trim(F.coalesce(col, F.lit("")))
    # characters are counted by what is left of a text without the others' runs: a match a run, not one a character
    alnum = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z0-9]+", ""))
    symbols = F.length(F.regexp_replace(text, r"[\sA-Za-z0-9]+", ""))
    return (text == "") | text.rlike(P.OCR_GARBAGE) | (alnum == 0) | (symbols / (alnum + symbols) > 0.55)


def is_reference_table(col: Column) -> Column:
    lines = trimmed_lines(col)
    grid = F.exists(F.slice(lines, 1, 2), lambda x: x.rlike(P.TABLE_DELIMITER))
    return (F.size(lines) >= 2) & grid & col.rlike(P.TABLE_SIGNAL)


def is_reference_list(col: Column) -> Column:
    return F.trim(col).rlike(P.LIST_START) & col.rlike(P.LIST_SIGNAL)


def has_body_beyond_footer(col: Column) -> Column:
    """Text that stays meaningful once footer lines are taken away."""
    body = F.array_join(F.filter(trimmed_lines(col), lambda x: ~x.rlike(P.FOOTER_HEADER) & ~x.rlike(P.FOOTER_EXTRA)), " ")
    n = token_count(body)
    return (n >= 5) & (body.rlike(P.PROCEDURE_SIGNAL) | body.rlike(P.BULLET) | body.rlike(P.TABLE_SIGNAL) | (n >= 10))


def imperative_verbs(col: Column) -> Column:
    """Imperative verbs of a text in order, repeats included."""
    verbs = F.array(*map(F.lit, P.IMPERATIVE_VERBS))
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[\s,;:.!?()\[\]{}]+"), lambda w: F.array_contains(verbs, w))


def has_verb_object(col: Column) -> Column:
    return col.rlike(rf"(?i)\b(?:{'|'.join(P.IMPERATIVE_VERBS)})\s+(?:a|an|the|each|all|any)?\s*\w+")


def is_empty_content(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike(P.EMPTY_CONTENT)


def boilerplate_hash(col: Column) -> Column:
    """SHA-256 of a text without dates, page references and version stamps."""
    out = F.lower(col)
    for pattern in P.HASH_STRIPS:
        out = F.regexp_replace(out, pattern, "")
    return F.sha2(F.trim(F.regexp_replace(out, r"\s+", " ")), 256)


def is_protected(col: Column, domain_terms: str | None = None) -> Column:
    out = any_match(col, P.PROTECTED)
    return out | col.rlike(domain_terms) if domain_terms else out


def rule_boilerplate(col: Column, own: tuple[tuple[str, str], ...] = ()) -> Column:
    """Label of the first boilerplate rule that matches, or null; `own` are a corpus's (pattern, label) pairs, such as its export headers."""
    return F.coalesce(*[F.when(col.rlike(pattern), F.lit(label)) for pattern, label in (*P.BOILERPLATE_RULES, *own)])


def is_low_information(col: Column, domain_terms: str | None = None) -> Column:
    few = F.size(F.array_distinct(words(F.lower(col)))) < 10
    return few & ~col.rlike(domain_terms) if domain_terms else few


def is_meaningful_short(content: Column, kind: Column) -> Column:
    """A short fragment worth keeping: lists, specifications, safety notes, compact bullets, steps or ranges."""
    n = token_count(content)
    bullets = F.filter(trimmed_lines(content), lambda x: x.rlike(P.BULLET))
    compact = (F.size(bullets) >= 2) & F.forall(bullets, lambda x: token_count(F.regexp_replace(x, r"^[-*•]\s*", "")) <= 8)
    return (
        ((kind == "list") & content.rlike(P.BULLET) & content.rlike(P.SHORT_LIST))
        | (content.rlike(P.EQUIPMENT_SPEC) & n.between(4, 30))
        | (content.rlike(P.SAFETY) & n.between(3, 40))
        | compact
        | (content.rlike(P.STEP_SIGNAL) & content.rlike(P.SHORT_PROCEDURE))
        | (content.rlike(P.SHORT_PROCEDURE) & content.rlike(P.SHORT_CONTEXT))
        | (content.rlike(P.VALUE_RANGE) & content.rlike(P.SHORT_LIST))
    )


def is_valuable_broken(content: Column) -> Column:
    """A fragment of broken structure that still holds a specification, setting, warning, step or reading."""
    n = token_count(content)
    number = content.rlike(r"\b\d+")
    return (n <= 50) & (
        (content.rlike(P.EQUIPMENT_SPEC) & (n >= 3))
        | (content.rlike(P.BROKEN_SETTING) & number)
        | (content.rlike(P.SAFETY) & (n >= 3))
        | (content.rlike(P.STEP_SIGNAL) & content.rlike(P.SHORT_PROCEDURE))
        | (content.rlike(P.BROKEN_RESULT) & number)
    )


def printable_ratio(col: Column) -> Column:
    """Share of ASCII letters, digits, white space and ten common marks."""
    n = F.length(col)
    return F.when(n > 0, (n - F.regexp_count(col, F.lit(P.UNPRINTABLE))) / n).otherwise(0.0)


def mean_token_score(col: Column) -> Column:
    """1 where the mean token has 3 to 8 characters, falling linearly outside."""
    n = token_count(col)
    mean = F.length(F.regexp_replace(col, r"\s+", "")) / n
    return (
        F.when(n == 0, 0.0)
        .when(mean.between(3, 8), 1.0)
        .when(mean < 3, mean / 3)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (mean - 8) / 4))
    )


def dictionary_hit_rate(col: Column, vocabulary: list[str] | None = None) -> Column:
    """Share of the distinct words, ASCII letters alone, that are in the vocabulary."""
    terms = F.array(*map(F.lit, vocabulary or P.COMMON_WORDS))
    cleaned = F.array_distinct(F.filter(F.transform(words(F.lower(col)), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: w != ""))
    return F.when(F.size(cleaned) > 0, F.size(F.array_intersect(cleaned, terms)) / F.size(cleaned)).otherwise(0.0)


def suspicious_rate(col: Column) -> Column:
    """Share of tokens that look like noise, and single characters from the third in a row on."""
    odd = lambda t: any_match(t, P.SUSPICIOUS) | t.rlike(r"^(.)\1{2,}$")
    tokens = words(col)
    found = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("n")),
        lambda a, t: F.when(odd(t), F.struct(F.lit(0).alias("run"), (a["n"] + 1).alias("n")))
        .when(F.length(t) == 1, F.struct((a["run"] + 1).alias("run"), (a["n"] + F.when(a["run"] >= 2, 1).otherwise(0)).alias("n")))
        .otherwise(F.struct(F.lit(0).alias("run"), a["n"].alias("n"))),
        lambda a: a["n"],
    )
    return F.when(F.size(tokens) > 0, found / F.size(tokens)).otherwise(0.0)


def trigrams(col: Column) -> Column:
    """Distinct trigrams of each word, lower case, padded with two spaces before and one after."""
    tokens = F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(tokens, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(x) if isinstance(x, str) else x) for c, x in pairs]))
