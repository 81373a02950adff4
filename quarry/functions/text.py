"""Scalar text functions: tokenizers, cleaning, hashing, extraction. Expressions on columns, all JVM-side.

The tokenizers differ on purpose; each belongs to the operator that names it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and characters of the mixed tokenizer.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "by"]
STOP_CHARS = "的了是在和与这那有为等及或但而"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bm25_tokens(text: Column | str) -> Column:
    """Runs of letters and digits of the lower-cased text, then the bigrams of each run of Chinese characters; null for null."""
    t = _col(text)
    return F.concat(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.regexp_extract_all(t, F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), F.lit(1)))


def mixed_tokens(text: Column | str) -> Column:
    """The set of lower-cased words by white space without stop words and single characters, and of bigrams of all Chinese characters,
    gaps closed, without those that hold a stop character."""
    low = F.lower(_col(text))
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    joined = F.regexp_replace(low, r"[^\x{4e00}-\x{9fff}]", "")
    pairs = F.filter(F.regexp_extract_all(joined, F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), F.lit(1)), lambda p: ~p.rlike(f"[{STOP_CHARS}]"))
    return F.array_distinct(F.concat(words, pairs))


def duplicate_tokens(text: Column | str) -> Column:
    """The set of ASCII words and single Chinese characters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]"), F.lit(0)))


def contains_point(answer: Column, point: Column) -> Column:
    """Whether at least half of a point's words of more than three characters stand in the answer; false without such words."""
    words = F.transform(F.filter(F.split(F.trim(point), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.lower(w))
    hit = F.size(F.filter(words, lambda w: F.contains(F.lower(answer), w)))
    return (F.size(words) > 0) & (hit >= 0.5 * F.size(words))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def normalized_path(path: Column | str) -> Column:
    """Slashes forward and single, lower case."""
    return F.lower(F.regexp_replace(F.replace(_col(path), F.lit("\\"), F.lit("/")), "/+", "/"))


def normalized_text(text: Column | str) -> Column:
    """Lower case and white space collapsed: the part of full normalisation that SQL engines share."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[ \t\r\n]+", " "))


def content_hash(text: Column | str) -> Column:
    return F.sha2(normalized_text(text), 256)


def cleaned(text: Column | str) -> Column:
    """Line ends as LF, blanks collapsed and trimmed around line ends, at most one blank line in a row, ends trimmed; null is empty."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "\r\n?", "\n")
    for pattern, to in (("[ \t]{2,}", " "), ("\n[ \t]+", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n"), ("^[ \t\n]+", ""), ("[ \t\n]+$", "")):
        t = F.regexp_replace(t, pattern, to)
    return t


def snippet(text: Column | str, size: int = 200) -> Column:
    """The first size characters, back to the last blank if that lies past four fifths, and an ellipsis; short texts whole."""
    t = _col(text)
    head = F.substring(t, 1, size)
    blank = size - F.instr(F.reverse(head), " ")  # characters before the last blank
    cut = F.when((F.instr(head, " ") > 0) & (blank > 0.8 * size), F.substring(t, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(cut, F.lit("...")))


def inferred_language(text: Column | str) -> Column:
    """zh for Chinese without Latin letters, mixed for both with at least eight Chinese characters, else en."""
    t = _col(text)
    cjk, latin = F.length(F.regexp_replace(t, r"[^\x{4e00}-\x{9fff}]", "")), t.rlike("[A-Za-z]")
    return F.when((cjk > 0) & ~latin, "zh").when((cjk >= 8) & latin, "mixed").otherwise("en")


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def anchor(text: Column | str, words: int = 12) -> Column:
    """The first words of four letters or more."""
    return F.array_join(F.slice(F.regexp_extract_all(_col(text), F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, words), " ")


def numbers(text: Column | str) -> Column:
    """Distinct numbers in order, thousands separators dropped."""
    found = F.regexp_extract_all(_col(text), F.lit(r"-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))))


def percentages(text: Column | str) -> Column:
    """Distinct percentages in order, written with a sign, the English word or the Chinese prefix."""
    t = _col(text)
    after = F.regexp_extract_all(t, F.lit(r"([0-9]+(?:\.[0-9]+)?) ?(?:%|percent)"), F.lit(1))
    before = F.regexp_extract_all(t, F.lit(r"百分之([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(after, before), lambda x: x.cast("double"))))


def rule_references(text: Column | str) -> Column:
    """Sorted distinct rule numbers that a text refers to, in English or Chinese."""
    t = _col(text)
    en = F.regexp_extract_all(t, F.lit(r"[Rr]ules? ([0-9]{1,2}[A-Z]?\.[0-9]+)"), F.lit(1))
    zh = F.regexp_extract_all(t, F.lit(r"第([0-9]{1,2}[A-Z]?\.[0-9]+)(?:\([0-9]+\))?條"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(en, zh)))


def pieces(text: Column | str, size: int = 100) -> Column:
    """A text cut every size characters, as it is streamed to a client; none for an empty text."""
    t = _col(text)
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size)), lambda i: F.substring(t, (i * size + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sub_queries(query: Column | str) -> Column:
    """A query cut at and / or."""
    return F.filter(F.transform(F.split(_col(query), r"(?i)\s+(?:and|or)\s+"), lambda x: F.trim(x)), lambda x: x != "")
