"""Problem 5: one consistent form for texts that read the same.

Tables are built by rule from the Unicode character database; only the look-alike letters are fixed values.
Null texts stay null and empty texts stay empty.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata as U

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import materialise

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d",
    "һ": "h", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "ѵ": "v", "Ѵ": "V", "Ү": "Y", "ү": "y", "Ӏ": "I", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Latin letters of other orthographies, Armenian
    "ɡ": "g", "ɑ": "a", "ı": "i", "օ": "o", "ս": "u", "հ": "h",
    # hyphens that differ only in where a line may break
    "‐": "-", "‑": "-",
}
#: Compatibility decompositions that don't change what a reader sees.
READS_SAME = {"<wide>", "<narrow>", "<noBreak>", "<font>"}


def _parts(ch: str) -> str:
    """ch fully decomposed: canonically, and by those compatibility mappings that read the same."""
    if U.category(ch) == "Cf" or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or ch in "\r͏ᅟᅠㅤ":
        return ""
    if U.category(ch) == "Zs" or ch in "\t\x0b\x0c\x85":
        return " "
    if "가" <= ch <= "힣":  # Hangul syllables compose by arithmetic and stay as they are
        return ch
    found = U.decomposition(ch).split()
    if found and found[0][0] == "<":
        rest = "".join(chr(int(x, 16)) for x in found[1:])
        if found[0] in READS_SAME or (found[0] == "<compat>" and len(rest) > 1 and all(x.isascii() and (x.isalnum() or x == ".") for x in rest)):
            return "".join(map(_parts, rest))
    elif found:
        return "".join(_parts(chr(int(x, 16))) for x in found)
    return LOOKALIKES.get(ch, ch)


@functools.cache
def mapping() -> dict[str, str]:
    """Each code point that is not its own decomposition, with the code points it is read as. A few thousand rows, bounded by Unicode."""
    skip = lambda c: 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF
    return {ch: out for ch in (chr(c) for c in range(sys.maxunicode + 1) if not skip(c)) if (out := _parts(ch)) != ch}


@functools.cache
def unstable() -> list[str]:
    """Code points that change when a text is brought to the consistent form; precomposed letters don't."""
    return [ch for ch, out in mapping().items() if U.normalize("NFC", out) != ch]


def _ranges(chars: list[str]) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if found and c == found[-1][1] + 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return [(a, b) for a, b in found]


#: Full-width forms stand 0xFEE0 above ASCII; blanks of any width are one blank. Both fold by arithmetic.
WIDE, BLANK = [chr(c) for c in range(0xFF01, 0xFF5F)], [chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]


def _java(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


@functools.cache
def java_class() -> str:
    """A Java regular expression: one code point that may change otherwise than in its width."""
    return "[\\p{M}" + _java(_ranges(sorted({*unstable()} - {*WIDE, *BLANK}))) + "]"


@functools.cache
def _usual() -> list[tuple[int, int]]:
    """Ranges of code points that most texts keep to and that never change."""
    may = {*map(ord, unstable())} | {c for c in range(sys.maxunicode + 1) if U.category(chr(c))[0] == "M"}
    usual = [chr(c) for a, b in ((0x0A, 0x0A), (0x20, 0x17F), (0x2013, 0x203A), (0x3001, 0x3011), (0x4E00, 0x9FFF)) for c in range(a, b + 1) if c not in may]
    return _ranges(usual)


def java_unusual() -> str:
    """A cheap Java regular expression: one code point outside the usual ranges that isn't only of another width."""
    return "[^" + _java(_usual()) + _java(_ranges(WIDE + BLANK)) + "]"


@functools.cache
def python_unusual() -> re.Pattern:
    return re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _usual()) + "]")


@functools.cache
def python_class() -> re.Pattern:
    marks = [chr(c) for c in range(sys.maxunicode + 1) if U.category(chr(c))[0] == "M"]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _ranges(sorted({*unstable(), *marks}))) + "]")


@functools.cache
def _table() -> dict[int, str]:
    return {ord(a): b for a, b in mapping().items()}


_BLANKS = re.compile(r" (?=\n)|(?<=\n) ")


def fold(text: str | None) -> str | None:
    """The same form as consistent_form, for use inside Arrow functions: whole texts of a batch at a time."""
    if text is None:
        return None
    if not text.isascii() and python_unusual().search(text) and python_class().search(text):
        text = U.normalize("NFC", U.normalize("NFD", text.translate(_table())))
    elif "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
        text = text.translate(_table())
    if "  " in text:
        text = re.sub(" {2,}", " ", text)
    if " \n" in text or "\n " in text:
        text = _BLANKS.sub("", text)
    return text.strip(" \n")


def even_width(text: Column) -> Column:
    """Full-width ASCII and blanks folded by arithmetic; only texts that hold any are rewritten."""
    folded = F.translate(text, "".join(WIDE + BLANK), "".join(chr(ord(c) - 0xFEE0) for c in WIDE) + " " * len(BLANK))
    return F.when(text.rlike("[" + _java(_ranges(WIDE + BLANK)) + "]"), folded).otherwise(text)


def tidy_blanks(text: Column) -> Column:
    """Runs of blanks as one, none at the ends of lines or of the text."""
    tidy = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), "(?<=\n) | (?=\n)", "")
    return F.trim(F.when(text.rlike("  | \n|\n "), tidy).otherwise(text), F.lit(" \n"))


def consistent_form(df: DataFrame, key: str, text: str, out: str = "form") -> DataFrame:
    """df's key and its text in the form shared by all texts that read the same.

    Rows of one key count once (any of them: they hold one text). Full-width ASCII and blanks fold by arithmetic. Texts that
    then still hold a code point which may change are exploded to positioned code points, joined with the broadcast decomposition
    and look-alike table (bounded by Unicode), combining marks are put in order of their class, clusters recomposed by a second
    broadcast table, and the text rebuilt; a group is one text. Null and empty texts come out as they are.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    # ASCII texts are told by their sizes; only control characters change in them
    ascii_only = F.octet_length("_t") == F.length("_t")
    changes = F.when(ascii_only, F.col("_t").rlike(r"[\t\r\x0B\f]")).otherwise(F.col("_t").rlike(java_unusual()) & F.col("_t").rlike(java_class()))
    plain = base.where(~F.coalesce(changes, F.lit(False))).select("_k", even_width(F.col("_t")).alias(out))
    # few bytes but much work: a fixed number of parts, which adaptive execution doesn't join up again
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    letters = base.where(changes).repartition(parts, "_k").dropDuplicates(["_k"]).select("_k", F.posexplode(F.split(even_width(F.col("_t")), "")).alias("_p", "_c"))
    decompose, compose = _frames(spark)
    read_as = letters.join(F.broadcast(decompose), letters._c == decompose.ch, "left")
    read_as = read_as.select("_k", "_p", F.posexplode(F.when(F.col("ch").isNull(), F.array("_c")).otherwise(F.col("parts"))).alias("_q", "_c"))
    marks = F.col("_c").rlike("^\\p{M}")
    w = Window.partitionBy("_k").orderBy("_p", "_q")
    cluster = read_as.withColumn("_m", marks).withColumn("_g", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(w))
    # runs of two or more code points in one cluster hold marks: put them in order of their class
    classes = _classes(spark)
    ranked = cluster.join(F.broadcast(classes), cluster._c == classes.mark, "left")
    grouped = ranked.groupBy("_k", "_g").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("ccc", F.lit(-1)).alias("o"), "_p", "_q", "_c"))).alias("s"))
    s = F.transform("s", lambda x: x._c)
    grouped = grouped.select("_k", "_g", F.array_join(s, "").alias("_all"), F.array_join(F.slice(s, 1, 2), "").alias("_two"), F.array_join(F.slice(s, 3, 1 << 30), "").alias("_rest"))
    full, pair = compose.select(F.col("parts").alias("_f"), F.col("ch").alias("_fc")), compose.select(F.col("parts").alias("_h"), F.col("ch").alias("_hc"))
    joined = grouped.join(F.broadcast(full), grouped._all == full._f, "left").join(F.broadcast(pair), grouped._two == pair._h, "left")
    built = joined.select("_k", "_g", F.coalesce("_fc", F.concat("_hc", "_rest"), "_all").alias("_c"))
    rebuilt = built.groupBy("_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_g", "_c"))), lambda x: x._c), "").alias(out))
    return plain.unionByName(rebuilt).select(F.col("_k").alias(key), tidy_blanks(F.col(out)).alias(out))


def _frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    decompose = spark.createDataFrame([(a, list(b)) for a, b in mapping().items()], "ch string, parts array<string>")
    whole = [(U.normalize("NFD", ch), ch) for ch, out in mapping().items() if len(out) > 1 and U.normalize("NFC", out) == ch]
    return decompose, spark.createDataFrame(whole, "parts string, ch string")


def _classes(spark: SparkSession) -> DataFrame:
    rows = [(chr(c), U.combining(chr(c))) for c in range(sys.maxunicode + 1) if U.category(chr(c))[0] == "M"]
    return spark.createDataFrame(rows, "mark string, ccc int")


def _classes_of(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, raw, form) of texts that share their form with another text, and (form, raw, head, copies) of those texts."""
    given = df.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("id"), F.col(text).alias("t"))
    formed = consistent_form(given, "id", "t", "form").select("id", F.md5("form").alias("form"))
    raw = given.select("id", F.md5("t").alias("raw"))
    both = materialise(raw.join(formed, "id").distinct())
    texts = both.groupBy("form", "raw").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    several = texts.groupBy("form").agg(F.count("*").alias("texts")).where("texts > 1")
    return both, materialise(texts.join(several, "form"))


def same_reading_pairs(df: DataFrame, key: str, text: str, all_up_to: int = 1000) -> DataFrame:
    """Pairs (id_a, id_b), smaller first, whose texts read the same but differ in code points; empty and null texts make none, nor do rows without an id.

    Forms are compared by 128-bit digests. Different texts of one form are paired first, each text once, and only then do a pair's
    copies meet, so the work is that of writing the pairs. Only copies of equal code points are represented: of a text with more than
    all_up_to copies, an id is paired with the smallest id of every other text of its class, and the smallest id with every id, so no
    link between different texts is lost and a hot text's copies aren't multiplied; texts of up to all_up_to copies give all their pairs.
    same_reading_classes gives one row an id whatever the number of copies.
    """
    both, texts = _classes_of(df, key, text)
    a, b = texts.alias("a"), texts.alias("b")
    met = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.raw") < F.col("b.raw"))).select(
        F.col("a.raw").alias("ra"), F.col("b.raw").alias("rb"), F.col("a.head").alias("ha"), F.col("b.head").alias("hb"), (F.greatest("a.copies", "b.copies") > all_up_to).alias("hot")
    )
    met = materialise(met)
    x, y = both.select(F.col("raw").alias("ra"), F.col("id").alias("p")), both.select(F.col("raw").alias("rb"), F.col("id").alias("q"))
    few = met.where("not hot").join(x, "ra").join(y, "rb").select("p", "q")
    hot = met.where("hot")
    led = hot.join(y, "rb").select(F.col("ha").alias("p"), "q").unionByName(hot.join(x, "ra").where("p <> ha").select("p", F.col("hb").alias("q")))
    out = few.unionByName(led)
    return out.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def same_reading_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class_id, links) of every id whose text reads like another text: the smallest id of its class, and how many ids of the class
    hold other code points. Linear in the rows; empty and null texts and rows without an id are in no class."""
    both, texts = _classes_of(df, key, text)
    classes = texts.groupBy("form").agg(F.min("head").alias("class_id"), F.sum("copies").alias("n"))
    counts = texts.join(classes, "form").select("form", "raw", "class_id", (F.col("n") - F.col("copies")).alias("links"))
    return both.join(counts, ["form", "raw"]).select("id", "class_id", "links")
