"""Problem 1: lines repeated across one site's documents, found by a distributed PrefixSpan over line identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialise


def site_of(path: str = "source_path"):
    """The second part of a path web/<site>/..."""
    return F.split(F.col(path), "/").getItem(1)


def lettered(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """(site, document_id, line_no, letters): every line with letters; letters are lower-cased."""
    lines = df.select("site", "document_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    letters = F.regexp_replace(F.lower("line"), "[^\\p{L}]+", "")
    return lines.select("site", "document_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), letters.alias("letters")).where("letters <> ''")


def lines_of(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """(site, document_id, line_no, key): every line with letters; key is a 64-bit digest of its letters, case aside."""
    return lettered(df, text).select("site", "document_id", "line_no", F.xxhash64("letters").alias("key"))


def thresholds(df: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """The number of distinct documents each site's sequences must stand in."""
    n = df.groupBy("site").agg(F.count_distinct("document_id").alias("docs"))
    return n.select("site", "docs", F.greatest(F.lit(min_docs), F.ceil(F.col("docs") * F.lit(min_share) - 1e-9)).alias("needed"))


def frequent_lines(lines: DataFrame, needed: DataFrame) -> DataFrame:
    """PrefixSpan's first level: (site, key, support) of single lines with sufficient distinct-document support.

    Documents are made distinct before they are counted, and Spark combines on the map side, so a line that stands in a third of
    all rows is spread over tasks until only counts are left.
    """
    support = lines.select("site", "key", "document_id").distinct().groupBy("site", "key").agg(F.count("*").alias("support"))
    return support.join(needed, "site").where("support >= needed").select("site", "key", "support")


def _facts(own: list[int], sequence: list[int]) -> set[tuple[int, int, bool]]:
    """(place, key, early) of keys that stand in a document's gap before a place of a sequence it holds.

    The widest gap runs from the first end of what comes before to the last start of what follows; early ones stand before the last
    start within the first match. A key in the gap of every document makes a longer sequence of the same support.
    """
    first, at = [], 0
    for key in sequence:
        at = own.index(key, at) + 1
        first.append(at - 1)
    late, soon, hi, lo = [0] * len(first), [0] * len(first), len(own), first[-1] + 1
    for i in reversed(range(len(first))):
        hi = max(k for k in range(hi) if own[k] == sequence[i])
        lo = max(k for k in range(lo) if own[k] == sequence[i])
        late[i], soon[i] = hi, lo
    out: dict[tuple[int, int], bool] = {}
    for i in range(len(first)):
        for k in range(first[i - 1] + 1 if i else 0, late[i]):
            out[i, own[k]] = out.get((i, own[k]), False) or k < soon[i]
    return {(i, key, early) for (i, key), early in out.items()}


def closed_sequences(df: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(site, sequence, support): the closed frequent sequences of line keys, of any length, in order and with any lines between.

    PrefixSpan: each level extends every frequent sequence by the lines that follow its first match in a document, all places and
    repeats included, until no sequence is frequent. A sequence is closed if no longer one has its support; every frequent sequence
    is part of a closed one of the same support, so none is lost, and a block of n lines is one row instead of 2^n - 1. Prefixes that
    no closed sequence can begin with (a line stands before a place of theirs in every document) are dropped, which keeps the levels
    small. A document's row holds its frequent lines only. Rows of one document_id count once; empty input gives no rows.
    """
    lines, needed = lines_of(df), materialise(thresholds(df, min_docs, min_share))
    items = lines.join(frequent_lines(lines, needed).select("site", "key"), ["site", "key"])
    own = items.groupBy("site", "document_id").agg(F.sort_array(F.collect_set(F.struct("line_no", "key"))).alias("s"))
    level = materialise(own.select("site", "document_id", F.col("s.key").alias("own"), F.array().cast("array<bigint>").alias("sequence"), F.lit(0).alias("end")))
    before, found = None, None
    while True:
        # of each key after the first match its first place there
        rest = F.slice("own", F.col("end") + 1, F.size("own"))
        grown = level.select("site", "document_id", "own", "sequence", "end", F.explode(F.array_distinct(rest)).alias("key"), rest.alias("rest"))
        grown = grown.select("site", "document_id", "own", F.concat("sequence", F.array("key")).alias("sequence"), (F.col("end") + F.array_position("rest", F.col("key"))).cast("int").alias("end"))
        counts = materialise(grown.groupBy("site", "sequence").agg(F.count("*").alias("support")).join(needed, "site").where("support >= needed").select("site", "sequence", "support"))
        if before is not None:  # a sequence isn't closed if a later line follows it in all of its documents
            longest = counts.groupBy("site", F.slice("sequence", 1, F.size("sequence") - 1).alias("sequence")).agg(F.max("support").alias("after"))
            done = before.join(longest, ["site", "sequence"], "left").where("not inside and coalesce(after, 0) < support").select("site", "sequence", "support")
            done = materialise(done)
            found = done if found is None else found.unionByName(done)
        if counts.isEmpty():
            return found if found is not None else counts
        kept = materialise(grown.join(counts, ["site", "sequence"]))

        def gaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(s, q, *x, n) for s, q, o, n in zip(b.site, b.sequence, b.own, b.support) for x in _facts(list(o), list(q))]
                yield pd.DataFrame(rows, columns=["site", "sequence", "place", "key", "early", "support"])

        facts = kept.select("site", "sequence", "own", "support").mapInPandas(gaps, "site string, sequence array<bigint>, place int, key bigint, early boolean, support bigint")
        facts = facts.groupBy("site", "sequence", "support", "place", "key").agg(F.count("*").alias("n"), F.count_if("early").alias("e")).where("n = support")
        marks = facts.groupBy("site", "sequence").agg(F.lit(True).alias("inside"), F.bool_or(F.col("e") == F.col("support")).alias("dead"))
        before = materialise(counts.join(marks, ["site", "sequence"], "left").select("site", "sequence", "support", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("dead", F.lit(False)).alias("dead")))
        level = kept.join(before.where("not dead").select("site", "sequence"), ["site", "sequence"], "left_semi").drop("support")


def shown_sequences(df: DataFrame, **options) -> DataFrame:
    """(site, sequence, support) of closed_sequences, a sequence as its lines' letters, one line each."""
    found = closed_sequences(df, **options).withColumn("n", F.xxhash64("site", "sequence"))
    letters = lettered(df).select("letters").distinct().select(F.xxhash64("letters").alias("key"), "letters")
    parts = found.select("n", F.posexplode("sequence").alias("place", "key")).join(letters, "key")
    texts = parts.groupBy("n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "letters"))), lambda x: x.letters), "\n").alias("text"))
    return found.join(texts, "n").select("site", F.col("text").alias("sequence"), "support")


def web_documents(df: DataFrame) -> DataFrame:
    """(site, document_id, cleaned_text) of web pages with a non-empty cleaned_text."""
    return df.where("document_id is not null and metadata.source_url is not null and cleaned_text <> ''").select(site_of().alias("site"), "document_id", "cleaned_text")


def repeated_lines(df: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(document_id, line_no): occurrences of the lines of closed frequent sequences, single lines among them.

    Every line of a frequent sequence is frequent itself, so all of its places go. Null or empty texts, null sites and lines without
    letters have none.
    """
    often = closed_sequences(df, min_docs, min_share).select("site", F.explode("sequence").alias("key")).distinct()
    return lines_of(df).join(often, ["site", "key"], "left_semi").select("document_id", "line_no").distinct()


def without_lines(df: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id, text): each document once, its text without the lines found; documents without any keep theirs.

    A null text stays null. Only the line numbers travel to the documents, not the lines.
    """
    gone = found.groupBy("document_id").agg(F.collect_set("line_no").alias("gone"))
    docs = df.where("document_id is not null").dropDuplicates(["document_id"]).select("document_id", "cleaned_text").join(gone, "document_id", "left")
    kept = F.filter(F.split("cleaned_text", "\n"), lambda x, i: ~F.array_contains("gone", (i + 1).cast("bigint")))
    return docs.select("document_id", F.when(F.col("gone").isNull(), F.col("cleaned_text")).otherwise(F.array_join(kept, "\n")).alias("text"))
