"""From raw documents to structure-aware chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A heading line is a word or none, a number of so many parts, an optional colon or dash, and a title; each opens a block of its kind.
_NUMBER = r"(\d{1,3}[A-Za-z]?(?:\.\d{1,3}){0,%d})[ \t]*[:-]?[ \t]*(.*)"
HEADINGS = {"chapter": r"(?:Chapter|CHAPTER)[ \t]+" + _NUMBER % 0, "section": r"(?:Section|SECTION)[ \t]+" + _NUMBER % 1, "rule": _NUMBER % 2}


def structure_blocks(docs: DataFrame, compat: bool = False) -> DataFrame:
    """(document_id, kind, number, title, start, stop, text, chapter): a block runs from its heading to the next of the same kind;
    documents without headings are one block of kind document.

    Headings are found line by line, with running offsets; a heading without a title of its own has the next line that isn't blank as
    title, and that line stays part of the text. chapter is the chapter heading that precedes the block; with compat, every
    block that isn't a chapter gets the document's last chapter instead. Rows of one id count once; null texts are empty.
    """
    base = docs.select("document_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["document_id"])
    lines = base.select("document_id", F.posexplode(F.split("text", "\n")).alias("n", "line"), F.length("text").alias("size"))
    order = Window.partitionBy("document_id").orderBy("n")
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the next line with text: the last one from the end
    back = Window.partitionBy("document_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("next", F.last(F.when(F.trim("line") != "", F.trim("line")), ignorenulls=True).over(back))
    kinds = F.array(*[F.when(F.col("line").rlike("^" + p + "$"), F.struct(F.lit(k).alias("kind"), F.trim(F.regexp_extract("line", "^" + p + "$", 1)).alias("number"), F.trim(F.regexp_extract("line", "^" + p + "$", 2)).alias("title"))) for k, p in HEADINGS.items()])
    heads = placed.select("document_id", "start", "size", "next", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("h"))
    heads = heads.select("document_id", "start", "size", "h.kind", "h.number", F.coalesce(F.when(F.col("h.title") != "", F.col("h.title")), "next", F.lit("")).alias("title"))
    stop = F.lead("start").over(Window.partitionBy("document_id", "kind").orderBy("start"))
    label = F.when(F.col("kind") == "chapter", F.concat(F.lit("Chapter "), "number", F.when(F.col("title") != "", F.concat(F.lit(": "), "title")).otherwise("")))
    whole = Window.partitionBy("document_id").orderBy("start", "kind")
    chapter = F.last(label, ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if compat else Window.currentRow))
    heads = heads.withColumn("stop", F.coalesce(stop, "size")).withColumn("chapter", F.when(F.col("kind") == "chapter", label).otherwise(chapter))
    cut = base.join(heads, "document_id", "left")
    out = cut.select(
        "document_id", F.coalesce("kind", F.lit("document")).alias("kind"), "number", F.nullif("title", F.lit("")).alias("title"), F.coalesce("start", F.lit(0)).cast("int").alias("start"),
        F.coalesce("stop", F.length("text")).cast("int").alias("stop"), "text", "chapter",
    )
    return out.withColumn("text", F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")))


def windows(docs: DataFrame, key: str = "doc_id", width: int = 1500, overlap: int = 100) -> DataFrame:
    """(key, chunk_order, char_start, char_end, text): sliding windows, stripped of white space; empty and null texts have none."""
    at = docs.where(F.length("text") > 0).select(key, "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(width - overlap))).alias("chunk_order", "char_start"))
    piece = F.regexp_replace(F.substring("text", F.col("char_start") + 1, F.lit(width)), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return at.select(key, "chunk_order", "char_start", F.least(F.col("char_start") + width, F.length("text")).alias("char_end"), piece.alias("text"))


def packed(paragraphs: list[str], width: int, overlap: int) -> list[str]:
    """Paragraphs packed greedily with a blank line between. A new chunk begins with the end of the last one, as far as the width
    allows: no chunk passes it. Paragraphs beyond the width slide."""
    out: list[str] = []
    held: list[str] = []

    def room() -> int:
        return width - sum(map(len, held)) - 2 * len(held)

    def close() -> str:
        whole = "\n\n".join(held)
        if whole:
            out.append(whole)
        held.clear()
        return whole

    for p in filter(None, (x.strip() for x in paragraphs)):
        if len(p) > width:
            close()
            out += [p[i : i + width] for i in range(0, len(p), width - overlap)]
            continue
        if len(p) > room():
            last = close()
            carried = min(overlap, width - len(p) - 2)
            if len(last) > overlap and carried > 0:
                held.append(last[-carried:])
        held.append(p)
    close()
    return [x for x in (y.strip() for y in out) if x]


def chunks(blocks: DataFrame, width: int = 1500, overlap: int = 100) -> DataFrame:
    """(chunk_id, document_id, chapter, section_title, rule_number, chunk_order, text) of blocks; equal ids get a suffix #1, #2, ...

    Blocks within the width stay whole and never reach Python; the others are packed paragraph by paragraph, a fold that SQL can't
    express without a loop.
    """
    fields = ["document_id", "kind", "number", "title", "chapter", "start"]
    short = blocks.where(F.length("text") <= width).select(*fields, F.lit(0).alias("chunk_order"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for b in batches:
            parts = [packed(re.split(r"\n{2,}", t), width, overlap) for t in b.text]
            n = [len(p) for p in parts]
            rows = b[fields].loc[b.index.repeat(n)].reset_index(drop=True)
            rows["chunk_order"] = [i for k in n for i in range(k)]
            rows["text"] = [x for p in parts for x in p]
            yield rows

    long = blocks.where(F.length("text") > width).select(*fields, "text").mapInPandas(cut, "document_id string, kind string, number string, title string, chapter string, start int, chunk_order int, text string")
    both = short.unionByName(long).withColumn("base", F.concat_ws(":", "document_id", F.coalesce("number", F.lit("chunk")), F.col("chunk_order").cast("string")))
    kind = F.when(F.col("kind") == "chapter", 0).when(F.col("kind") == "section", 1).otherwise(2)
    again = F.row_number().over(Window.partitionBy("document_id", "base").orderBy(kind, "start", "chunk_order")) - 1
    return both.withColumn("again", again).select(
        F.when(F.col("again") > 0, F.concat("base", F.lit("#"), F.col("again").cast("string"))).otherwise(F.col("base")).alias("chunk_id"),
        "document_id", "chapter", F.col("title").alias("section_title"), F.when(F.col("kind") == "rule", F.col("number")).alias("rule_number"), "chunk_order", "text",
    )


def kept_lines(docs: DataFrame, key: str, text: str, long: int = 120, repeats: int = 3) -> DataFrame:
    """(key, text): a line that follows an equal kept line goes; of a short line the first repeats stay, of a long one, case aside, the
    first. Repeats in a row don't count; short lines are compared as they are written. Null texts are empty.

    One ordered fold per document with a count of each line, linear in its lines, in Arrow batches; documents stay where they are.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": ["\n".join(_kept([y for y in (x.strip(" ") for x in t.split("\n")) if y], long, repeats)) for t in b["_t"]]})

    given = docs.select(key, F.coalesce(text, F.lit("")).alias("_t"))
    return given.mapInPandas(fold, f"`{key}` {docs.schema[key].dataType.simpleString()}, text string")


def _kept(lines: list[str], long: int, repeats: int) -> list[str]:
    seen: Counter[str] = Counter()
    out: list[str] = []
    for x in lines:
        if out and out[-1] == x:
            continue
        like, most = (x.lower(), 1) if len(x) >= long else (x, repeats)
        seen[like] += 1
        if seen[like] <= most:
            out.append(x)
    return out
