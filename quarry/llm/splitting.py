"""Problem 3: oversized items cut at natural boundaries by packing a structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What begins a heading: marks of Markdown, a chapter, a section, a rule number; the last group is a rule number's parts below the first.
HEADING = re.compile(r"(?:^|(?<=\n))(?:(#{1,6}) |((?:Chapter|CHAPTER) \d|第\d+[A-Z]?章)|((?:Section|SECTION) \d|第\d+[A-Z]?節)|\d{1,3}[A-Z]?((?:\.\d+|\(\d+\))+)[: ])")
#: How a line shows that it belongs to a list or a table.
ITEM, ROW = re.compile(r"\s*(?:[-*•›] |\([a-z0-9]+\) |\d+[.)] )"), re.compile(r"[^\n]*\|")
#: Below blocks, from the coarsest boundary to the finest: each splits a node into children that begin after the match.
FINER = [re.compile(r"\n"), re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])"), re.compile(r"\s+|(?<=[，、,])")]


def depth(m: re.Match) -> int:
    """A heading's depth: as many as its marks, or below all of those chapters, sections, and rules by the parts of their number."""
    return len(m[1]) if m[1] else 7 if m[2] else 8 if m[3] else 8 + len(re.findall(r"[.(]", m[4]))


@dataclass
class Node:
    """A span of the text with its children, which cover it; a leaf has none. kind: what a leaf is to be cut by, if need be."""

    start: int
    end: int
    kind: str = "part"
    children: list[Node] = field(default_factory=list)


def blocks(text: str, start: int, end: int) -> list[Node]:
    """Leaves below a heading: paragraphs, whole lists and whole tables, each with the blank lines after it. A list's or table's
    children are its items and rows."""
    lines, at = [], start
    while at < end:
        stop = text.find("\n", at, end) + 1 or end
        line = text[at:stop]
        lines.append((at, stop, "blank" if not line.strip() else "list" if ITEM.match(line) else "table" if ROW.match(line) else "text"))
        at = stop
    out: list[Node] = []
    fresh = True
    for a, b, kind in lines:
        if kind == "blank" and out:
            out[-1].end, fresh = b, True
            if out[-1].children:
                out[-1].children[-1].end = b
        elif out and kind == out[-1].kind and not (fresh and kind == "text"):
            out[-1].end, fresh = b, False
            out[-1].children.append(Node(a, b, "text"))
        else:
            out.append(Node(a, b, kind, [Node(a, b, "text")]))
            fresh = False
    for n in out:
        if n.kind in ("text", "blank"):
            n.children = []
    return out


def tree(text: str) -> Node:
    """The text's structure: a heading's node holds what stands before its first subheading as blocks, and the nodes of its
    subheadings; a heading of less depth ends it."""
    root = Node(0, len(text))
    found = [(m.start(), depth(m)) for m in HEADING.finditer(text)]
    open_: list[tuple[int, Node]] = [(0, root)]
    first = found[0][0] if found else len(text)
    root.children += blocks(text, 0, first)
    for (at, level), (stop, _) in zip(found, [*found[1:], (len(text), 0)]):
        while open_[-1][0] >= level:
            open_.pop()[1].end = at
        node = Node(at, len(text), children=blocks(text, at, stop))
        open_[-1][1].children.append(node)
        open_.append((level, node))
    return root


def finer(text: str, node: Node) -> list[Node]:
    """A leaf cut at lines, else at sentences, else at words."""
    for pattern in FINER:
        cuts = [node.start] + [m.end() for m in pattern.finditer(text, node.start, node.end) if node.start < m.end() < node.end]
        if len(cuts) > 1:
            return [Node(a, b, "text") for a, b in zip(cuts, [*cuts[1:], node.end]) if b > a]
    return []


def packed(text: str, node: Node, room: int) -> list[tuple[int, int]]:
    """Spans of at most room characters that cover a node: sibling subtrees are merged up to the limit, and only nodes that are too
    large are descended into; what has no boundary left is cut every room characters.

    The pieces of a large part with a heading don't join up with what stands before it, so a heading stays with its own text.
    """
    done: list[tuple[int, int]] = []
    todo = [(node, True)]
    while todo:
        n, joins = todo.pop()
        if n.end - n.start <= room:
            if joins and done and n.end - done[-1][0] <= room:
                done[-1] = (done[-1][0], n.end)
            else:
                done.append((n.start, n.end))
        elif below := n.children or finer(text, n):
            todo += [(c, True if i else joins and n.kind != "part") for i, c in reversed(list(enumerate(below)))]
        else:
            done += [(i, min(i + room, n.end)) for i in range(n.start, n.end, room)]
    return done


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans [a, b) of the pieces: each at most limit long; each but the first begins overlap characters before the last one's end."""
    if len(text) <= limit:
        return [(0, len(text))]
    body = packed(text, tree(text), limit - overlap)
    return [(max(0, a - overlap), b) for a, b in body]


def split_oversized(df: DataFrame, limit: int = 1500, overlap: int = 100) -> DataFrame:
    """(chunk_id, chunk_order, char_start, char_end, text) of the pieces of every chunk longer than limit code points.

    Rows of one chunk_id count once. chunk_order numbers the pieces from the chunk's own order; char offsets add to the chunk's
    own char_start. A null order or offset counts as 0; null, empty and short texts aren't oversized and have
    no pieces, nor have rows without an id. Only
    oversized texts reach Python, and each is cut by itself.
    """
    given = df.where(F.col("chunk_id").isNotNull() & (F.length("text") > limit)).select("chunk_id", F.coalesce("chunk_order", F.lit(0)).alias("chunk_order"), F.coalesce("char_start", F.lit(0)).alias("char_start"), "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, order, at, text in zip(b.chunk_id, b.chunk_order, b.char_start, b.text):
                rows += [(k, int(order) + i, int(at) + x, int(at) + y, text[x:y]) for i, (x, y) in enumerate(pieces(text, limit, overlap))]
            yield pd.DataFrame(rows, columns=["chunk_id", "chunk_order", "char_start", "char_end", "text"])

    return given.dropDuplicates(["chunk_id"]).mapInPandas(cut, "chunk_id string, chunk_order int, char_start int, char_end int, text string")
