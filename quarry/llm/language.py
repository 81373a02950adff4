"""Problem 2: languages of documents and of lines by cross-parsing entropy.

One suffix automaton per language holds labelled text. A text is parsed greedily into the longest phrases that occur there
(cross parsing); the language with the fewest phrases, normalised by the length of its text, wins. Automata become dense
transition tables, so a batch's lines advance side by side, one symbol a step.
"""

from __future__ import annotations

import functools
import math
import unicodedata as U
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.forms import mapping

LANGS = ["en", "zh", "fr", "de", "es", "pt"]
# Names and codes that labels use for the six languages.
NAMES = {
    "en": ["en", "eng", "english", "anglais", "englisch", "inglés", "英文", "英語"],
    "zh": ["zh", "zho", "chi", "cmn", "yue", "chinese", "中文", "汉语", "漢語", "chinois", "chinesisch", "chino"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
}
#: The accented letters of the six languages get symbols of their own.
ACCENTED = "àâäáãçéèêëíìîïñóòôöõúùûüßœæ"
SPACE, CJK, OTHER, LINE, END, DROP = 1, 2 + 26 + len(ACCENTED), 3 + 26 + len(ACCENTED), 253, 254, 255
WIDTH = OTHER + 1
#: Symbols that phrases of a readable line have on average, at least.
READABLE = 4.0


def canonical_label(col: str) -> Column:
    """A label's language, or null where it names none; regions and scripts after - or _ don't count."""
    base = F.lower(F.trim(F.regexp_replace(F.col(col), "[-_ (].*$", "")))
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(base.isin(names), F.lit(lang)).otherwise(out)
    return out


@functools.cache
def _symbols() -> np.ndarray:
    """The symbol of each code point up to U+FFFF: letters, case aside and as they read; CJK as one; all else separates words."""
    own = {c: 2 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED)}
    lut, same = np.full(65536, SPACE, np.uint8), mapping()
    for cp in range(65536):
        ch = chr(cp)
        if "一" <= ch <= "鿿" or "㐀" <= ch <= "䶿":
            lut[cp] = CJK
        elif U.category(ch)[0] in "LM" or ch in same:
            read = U.normalize("NFC", same.get(ch, ch)).lower()
            if not read or U.category(ch)[0] == "M":
                lut[cp] = DROP
            elif read[0] in own:
                lut[cp] = own[read[0]]
            elif read[0].isalpha():
                lut[cp] = OTHER
    lut[10], lut[0x1E] = LINE, END
    return lut


def symbolise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all lines of all texts; each line's text number, line number (from 0) and the bounds of its symbols."""
    joined = "\x1e".join(t.replace("\x1e", " ") for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _symbols()[np.minimum(cps, 65535)]
    sym = sym[sym != DROP]
    breaks = sym >= LINE
    blank = (sym == SPACE) | breaks
    keep = np.ones(len(sym), bool)
    keep[1:] = ~((sym[1:] == SPACE) & blank[:-1])
    sym = sym[keep]
    ends = np.append(np.flatnonzero(sym >= LINE), len(sym))
    starts = np.append(0, ends[:-1] + 1)
    text_no = np.append(0, np.cumsum(sym[ends[:-1]] == END))
    first = np.flatnonzero(np.append(True, text_no[1:] != text_no[:-1]))
    line_no = np.arange(len(text_no)) - np.repeat(first, np.diff(np.append(first, len(text_no))))
    return sym, text_no, line_no, np.stack([starts, ends], 1)


def automaton(symbols: np.ndarray) -> np.ndarray:
    """The suffix automaton of a text as a dense table [state, symbol] -> state, 0 where a phrase can't go on."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.zeros((len(nxt), WIDTH), np.int32)
    for s, out in enumerate(nxt):
        for c, t in out.items():
            table[s, c] = t
    return table


class CrossParser:
    """Cross-parses lines against every language at once. texts: a language's labelled symbols."""

    def __init__(self, texts: dict[str, np.ndarray]):
        self.langs = [x for x in LANGS if len(texts.get(x, ())) > 0]
        parts, roots, at = [np.zeros((1, WIDTH), np.int32)], [], 1
        for lang in self.langs:
            t = automaton(texts[lang])
            root = t[0].copy()
            go = np.where(t > 0, t + at, -np.where(root > 0, root + at, at)[None, :])  # below zero: a new phrase begins here
            parts.append(go.astype(np.int32))
            roots.append(at)
            at += len(t)
        self.table, self.roots = np.concatenate(parts).ravel(), np.array(roots, np.int32)
        self.bits = np.array([math.log2(len(texts[x]) + 1) for x in self.langs])

    def cost(self, sym: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Phrases of each line by language, times the bits that name a place in the language's text. Lines are parsed whole, side by
        side, longest first: after a line's last symbol its column takes no further part."""
        order = np.argsort(spans[:, 0] - spans[:, 1], kind="stable")
        start, size = spans[order, 0], (spans[:, 1] - spans[:, 0])[order]
        state = np.repeat(self.roots[:, None], len(order), 1)
        phrases = np.zeros(state.shape, np.int64)
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        for step in range(longest):
            n = live[step]
            to = self.table[state[:, :n] * WIDTH + sym[start[:n] + step]]
            phrases[:, :n] += to < 0
            state[:, :n] = np.abs(to)
        total = np.zeros((len(spans), len(self.langs)))
        total[order] = phrases.T
        return (total + 1) * self.bits


def of_one_script(sym: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines without the letters of the script that weighs less in them (a Chinese character as three letters): names in another
    script don't make a line foreign."""
    size = spans[:, 1] - spans[:, 0]
    line = np.repeat(np.arange(len(spans)), size)
    flat = sym[np.repeat(spans[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    han, other = flat == CJK, (flat != CJK) & (flat != SPACE)
    count = lambda m: np.bincount(line[m], minlength=len(spans))
    chinese, mixed = 3 * count(han) >= count(other), (count(han) > 0) & (count(other) > 0)
    keep = ~mixed[line] | np.where(chinese[line], han, ~han)
    ends = np.cumsum(np.bincount(line[keep], minlength=len(spans)))
    return flat[keep], np.stack([np.append(0, ends[:-1])[: len(spans)], ends], 1)


def training_texts(docs: DataFrame, labels: DataFrame, per_language: int = 120, symbols: int = 20_000) -> dict[str, bytes]:
    """Symbols of labelled text by language, from at most per_language documents each (a documented, bounded sample).

    Labels are partly wrong and documents hold lines of other languages, so the sample is cleaned by cross-validation: automata of
    one half of each language's documents judge the other half, first whole documents, then lines; what disagrees with its label goes.
    """
    slots = labels.select("document_id", canonical_label("lang").alias("lang")).where("lang is not null").withColumn("h", F.xxhash64("document_id"))
    picked = slots.groupBy("lang", F.pmod("h", F.lit(per_language)).alias("slot")).agg(F.min(F.struct("h", "document_id")).alias("m")).select("lang", F.col("m.document_id").alias("document_id"), "slot")
    rows = docs.select("document_id", "raw_text").where("raw_text <> ''").join(F.broadcast(picked), "document_id").dropDuplicates(["document_id"]).orderBy("lang", "slot").collect()  # at most 6 * per_language
    sample: list[tuple[str, int, list[np.ndarray]]] = []
    for r in rows:
        sym, _, _, spans = symbolise([r.raw_text])
        found = [sym[a:b] for a, b in spans if b - a >= 12]
        if own := [x for x in found if len(x) >= 40 or (x == CJK).mean() > 0.3]:
            sample.append((r.lang, r.slot % 2, own))
    for whole in (True, False, False):
        sample = _agreeing(sample, symbols, whole)
    return {x: _joined([s for lang, _, own in sample if lang == x for s in own], symbols).tobytes() for x in LANGS}


def _joined(lines: list[np.ndarray], symbols: int) -> np.ndarray:
    return np.concatenate([np.append(x, SPACE) for x in lines]).astype(np.uint8)[:symbols] if lines else np.zeros(0, np.uint8)


def _agreeing(sample: list[tuple[str, int, list[np.ndarray]]], symbols: int, whole: bool) -> list[tuple[str, int, list[np.ndarray]]]:
    """The documents (or, within them, the lines) whose label agrees with the automata of the other half."""
    kept = []
    for half in (0, 1):
        judge = CrossParser({x: _joined([s for lang, h, own in sample if (lang, h) == (x, 1 - half) for s in own], symbols) for x in LANGS})
        for lang, h, own in sample:
            if h != half or lang not in judge.langs:
                continue
            ends = np.cumsum([len(x) for x in own])
            cost = judge.cost(np.concatenate(own), np.stack([np.append(0, ends[:-1]), ends], 1))
            says = np.full(len(own), cost.sum(0).argmin()) if whole else cost.argmin(1)
            if agree := [x for x, i in zip(own, says) if judge.langs[i] == lang]:
                kept.append((lang, h, agree))
    return kept


def _line_languages(p: CrossParser, texts: list[str]):
    sym, text_no, line_no, spans = symbolise(texts)
    parsed, within = of_one_script(sym, spans)
    cost = p.cost(parsed, within)
    size = spans[:, 1] - spans[:, 0]
    best = cost.argmin(1)
    two = np.partition(cost, 1, axis=1)[:, :2] if cost.shape[1] > 1 else np.repeat(cost, 2, 1) + [0, 1]
    confidence = 1 - two[:, 0] / two[:, 1]
    cjk = np.add.reduceat(np.append(sym == CJK, False).astype(np.int64), np.minimum(spans[:, 0], len(sym))) if len(spans) else size
    cjk = np.where(size > 0, cjk, 0)
    words = np.add.reduceat(np.append(sym == SPACE, False).astype(np.int64), np.minimum(spans[:, 0], len(sym))) if len(spans) else size
    # a line of code or noise falls into phrases of a symbol or two in every language: it is in none
    reads = within[:, 1] - within[:, 0] >= READABLE * (cost / p.bits).min(1, initial=np.inf) if cost.shape[1] else size < 0
    return text_no, line_no, size * reads, cjk * reads, words * reads, cost, best, confidence


def _slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Batches in parts, to bound the arrays of symbols."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows].reset_index(drop=True)


def parser(spark: SparkSession, texts: dict[str, bytes]) -> Broadcast:
    """The tables of the languages' texts, built once and broadcast. A text of n symbols has at most 2n states, so the size is bound by
    training_texts's symbols: 59 MB for six languages of 20,000."""
    return spark.sparkContext.broadcast(CrossParser({k: np.frombuffer(v, np.uint8) for k, v in texts.items()}))


def document_languages(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """(document_id, lang, confidence) of every document with a non-empty raw_text, from its main body.

    A line speaks with its length (a Chinese character as three letters) where it reads like prose: it ends as a sentence does.
    Where none does, all lines speak. Texts without letters come out with a null language; rows without
    an id, null and empty texts are left out.
    """

    shared = parser(docs.sparkSession, texts)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in _slices(batches):
            raws = b.raw_text.tolist()
            text_no, _, size, cjk, words, cost, best, _ = _line_languages(p, raws)
            prose = np.array([x.rstrip()[-1:] in _STOPS for t in raws for x in t.replace("\x1e", " ").split("\n")])
            weight = (size + 2 * cjk) * (size + 2 * cjk >= 36)
            votes = np.zeros((2, len(raws), len(LANGS)))
            at = np.array([LANGS.index(x) for x in p.langs])[best]
            np.add.at(votes[0], (text_no, at), weight * prose)
            np.add.at(votes[1], (text_no, at), size - words + 2 * cjk)
            use = np.where(votes[0].sum(1, keepdims=True) > 0, votes[0], votes[1])
            total = use.sum(1)
            win = use.argmax(1)
            yield pd.DataFrame({"document_id": b.document_id, "lang": [LANGS[w] if t else None for w, t in zip(win, total)], "confidence": use.max(1) / np.maximum(total, 1)})

    given = docs.where("document_id is not null and raw_text <> ''").select("document_id", "raw_text")
    return given.mapInPandas(judge, "document_id string, lang string, confidence double").dropDuplicates(["document_id"])


_STOPS = tuple(".。!！?？;；:：")


def foreign_lines(chunks: DataFrame, texts: dict[str, bytes], least: int = 30, least_confidence: float = 0.4) -> DataFrame:
    """(chunk_id, line_no, lang, confidence) of lines written in another language than most of their chunk.

    The chunk's language is the one most of its letters are in. A line speaks for itself from least letters (a Chinese character as
    three) and three words on, and with least_confidence: one minus the ratio of its language's cost to its chunk's. Rows of one
    chunk_id count once; null and empty texts have no lines, nor have rows without an id.
    """

    shared = parser(chunks.sparkSession, texts)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in _slices(batches):
            text_no, line_no, size, cjk, words, cost, best, _ = _line_languages(p, b.text.tolist())
            letters = size + 2 * cjk
            votes = np.zeros((len(b), len(p.langs)))
            np.add.at(votes, (text_no, best), letters)
            main = votes.argmax(1)[text_no]
            mine, theirs = cost[np.arange(len(best)), best], cost[np.arange(len(best)), main]
            confidence = 1 - mine / theirs
            hit = np.flatnonzero((best != main) & (letters >= least) & ((words >= 3) | (cjk >= 6)) & (confidence >= least_confidence))
            ids, found = b.chunk_id.tolist(), [p.langs[i] for i in best[hit]]
            yield pd.DataFrame({"chunk_id": pd.Series([ids[i] for i in text_no[hit]], dtype=object), "line_no": line_no[hit] + 1, "lang": pd.Series(found, dtype=object), "confidence": confidence[hit]})

    given = chunks.where("chunk_id is not null and text <> ''").select("chunk_id", "text")
    return given.mapInPandas(judge, "chunk_id string, line_no bigint, lang string, confidence double").dropDuplicates(["chunk_id", "line_no"])


def wrong_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(document_id, lang): documents whose label is absent, null, empty, no language, or another one than found. Where a document has
    several labels, one wrong one suffices, and none that names a language is as good as no label."""
    slot = canonical_label("lang")
    given = labels.groupBy("document_id").agg(F.min(slot).alias("least"), F.max(slot).alias("most"))
    right = F.coalesce((F.col("least") == F.col("lang")) & (F.col("most") == F.col("lang")), F.lit(False))
    return found.join(given, "document_id", "left").where(F.col("lang").isNotNull() & ~right).select("document_id", "lang")


__all__ = ["LANGS", "CrossParser", "document_languages", "foreign_lines", "training_texts", "wrong_labels"]
