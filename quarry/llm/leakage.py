"""Problem 9: evaluation texts in a training corpus, by latent semantic retrieval.

Passages of items and documents are TF-IDF vectors over the items' words. A randomised SVD, whose products with the passage matrix
Spark aggregates, gives the latent space; a document's passages are looked up there by cosine, and candidates are checked word by
word: for runs of successive words, or by longest common subsequence and shared answers for paraphrases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.forms import fold
from quarry.session import stored

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
#: Words of a run that counts as a leak, by an item's language: see also SPAN, the words of a passage, and STEP between passages.
#: Any run of RUN words holds a whole passage: SPAN + STEP - 1 <= RUN.
RUN, SPAN, STEP = {"en": 12, "zh": 24}, {"en": 8, "zh": 16}, {"en": 4, "zh": 8}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(fold(text).casefold()) if text else []


class Items:
    """The held-out items (a fixed table, broadcast): their words, vocabulary and passages by language."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        words = {i: words_of(t) for i, t, _ in rows}
        self.lang = {i: lang for i, _, lang in rows if lang in RUN}
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for i in self.lang for w in words[i]}))}
        self.ids = {i: [self.vocabulary[w] for w in words[i]] for i in self.lang}
        self.figures = {n for w, n in self.vocabulary.items() if w[0].isdigit()}
        self.passages: dict[str, tuple[np.ndarray, list[np.ndarray]]] = {}
        for lang in RUN:
            owners: dict[tuple[int, ...], set[int]] = {}
            for i, own in self.lang.items():
                for at in range(len(self.ids[i]) - SPAN[lang] + 1 if own == lang else 0):
                    owners.setdefault(tuple(sorted(self.ids[i][at : at + SPAN[lang]])), set()).add(i)
            bags = np.array(list(owners), np.int32).reshape(-1, SPAN[lang])
            self.passages[lang] = bags, [np.array(sorted(x)) for x in owners.values()]
        self.grams = {i: {tuple(w[k : k + RUN[lang]]) for k in range(len(w) - RUN[lang] + 1)} for i, lang in self.lang.items() for w in [self.ids[i]]}

    def numbered(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words_of(text)], np.int32)


def numbered_texts(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, ids): each text's words as numbers in the items' vocabulary, -1 for all others; read in place of the texts from here on."""
    bc = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "ids": [bc.value.numbered(t) for t in b.text]})

    given = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stored(given.mapInPandas(work, "doc_id bigint, ids array<int>"))


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch one after the other, and where each document begins (and the last ends)."""
    return (np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)), np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)


def passages(flat: np.ndarray, bounds: np.ndarray, lang: str, known: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of documents and starts of their passages of which at least a share of known words is in the items' vocabulary."""
    span, step = SPAN[lang], STEP[lang]
    count = np.maximum(0, (np.diff(bounds) - span) // step + 1)
    doc = np.repeat(np.arange(len(count)), count)
    at = bounds[doc] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
    inside = np.append(0, np.cumsum(flat >= 0))
    ok = inside[at + span] - inside[at] >= known * span
    return doc[ok], at[ok]


def document_frequencies(texts: DataFrame, items: Items) -> np.ndarray:
    """In how many of all documents each word of the items stands, and the number of documents; counted in partitions first."""
    words = texts.select(F.explode(F.array_distinct("ids")).alias("word")).where("word >= 0").groupBy("word").agg(F.count("*").alias("n"))
    out = np.zeros(len(items.vocabulary) + 1)
    for r in words.collect():  # the items' vocabulary, fixed
        out[r.word] = r.n
    out[-1] = texts.count()
    return out


def _vectors(bags: np.ndarray, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit latent vectors of passages (rows of word numbers, -1 for words of no item)."""
    weighted = np.append(space * idf[:, None], np.zeros((1, space.shape[1])), 0).astype(np.float32)
    out = np.zeros((len(bags), space.shape[1]), np.float32)
    for j in range(bags.shape[1]):
        out += weighted[bags[:, j]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


#: Partial products that one task adds up.
FAN = 32


def latent_space(texts: DataFrame, items: Items, idf: np.ndarray, rank: int = 64, seed: int = 5) -> np.ndarray:
    """(words, rank): the leading right singular directions of all TF-IDF passages, by a single-pass randomised SVD.

    Each partition multiplies its passages' Gram matrix with a random test matrix. Partial products, whose size is that of the items'
    vocabulary times rank, are added FAN at a time in a tree, so neither a task nor the driver ever holds more than FAN of them,
    whatever the number of partitions. Items' own passages take part.
    """
    size = len(items.vocabulary)
    rank = min(rank, size)
    test = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    bc = texts.sparkSession.sparkContext.broadcast((idf, test))

    def product(bags: np.ndarray, idf: np.ndarray, test: np.ndarray, out: np.ndarray) -> None:
        if len(bags):
            spread = np.append(test * idf[:, None], np.zeros((1, test.shape[1])), 0)
            at = spread[bags].sum(1)  # passages times rank
            for j in range(bags.shape[1]):
                ok = bags[:, j] >= 0
                np.add.at(out, bags[ok, j], at[ok] * idf[bags[ok, j], None])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, test = bc.value
        out = np.zeros(test.shape)
        for b in batches:
            flat, bounds = _flat(list(b.ids))
            for lang in RUN:
                _, at = passages(flat, bounds, lang)
                for i in range(0, len(at), 20_000):
                    product(flat[at[i : i + 20_000, None] + np.arange(SPAN[lang])], idf, test, out)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sum": [out.astype(np.float64).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(pdf.part.iloc[0]) // FAN], "sum": [sum(np.frombuffer(x) for x in pdf["sum"]).tobytes()]})

    parts, left = texts.select("ids").mapInPandas(work, "part bigint, sum binary"), texts.rdd.getNumPartitions()
    while left > FAN:
        parts, left = parts.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInPandas(add, "part bigint, sum binary"), -(-left // FAN)
    y = sum((np.frombuffer(r["sum"]).reshape(size, rank) for r in parts.select("sum").collect()), np.zeros((size, rank)))  # at most FAN rows
    for lang in RUN:
        product(items.passages[lang][0], idf, test, y)
    core = test.T @ y  # Nystroem: A'A is about y core^-1 y'
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-9
    u, s, _ = np.linalg.svd(y @ vectors[:, keep] / np.sqrt(values[keep]), full_matrices=False)
    return u[:, s > s.max(initial=0) * 1e-9] if len(s) else np.zeros((size, 1))


def _lookup(own: Items, ids: list[np.ndarray], idf: np.ndarray, space: np.ndarray, heads: dict[str, np.ndarray], cosine: float, known: float) -> dict[tuple[int, int], set[int]]:
    """By (number of a document in the batch, item) where passages begin whose cosine with an item's passage reaches the threshold."""
    flat, bounds = _flat(ids)
    hits: dict[tuple[int, int], set[int]] = {}
    for lang in RUN:
        owners = own.passages[lang][1]
        of, at = passages(flat, bounds, lang, known)
        if not len(owners) or not len(at):
            continue
        distinct, back = np.unique(np.sort(flat[at[:, None] + np.arange(SPAN[lang])], 1), axis=0, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        ends = np.searchsorted(back.ravel()[order], np.arange(len(distinct) + 1))
        vectors = _vectors(distinct, idf, space)
        for a in range(0, len(distinct), 1024):
            for i, j in zip(*np.nonzero(vectors[a : a + 1024] @ heads[lang].T >= cosine)):
                for p in order[ends[a + i] : ends[a + i + 1]]:
                    for k in owners[j]:
                        hits.setdefault((int(of[p]), int(k)), set()).add(int(at[p] - bounds[of[p]]))
    return hits


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        if m := where.get(w):
            m &= row
            row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def paraphrased(item: list[int], words: list[int], starts: set[int], figures: set[int]) -> float:
    """The greatest share of an item's words that stand in order in a stretch of a document around a passage found, among stretches
    with at least half of the item's figures."""
    size, width, best = len(item), len(item) + len(item) // 2, 0.0
    want = Counter(w for w in item if w in figures)
    for at in sorted({max(0, s - size // 2 * k) for s in starts for k in (0, 1, 2)}):
        part = words[at : at + width]
        if 2 * (Counter(w for w in part if w in figures) & want).total() >= want.total():
            best = max(best, common_subsequence(item, part) / size)
    return best


def leaks(docs: DataFrame, held_out: DataFrame, cosine: float = 0.98, paraphrases: bool = False, share: float = 0.7, most_mb: int = 64) -> DataFrame:
    """(doc_id, item_id): documents that hold a run of RUN successive words of an item, spacing and punctuation aside.

    With paraphrases, (doc_id, item_id, overlap): documents of which some stretch has a longest common subsequence of at least share of
    the item's words and half of its figures. Passages lie so that every such run holds a whole one, whose vector then equals that of
    an item's passage: cosine below 1 only serves to find. Null and empty texts hold nothing, items of other languages aren't looked
    for, repeated items count once, and no items give no rows. Items are broadcast: more than most_mb of their text is an error.
    """
    spark = docs.sparkSession
    given = held_out.where("item_id is not null and text <> ''").select("item_id", "text", "lang").dropDuplicates(["item_id"])
    if (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most_mb << 20:
        raise ValueError(f"held-out items of more than {most_mb} MB: look for them in parts")
    items = Items([(r.item_id, r.text, r.lang) for r in given.orderBy("item_id").collect()])
    schema = "doc_id bigint, item_id bigint" + ", overlap double" * paraphrases
    if not items.vocabulary:
        return spark.createDataFrame([], schema)
    texts = numbered_texts(docs, items)
    df = document_frequencies(texts, items)
    idf = np.log((df[-1] + 1) / (df[:-1] + 0.5)) + 1e-3
    space = latent_space(texts, items, idf)
    heads = {lang: _vectors(items.passages[lang][0], idf, space) for lang in RUN}
    bc = spark.sparkContext.broadcast((items, idf, space, heads))
    known, least = (0.7, 0.8) if paraphrases else (1.0, cosine)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, idf, space, heads = bc.value
        for b in (big.iloc[i : i + 2000].reset_index(drop=True) for big in batches for i in range(0, len(big), 2000)):
            found = _lookup(own, list(b.ids), idf, space, heads, least, known)
            out = []
            for (n, i), starts in sorted(found.items()):
                words, item = b.ids[n].tolist(), own.ids[i]
                if paraphrases:
                    if (best := paraphrased(item, words, starts, own.figures)) >= share:
                        out.append((b.doc_id[n], i, best))
                else:
                    k = RUN[own.lang[i]]
                    near = {a for s in starts for a in range(max(0, s - k + 1), min(s + k, len(words) - k + 1))}
                    if any(tuple(words[a : a + k]) in own.grams[i] for a in near):
                        out.append((b.doc_id[n], i))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "overlap"][: 2 + paraphrases])

    return texts.mapInPandas(work, schema).dropDuplicates(["doc_id", "item_id"])
