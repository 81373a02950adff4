"""Problem 6: groups of texts that share most of their word runs, with pivot distance tables.

A text's fingerprint has a bit for every hashed run of three words. The Hamming distance of two fingerprints is the size of the
symmetric difference of the run sets, so every reference fingerprint (pivot) p gives a bound without loss:
|d(x, p) - d(y, p)| <= d(x, y) <= (1 - t) / (1 + t) * (|x| + |y|) for all pairs with a Jaccard similarity of t or more.
Bit positions are dealt into PARTS disjoint parts, and every union of parts is a pivot. d(x, p) - d(y, p) is the difference of the
counts of x and y over the parts outside p less that over the parts inside, so the largest coordinate difference over all 2^PARTS
pivots is the sum of the absolute differences of the counts: a table of PARTS counts holds the distances to all of them.
Min-hash bands propose pairs, the pivot tables discard by the maximum coordinate difference, and survivors are verified exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.forms import fold
from quarry.session import materialise, stored

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
PARTS = 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Stable 64-bit hashes of words, kept while a worker lives and its table is small."""

    def __missing__(self, word: str) -> int:
        b = word.encode("utf-8", "surrogatepass")
        h = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
        if len(self) < 300_000:
            self[word] = h
        return h


_WORDS = _Words()


def runs(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """40-bit hashes of the distinct runs of k successive words of each text, as it reads, in order, one text after the other, and
    where each text's begin (and the last's end). Texts below k words have none. At most 2^24 texts at once."""
    table, counts, flat = _WORDS, [], []
    for t in texts:
        words = WORD.findall(fold(t).casefold())
        counts.append(len(words))
        flat += [table[w] for w in words]
    of = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    h = _mixed(np.array(flat, np.uint64))
    n = max(0, len(h) - k + 1)
    acc = h[:n].copy()
    for i in range(1, k):
        acc = _mixed(acc * _M1 + h[i : n + i])
    both = (of[:n] << np.uint64(40) | acc >> np.uint64(24))[of[:n] == of[k - 1 :][:n]]  # a run doesn't cross texts
    both.sort()
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return both & np.uint64((1 << 40) - 1), np.searchsorted(both >> np.uint64(40), np.arange(len(texts) + 1, dtype=np.uint64))


def _seeds(count: int, salt: int) -> np.ndarray:
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * _M1 + np.uint64(salt)) | np.uint64(1)


def signatures(x: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[text, band]: a 32-bit digest of the minima of rows hash functions over each text's runs; starts: where texts begin, none empty."""
    out = np.zeros((len(starts), bands), np.uint64)
    for i, seed in enumerate(_seeds(bands * rows, 7)):
        low = np.minimum.reduceat((x * seed) >> np.uint64(16), starts)
        out[:, i // rows] = _mixed(out[:, i // rows] * _M1 + low)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def pivot_counts(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[text, part]: how many of a text's runs fall into each part of the bit positions, from which follow the distances to all pivots.

    Counts are clipped to 16 bits, which can't push two further apart.
    """
    size = np.diff(np.append(starts, len(x)))
    part = (_mixed(x * _M1) >> np.uint64(40)).astype(np.int64) % PARTS
    out = np.bincount(np.repeat(np.arange(len(starts)), size) * PARTS + part, minlength=len(starts) * PARTS)
    return np.minimum(out, 32767).astype(np.int16).reshape(len(starts), PARTS)


def _nodes(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each text's set of runs."""
    both = np.bitwise_xor.reduceat(_mixed(x), starts) + np.add.reduceat(x * _M1, starts)
    return _mixed(both).view(np.int64)


def describe(df: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, raw, node, size, pivots, bands): what pairs are found with; raw and node are 64-bit digests of the text and of its run set, bands hold 32-bit digests
    beside their number. Texts below k words are left out. A few hundred bytes a text; run sets are made again where they're verified."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (big.iloc[i : i + 2000] for big in batches for i in range(0, len(big), 2000)):
            x, bounds = runs(b.text.tolist(), k)
            has = np.flatnonzero(np.diff(bounds))
            starts = bounds[has]
            if len(has):
                yield pd.DataFrame({"id": b.id.to_numpy()[has], "raw": b.raw.to_numpy()[has], "node": _nodes(x, starts), "size": np.diff(bounds)[has].astype(np.int32), "pivots": list(pivot_counts(x, starts)), "bands": list(signatures(x, starts, bands, rows))})

    given = df.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("raw"))
    return given.mapInPandas(work, "id string, raw bigint, node bigint, size int, pivots array<smallint>, bands array<int>")


def _run_sets(df: DataFrame, key: str, text: str, wanted: DataFrame, k: int) -> DataFrame:
    """(node, runs) of the wanted nodes: one text each, led by the smallest id."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, bounds = runs(b.text.tolist(), k)
            yield pd.DataFrame({"node": b.node, "runs": np.split(x.view(np.int64), bounds[1:-1])})

    given = df.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("id"), F.col(text).alias("text"))
    texts = given.join(wanted, "id").select("node", "text")
    return texts.mapInPandas(work, "node bigint, runs array<bigint>").dropDuplicates(["node"])


def _pairs_of_runs(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket as pairs of the nodes of each bucket, (a, b, null); a bucket of more than block nodes comes out as its rows,
    (node, null, bucket). Only the run that a batch breaks is held, and never more than block rows of it."""

    def rows(a, b=None, bucket=None):
        none = pd.array([None] * len(a), dtype="Int64")
        return pd.DataFrame({"a": a, "b": none if b is None else b, "bucket": none if bucket is None else bucket})

    def whole(k: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(starts, len(k)))
        for size in np.unique(sizes[sizes > 1]).tolist():
            own = starts[sizes == size]
            if size > block:
                at = (own[:, None] + np.arange(size)).ravel()
                yield rows(n[at], bucket=k[at])
                continue
            i, j = np.triu_indices(size, 1)
            step = max(1, 200_000 // len(i))
            for g in range(0, len(own), step):
                nodes = n[own[g : g + step, None] + np.arange(size)]
                yield rows(nodes[:, i].ravel(), nodes[:, j].ravel())

    held, hot = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
    for batch in batches:
        k, n = np.concatenate([held[0], batch.bucket.to_numpy()]), np.concatenate([held[1], batch.node.to_numpy()])
        if hot is not None:
            m = int(np.searchsorted(k, hot, side="right"))
            if m:
                yield rows(n[:m], bucket=k[:m])
            k, n = k[m:], n[m:]
            if not len(k):
                continue
            hot = None
        last = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
        if last:
            yield from whole(k[:last], n[:last])
        held = k[last:], n[last:]
        if len(held[0]) > block:
            yield rows(held[1], bucket=held[0])
            held, hot = (held[0][:0], held[1][:0]), held[0][0]
    if len(held[0]):
        yield from whole(*held)


def proposed(keyed: DataFrame, block: int = 1000) -> DataFrame:
    """(a, b): distinct pairs of nodes, smaller first, that share a bucket; keyed: (node, bucket), each row once.

    One shuffle brings buckets together, sorted, and pairs are read off the runs of equal buckets. A bucket of more than block nodes is
    cut into blocks by a hash of the node; one side goes to each of its bucket's blocks, so no task compares more than a bucket with a
    block.
    """
    run = keyed.select("node", "bucket").repartition("bucket").sortWithinPartitions("bucket", "node")
    read = stored(run.mapInPandas(lambda batches: _pairs_of_runs(batches, block), "a bigint, b bigint, bucket bigint"))
    hot = read.where("bucket is not null").select("bucket", F.col("a").alias("node"))
    sizes = hot.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("blocks"))
    hot = hot.join(sizes, "bucket")
    one = hot.select("bucket", F.col("node").alias("b"), F.pmod(F.xxhash64("node"), "blocks").alias("part"))
    each = hot.select("bucket", F.col("node").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("part"))
    return read.where("bucket is null").select("a", "b").unionByName(each.join(one, ["bucket", "part"]).where("a < b").select("a", "b")).distinct()


def candidates(df: DataFrame, key: str, text: str, k: int = 3, threshold: float = 0.7, bands: int = 36, rows: int = 6, broadcast_mb: int = 16) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is known of all texts, pairs the bands propose, their nodes' tables, and the pairs that sizes and pivots leave."""
    told = stored(describe(df, key, text, k, bands, rows))
    nodes = told.select("node", "bands").dropDuplicates(["node"])
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", (F.col("band") * F.lit(1 << 32) + F.col("value")).alias("bucket"))
    met = materialise(proposed(keyed))
    ends = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tables = told.join(_hinted(ends, broadcast_mb), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("size", "pivots")).alias("t"))
    tables = materialise(tables.select("node", "id", "t.size", "t.pivots"))
    x, y = tables.alias("x"), tables.alias("y")
    most = F.floor((F.col("x.size") + F.col("y.size")) * ((1 - threshold) / (1 + threshold)) + 1e-6)
    apart = F.aggregate(F.zip_with("x.pivots", "y.pivots", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda n, d: n + d)
    sizes = (F.col("x.size") >= F.col("y.size") * threshold - 1e-6) & (F.col("y.size") >= F.col("x.size") * threshold - 1e-6)
    near = met.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(sizes & (apart <= most)).select("a", "b")
    return told, met, tables, materialise(near)


def classes_and_pairs(df: DataFrame, key: str, text: str, k: int = 3, threshold: float = 0.7, broadcast_mb: int = 16, **options) -> tuple[DataFrame, DataFrame]:
    """(id, node, raw) of every text of k words or more, and (a, b, similarity) between the nodes of different texts.

    Texts with equal run sets are one node; only nodes are compared, so a text's copies cost nothing. With 36 bands of 6 rows a pair
    at the threshold of 0.7 is proposed with a probability of 0.989, one at 0.75 with 0.999 and one at 0.8 with 0.99998, while texts
    that only share stock phrases hardly ever meet. The pivot bound loses nothing, and the last step compares whole run sets. The ids
    of proposed texts are broadcast up to broadcast_mb, and joined beyond that.
    """
    told, _, tables, near = candidates(df, key, text, k, threshold, broadcast_mb=broadcast_mb, **options)
    left = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = _hinted(tables.join(left, "node", "left_semi").select("id", "node"), broadcast_mb)
    sets = _run_sets(df, key, text, wanted, k)
    both = near.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    pairs = both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    return told.groupBy("id", "node").agg(F.min("raw").alias("raw")), pairs


def _hinted(df: DataFrame, up_to_mb: int) -> DataFrame:
    """A frame of numbers and ids, computed, and broadcast if its rows take at most up_to_mb (32 bytes each and the ids' own)."""
    made = materialise(df)
    own = F.sum(F.lit(32) + (F.octet_length("id") if "id" in df.columns else F.lit(0)))
    return F.broadcast(made) if (made.agg(own).first()[0] or 0) <= up_to_mb << 20 else made


def near_duplicate_pairs(df: DataFrame, key: str = "chunk_id", text: str = "text", all_up_to: int = 1000, **options) -> DataFrame:
    """(chunk_a, chunk_b): pairs of ids, smaller first, whose texts are nearly the same, copies included.

    A pair of nodes stands for the pairs between their members. Only exact copies are represented: of a text with more than
    all_up_to copies the smallest id makes the pairs with other texts, of its node and of near ones, and each copy is paired with
    that id; pairs between different texts are all written out. Null, empty and short texts and rows without an id make no pairs;
    rows of one id count once; empty tables give none.
    """
    members, pairs = classes_and_pairs(df, key, text, **options)
    texts = members.groupBy("node", "raw").agg(F.count("*").alias("copies"), F.min("id").alias("head"))
    texts = texts.select("node", "raw", "copies", F.when(F.col("copies") > all_up_to, F.col("head")).alias("head"))
    sizes = texts.groupBy("node").agg(F.sum("copies").alias("n"))
    pairs = materialise(pairs.select("a", "b"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = sizes.join(ends.withColumn("paired", F.lit(True)), "node", "left").where("n > 1 or paired").select("node", "n")
    many = materialise(members.join(texts.join(wanted, "node").select("node", "raw", "n", "head"), ["node", "raw"]).select("node", "id", "n", "head"))
    shown = many.where("head is null or id = head")
    x, y = shown.select(F.col("node").alias("a"), F.col("id").alias("p")), shown.select(F.col("node").alias("b"), F.col("id").alias("q"))
    across = pairs.join(x, "a").join(y, "b").select("p", "q")
    close = shown.where("n > 1")
    inside = close.select("node", F.col("id").alias("p")).join(close.select("node", F.col("id").alias("q")), "node").where("p < q").select("p", "q")
    hot = many.where("id <> head").select(F.col("head").alias("p"), F.col("id").alias("q"))
    out = across.unionByName(inside).unionByName(hot)
    return out.select(F.least("p", "q").alias("chunk_a"), F.greatest("p", "q").alias("chunk_b"))


def near_duplicate_groups(df: DataFrame, key: str = "chunk_id", text: str = "text", **options) -> DataFrame:
    """(id, class_id, group_id, links): every text with the smallest id of its class of equal run sets and of its group, and its
    number of links to other texts.

    Groups are connected components of nodes: labels take the smallest of their neighbours' labels and then jump to their label's
    label, until none changes; rounds grow with the logarithm of the longest chain. All steps are joins; nothing is collected.
    """
    members, pairs = classes_and_pairs(df, key, text, **options)
    pairs = pairs.select("a", "b")
    edges = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialise(edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = step.select(F.col("id").alias("label"), F.col("label").alias("top"))
        new = materialise(step.join(up, "label", "left").select("id", F.least("label", F.coalesce("top", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            break
    links = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    out = members.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = members.groupBy("node").agg(F.min("id").alias("class_id"))
    groups = members.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("id").alias("group_id"))
    return out.join(classes, "node").join(groups, "label").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
