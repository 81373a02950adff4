"""Near-duplicate questions: a self join by shared tokens or by the ratio of matching characters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.session import stored


def prefix_pairs(sets: DataFrame, least: Column, block: int = 1000) -> DataFrame:
    """(a, b): pairs of ids, smaller first, of sets (id, items, size, kept) that share one of their rarest items.

    Items are put in order of how many sets hold them; kept is how many of its rarest ones a set must be looked at by, so that any pair
    wanted shares one of them: if two sets have o items in common, the first |x| - o + 1 of each hold one of those. least, of the smaller
    and the greater size (x, y), must hold for a pair. An item of more than block sets is cut into blocks, and one side goes to each.
    """
    items = sets.select("id", "size", "kept", F.explode("items").alias("item"))
    counts = items.groupBy("item").agg(F.count("*").alias("c"))
    order = Window.partitionBy("id").orderBy("c", "item")
    rare = items.join(counts, "item").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("kept"))
    rare = rare.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("item")) / block))
    a = rare.select("item", F.col("id").alias("a"), F.col("size").alias("na"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("part"))
    b = rare.select("item", F.col("id").alias("b"), F.col("size").alias("nb"), F.pmod(F.xxhash64("id"), "blocks").alias("part"))
    met = a.join(b, ["item", "part"]).where("a < b").withColumn("x", F.least("na", "nb")).withColumn("y", F.greatest("na", "nb"))
    return met.where(least).select("a", "b").distinct()


def texts_of(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, node) of rows with a text, and (id, t) of each different text in full normalisation: equal texts are one node, its digest."""
    given = rows.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), A.fully_normalized(text).alias("t")).distinct().where("t <> ''")
    given = stored(given.select("key", "t", F.sha2("t", 256).alias("id")))
    return given.select(F.col("key"), F.col("id").alias("node")), given.select("id", "t").distinct()


def jaccard_pairs(texts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(a, b): different texts (id, t) whose sets of duplicate tokens have a Jaccard similarity of threshold or more; no pair is lost."""
    sets = stored(texts.select("id", T.duplicate_tokens("t").alias("items")).where("size(items) > 0"))
    n = F.size("items")
    met = prefix_pairs(sets.select("id", "items", n.alias("size"), (n - F.ceil(n * threshold - 1e-9) + 1).alias("kept")), F.col("x") >= F.col("y") * threshold - 1e-9)
    both = met.join(sets.select(F.col("id").alias("a"), F.col("items").alias("p")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("q")), "b")
    return both.where(T.jaccard(F.col("p"), F.col("q")) >= threshold - 1e-12).select("a", "b")


def sequence_pairs(texts: DataFrame, threshold: float = 0.9, block: int = 2000) -> DataFrame:
    """(a, b): different texts whose ratio of matching characters is threshold or more in either order; no pair is lost.

    Of texts of x and y characters y is at most (2 - threshold) / threshold * x, so texts meet those of their own and the next band of
    lengths, in blocks. At most (1 - threshold) * (x + y) characters stay unmatched: pairs whose counts of characters differ by more, or
    whose longest common subsequence leaves more out, go before the ratio is computed.
    """
    import difflib

    step = math.log((2 - threshold) / threshold * (1 + 1e-9))
    own = stored(texts.select("id", "t", F.floor(F.log(F.length("t").cast("double")) / step).alias("band")))
    blocks = own.groupBy("band").agg(F.ceil(F.count("*") / block).alias("n"))  # one row a band
    for name, by in (("n0", 0), ("n1", 1), ("n2", -1)):
        own = own.join(F.broadcast(blocks.select((F.col("band") - by).alias("band"), F.col("n").alias(name))), "band", "left")
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), "n0"))
    many = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), f)).otherwise(F.array())
    cell = lambda *c: F.struct(*[x.cast("bigint").alias(n) for n, x in zip(("p", "i", "q", "j"), c)])
    here = lambda x: cell(F.col("band"), F.least("part", x), F.col("band"), F.greatest("part", x))
    after, before = lambda x: cell(F.col("band"), F.col("part"), F.col("band") + 1, x), lambda x: cell(F.col("band") - 1, x, F.col("band"), F.col("part"))
    met = own.select("id", "t", "band", "part", F.explode(F.concat(many("n0", here), many("n1", after), many("n2", before))).alias("cell")).select("id", "t", "band", "part", "cell.*")

    def counts(texts):
        """A text's numbers of characters: letters, digits and blank apart, all others in 27 groups."""
        import numpy as np

        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        group = 37 + points % 27
        for first, last, at in ((97, 122, 0), (48, 57, 26), (32, 32, 36)):
            group = np.where((points >= first) & (points <= last), points - first + at, group)
        return np.bincount(row * 64 + group, minlength=len(texts) * 64).reshape(-1, 64).astype(np.int32)

    def common(places, size, other):
        """Length of the longest common subsequence; places: the bits of each character's places in a text of size."""
        whole = (1 << size) - 1
        v = whole
        for c in other:
            u = v & places.get(c, 0)
            v = ((v + u) | (v - u)) & whole
        return size - v.bit_count()

    def meet(table):
        import numpy as np
        import pyarrow as pa

        p, i, q, j = (table[c][0].as_py() for c in "piqj")
        band, part = table["band"].to_numpy(), table["part"].to_numpy()
        ids, texts = np.array(table["id"].to_pylist(), object), np.array(table["t"].to_pylist(), object)
        left, right = np.flatnonzero((band == p) & (part == i)), np.flatnonzero((band == q) & (part == j))
        same, out = (p, i) == (q, j), []
        if len(left) and len(right):
            size, fine = np.array([len(t) for t in texts]), counts(texts)
            rough = np.ascontiguousarray(fine.reshape(-1, 8, 8).sum(2))
            for n, x in enumerate(left):
                y = right[n + 1 :] if same else right
                for c in (rough, fine):
                    y = y[np.abs(c[y] - c[x]).sum(1) <= (1 - threshold) * (size[y] + size[x]) + 1e-6]
                if not len(y):
                    continue
                text, places = texts[x], {}
                for k, c in enumerate(text):
                    places[c] = places.get(c, 0) | 1 << k
                alike = difflib.SequenceMatcher(None, "", text)
                for z in y:
                    other = texts[z]
                    if 2 * common(places, len(text), other) < threshold * (len(text) + len(other)) - 1e-6:
                        continue
                    alike.set_seq1(other)
                    if alike.ratio() >= threshold or difflib.SequenceMatcher(None, text, other).ratio() >= threshold:
                        out.append((min(ids[x], ids[z]), max(ids[x], ids[z])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.string()), "b": pa.array([o[1] for o in out], pa.string())})

    tasks = 8 * texts.sparkSession.sparkContext.defaultParallelism  # much work on few bytes
    return met.repartition(tasks, "p", "i", "q", "j").groupBy("p", "i", "q", "j").applyInArrow(meet, "a string, b string")


def near_pairs(rows: DataFrame, key: str, text: str, threshold: float = 0.9, characters: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, node), and pairs (a, b) of nodes that are nearly the same by tokens or, with characters, by characters."""
    members, texts = texts_of(rows, key, text)
    pairs = jaccard_pairs(texts, threshold)
    return members, (pairs.unionByName(sequence_pairs(texts, threshold)).distinct() if characters else pairs)


def accepted_in_order(rows: DataFrame, key: str, text: str, threshold: float = 0.9, characters: bool = True) -> DataFrame:
    """(key) accepted one by one in order, each unless its text is nearly that of one accepted before.

    A text's first key stands for it; the later ones are copies and go. First keys are decided in rounds until all are.
    """
    from quarry.operators.governance import first_without_near_duplicate

    members, pairs = near_pairs(rows, key, text, threshold, characters)
    first = members.groupBy("node").agg(F.min("key").alias("id"))
    named = pairs.join(first.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(first.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
    return first_without_near_duplicate(first.select("id"), named.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))).select(F.col("id").alias(key))
