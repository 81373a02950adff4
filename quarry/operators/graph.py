"""The typed, weighted relationship graph over chunks: nodes and edges are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import materialise

# Weight and reach of each neighbour relation.
RELATIONS = {"same_rule": (1.0, 2), "same_section": (0.55, 1), "same_chapter": (0.40, 1), "same_scenario": (0.70, 2), "keyword_overlap": (0.50, 1)}


def neighbour_edges(nodes: DataFrame, group: str, relation: str, key: str = "chunk_id") -> DataFrame:
    """(src, dst, relation, weight) between each node and the next ones of its group in order of key: linear in the nodes.

    Nodes are numbered over the whole frame in order of group and key, and each is joined with the numbers that follow, so a group that
    holds a third of all nodes is spread over tasks like any other. Null and empty groups make no edges.
    """
    weight, reach = RELATIONS[relation]
    held = nodes.where((F.col(group).isNotNull()) & (F.col(group) != "")).select(F.col(group).alias("g"), F.col(key).alias("k"))
    placed = numbered(held, ["g", "k"])
    steps = placed.select("g", F.col("k").alias("src"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + reach)).alias("n"))
    pairs = steps.join(placed.select(F.col("g").alias("same"), F.col("k").alias("dst"), "n"), "n").where("g = same")
    return pairs.select("src", "dst", F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One edge of each unordered pair and relation, its greatest weight; self-loops go."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.where("src <> dst").groupBy(a.alias("src"), b.alias("dst"), "relation").agg(F.max("weight").alias("weight"))


def reference_edges(references: DataFrame, nodes: DataFrame, weight: float = 0.95) -> DataFrame:
    """(src, dst, relation, weight): from a chunk to the first other chunk of each rule it refers to.

    references (chunk_id, rule_number). The two smallest chunk ids of a rule suffice, so each rule joins with two rows.
    """
    first = nodes.where("rule_number is not null").select("rule_number", "chunk_id").distinct()
    two = first.groupBy("rule_number").agg(F.min("chunk_id").alias("one"))
    rest = first.join(two, "rule_number").where("chunk_id > one").groupBy("rule_number").agg(F.min("chunk_id").alias("other"))
    heads = two.join(rest, "rule_number", "left")
    to = F.when(F.col("chunk_id") == F.col("one"), F.col("other")).otherwise(F.col("one"))
    return references.distinct().join(heads, "rule_number").select(F.col("chunk_id").alias("src"), to.alias("dst"), F.lit("rule_reference").alias("relation"), F.lit(weight).alias("weight")).where("dst is not null")


def rotating_pairs(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(src, dst): the i-th left row with the right row i modulo the number of right rows, the next one where both are the same.

    Positions come from a range-partitioned sort, not from one task: a row's number is its partition's offset and its place in it.
    """
    a, b = numbered(left, [key]), numbered(right, [key])
    n = b.count()
    if n == 0:
        return left.select(F.col(key).alias("src"), F.col(key).alias("dst")).limit(0)
    at = a.join(b.select(F.col(key).alias("same"), F.col("n").alias("m")), a[key] == F.col("same"), "left")
    slot = F.pmod(F.col("n"), F.lit(n))
    at = at.select(F.col(key).alias("src"), F.when(F.col("m") == slot, F.pmod(F.col("n") + 1, F.lit(n))).otherwise(slot).alias("n"))
    return at.join(b.select("n", F.col(key).alias("dst")), "n").where("src <> dst").select("src", "dst")


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys and n, their place from 0 in order over the whole frame: a row's place in its range of keys and the range's offset."""
    ranged = materialise(df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("p", F.spark_partition_id()))
    local = ranged.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(*keys)) - 1)
    sizes = ranged.groupBy("p").agg(F.count("*").alias("c"))
    offsets = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("o"))  # one row a range
    return local.join(F.broadcast(offsets), "p").select(*keys, (F.col("i") + F.col("o")).alias("n"))


def semantic_edges(neighbours: DataFrame, threshold: float = 0.72, low: float = 0.60, high: float = 0.85, keep: int = 5) -> DataFrame:
    """Edges from ranked neighbours (query_id, chunk_id, score, rank) at the threshold or above, weights clamped."""
    near = neighbours.where((F.col("score") >= threshold) & (F.col("rank") <= keep))
    return near.select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("semantic_similarity").alias("relation"), F.least(F.lit(high), F.greatest(F.lit(low), F.col("score"))).alias("weight"))


def connected_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, src_rule, dst_rule): edges whose ends are both known nodes of different rules."""
    known = nodes.where("rule_number is not null").groupBy("chunk_id").agg(F.min("rule_number").alias("rule"))
    out = edges.join(known.select(F.col("chunk_id").alias("src"), F.col("rule").alias("src_rule")), "src").join(known.select(F.col("chunk_id").alias("dst"), F.col("rule").alias("dst_rule")), "dst")
    return out.where("src_rule <> dst_rule").select("src", "dst", "relation", "src_rule", "dst_rule").distinct()


def tags(text: Column, words: dict[str, list[str]]) -> Column:
    """Sorted names of the word lists of which any word stands in the text."""
    found = [F.when(F.arrays_overlap(F.array(*[F.contains(text, F.lit(w)) for w in ws]), F.array(F.lit(True))), F.lit(k)) for k, ws in sorted(words.items())]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def ruleset(path: Column, start: Column, named: str) -> Column:
    """The rule set a chunk belongs to, told from its normalised path, else from the start of its text; named: a pattern around a name."""
    return (
        F.when(path.rlike("(^|/)gem\\.pdf$|/gem/|(^|/)gem_[^/]*$"), "gem").when(path.rlike("main_board[^/]*$|/main_board/"), "main_board").when(path.contains("guidance"), "guidance")
        .when(start.rlike(named.format("main board")), "main_board").when(start.rlike(named.format("gem")), "gem").otherwise("unknown")
    )
