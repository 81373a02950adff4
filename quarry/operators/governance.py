"""Registries: duplicates, manifests, completeness, keyed upserts and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, digest: str, key: str, order: list[str]) -> DataFrame:
    """(key, canonical, copies): of rows with one digest, the canonical one comes first in order; each row's group size.

    The group's minimum and size are combined on the map side and joined back, so a group that holds a third of all rows isn't
    gathered anywhere. Null digests are groups of their own row.
    """
    first = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(F.struct(*order, F.col(key).alias("_k"))).alias("m"), F.count("*").alias("copies"))
    joined = rows.select(key, digest).join(first.select(digest, F.col("m._k").alias("canonical"), "copies"), digest, "left")
    return joined.select(key, F.coalesce("canonical", key).alias("canonical"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))


def worst(rows: DataFrame, group: Column, value: str, priority: dict[str, int]) -> DataFrame:
    """(group, worst): per group the value of least priority number; unknown values come last."""
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col(value)], F.lit(1 << 20))
    return rows.groupBy(group.alias("group")).agg(F.min(F.struct(order.alias("o"), F.col(value).alias("v"))).alias("m")).select("group", F.col("m.v").alias("worst"))


def count_map(rows: DataFrame, value: Column) -> DataFrame:
    """One row: a map from each value to how often it stands; of no rows an empty map. For domains of few values."""
    counts = rows.groupBy(value.alias("k")).agg(F.count("*").alias("c")).where("k is not null")
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "c")))).alias("counts"))


def completeness(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): expected ids that are missing, ids that aren't expected, ids that come more than once."""
    want, have = expected.select(key).distinct(), actual.groupBy(key).agg(F.count("*").alias("n"))
    missing = want.join(have, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = have.join(want, key, "left_anti").select(key, F.lit("unexpected").alias("problem"))
    return missing.unionByName(extra).unionByName(have.where("n > 1").select(key, F.lit("repeated").alias("problem")))


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows by key where a later layer overrides earlier ones: a union and one grouping, not a chain of joins."""
    cols = [c for c in layers[0].columns if c != key]
    rows = layers[0].withColumn("_layer", F.lit(0))
    for i, x in enumerate(layers[1:], 1):
        rows = rows.unionByName(x.withColumn("_layer", F.lit(i)))
    won = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("_layer", *[F.col(c) for c in cols])).alias("r"))
    return won.select(key, "r.*")


def quota_check(quota: DataFrame, held: DataFrame, cell: list[str]) -> DataFrame:
    """Cells whose count differs: (cell, wanted, have, difference); cells of one side only count as 0 on the other."""
    have = held.groupBy(*cell).agg(F.count("*").alias("have"))
    both = quota.select(*cell, F.col("count").alias("wanted")).join(have, cell, "full")
    out = both.select(*cell, F.coalesce("wanted", F.lit(0)).cast("bigint").alias("wanted"), F.coalesce("have", F.lit(0)).cast("bigint").alias("have"))
    return out.withColumn("difference", F.col("have") - F.col("wanted")).where("difference <> 0")


def cache_split(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits joined with their cached values, misses): only misses are computed again."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; a null check fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())


def first_without_near_duplicate(ids: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """ids accepted one by one in order, each unless it nearly equals an accepted one: the result of the sequential loop.

    pairs (a, b) with a before b. In each round an id without undecided or accepted earlier partners is accepted, and one with an
    accepted earlier partner rejected, until all are decided, as many rounds as the longest chain has ids; pairs in a circle raise an error.
    """
    from quarry.session import materialise

    edges = materialise(pairs.select("a", "b").distinct())
    state = materialise(ids.select(F.col(key).alias("id")).distinct().withColumn("ok", F.lit(None).cast("boolean")))
    undecided = None
    while undecided != 0:
        before = edges.join(state.select(F.col("id").alias("a"), F.col("ok").alias("a_ok")), "a").groupBy("b").agg(F.coalesce(F.bool_or("a_ok"), F.lit(False)).alias("taken"), F.count_if(F.col("a_ok").isNull()).alias("open"))
        seen = state.join(before, state.id == before.b, "left")
        state = materialise(seen.select("id", F.coalesce("ok", F.when(F.col("taken"), False).when(F.coalesce("open", F.lit(0)) == 0, True)).alias("ok")))
        left = state.where("ok is null").count()
        if left and left == undecided:
            raise ValueError("pairs (a, b) must have a before b")
        undecided = left
    return state.where("ok").select(F.col("id").alias(key))
