"""Retrieval and answer metrics, agreement and significance, stratified sampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """Per system: hits over all rows; recall, precision and reciprocal rank over rows with gold ids; null where there are none.

    rows (system, gold ARRAY, retrieved ARRAY in order of rank); null arrays are empty.
    """
    gold, got = F.array_distinct(F.coalesce("gold", F.array())), F.coalesce("retrieved", F.array())
    with_gold, common = F.size(gold) > 0, F.size(F.array_intersect(gold, got))
    first = F.array_min(F.filter(F.transform(gold, lambda g: F.array_position(got, g)), lambda p: p > 0))
    return rows.groupBy("system").agg(
        F.count("*").alias("case_count"),
        F.round(F.avg(F.arrays_overlap(gold, F.slice(got, 1, 5)).cast("double")), 6).alias("hit_at_5"),
        F.round(F.avg(F.arrays_overlap(gold, F.slice(got, 1, 10)).cast("double")), 6).alias("hit_at_10"),
        F.round(F.avg(F.when(with_gold, common / F.size(gold))), 6).alias("context_recall"),
        F.round(F.avg(F.when(with_gold, F.when(F.size(got) > 0, common / F.size(got)).otherwise(0.0))), 6).alias("context_precision"),
        F.round(F.avg(F.when(with_gold, F.coalesce(1.0 / first, F.lit(0.0)))), 6).alias("mrr"),
    )


def latencies(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and exact interpolated quantiles per group."""
    v = F.col(value).cast("double")
    return rows.groupBy(group).agg(F.round(F.avg(v), 6).alias("average"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"))


def breakdowns(rows: DataFrame, attributes: list[str], success: str = "success") -> DataFrame:
    """(attribute, value, cases, successes, rate): one pass of grouping sets for all attributes; null values are their own group."""
    sets = [[F.col(a)] for a in attributes]
    grouped = rows.groupingSets(sets, *[F.col(a) for a in attributes]).agg(F.grouping_id().alias("g"), F.count("*").alias("cases"), F.count_if(F.col(success)).alias("successes"))
    n = len(attributes)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, a in enumerate(attributes):
        own = F.col("g") == ((1 << n) - 1) ^ (1 << (n - 1 - i))
        name, value = F.when(own, F.lit(a)).otherwise(name), F.when(own, F.col(a).cast("string")).otherwise(value)
    return grouped.select(name.alias("attribute"), value.alias("value"), "cases", "successes", F.round(F.col("successes") / F.col("cases"), 6).alias("rate"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters' labels; null kappa where agreement by chance is certain. Pairs with a null go."""
    counts = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    sides = counts.groupBy("a").agg(F.sum("c").alias("x")).join(counts.groupBy("b").agg(F.sum("c").alias("y")), F.col("a") == F.col("b")).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    both = total.crossJoin(sides).select("n", (F.col("same") / F.col("n")).alias("o"), (F.coalesce("xy", F.lit(0.0)) / F.col("n") / F.col("n")).alias("e"))
    return both.select("n", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.when(F.abs(F.col("e") - 1) > 1e-9, F.round((F.col("o") - F.col("e")) / (1 - F.col("e")), 6)).alias("kappa"))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a_only, b_only, p_value): exact two-sided test on paired outcomes; 1 where no pair differs."""
    n = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("a_only"), F.count_if(~F.col(a) & F.col(b)).alias("b_only"))
    total, low = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    # log binomials are summed up term by term: C(n, k) = C(n, k - 1) * (n - k + 1) / k
    start = F.struct(F.lit(0.0).alias("l"), F.exp(-total * math.log(2)).alias("s"))
    step = lambda acc, k: F.struct((acc.l + F.log((total - k + 1) / k)).alias("l"), (acc.s + F.exp(acc.l + F.log((total - k + 1) / k) - total * math.log(2))).alias("s"))
    tail = F.when(low > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(low, F.lit(1).cast("bigint"))), start, step).s).otherwise(F.exp(-total * math.log(2)))
    return n.select("a_only", "b_only", F.when(total == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 6)).alias("p_value"))


def bootstrap(pairs: DataFrame, case: str, a: str, b: str, samples: int = 5000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """(case_count, mean_difference, ci_low, ci_high) of b - a, by resampling.

    Differences are counted by value first, so a resample is one multinomial draw over distinct differences: the work doesn't grow
    with the cases. Only those counts reach the single task that draws.
    """
    import numpy as np
    import pandas as pd

    counts = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy((F.col(b).cast("double") - F.col(a).cast("double")).alias("d")).agg(F.count("*").alias("c"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        d, c = pdf.d.to_numpy(), pdf.c.to_numpy()
        n = int(c.sum())
        means = np.random.default_rng(seed).multinomial(n, c / n, samples) @ d / n
        low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame({"case_count": [n], "mean_difference": [float(d @ c / n)], "ci_low": [low], "ci_high": [high]})

    return counts.groupBy().applyInPandas(draw, "case_count bigint, mean_difference double, ci_low double, ci_high double")


def stratified(cases: DataFrame, quota: DataFrame, cell: list[str], key: str = "case_id", seed: str = "42") -> DataFrame:
    """The first count cases of each cell in order of a seeded hash of their id; ids count once, null labels match no cell.

    Cells are first cut into parts, each of which keeps its first count, so a cell of a third of all cases isn't sorted in one task.
    """
    once = cases.select(key, *cell).dropDuplicates([key])
    order = F.sha2(F.concat_ws(":", F.lit(seed), key), 256)
    joined = once.join(F.broadcast(quota.select(*cell, F.col("count").alias("wanted"))), cell)  # one row a cell
    parts = joined.withColumn("o", order).withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)))
    first = parts.withColumn("place", F.row_number().over(Window.partitionBy(*cell, "part").orderBy("o", key))).where("place <= wanted")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy("o", key))).where("place <= wanted").select(key, *cell, "place")


def distributions(cases: DataFrame, attributes: list[str]) -> DataFrame:
    """Counts of each value of each attribute and of all together, in one pass."""
    cols = [F.col(a) for a in attributes]
    return cases.groupingSets([*[[c] for c in cols], cols], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Exact match and mean Jaccard of two id lists per case (left, right); cases with both empty don't count."""
    a, b = F.array_distinct(F.coalesce("left", F.array())), F.array_distinct(F.coalesce("right", F.array()))
    union, common = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    return pairs.where(union > 0).agg(F.count("*").alias("n"), F.round(F.avg((union == common).cast("double")), 6).alias("exact"), F.round(F.avg(common / union), 6).alias("mean_jaccard"))
