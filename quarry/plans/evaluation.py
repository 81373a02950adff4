"""Queries of metrics, agreement, significance and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation as E
from quarry.session import read

CELL = ["primary_category", "language", "difficulty"]


def _runs(spark, d):
    """Run rows by system: each case's gold ids against the ids retrieved for the cases of the same cell, a stand-in for a run's results."""
    c = read(spark, d, "benchmark_case").dropDuplicates(["case_id"])
    other = c.select(F.concat(F.lit("case-"), F.lpad((F.substring("case_id", 6, 20).cast("bigint") + 1).cast("string"), 8, "0")).alias("case_id"), F.col("source_chunk_ids").alias("near"))
    rows = c.join(other, "case_id", "left")
    got = F.concat(F.coalesce("near", F.array()), F.slice(F.coalesce("source_chunk_ids", F.array()), 1, 1))
    return rows.select("case_id", F.coalesce("case_type", F.lit("none")).alias("system"), F.col("source_chunk_ids").alias("gold"), got.alias("retrieved"))


RUNS = """
  SELECT c.case_id, coalesce(c.case_type, 'none') AS system, coalesce(c.source_chunk_ids, []) AS gold, list_concat(coalesce(o.source_chunk_ids, []), list_slice(coalesce(c.source_chunk_ids, []), 1, 1)) AS retrieved
  FROM (SELECT case_id, any_value(case_type) AS case_type, any_value(source_chunk_ids) AS source_chunk_ids FROM benchmark_case GROUP BY case_id) c
  LEFT JOIN (SELECT case_id, any_value(source_chunk_ids) AS source_chunk_ids FROM benchmark_case GROUP BY case_id) o ON o.case_id = 'case-' || lpad((CAST(substr(c.case_id, 6) AS BIGINT) - 1)::VARCHAR, 8, '0')"""


def retrieval_metrics(spark, d):
    return E.retrieval_metrics(_runs(spark, d))


METRICS = f"""
  WITH r AS (SELECT system, list_distinct(gold) AS g, retrieved AS x FROM ({RUNS})),
  p AS (SELECT *, len(list_intersect(g, x)) AS c, list_min(list_filter(list_transform(g, lambda i: list_position(x, i)), lambda i: i > 0)) AS first FROM r)
  SELECT system, count(*) AS case_count, round(avg(list_has_any(g, list_slice(x, 1, 5))::INT), 6) AS hit_at_5, round(avg(list_has_any(g, list_slice(x, 1, 10))::INT), 6) AS hit_at_10,
  round(avg(CASE WHEN len(g) > 0 THEN c / len(g) END), 6) AS context_recall, round(avg(CASE WHEN len(g) > 0 THEN CASE WHEN len(x) > 0 THEN c / len(x) ELSE 0.0 END END), 6) AS context_precision,
  round(avg(CASE WHEN len(g) > 0 THEN coalesce(1.0 / first, 0.0) END), 6) AS mrr FROM p GROUP BY system"""


def latency_quantiles(spark, d):
    return E.latencies(read(spark, d, "events"), "event_type", "value")


def breakdowns(spark, d):
    rows = read(spark, d, "benchmark_case").dropDuplicates(["case_id"]).withColumn("success", F.coalesce("accepted", F.lit(False)))
    return E.breakdowns(rows, ["primary_category", "language", "difficulty", "case_type"])


_ONCE = "SELECT case_id, any_value(primary_category) AS primary_category, any_value(language) AS language, any_value(difficulty) AS difficulty, any_value(case_type) AS case_type, any_value(accepted) AS accepted FROM benchmark_case GROUP BY case_id"
BREAKDOWNS = " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {a} AS value, count(*) AS cases, count(*) FILTER (accepted) AS successes, round(count(*) FILTER (accepted) / count(*), 6) AS rate FROM ({_ONCE}) GROUP BY {a}" for a in [*CELL, "case_type"]
)


def _raters(spark, d):
    """Two raters of a document's language: the label it arrived with and the column of the table."""
    return read(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("left"), F.coalesce("doc_kind", F.lit("none")).alias("kind"), F.when(F.col("text").rlike("[一-鿿]"), "zh").otherwise(F.coalesce("lang", F.lit("none"))).alias("right"))


_RATERS = "SELECT coalesce(lang, 'none') AS l, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE coalesce(lang, 'none') END AS r FROM documents"


def kappa(spark, d):
    return E.kappa(_raters(spark, d), "left", "right")


KAPPA = f"""
  WITH p AS ({_RATERS}), n AS (SELECT count(*) AS n, avg((l = r)::INT) AS o FROM p),
  e AS (SELECT sum(x.c::DOUBLE * y.c) AS xy FROM (SELECT l AS k, count(*) AS c FROM p GROUP BY l) x JOIN (SELECT r AS k, count(*) AS c FROM p GROUP BY r) y USING (k))
  SELECT n::BIGINT AS n, round(o, 6) AS observed, round(xy / n / n, 6) AS expected, round((o - xy / n / n) / (1 - xy / n / n), 6) AS kappa FROM n, e"""


def _outcomes(spark, d):
    return read(spark, d, "benchmark_case").dropDuplicates(["case_id"]).select("case_id", F.coalesce("accepted", F.lit(False)).alias("a"), F.coalesce(F.size("source_chunk_ids") >= 2, F.lit(False)).alias("b"))


def mcnemar_counts(spark, d):
    return E.mcnemar(_outcomes(spark, d), "a", "b").select("a_only", "b_only")


MCNEMAR = "SELECT count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM (SELECT coalesce(any_value(accepted), false) AS a, coalesce(len(any_value(source_chunk_ids)) >= 2, false) AS b FROM benchmark_case GROUP BY case_id)"


def mcnemar_test(spark, d):
    return E.mcnemar(_outcomes(spark, d), "a", "b")


def bootstrap_ci(spark, d):
    return E.bootstrap(_outcomes(spark, d).select("case_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")), "case_id", "a", "b")


def stratified_sample(spark, d):
    return E.stratified(read(spark, d, "benchmark_case").where("accepted"), read(spark, d, "default_benchmark_quota"), CELL)


SAMPLE = """
  WITH o AS (SELECT case_id, any_value(primary_category) AS primary_category, any_value(language) AS language, any_value(difficulty) AS difficulty FROM benchmark_case WHERE accepted GROUP BY case_id)
  SELECT case_id, primary_category, language, difficulty, place::INT AS place FROM (SELECT o.*, q.count AS wanted, row_number() OVER (PARTITION BY primary_category, language, difficulty ORDER BY sha256('42:' || case_id), case_id) AS place
  FROM o JOIN default_benchmark_quota q USING (primary_category, language, difficulty)) WHERE place <= wanted"""


def distributions(spark, d):
    rows = read(spark, d, "benchmark_case").dropDuplicates(["case_id"]).select(*[F.coalesce(c, F.lit("none")).alias(c) for c in CELL])
    return E.distributions(rows, CELL).drop("level")


_D = "SELECT coalesce(primary_category, 'none') AS primary_category, coalesce(language, 'none') AS language, coalesce(difficulty, 'none') AS difficulty FROM (" + _ONCE + ")"
DISTRIBUTIONS = f"SELECT primary_category, language, difficulty, count(*) AS n FROM ({_D}) GROUP BY GROUPING SETS ((primary_category), (language), (difficulty), (primary_category, language, difficulty))"


def evidence_agreement(spark, d):
    return E.agreement(_runs(spark, d).select(F.col("gold").alias("left"), F.col("retrieved").alias("right")))


AGREEMENT = f"""
  WITH p AS (SELECT list_distinct(gold) AS l, list_distinct(retrieved) AS r FROM ({RUNS})), u AS (SELECT len(list_intersect(l, r)) AS c, len(list_distinct(list_concat(l, r))) AS u FROM p)
  SELECT count(*) AS n, round(avg((u = c)::INT), 6) AS "exact", round(avg(c / u), 6) AS mean_jaccard FROM u WHERE u > 0"""


def paired_rows(spark, d):
    """Success of the same user in two event types, only where both have the same users: the gate of paired comparisons."""
    e = read(spark, d, "events").where("user_id is not null")
    a, b = (e.where(F.col("event_type") == t).groupBy("user_id").agg(F.avg("value").alias(t)) for t in ("view", "click"))
    both = a.join(b, "user_id", "full")
    return both.agg(F.count("*").alias("users"), F.count_if(F.col("view").isNull() | F.col("click").isNull()).alias("unpaired"), F.round(F.avg(F.col("click") - F.col("view")), 6).alias("mean_difference"))


PAIRED = """
  WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' AND user_id IS NOT NULL GROUP BY 1), b AS (SELECT user_id, avg(value) AS c FROM events WHERE event_type = 'click' AND user_id IS NOT NULL GROUP BY 1)
  SELECT count(*) AS users, count(*) FILTER (v IS NULL OR c IS NULL) AS unpaired, round(avg(c - v), 6) AS mean_difference FROM a FULL JOIN b USING (user_id)"""

QUERIES = {
    "retrieval_metrics": (retrieval_metrics, METRICS),
    "latency_quantiles": (latency_quantiles, "SELECT event_type, round(avg(value::DOUBLE), 6) AS average, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95 FROM events GROUP BY event_type"),
    "breakdowns": (breakdowns, BREAKDOWNS),
    "kappa": (kappa, KAPPA),
    "mcnemar_counts": (mcnemar_counts, MCNEMAR),
    "mcnemar_test": (mcnemar_test, f"WITH c AS ({MCNEMAR}), n AS (SELECT *, a_only + b_only AS t, least(a_only, b_only) AS low FROM c) SELECT a_only, b_only, round(CASE WHEN t = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) - t * ln(2))) FROM range(0, low + 1) r(i))) END, 6) AS p_value FROM n"),
    "bootstrap_ci": (bootstrap_ci, None),
    "stratified_sample": (stratified_sample, SAMPLE),
    "distributions": (distributions, DISTRIBUTIONS),
    "evidence_agreement": (evidence_agreement, AGREEMENT),
    "paired_rows": (paired_rows, PAIRED),
}
