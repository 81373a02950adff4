"""Queries of the metric block over run rows that are made from the cases by rule, since the tables hold no system's runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.session import read

#: Systems, and the number that sets each one's results apart.
SYSTEMS = [("B3", 1), ("A1", 2), ("A2", 3)]


def runs(spark, d):
    """(cases, rows): each case once, and one row of every system; what a row holds follows from the case's number n and the system's s."""
    c = read(spark, d, "benchmark_case").groupBy("case_id").agg(F.min(F.struct(F.coalesce("case_type", F.lit("none")).alias("case_type"), F.coalesce("query", F.lit("")).alias("q"), F.coalesce("source_chunk_ids", F.array().cast("array<string>")).alias("gold"))).alias("r")).select("case_id", "r.*")
    c = c.withColumn("n", F.substring("case_id", 6, 20).cast("int"))
    tool = F.struct(F.lit("lookup").alias("tool"), F.create_map(F.lit("rule"), (F.col("n") % 5).cast("string")).alias("inputs"), F.create_map(F.lit("x"), (F.col("n") % 4).cast("double")).alias("output"), F.lit(0.5).alias("tolerance"))
    cases = c.select(
        "case_id", "case_type", "gold", F.array(F.concat(F.lit("R"), (F.col("n") % 7).cast("string"))).alias("rules"), F.filter(F.array(F.substring("q", 1, 40)), lambda p: p != "").alias("points"), F.array(F.lit("insufficient evidence")).alias("messages"),
        F.when(F.col("case_type") == "multi_turn", 2).otherwise(0).alias("turns"), F.lit("lookup").alias("intent"), F.when(F.col("n") % 2 == 0, "retrieval").otherwise("tool_only").alias("route"),
        F.when(F.col("n") % 3 == 0, F.array(tool)).otherwise(F.array().cast(M.TOOL)).alias("tools"),
    )
    s = spark.createDataFrame(SYSTEMS, "system string, s int")
    x = c.crossJoin(F.broadcast(s)).withColumn("k", F.col("n") * 7 + F.col("s") * 3)
    round_ = lambda i, b, a: F.struct(F.lit(i).alias("number"), b.cast("double").alias("before"), a.cast("double").alias("after"))
    rows = x.select(
        "system", "case_id", F.when(F.col("case_type") == "multi_turn", "aggregate").otherwise("single_turn").alias("row_type"), F.lit(None).cast("int").alias("turn_index"),
        F.when(F.col("k") % 11 == 0, " ").when(F.col("k") % 2 == 0, F.concat(F.col("q"), F.lit(" insufficient evidence"))).otherwise("nothing found").alias("answer"), F.when(F.col("k") % 13 == 0, "timeout").alias("error"),
        ((F.col("k") % 17) / 10.0).alias("latency"), F.lit(None).cast("string").alias("perturbation_id"), F.lit(None).cast("string").alias("parent_case_id"),
        F.concat(F.array(F.lit("none"), F.concat(F.lit("x"), F.col("s").cast("string"))), F.slice("gold", 1, F.col("s")), F.when(F.col("k") % 5 == 0, F.array(F.lit("y"))).otherwise(F.array().cast("array<string>"))).alias("retrieved"),
        F.array(F.concat(F.lit("r"), (F.col("k") % 7).cast("string"))).alias("retrieved_rules"), F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice("gold", 1, 1), F.array(F.lit("z")))).alias("cited"),
        F.when(F.col("k") % 3 == 0, "other").otherwise("lookup").alias("intent"), F.when(F.col("k") % 2 == 0, "none").otherwise("tool_only").alias("mode"),
        F.when(F.col("k") % 6 == 0, F.array().cast(M.CALL)).otherwise(F.array(F.struct(F.lit("lookup").alias("tool"), F.create_map(F.lit("rule"), (F.col("k") % 5).cast("string")).alias("inputs")))).alias("calls"),
        F.array(F.struct(F.lit("lookup").alias("tool"), (F.col("k") % 4 != 0).alias("success"), F.create_map(F.lit("x"), (F.col("k") % 4).cast("double")).alias("output"))).alias("results"),
        F.when(F.col("k") % 3 == 0, F.array(round_(1, F.lit(0.0), F.lit(0.5)), round_(2, F.lit(0.5), F.lit(0.5) + (F.col("k") % 2) / 4.0))).otherwise(F.array(round_(1, F.lit(0.0), F.lit(1.0)))).alias("rounds"),
    )
    return cases, rows


RETRIEVAL = ["case_count", "hit_at_5", "hit_at_10", "context_recall", "context_precision", "mrr", "rule_coverage", "citation_hit_rate", "citation_precision"]
ANSWER = ["answer_point_coverage", "negative_case_handling_accuracy", "multi_turn_resolution_accuracy", "intent_accuracy", "route_accuracy", "failure_rate", *M.NOT_COMPUTED]
TOOLS = ["tool_selection_accuracy", "tool_input_accuracy", "tool_result_accuracy", "tool_chain_completion_rate", "coverage_improvement_rate", "second_retrieval_rate", "average_latency_seconds", "p50_latency_seconds", "p95_latency_seconds"]


def _block(spark, d):
    cases, rows = runs(spark, d)
    return M.block(M.case_rows(rows), cases)


def metrics_retrieval(spark, d):
    return _block(spark, d).select("system", *RETRIEVAL)


def metrics_answers(spark, d):
    return _block(spark, d).select("system", *ANSWER)


def metrics_tools(spark, d):
    return _block(spark, d).select("system", *TOOLS)


def metric_readiness(spark, d):
    cases, rows = runs(spark, d)
    return M.readiness(rows, cases).groupBy("metric").agg(F.count("*").alias("reasons"))


def metrics_gated(spark, d):
    cases, rows = runs(spark, d)
    return M.gated(M.block(M.case_rows(rows), cases), M.readiness(rows, cases)).select("system", "coverage_improvement_rate", "tool_input_accuracy", "multi_turn_resolution_accuracy")


def paired_systems(spark, d):
    _, rows = runs(spark, d)
    return M.paired(rows, [("B3", "A1"), ("A1", "A2"), ("A1", "A3")])


def capability_split(spark, d):
    """Cases that need neither tools nor turns, and those that need either."""
    cases, _ = runs(spark, d)
    return cases.select("case_id", F.when((F.size("tools") > 0) | (F.col("turns") > 0), "agentic").otherwise("common").alias("capability"))


_CASES = """
  SELECT case_id, r[1] AS case_type, r[2] AS q, r[3] AS gold, substr(case_id, 6)::INT AS n FROM (SELECT case_id, min(row(coalesce(case_type, 'none'), coalesce(query, ''), coalesce(source_chunk_ids, []))) AS r FROM benchmark_case GROUP BY case_id)"""
_RUNS = f"""
  SELECT *, case_type = 'multi_turn' AS multi, n % 3 = 0 AS tooled, CASE WHEN k % 11 = 0 THEN ' ' WHEN k % 2 = 0 THEN q || ' insufficient evidence' ELSE 'nothing found' END AS answer,
  list_concat(list_concat(['none', 'x' || s], gold[1:s]), CASE WHEN k % 5 = 0 THEN ['y'] ELSE [] END) AS got, CASE WHEN k % 4 = 0 THEN [] ELSE list_distinct(list_append(gold[1:1], 'z')) END AS cited, list_distinct(gold) AS g
  FROM (SELECT c.*, system, s, n * 7 + s * 3 AS k FROM ({_CASES}) c, (VALUES ('B3', 1), ('A1', 2), ('A2', 3)) v(system, s))"""
_POINT = "list_filter(regexp_split_to_array(trim({0}), '\\s+'), lambda w: length(w) > 3)"
_HIT = f"(len({_POINT}) > 0 AND len(list_filter({_POINT}, lambda w: contains(lower(answer), lower(w)))) >= 0.5 * len({_POINT}))::INT"
METRICS_RETRIEVAL = f"""
  WITH x AS (SELECT *, len(list_intersect(g, got)) AS c, list_min(list_filter(list_transform(g, lambda i: list_position(got, i)), lambda i: i > 0)) AS first FROM ({_RUNS}))
  SELECT system, count(*) AS case_count, round(avg(list_has_any(g, got[1:5])::INT), 6) AS hit_at_5, round(avg(list_has_any(g, got[1:10])::INT), 6) AS hit_at_10, round(avg(CASE WHEN len(g) > 0 THEN c / len(g) END), 6) AS context_recall,
  round(avg(CASE WHEN len(g) > 0 THEN c / len(got) END), 6) AS context_precision, round(avg(CASE WHEN len(g) > 0 THEN coalesce(1.0 / first, 0) END), 6) AS mrr, round(avg((n % 7 = k % 7)::INT), 6) AS rule_coverage,
  round(avg(list_has_any(g, cited)::INT), 6) AS citation_hit_rate, round(avg(CASE WHEN len(cited) > 0 THEN len(list_intersect(g, cited)) / len(cited) END), 6) AS citation_precision FROM x GROUP BY system"""
METRICS_ANSWERS = f"""
  SELECT system, round(avg(CASE WHEN substr(q, 1, 40) <> '' THEN {_HIT.format("substr(q, 1, 40)")} ELSE 1.0 END), 6) AS answer_point_coverage, round(avg(CASE WHEN case_type = 'negative' THEN {_HIT.format("'insufficient evidence'")} END), 6) AS negative_case_handling_accuracy,
  round(avg(CASE WHEN multi THEN CASE WHEN substr(q, 1, 40) <> '' THEN {_HIT.format("substr(q, 1, 40)")} ELSE (trim(answer) <> '')::INT END END), 6) AS multi_turn_resolution_accuracy, round(avg(CASE WHEN system <> 'B3' THEN (k % 3 <> 0)::INT END), 6) AS intent_accuracy,
  round(avg(CASE WHEN system <> 'B3' THEN ((k % 2 = 0) = (n % 2 = 0))::INT END), 6) AS route_accuracy, round(avg((k % 13 = 0 OR trim(answer) = '')::INT), 6) AS failure_rate, NULL::DOUBLE AS faithfulness, NULL::DOUBLE AS response_relevancy, NULL::DOUBLE AS factual_correctness
  FROM ({_RUNS}) GROUP BY system"""
METRICS_TOOLS = f"""
  SELECT system, round(avg(CASE WHEN tooled THEN (k % 6 <> 0)::INT END), 6) AS tool_selection_accuracy, round(avg(CASE WHEN tooled THEN (k % 6 <> 0 AND k % 5 = n % 5)::INT END), 6) AS tool_input_accuracy,
  round(avg(CASE WHEN tooled THEN (k % 4 <> 0 AND k % 4 = n % 4)::INT END), 6) AS tool_result_accuracy, round(avg(CASE WHEN tooled THEN (k % 4 <> 0)::INT END), 6) AS tool_chain_completion_rate,
  round(avg(CASE WHEN k % 3 = 0 THEN (k % 2 = 1)::INT END), 6) AS coverage_improvement_rate, round(avg((k % 3 = 0)::INT), 6) AS second_retrieval_rate, round(avg((k % 17) / 10), 6) AS average_latency_seconds,
  round(quantile_cont((k % 17) / 10::DOUBLE, 0.5), 6) AS p50_latency_seconds, round(quantile_cont((k % 17) / 10::DOUBLE, 0.95), 6) AS p95_latency_seconds FROM ({_RUNS}) GROUP BY system"""
READY = f"""
  SELECT 'noise_sensitivity' AS metric, 1::BIGINT AS reasons UNION ALL SELECT * FROM (SELECT 'multi_turn_resolution', count(*) AS n FROM ({_RUNS}) WHERE multi) WHERE n > 0 UNION ALL SELECT * FROM (SELECT 'tool_input_accuracy', count(*) AS n FROM ({_RUNS}) WHERE tooled AND k % 6 = 0) WHERE n > 0"""
GATED = f"""
  SELECT m.system, m.coverage_improvement_rate, CASE WHEN t = 0 THEN m.tool_input_accuracy END AS tool_input_accuracy, CASE WHEN u = 0 THEN a.multi_turn_resolution_accuracy END AS multi_turn_resolution_accuracy
  FROM ({METRICS_TOOLS}) m JOIN ({METRICS_ANSWERS}) a USING (system), (SELECT count(*) FILTER (tooled AND k % 6 = 0) AS t, count(*) FILTER (multi) AS u FROM ({_RUNS}))"""
PAIRS = f"""
  WITH o AS (SELECT system, case_id, k % 13 <> 0 AND trim(answer) <> '' AS ok FROM ({_RUNS}))
  SELECT p.a AS baseline, p.b AS candidate, count(*) AS cases, count(*) FILTER (x.ok AND y.ok) AS both, count(*) FILTER (x.ok AND NOT y.ok) AS a_only, count(*) FILTER (y.ok AND NOT x.ok) AS b_only, round(avg(y.ok::INT - x.ok::INT), 6) AS mean_difference
  FROM (VALUES ('B3', 'A1'), ('A1', 'A2')) p(a, b) JOIN o x ON x.system = p.a JOIN o y ON y.system = p.b AND y.case_id = x.case_id GROUP BY p.a, p.b"""

QUERIES = {
    "metrics_retrieval": (metrics_retrieval, METRICS_RETRIEVAL),
    "metrics_answers": (metrics_answers, METRICS_ANSWERS),
    "metrics_tools": (metrics_tools, METRICS_TOOLS),
    "metric_readiness": (metric_readiness, READY),
    "metrics_gated": (metrics_gated, GATED),
    "paired_systems": (paired_systems, PAIRS),
    "capability_split": (capability_split, f"SELECT case_id, CASE WHEN n % 3 = 0 OR case_type = 'multi_turn' THEN 'agentic' ELSE 'common' END AS capability FROM ({_CASES})"),
}
