"""The metric block of evaluation runs, what makes a metric reportable, and paired comparisons of systems.

Run rows hold, beside system and case_id: row_type, turn_index, answer, error, latency, perturbation_id, parent_case_id, retrieved
(array of chunk ids in order), retrieved_rules, cited, intent, mode, calls and results (arrays of structs) and rounds (array of
coverage before and after). Cases hold gold, rules, points, messages, case_type, turns, intent, route and tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

ROUND = "array<struct<number: int, before: double, after: double>>"
CALL = "array<struct<tool: string, inputs: map<string, string>>>"
RESULT = "array<struct<tool: string, success: boolean, output: map<string, double>>>"
TOOL = "array<struct<tool: string, inputs: map<string, string>, output: map<string, double>, tolerance: double>>"
NOT_COMPUTED = ["faithfulness", "response_relevancy", "factual_correctness"]


def succeeded(answer: Column, error: Column) -> Column:
    """Success of a run row: no error, and an answer that isn't blank."""
    return (F.coalesce(error, F.lit("")) == "") & (F.coalesce(F.trim(answer), F.lit("")) != "")


def case_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_type").isin("single_turn", "aggregate"))


def joined(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Run rows with their cases; a row of an unknown case is an error."""
    if not rows.join(cases, "case_id", "left_anti").isEmpty():
        raise ValueError("run rows of unknown cases")
    return rows.join(cases.withColumnRenamed("intent", "expected_intent"), "case_id")


def share(points: Column, answer: Column) -> Column:
    """The share of points that stand in the answer; null without points."""
    told = F.coalesce(answer, F.lit(""))
    return F.try_divide(F.size(F.filter(points, lambda p: T.contains_point(told, p))).cast("double"), F.size(points))


def _same(expected: Column, actual: Column, tolerance: Column) -> Column:
    keys = F.map_keys(expected)
    return F.forall(keys, lambda k: F.coalesce(F.abs(F.element_at(actual, k) - F.element_at(expected, k)) <= tolerance, F.lit(False)))


def block(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a system with all metrics; null where a metric's denominator is empty.

    Sets are compared as arrays of a case, so all of it is one grouping with a map-side combine.
    """
    e = lambda c, kind="string": F.coalesce(c, F.array().cast(f"array<{kind}>"))
    x = joined(rows, cases).select(
        "system", "case_type", "answer", F.array_distinct(e("gold")).alias("gold"), e("retrieved").alias("got"), F.array_distinct(e("cited")).alias("cited"), F.array_distinct(F.transform(e("rules"), lambda r: F.lower(r))).alias("rules"),
        F.transform(e("retrieved_rules"), lambda r: F.lower(r)).alias("got_rules"), e("points").alias("points"), e("messages").alias("messages"), F.coalesce("turns", F.lit(0)).alias("turns"), "intent", "expected_intent", "route", "mode",
        F.coalesce("tools", F.array().cast(TOOL)).alias("tools"), F.coalesce("calls", F.array().cast(CALL)).alias("calls"), F.coalesce("results", F.array().cast(RESULT)).alias("results"), F.coalesce("rounds", F.array().cast(ROUND)).alias("rounds"),
        "latency", succeeded(F.col("answer"), F.col("error")).alias("ok"),
    )
    gold, got, common = F.size("gold") > 0, F.size("got") > 0, F.size(F.array_intersect("gold", "got"))
    first = F.array_min(F.filter(F.transform("gold", lambda g: F.array_position("got", g)), lambda p: p > 0))
    spoken, points = (F.coalesce(F.trim("answer"), F.lit("")) != "").cast("double"), share(F.col("points"), F.col("answer"))
    mode = F.when(F.coalesce("mode", F.lit("none")) == "none", "retrieval").otherwise(F.col("mode"))
    names = lambda a: F.transform(a, lambda t: t.tool)
    of = lambda a, t: F.try_element_at(F.filter(a, lambda c: c.tool == t.tool), F.lit(1))
    given = F.transform("tools", lambda t: F.coalesce(of("calls", t).isNotNull() & F.forall(F.map_keys(t.inputs), lambda k: F.coalesce(F.element_at(of("calls", t).inputs, k) == F.element_at(t.inputs, k), F.lit(False))), F.lit(False)))
    made = F.transform("tools", lambda t: F.coalesce(of("results", t).success & _same(t.output, of("results", t).output, F.coalesce(t.tolerance, F.lit(0.0))), F.lit(False)))
    part = lambda a: F.size(F.filter(a, lambda v: v)) / F.size(a)
    used = F.size("tools") > 0
    chain = (F.size("results") >= F.size("tools")) & F.forall(F.slice("results", 1, F.size("tools")), lambda r: F.coalesce(r.success, F.lit(False)))
    later = F.filter("rounds", lambda r: r.before.isNotNull() & r.after.isNotNull() & (r.number > 1))
    judged = F.col("system") != "B3"
    r6 = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return x.groupBy("system").agg(
        F.count("*").alias("case_count"), r6(F.arrays_overlap("gold", F.slice("got", 1, 5)), "hit_at_5"), r6(F.arrays_overlap("gold", F.slice("got", 1, 10)), "hit_at_10"), r6(F.when(gold, common / F.size("gold")), "context_recall"),
        r6(F.when(gold, F.when(got, common / F.size("got")).otherwise(0.0)), "context_precision"), r6(F.when(gold, F.coalesce(1.0 / first, F.lit(0.0))), "mrr"),
        r6(F.when(F.size("rules") > 0, F.size(F.array_intersect("rules", "got_rules")) / F.size("rules")), "rule_coverage"), r6(F.arrays_overlap("gold", "cited"), "citation_hit_rate"),
        r6(F.when(F.size("cited") > 0, F.size(F.array_intersect("gold", "cited")) / F.size("cited")), "citation_precision"), r6(F.coalesce(points, F.lit(1.0)), "answer_point_coverage"), *[F.lit(None).cast("double").alias(n) for n in NOT_COMPUTED],
        r6(F.when(judged, F.coalesce(F.col("intent") == F.col("expected_intent"), F.lit(False))), "intent_accuracy"), r6(F.when(judged, F.coalesce(mode == F.col("route"), F.lit(False))), "route_accuracy"),
        r6(F.when(used, names("calls") == names("tools")), "tool_selection_accuracy"), r6(F.when(used, part(given)), "tool_input_accuracy"), r6(F.when(used, part(made)), "tool_result_accuracy"), r6(F.when(used, chain), "tool_chain_completion_rate"),
        F.round(F.try_divide(F.sum(F.size(F.filter(later, lambda r: r.after > r.before))), F.sum(F.size(later))), 6).alias("coverage_improvement_rate"), r6(F.size("rounds") > 1, "second_retrieval_rate"),
        r6(F.when(F.col("case_type") == "negative", F.coalesce(share(F.col("messages"), F.col("answer")), spoken)), "negative_case_handling_accuracy"), r6(F.when(F.col("turns") > 0, F.coalesce(points, spoken)), "multi_turn_resolution_accuracy"),
        r6(~F.col("ok"), "failure_rate"), r6(F.col("latency"), "average_latency_seconds"), F.round(F.percentile("latency", F.lit(0.5)), 6).alias("p50_latency_seconds"), F.round(F.percentile("latency", F.lit(0.95)), 6).alias("p95_latency_seconds"),
    )


def readiness(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """(metric, reason): what speaks against reporting a metric; a metric without a row is ready."""
    at = F.concat_ws("/", "system", "case_id")
    told = rows.where(F.size(F.coalesce("rounds", F.array().cast(ROUND))) > 0)
    none = told.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("coverage_improvement").alias("metric"), F.lit("no rows contain rounds").alias("reason"))
    open_ = told.where(F.exists("rounds", lambda r: r.before.isNull() | r.after.isNull())).select(F.lit("coverage_improvement").alias("metric"), F.concat(at, F.lit(": missing coverage")).alias("reason"))
    plain = case_rows(rows)
    noise = plain.where("perturbation_id is not null")
    clean = plain.where("perturbation_id is null").select("system", F.col("case_id").alias("parent_case_id")).distinct()
    orphan = noise.join(clean, ["system", "parent_case_id"], "left_anti").select(F.lit("noise_sensitivity").alias("metric"), F.concat(at, F.lit(": no clean parent")).alias("reason"))
    quiet = noise.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("noise_sensitivity").alias("metric"), F.lit("no perturbed rows").alias("reason"))
    many = cases.where("case_type = 'multi_turn'").select("case_id", F.coalesce("turns", F.lit(0)).alias("turns"))
    held = rows.groupBy("system", "case_id").agg(F.count_if(F.col("row_type") == "aggregate").alias("whole"), F.sort_array(F.collect_list(F.when(F.col("row_type") == "turn", F.col("turn_index")))).alias("at"), F.count_if(F.col("row_type") == "turn").alias("n"))
    want = many.crossJoin(F.broadcast(rows.select("system").distinct())).join(held, ["system", "case_id"], "left")  # a handful of systems
    fits = (F.coalesce("whole", F.lit(0)) == 1) & (F.coalesce("n", F.lit(0)) == F.col("turns")) & ((F.coalesce(F.size("at"), F.lit(0)) < 1) | (F.col("at") == F.sequence(F.lit(1), F.greatest("turns", F.lit(1)))))
    turns = want.where(~F.coalesce(fits, F.lit(False))).select(F.lit("multi_turn_resolution").alias("metric"), F.concat(at, F.lit(": turns incomplete")).alias("reason"))
    needed = cases.where(F.size(F.coalesce("tools", F.array().cast(TOOL))) > 0).select("case_id", "tools")
    silent = plain.join(needed, "case_id").where(~F.forall("tools", lambda t: F.coalesce(F.exists("calls", lambda c: c.tool == t.tool), F.lit(False)))).select(F.lit("tool_input_accuracy").alias("metric"), F.concat(at, F.lit(": no inputs")).alias("reason"))
    parts = [none, open_, quiet, orphan, turns, silent]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gated(metrics: DataFrame, ready: DataFrame) -> DataFrame:
    """The metric block with the metrics that aren't ready set to null."""
    gates = {"coverage_improvement_rate": "coverage_improvement", "tool_input_accuracy": "tool_input_accuracy", "multi_turn_resolution_accuracy": "multi_turn_resolution"}
    flags = ready.agg(*[F.count_if(F.col("metric") == g).alias(f"_{m}") for m, g in gates.items()])  # one row
    out = metrics.crossJoin(F.broadcast(flags))
    for m in gates:
        out = out.withColumn(m, F.when(F.col(f"_{m}") == 0, F.col(m)))
    return out.drop(*[f"_{m}" for m in gates])


def paired(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(baseline, candidate, cases, both, a_only, b_only, mean_difference) of systems that ran exactly the same cases; others have no row."""
    own = case_rows(rows).select("system", "case_id", succeeded(F.col("answer"), F.col("error")).alias("ok"))
    named = rows.sparkSession.createDataFrame(pairs, "baseline string, candidate string")
    a = named.join(own.withColumnRenamed("ok", "a"), F.col("baseline") == F.col("system")).drop("system")
    b = named.join(own.withColumnRenamed("ok", "b"), F.col("candidate") == F.col("system")).drop("system")
    both = a.join(b, ["baseline", "candidate", "case_id"], "full").groupBy("baseline", "candidate")
    out = both.agg(
        F.count("*").alias("cases"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("single"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"),
        F.round(F.avg(F.col("b").cast("double") - F.col("a").cast("double")), 6).alias("mean_difference"),
    )
    return out.where("single = 0").drop("single")


__all__ = ["block", "case_rows", "gated", "joined", "paired", "readiness", "succeeded"]
