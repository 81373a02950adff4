"""Queries of near-duplicate questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import dedupe as D
from quarry.session import read


def _rows(spark, d):
    return read(spark, d, "benchmark_case").select("case_id", "query")


def question_pairs(spark, d):
    """Different questions with nearly the same tokens, each named by its first case."""
    members, pairs = D.near_pairs(_rows(spark, d), "case_id", "query", characters=False)
    first = members.groupBy("node").agg(F.min("key").alias("id"))
    named = pairs.join(first.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(first.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
    return named.select(F.least("ia", "ib").alias("first"), F.greatest("ia", "ib").alias("second"))


def questions_accepted(spark, d):
    """Questions accepted in order, by tokens alone: what SQL can follow."""
    return D.accepted_in_order(_rows(spark, d), "case_id", "query", characters=False)


def questions_distinct(spark, d):
    """Questions accepted in order, by tokens or characters."""
    return D.accepted_in_order(_rows(spark, d), "case_id", "query")


# Full normalisation as far as the tables need it: widths of letters and blanks, case and white space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_NORM = f"trim(regexp_replace(lower(translate(query, '{_WIDE}', '{_NARROW}')), '[\\s\u00a0\u2000-\u200a\u3000]+', ' ', 'g'))"
_TEXTS = f"""SELECT min(case_id) AS id, t, list_distinct(regexp_extract_all(t, '[a-z0-9]+|[一-鿿]')) AS s FROM (SELECT case_id, {_NORM} AS t FROM benchmark_case WHERE case_id IS NOT NULL AND query <> '') WHERE t <> '' GROUP BY t"""
PAIRS = f"""
  WITH x AS ({_TEXTS}) SELECT a.id AS first, b.id AS second FROM x a JOIN x b ON a.id < b.id WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= 0.9 - 1e-12"""
ACCEPTED = f"""
  WITH RECURSIVE p AS MATERIALIZED ({PAIRS}), o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n, (SELECT list(first) FROM p WHERE second = id) AS before FROM ({_TEXTS})),
  r AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS held UNION ALL SELECT o.n, CASE WHEN len(list_intersect(held, coalesce(before, []))) > 0 THEN held ELSE list_append(held, o.id) END FROM r JOIN o ON o.n = r.n + 1)
  SELECT unnest(held) AS case_id FROM (SELECT held FROM r ORDER BY n DESC LIMIT 1)"""

QUERIES = {
    "question_pairs": (question_pairs, PAIRS),
    "questions_accepted": (questions_accepted, ACCEPTED),
    "questions_distinct": (questions_distinct, None),
}
