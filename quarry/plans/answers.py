"""Queries from selected evidence to answers, claims and their support."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import retrieval as R
from quarry.plans import retrieval as Q
from quarry.session import read, stored, stored_alone


def _selected(spark, d, whole=False):
    """Selected evidence, stored: what is made of it reads it as often as it needs without another search."""
    if whole:
        return stored_alone(lambda: Q._with_chunks(spark, d, stored(Q._evidence(spark, d, whole).drop("rule_number")), whole))
    return stored_alone(lambda: Q._evidence(spark, d))


SELECTED = f"SELECT e.query_id, e.chunk_id, e.place, e.score, c.rule_number, c.section_title, c.text, c.source_path FROM ({Q.EVIDENCE}) e JOIN ({Q._OWN}) c USING (chunk_id)"


def answer_render(spark, d):
    return A.rendered(_selected(spark, d))


ANSWERS = f"""
  SELECT query_id, 'Based on ' || coalesce(arg_min(t, place), 'the document') || arg_min(r, place) || ' the following applies: ' || arg_min(x, place) ||
  CASE WHEN count(*) > 1 THEN ' ' || (count(*) - 1)::VARCHAR || ' other sources agree.' ELSE '' END AS answer
  FROM (SELECT query_id, place, coalesce(section_title, 'the document') AS t, CASE WHEN coalesce(rule_number, '') <> '' THEN ' (Rule ' || rule_number || ')' ELSE '' END AS r, substr(text, 1, 300) AS x FROM ({SELECTED})) GROUP BY query_id"""


def answer_claims(spark, d):
    return A.claims(answer_render(spark, d))


CLAIMS = f"""
  SELECT query_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(answer, '[.!?。！？]+'), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'), ' ')), lambda x: length(x) > 15))) AS claim FROM ({ANSWERS})"""


def claim_support(spark, d):
    selected = _selected(spark, d)
    return A.supported(A.claims(A.rendered(selected)), selected)


SUPPORT = f"""
  WITH c AS (SELECT query_id, claim, {Q.MIXED.format("claim")} AS want, {Q._REFS.format("claim")} AS rules FROM ({CLAIMS})), r AS (SELECT query_id, rule_number, {Q.MIXED.format("text")} AS have FROM ({SELECTED})),
  m AS (SELECT c.query_id, claim, want, coalesce(CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) ELSE 0.0 END, 0.0) AS share, coalesce(list_contains(rules, rule_number), false) AS named FROM c LEFT JOIN r USING (query_id))
  SELECT query_id, claim, round(max(share), 6) AS overlap, coalesce(bool_or(share >= CASE WHEN len(want) <= 5 THEN 0.6 WHEN len(want) <= 10 THEN 0.5 ELSE 0.4 END OR named), false) AS ok FROM m GROUP BY query_id, claim"""


def answer_confidence(spark, d, whole=False):
    selected = _selected(spark, d, whole)
    return A.confidence(A.supported(A.claims(A.rendered(selected)), selected), selected)


CONFIDENCE = f"""
  WITH n AS (SELECT query_id, count(*) AS results FROM ({SELECTED}) GROUP BY 1), s AS (SELECT query_id, count(*) AS claims, count(*) FILTER (NOT ok) AS unsupported FROM ({SUPPORT}) GROUP BY 1)
  SELECT query_id, coalesce(claims, 0) AS claims, coalesce(unsupported, 0) AS unsupported, CASE WHEN coalesce(claims, 0) = 0 THEN 'low' WHEN 1 - unsupported / claims >= 0.6 AND results >= 2 THEN 'high' WHEN 1 - unsupported / claims >= 0.4 THEN 'medium' ELSE 'low' END AS confidence
  FROM n LEFT JOIN s USING (query_id)"""


def citations(spark, d, whole=False):
    """Selected chunks that the answer's claims rest on: those of a rule or section that the answer names, with snippets."""
    selected = _selected(spark, d, whole)
    used = selected.join(A.rendered(selected), "query_id").where(F.contains("answer", F.coalesce("section_title", F.lit("\u0000"))) | (F.col("place") == 1))
    return used.select("query_id", "chunk_id", "rule_number", T.snippet("text").alias("snippet"))


CITATIONS = f"""
  WITH s AS ({SELECTED}), a AS ({ANSWERS}) SELECT s.query_id, s.chunk_id, s.rule_number, {Q._snippet_sql("s.text")} AS snippet FROM s JOIN a USING (query_id) WHERE contains(answer, coalesce(section_title, chr(1))) OR place = 1"""


def gap_rewrite(spark, d):
    """At most three targeted queries of each request's parts, the same ones but for case once, in order."""
    q = read(spark, d, "query_request").select("request_id", "query").distinct()
    parts = q.select("request_id", F.posexplode(T.sub_queries("query")).alias("part", "gap")).where("part < 3").withColumn("rewritten", A.rewritten(F.col("gap")))
    once = parts.withColumn("n", F.row_number().over(Window.partitionBy("request_id", F.lower("rewritten")).orderBy("part"))).where("n = 1")
    return once.select("request_id", "part", "rewritten")


REWRITE = f"""
  WITH p AS (SELECT request_id, unnest(range(0, len(l)))::INT AS part, unnest(l) AS gap FROM (SELECT request_id, list_filter(list_transform(regexp_split_to_array(query, '(?i)\\s+(?:and|or)\\s+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM (SELECT DISTINCT request_id, query FROM query_request))),
  t AS (SELECT *, regexp_extract_all(gap, '([0-9]{{1,2}}[A-Z]?\\.[0-9]+)', 1) AS rules, trim(regexp_replace(regexp_replace(gap, '[Rr]ules? [0-9]{{1,2}}[A-Z]?\\.[0-9]+(?:\\([0-9]+\\))?', '', 'g'), ' {{2,}}', ' ', 'g'), ' ') AS topic FROM p WHERE part < 3),
  r AS (SELECT request_id, part, CASE WHEN len(rules) > 0 AND topic <> '' THEN topic || ' under ' || array_to_string(list_transform(list_filter(rules, lambda x, i: list_position(rules, x) = i), lambda x: 'Rule ' || x), ' and ') ELSE gap END AS rewritten FROM t)
  SELECT request_id, part, rewritten FROM (SELECT *, row_number() OVER (PARTITION BY request_id, lower(rewritten) ORDER BY part) AS n FROM r) WHERE n = 1"""


def nfkc_norm(spark, d):
    q = read(spark, d, "query_request").select("request_id", "query").distinct()
    return q.select("request_id", A.fully_normalized("query").alias("normalized"))


def seq_similarity(spark, d):
    """Successive questions of a conversation whose texts are alike: only pairs that the length bound leaves are compared."""
    q = read(spark, d, "query_request").where("conversation_id is not null and query <> ''").dropDuplicates(["request_id"])
    w = Window.partitionBy("conversation_id").orderBy("asked_at", "request_id")
    pairs = q.select("conversation_id", "request_id", "query", F.lag("request_id").over(w).alias("earlier"), F.lag("query").over(w).alias("text")).where("earlier is not null")
    near = pairs.where(A.sequence_bound(F.col("query"), F.col("text")) >= 0.9)
    return near.select("request_id", "earlier", F.round(A.sequence_similarity("query", "text"), 6).alias("ratio")).where("ratio >= 0.9")


QUERIES = {
    "answer_render": (answer_render, ANSWERS),
    "answer_claims": (answer_claims, CLAIMS),
    "claim_support": (claim_support, SUPPORT),
    "answer_confidence": (answer_confidence, CONFIDENCE),
    "whole_answer_confidence": (partial(answer_confidence, whole=True), Q.whole_sql(CONFIDENCE)),
    "citations": (citations, CITATIONS),
    "whole_citations": (partial(citations, whole=True), Q.whole_sql(CITATIONS)),
    "gap_rewrite": (gap_rewrite, REWRITE),
    "nfkc_norm": (nfkc_norm, None),
    "seq_similarity": (seq_similarity, None),
}
