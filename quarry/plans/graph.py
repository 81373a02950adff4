"""Queries of the relationship graph over chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import graph as G
from quarry.plans.retrieval import _REFS
from quarry.session import read

# Words that tag a chunk with a topic.
TOPICS = {"disposal": ["disposal", "出售事項"], "financing": ["financing", "融資"], "guarantee": ["guarantee", "擔保", "保證"], "reporting": ["report", "return", "報告", "月報表"], "trading": ["trading", "停牌", "買賣"]}
SECTION = "array_to_string([coalesce(document_id, ''), section_title], '|')"


def _nodes(spark, d):
    return read(spark, d, "chunk").select("chunk_id", "document_id", "rule_number", "section_title", "chapter", "text").distinct()


def graph_nodes(spark, d):
    n = _nodes(spark, d)
    return n.select("chunk_id", F.array_join(G.tags(F.lower("text"), TOPICS), ",").alias("topics"), T.inferred_language("text").alias("language"))


def _tag_sql(t: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({t}, ' + repr(w) + ')' for w in ws)} THEN '{k}' END" for k, ws in sorted(TOPICS.items())) + "], lambda x: x IS NOT NULL), ',')"


def neighbour_edges(spark, d):
    n = _nodes(spark, d)
    edges = G.neighbour_edges(n, "rule_number", "same_rule")
    sections = n.where("section_title <> ''").withColumn("section", F.concat_ws("|", "document_id", "section_title"))
    chapters = n.where("chapter <> ''").withColumn("in_chapter", F.concat_ws("|", "document_id", "chapter"))
    edges = edges.unionByName(G.neighbour_edges(sections, "section", "same_section")).unionByName(G.neighbour_edges(chapters, "in_chapter", "same_chapter"))
    return G.canonical_edges(edges)


def _neighbour_sql(group: str, relation: str, where: str) -> str:
    weight, reach = G.RELATIONS[relation]
    return " UNION ALL ".join(
        f"SELECT chunk_id AS a, lead(chunk_id, {i}) OVER (PARTITION BY g ORDER BY chunk_id) AS b, '{relation}' AS relation, {weight} AS weight FROM (SELECT DISTINCT {group} AS g, chunk_id FROM chunk WHERE {where})" for i in range(1, reach + 1)
    )


NEIGHBOURS = f"""
  SELECT least(a, b) AS src, greatest(a, b) AS dst, relation, max(weight)::DOUBLE AS weight FROM ({_neighbour_sql("rule_number", "same_rule", "rule_number <> ''")}
  UNION ALL {_neighbour_sql("document_id || '|' || section_title", "same_section", "section_title <> ''")} UNION ALL {_neighbour_sql("document_id || '|' || chapter", "same_chapter", "chapter <> ''")})
  WHERE b IS NOT NULL GROUP BY ALL"""


def topic_edges(spark, d):
    """Neighbours within each topic (a value of many) of a document; corpus_topic_edges goes across documents."""
    n = _nodes(spark, d).select("chunk_id", "document_id", F.explode(G.tags(F.lower("text"), TOPICS)).alias("topic"))
    return G.canonical_edges(G.neighbour_edges(n.withColumn("g", F.concat_ws("|", "document_id", "topic")), "g", "same_scenario"))


_TOPIC_ROWS = " UNION ALL ".join(f"SELECT document_id || '|{k}' AS g, chunk_id FROM chunk WHERE {' OR '.join(f'contains(lower(text), ' + repr(w) + ')' for w in ws)}" for k, ws in sorted(TOPICS.items()))
TOPIC_EDGES = f"""
  WITH r AS (SELECT DISTINCT g, chunk_id FROM ({_TOPIC_ROWS})), e AS (SELECT chunk_id AS a, lead(chunk_id, 1) OVER w AS b FROM r WINDOW w AS (PARTITION BY g ORDER BY chunk_id)
  UNION ALL SELECT chunk_id AS a, lead(chunk_id, 2) OVER w AS b FROM r WINDOW w AS (PARTITION BY g ORDER BY chunk_id))
  SELECT least(a, b) AS src, greatest(a, b) AS dst, 'same_scenario' AS relation, max(0.70)::DOUBLE AS weight FROM e WHERE b IS NOT NULL GROUP BY ALL"""


def reference_edges(spark, d):
    n = _nodes(spark, d)
    refs = n.select("chunk_id", F.explode(T.rule_references("text")).alias("rule_number"))
    return G.reference_edges(refs, n)


REFERENCES = f"""
  WITH c AS (SELECT DISTINCT chunk_id, rule_number, text FROM chunk), r AS (SELECT DISTINCT chunk_id, unnest({_REFS.format("text")}) AS rule_number FROM c)
  SELECT r.chunk_id AS src, min(c.chunk_id) AS dst, 'rule_reference' AS relation, 0.95::DOUBLE AS weight FROM r JOIN c USING (rule_number) WHERE c.chunk_id <> r.chunk_id GROUP BY r.chunk_id, rule_number"""


def rotating_pairs(spark, d):
    left = read(spark, d, "benchmark_case").select(F.col("case_id").alias("id"))
    right = read(spark, d, "benchmark_case").where("accepted").select(F.col("case_id").alias("id"))
    return G.rotating_pairs(left, right)


ROTATING = """
  WITH a AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT case_id AS id FROM benchmark_case)),
  b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT case_id AS id FROM benchmark_case WHERE accepted)), k AS (SELECT count(*) AS c FROM b),
  t AS (SELECT a.id AS src, CASE WHEN s.id = a.id THEN (a.n + 1) % c ELSE a.n % c END AS n FROM a, k LEFT JOIN b s ON s.n = a.n % c)
  SELECT src, b.id AS dst FROM t JOIN b USING (n) WHERE src <> b.id"""


def connected_pairs(spark, d):
    return G.connected_pairs(neighbour_edges(spark, d).unionByName(reference_edges(spark, d)), _nodes(spark, d))


CONNECTED = f"""
  WITH e AS (SELECT src, dst, relation FROM ({NEIGHBOURS}) UNION ALL SELECT src, dst, relation FROM ({REFERENCES})),
  n AS (SELECT chunk_id, min(rule_number) AS rule FROM chunk WHERE rule_number IS NOT NULL GROUP BY chunk_id)
  SELECT DISTINCT src, dst, relation, a.rule AS src_rule, b.rule AS dst_rule FROM e JOIN n a ON a.chunk_id = src JOIN n b ON b.chunk_id = dst WHERE a.rule <> b.rule"""


def graph_stats(spark, d):
    return neighbour_edges(spark, d).groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


# The words around a name of a rule set: none that make it part of another word.
_NAMED = "(?i)(^|[^\\p{{L}}\\p{{N}}_]){0}($|[^\\p{{L}}\\p{{N}}_])"


def corpus_neighbour_edges(spark, d):
    """Neighbours by rule, section title, rule set and chapter, and keyword over the whole corpus, whatever the document.

    neighbour_edges takes sections and chapters document by document, as its SQL does. Titles are compared in full normalisation; the
    tables hold no rule set, so it is told from path and text as in the reference.
    """
    n = read(spark, d, "chunk").where("chunk_id is not null")
    start = F.substring(F.coalesce("text", F.lit("")), 1, 500)
    n = n.withColumn("in_chapter", F.concat_ws(":", G.ruleset(T.normalized_path(F.coalesce("source_path", F.lit(""))), start, _NAMED), "chapter"))
    edges = G.neighbour_edges(n, "rule_number", "same_rule")
    edges = edges.unionByName(G.neighbour_edges(n.withColumn("section", A.fully_normalized("section_title")), "section", "same_section"))
    edges = edges.unionByName(G.neighbour_edges(n.where("chapter <> ''"), "in_chapter", "same_chapter"))
    words = {w: [w] for ws in TOPICS.values() for w in ws}
    edges = edges.unionByName(G.neighbour_edges(n.select("chunk_id", F.explode(G.tags(F.lower("text"), words)).alias("keyword")), "keyword", "keyword_overlap"))
    return G.canonical_edges(edges)


def _corpus_sql(relation: str, rows: str) -> str:
    """Edges of rows (g, chunk_id)."""
    weight, reach = G.RELATIONS[relation]
    return " UNION ALL ".join(f"SELECT chunk_id AS a, lead(chunk_id, {i}) OVER (PARTITION BY g ORDER BY chunk_id) AS b, '{relation}' AS relation, {weight} AS weight FROM (SELECT DISTINCT g, chunk_id FROM ({rows}) WHERE g <> '' AND chunk_id IS NOT NULL)" for i in range(1, reach + 1))


_EDGES_OF = "SELECT least(a, b) AS src, greatest(a, b) AS dst, relation, max(weight)::DOUBLE AS weight FROM ({}) WHERE b IS NOT NULL GROUP BY ALL"
_PATH = "lower(regexp_replace(replace(coalesce(source_path, ''), '\\', '/'), '/+', '/', 'g'))"
_RULESET = f"""CASE WHEN regexp_matches({_PATH}, '(^|/)gem\\.pdf$|/gem/|(^|/)gem_[^/]*$') THEN 'gem' WHEN regexp_matches({_PATH}, 'main_board[^/]*$|/main_board/') THEN 'main_board'
  WHEN contains({_PATH}, 'guidance') THEN 'guidance' WHEN regexp_matches(left(text, 500), '{_NAMED.format("main board")}') THEN 'main_board' WHEN regexp_matches(left(text, 500), '{_NAMED.format("gem")}') THEN 'gem' ELSE 'unknown' END"""
_KEYWORD_ROWS = " UNION ALL ".join(f"SELECT '{w}' AS g, chunk_id FROM chunk WHERE contains(lower(text), '{w}')" for ws in TOPICS.values() for w in ws)
CORPUS_NEIGHBOURS = _EDGES_OF.format(
    " UNION ALL ".join([
        _corpus_sql("same_rule", "SELECT rule_number AS g, chunk_id FROM chunk"),
        _corpus_sql("same_section", "SELECT trim(regexp_replace(lower(section_title), '\\s+', ' ', 'g')) AS g, chunk_id FROM chunk"),
        _corpus_sql("same_chapter", f"SELECT {_RULESET} || ':' || chapter AS g, chunk_id FROM chunk WHERE chapter <> ''"),
        _corpus_sql("keyword_overlap", _KEYWORD_ROWS),
    ])
)


def corpus_connected_pairs(spark, d):
    return G.connected_pairs(corpus_neighbour_edges(spark, d).unionByName(reference_edges(spark, d)), _nodes(spark, d))


def corpus_graph_stats(spark, d):
    return corpus_neighbour_edges(spark, d).groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


def corpus_topic_edges(spark, d):
    """Neighbours within each topic (a value of many) over all chunks; topic_edges stays within documents, as its SQL does."""
    n = read(spark, d, "chunk").where("chunk_id is not null").select("chunk_id", F.explode(G.tags(F.lower("text"), TOPICS)).alias("topic"))
    return G.canonical_edges(G.neighbour_edges(n, "topic", "same_scenario"))


_SCENARIO_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS g, chunk_id FROM chunk WHERE {' OR '.join(f'contains(lower(text), ' + repr(w) + ')' for w in ws)}" for k, ws in sorted(TOPICS.items()))


QUERIES = {
    "graph_nodes": (graph_nodes, f"SELECT DISTINCT chunk_id, {_tag_sql('lower(text)')} AS topics, CASE WHEN regexp_matches(text, '[一-鿿]') AND NOT regexp_matches(text, '[A-Za-z]') THEN 'zh' WHEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) >= 8 AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' ELSE 'en' END AS language FROM chunk"),
    "neighbour_edges": (neighbour_edges, NEIGHBOURS),
    "corpus_neighbour_edges": (corpus_neighbour_edges, CORPUS_NEIGHBOURS),
    "corpus_connected_pairs": (corpus_connected_pairs, CONNECTED.replace(NEIGHBOURS, CORPUS_NEIGHBOURS)),
    "corpus_graph_stats": (corpus_graph_stats, f"SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources FROM ({CORPUS_NEIGHBOURS}) GROUP BY relation"),
    "topic_edges": (topic_edges, TOPIC_EDGES),
    "corpus_topic_edges": (corpus_topic_edges, _EDGES_OF.format(_corpus_sql("same_scenario", _SCENARIO_ROWS))),
    "reference_edges": (reference_edges, REFERENCES),
    "rotating_pairs": (rotating_pairs, ROTATING),
    "connected_pairs": (connected_pairs, CONNECTED),
    "graph_stats": (graph_stats, f"SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources FROM ({NEIGHBOURS}) GROUP BY relation"),
}
