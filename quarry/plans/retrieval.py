"""Queries of lexical and vector retrieval, fusion and evidence over the test tables."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import retrieval as R
from quarry.session import ensure_checkpoint_dir, materialise, read, stored, stored_alone
from quarry.sources.files import read_index, write_index

#: Searches take the stated set of requests and vectors whose number is divisible by 100.
ASKED_SQL = "SELECT DISTINCT request_id AS query_id, query AS text FROM query_request WHERE query <> '' AND CAST(substr(request_id, 3) AS BIGINT) % 100 = 0"
#: The whole_ queries take every request that has a number and a text.
EVERY_SQL = "SELECT DISTINCT request_id AS query_id, query AS text FROM query_request WHERE query <> '' AND request_id IS NOT NULL"
CHUNK_SQL = "SELECT chunk_id, any_value(text) AS text FROM chunk GROUP BY chunk_id"
BIGRAMS = "flatten(list_transform(regexp_extract_all({0}, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"
TOKENS = "list_concat(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), " + BIGRAMS + ")"
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
_PAIRS = "list_filter(list_transform(range(1, length(regexp_replace({0}, '[^一-鿿]', '', 'g'))), lambda i: substr(regexp_replace({0}, '[^一-鿿]', '', 'g'), i, 2)), lambda p: NOT regexp_matches(p, '[" + T.STOP_CHARS + "]'))"
MIXED = f"list_distinct(list_concat({_WORDS}, {_PAIRS}))"


def asked(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    q = read(spark, d, "query_request").where("query <> '' and " + ("request_id is not null" if whole else "cast(substr(request_id, 3) as bigint) % 100 = 0"))
    return q.select(F.col("request_id").alias("query_id"), F.col("query").alias("text")).distinct()


def whole_sql(sql: str) -> str:
    """A search's SQL over every request."""
    return sql.replace(ASKED_SQL, EVERY_SQL)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunk").select("chunk_id", "text")


def bm25_sql(queries: str, k: int = 20) -> str:
    return f"""
      WITH q AS ({queries}), d AS (SELECT chunk_id, coalesce({TOKENS.format("text")}, []) AS tokens FROM ({CHUNK_SQL})),
      c AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
      p AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS length, unnest(tokens) AS term FROM d) GROUP BY ALL),
      w AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS term FROM q) GROUP BY ALL),
      f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
      s AS (SELECT query_id, chunk_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score
            FROM w JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL)
      SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


def overlap_sql(k: int = 20) -> str:
    return f"""
      WITH q AS (SELECT query_id, {MIXED.format("text")} AS want FROM ({ASKED_SQL})), d AS (SELECT chunk_id, {MIXED.format("text")} AS have FROM ({CHUNK_SQL})),
      x AS (SELECT query_id, chunk_id, len(list_intersect(want, have)) AS c, len(want) AS a, len(have) AS b FROM q, d),
      s AS (SELECT query_id, chunk_id, round(c / (a + b - c), 6) AS score FROM x WHERE c > 0)
      SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}"""


def term_stats(spark, d):
    return R.lexical_index(chunks(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


TERM_STATS = f"""
  WITH d AS (SELECT chunk_id, coalesce({TOKENS.format("text")}, []) AS tokens FROM ({CHUNK_SQL})), n AS (SELECT count(*) AS n FROM d)
  SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(tokens) AS term FROM d) GROUP BY term), n"""


def corpus_stats(spark, d):
    return R.lexical_index(chunks(spark, d)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


CORPUS_STATS = f"SELECT count(*) AS n, round(avg(len(coalesce({TOKENS.format('text')}, []))), 6) AS avgdl FROM ({CHUNK_SQL})"


def bm25_topk(spark, d):
    return R.bm25(asked(spark, d), chunks(spark, d))


def bm25_stored(spark, d):
    """The same search over an index that was written and read back: only postings of the asked terms are read."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    write_index(R.lexical_index(chunks(spark, d)), folder)
    return R.bm25(asked(spark, d), read_index(spark, folder))


def knn_all(spark, d):
    """The five nearest of every vector, by lists of centroids."""
    v = _vectors(spark, d)[1]
    return R.approximate_neighbours(v, k=5)


def overlap_topk(spark, d):
    return R.overlap(asked(spark, d), chunks(spark, d))


def _lists(spark, d, whole: bool = False) -> DataFrame:
    """Both lists, stored one after the other: at most twenty rows each of an asked query. What the first search keeps of the texts is
    removed before the second begins; which ids come again is found once for both."""

    def both():
        again = R.repeated(chunks(spark, d))
        a = stored_alone(lambda: R.bm25(asked(spark, d, whole), chunks(spark, d), again=again)).withColumn("signal", F.lit("bm25"))
        return a.unionByName(stored_alone(lambda: R.overlap(asked(spark, d, whole), chunks(spark, d), again=again)).withColumn("signal", F.lit("overlap")))

    return stored_alone(both)


LISTS = f"SELECT 'bm25' AS signal, * FROM ({bm25_sql(ASKED_SQL)}) UNION ALL SELECT 'overlap' AS signal, * FROM ({overlap_sql()})"


def rrf_fuse(spark, d):
    return R.reciprocal_rank_fusion(_lists(spark, d))


FUSED = f"""
  SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(sum(1.0 / (20 + rank)), 9) AS score FROM ({LISTS}) GROUP BY ALL)) WHERE rank <= 10"""


def minmax_scores(spark, d):
    return R.min_max(_lists(spark, d)).select("query_id", "signal", "chunk_id", F.round("normalized", 6).alias("normalized"))


MINMAX = f"""
  SELECT query_id, signal, chunk_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS normalized
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ({LISTS}) WINDOW w AS (PARTITION BY query_id, signal))"""


def full_outer_scores(spark, d, lists: DataFrame | None = None):
    """Both signals side by side, absent ones 0: the grouped form of a full outer join."""
    both = R.min_max(_lists(spark, d) if lists is None else lists).groupBy("query_id", "chunk_id")
    one = lambda s: F.round(F.coalesce(F.max(F.when(F.col("signal") == s, F.col("normalized"))), F.lit(0.0)), 6)
    return both.agg(one("bm25").alias("bm25_score"), one("overlap").alias("overlap_score"))


FULL_OUTER = f"""
  WITH m AS ({MINMAX}) SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a.normalized, 0.0) AS bm25_score,
  coalesce(b.normalized, 0.0) AS overlap_score FROM (SELECT * FROM m WHERE signal = 'bm25') a FULL JOIN (SELECT * FROM m WHERE signal = 'overlap') b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id"""


def _parts(spark, d, whole: bool = False) -> DataFrame:
    q = asked(spark, d, whole).select("query_id", F.posexplode(T.sub_queries("text")).alias("part", "text"), F.size(T.sub_queries("text")).alias("parts"))
    return q.select(F.concat_ws("|", "query_id", "part").alias("query_id"), "text", F.col("query_id").alias("whole"), "parts")


def multi_query_merge(spark, d, whole=False):
    parts = _parts(spark, d, whole)
    found = R.bm25(parts.select("query_id", "text"), chunks(spark, d)).join(parts.select("query_id", "whole", "parts"), "query_id")
    return R.best_of_sub_queries(found.select(F.col("whole").alias("query_id"), "parts", "chunk_id", "score", "rank"))


_PARTS_SQL = f"""SELECT query_id || '|' || part AS query_id, text, query_id AS whole, parts FROM (
  SELECT query_id, len(l) AS parts, unnest(range(0, len(l))) AS part, unnest(l) AS text FROM (
  SELECT query_id, list_filter(list_transform(regexp_split_to_array(text, '(?i)\\s+(?:and|or)\\s+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({ASKED_SQL})))"""
MERGE = f"""
  WITH p AS ({_PARTS_SQL}), b AS ({bm25_sql("SELECT query_id, text FROM p")}), m AS (SELECT p.whole AS query_id, b.chunk_id, max(b.score) AS score FROM b JOIN p USING (query_id)
  WHERE b.rank <= greatest(3, floor(10 / p.parts)) + 2 GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 10"""


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    v = read(spark, d, "embeddings").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


def dense_topk(spark, d):
    return R.dense(*_vectors(spark, d))


_COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
DENSE = f"""
  WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20"""


def knn_edges(spark, d):
    from quarry.operators import graph as G

    q, v = _vectors(spark, d)
    near = R.dense(q, v, k=5, least=0.2, drop_self=True)
    return G.canonical_edges(G.semantic_edges(near, threshold=0.2)).select("src", "dst", "relation", F.round("weight", 6).alias("weight"))


KNN = f"""
  WITH s AS (SELECT q.vec_id AS a, v.vec_id AS b, {_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
  t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s WHERE score >= 0.2)
  SELECT least(a, b) AS src, greatest(a, b) AS dst, 'semantic_similarity' AS relation, round(max(least(0.85, greatest(0.60, score))), 6) AS weight FROM t WHERE rank <= 5 GROUP BY 1, 2"""


def unit_vectors(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", R.normalized("embedding").alias("u"))
    return v.select("vec_id", F.size("u").alias("dimension"), F.round(R.dot(F.col("u"), F.col("u")), 5).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


UNIT = """
  WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
  SELECT vec_id, len(e) AS dimension, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 5) AS norm, round(list_sum(list_transform(e, lambda x: x / n)), 5) AS total FROM v"""


def dimension_check(spark, d):
    return read(spark, d, "embeddings").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("vectors"), F.count_if(F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).alias("broken"))


DIMENSION = "SELECT len(embedding) AS dimension, count(*) AS vectors, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS broken FROM embeddings GROUP BY 1"


def _with_chunks(spark, d, found: DataFrame, whole: bool = False) -> DataFrame:
    """found, which is stored, with its chunks' fields; ids without a chunk are dropped. Only chunks that were found leave the table. What
    every request finds grows with the table and isn't broadcast."""
    ids = found.select("chunk_id").distinct()  # at most ten of each asked query
    own = read(spark, d, "chunk").join(ids if whole else F.broadcast(ids), "chunk_id", "left_semi")
    own = own.groupBy("chunk_id").agg(F.min(F.struct("rule_number", "section_title", "text", "source_path")).alias("c"))
    return found.join(own, "chunk_id").select(*found.columns, "c.*")


def _results(spark, d, lists: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Fused results with their chunks' fields, stored once; those of every request are to be read once and aren't stored."""
    found = stored(R.reciprocal_rank_fusion(_lists(spark, d, whole) if lists is None else lists).select("query_id", "chunk_id", "score", "rank"))
    return _with_chunks(spark, d, found, whole) if whole else stored(_with_chunks(spark, d, found))


def _evidence(spark, d, whole: bool = False) -> DataFrame:
    """Selected evidence with its chunks' fields; of every request with their rules alone, which the selection goes by."""
    if not whole:
        return R.evidence(_results(spark, d))
    rules = read(spark, d, "chunk").groupBy("chunk_id").agg(F.min(F.struct("rule_number")).alias("c"))
    return R.evidence(R.reciprocal_rank_fusion(_lists(spark, d, whole)).join(rules, "chunk_id").select("query_id", "chunk_id", "score", "c.*"))


_OWN = "SELECT chunk_id, any_value(rule_number) AS rule_number, any_value(section_title) AS section_title, any_value(text) AS text, any_value(source_path) AS source_path FROM chunk GROUP BY chunk_id"
RESULTS = f"SELECT f.query_id, f.chunk_id, f.score, f.rank, c.rule_number, c.section_title, c.text, c.source_path FROM ({FUSED}) f JOIN ({_OWN}) c USING (chunk_id)"


def hybrid_search(spark, d, whole=False):
    """The flagship: both signals fused, best ten of each request, with their chunks and snippets."""
    return _results(spark, d, whole=whole).select("query_id", "chunk_id", "score", "rank", "rule_number", "section_title", "source_path", T.snippet("text").alias("snippet"))


def _snippet_sql(t: str) -> str:
    h = f"substr({t}, 1, 200)"
    at = f"(200 - strpos(reverse({h}), ' '))"
    return f"CASE WHEN length({t}) <= 200 THEN {t} WHEN strpos({h}, ' ') > 0 AND {at} > 160 THEN substr({t}, 1, {at}) || '...' ELSE {h} || '...' END"


HYBRID = f"SELECT query_id, chunk_id, score, rank, rule_number, section_title, source_path, {_snippet_sql('text')} AS snippet FROM ({RESULTS})"


def evidence_select(spark, d, whole=False):
    return _evidence(spark, d, whole).select("query_id", "chunk_id", "place", "score")


EVIDENCE = f"""
  SELECT query_id, chunk_id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN coalesce(rule_number, '') <> '' THEN 0 ELSE 1 END, score DESC, chunk_id) AS place
  FROM ({RESULTS})) WHERE place <= 5"""


def evidence_diversity(spark, d):
    out = R.diversity(R.evidence(_results(spark, d)))
    return out.select("query_id", "n", "diversity", F.array_join("rules", ",").alias("rules"))


DIVERSITY = f"""
  WITH e AS (SELECT e.*, c.rule_number AS r, c.section_title AS s FROM ({EVIDENCE}) e JOIN ({_OWN}) c USING (chunk_id)),
  f AS (SELECT query_id, r, min(place) AS p FROM e WHERE r <> '' GROUP BY ALL)
  SELECT query_id, count(*) AS n, round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE (count(DISTINCT nullif(r, '')) / count(*) + count(DISTINCT nullif(s, '')) / count(*)) / 2 END, 6) AS diversity,
  coalesce((SELECT string_agg(r, ',' ORDER BY p) FROM f WHERE f.query_id = e.query_id), '') AS rules FROM e GROUP BY query_id"""


def _tasks(spark, d) -> DataFrame:
    return asked(spark, d).select("query_id", F.explode(T.sub_queries("text")).alias("task"))


def task_coverage(spark, d):
    return R.coverage(_tasks(spark, d), _results(spark, d).select("query_id", "text"))


COVERAGE = f"""
  WITH t AS (SELECT DISTINCT whole AS query_id, text AS task FROM ({_PARTS_SQL})),
  x AS (SELECT t.query_id, t.task, coalesce(bool_or(len(list_intersect({MIXED.format("t.task")}, {MIXED.format("r.text")})) >= 0.3 * len({MIXED.format("t.task")}) AND len({MIXED.format("t.task")}) > 0), false) AS ok
        FROM t LEFT JOIN ({RESULTS}) r USING (query_id) GROUP BY ALL)
  SELECT query_id, count(*) AS tasks, count(*) FILTER (ok) AS covered, round(avg(ok::INT), 6) AS score FROM x GROUP BY query_id"""


def second_round(spark, d):
    """Gaps of the first round asked again: results of uncovered sub-tasks that the first round hadn't found (a bounded loop, unrolled)."""
    first = materialise(_results(spark, d).select("query_id", "chunk_id", "text"))
    tasks = _tasks(spark, d)
    met = tasks.join(first, "query_id", "left").withColumn("ok", F.size(F.array_intersect(T.mixed_tokens("task"), T.mixed_tokens("text"))) >= 0.3 * F.size(T.mixed_tokens("task")))
    gaps = met.groupBy("query_id", "task").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok")).where("not ok")
    ask = gaps.select(F.concat_ws("|", "query_id", "task").alias("query_id"), F.col("task").alias("text"), F.col("query_id").alias("whole"))
    found = R.bm25(ask.select("query_id", "text"), chunks(spark, d), k=10).join(ask.select("query_id", "whole"), "query_id")
    best = found.groupBy(F.col("whole").alias("query_id"), "chunk_id").agg(F.max("score").alias("score"))
    return R.ranked(best.join(first, ["query_id", "chunk_id"], "left_anti"), 10)


SECOND = f"""
  WITH t AS (SELECT DISTINCT whole AS query_id, text AS task FROM ({_PARTS_SQL})), r AS MATERIALIZED (SELECT query_id, chunk_id, text FROM ({RESULTS})),
  g AS (SELECT t.query_id, t.task FROM t LEFT JOIN r USING (query_id) GROUP BY ALL HAVING NOT coalesce(bool_or(len(list_intersect({MIXED.format("t.task")}, {MIXED.format("r.text")})) >= 0.3 * len({MIXED.format("t.task")})), false)),
  a AS (SELECT query_id || '|' || task AS query_id, task AS text, query_id AS whole FROM g), b AS ({bm25_sql("SELECT query_id, text FROM a", 10)}),
  m AS (SELECT a.whole AS query_id, b.chunk_id, max(b.score) AS score FROM b JOIN a USING (query_id) GROUP BY ALL)
  SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, m.chunk_id) AS rank FROM m ANTI JOIN r ON r.query_id = m.query_id AND r.chunk_id = m.chunk_id) WHERE rank <= 10"""


def rule_lookup(spark, d):
    """Chunks of the rules that requests refer to, in order; null rule numbers never match."""
    q = read(spark, d, "query_request").select(F.col("request_id").alias("query_id"), F.col("query").alias("text")).distinct()
    refs = q.select("query_id", F.explode(T.rule_references("text")).alias("rule_number"))
    own = read(spark, d, "chunk").select("chunk_id", "rule_number", "chunk_order").distinct()
    return refs.join(own, "rule_number").select("query_id", "rule_number", "chunk_order", "chunk_id")


_REFS = "list_sort(list_distinct(list_concat(regexp_extract_all({0}, '[Rr]ules? ([0-9]{{1,2}}[A-Z]?\\.[0-9]+)', 1), regexp_extract_all({0}, '第([0-9]{{1,2}}[A-Z]?\\.[0-9]+)(?:\\([0-9]+\\))?條', 1))))"
LOOKUP = f"""
  WITH r AS (SELECT query_id, unnest({_REFS.format("text")}) AS rule_number FROM (SELECT DISTINCT request_id AS query_id, query AS text FROM query_request))
  SELECT DISTINCT r.query_id, rule_number, c.chunk_order, c.chunk_id FROM r JOIN chunk c USING (rule_number)"""


def chunk_by_id(spark, d):
    """Cases' source chunks; ids without a chunk are reported as missing."""
    ids = read(spark, d, "benchmark_case").select("case_id", F.explode("source_chunk_ids").alias("chunk_id")).distinct()
    own = read(spark, d, "chunk").select("chunk_id", "document_id").distinct()
    return ids.join(own, "chunk_id", "left").select("case_id", "chunk_id", "document_id", F.col("document_id").isNull().alias("missing"))


BY_ID = """
  WITH i AS (SELECT DISTINCT case_id, unnest(source_chunk_ids) AS chunk_id FROM benchmark_case), c AS (SELECT DISTINCT chunk_id, document_id FROM chunk)
  SELECT case_id, chunk_id, document_id, document_id IS NULL AS missing FROM i LEFT JOIN c USING (chunk_id)"""

QUERIES = {
    "term_stats": (term_stats, TERM_STATS),
    "corpus_stats": (corpus_stats, CORPUS_STATS),
    "bm25_topk": (bm25_topk, bm25_sql(ASKED_SQL)),
    "bm25_stored": (bm25_stored, bm25_sql(ASKED_SQL)),
    "knn_all": (knn_all, None),
    "overlap_topk": (overlap_topk, overlap_sql()),
    "rrf_fuse": (rrf_fuse, FUSED),
    "minmax_scores": (minmax_scores, MINMAX),
    "full_outer_scores": (full_outer_scores, FULL_OUTER),
    "multi_query_merge": (multi_query_merge, MERGE),
    "whole_multi_query_merge": (partial(multi_query_merge, whole=True), whole_sql(MERGE)),
    "dense_topk": (dense_topk, DENSE),
    "knn_edges": (knn_edges, KNN),
    "unit_vectors": (unit_vectors, UNIT),
    "dimension_check": (dimension_check, DIMENSION),
    "hybrid_search": (hybrid_search, HYBRID),
    "whole_hybrid_search": (partial(hybrid_search, whole=True), whole_sql(HYBRID)),
    "evidence_select": (evidence_select, EVIDENCE),
    "whole_evidence_select": (partial(evidence_select, whole=True), whole_sql(EVIDENCE)),
    "evidence_diversity": (evidence_diversity, DIVERSITY),
    "task_coverage": (task_coverage, COVERAGE),
    "second_round": (second_round, SECOND),
    "rule_lookup": (rule_lookup, LOOKUP),
    "chunk_by_id": (chunk_by_id, BY_ID),
}
