"""Queries of registries: duplicates, manifests, completeness, upserts and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import governance as G
from quarry.session import read

ORDER = {"pdf": 0, "md": 1, "txt": 2}


def exact_dups(spark, d):
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", T.content_hash("text").alias("digest"))
    return G.duplicate_groups(rows, "digest", "doc_id", ["doc_id"])


_HASH = "sha256(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')))"
DUPS = f"SELECT doc_id, min(doc_id) OVER w AS canonical, count(*) OVER w AS copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY {_HASH})"


def chunk_dups(spark, d):
    """Of chunks of one text the canonical one comes first by path, then by id."""
    rows = read(spark, d, "chunk").where("text <> ''").select("chunk_id", F.coalesce("source_path", F.lit("")).alias("path"), F.sha2("text", 256).alias("digest")).distinct()
    return G.duplicate_groups(rows, "digest", "chunk_id", ["path"])


CHUNK_DUPS = "SELECT chunk_id, first_value(chunk_id) OVER (PARTITION BY digest ORDER BY path, chunk_id) AS canonical, count(*) OVER (PARTITION BY digest) AS copies FROM (SELECT DISTINCT chunk_id, coalesce(source_path, '') AS path, sha256(text) AS digest FROM chunk WHERE text <> '')"


def doc_status(spark, d):
    rows = read(spark, d, "source_document").select("source_path", "source_type")
    folder = F.regexp_extract(T.normalized_path("source_path"), "^(.*)/", 1)
    return G.worst(rows, folder, "source_type", ORDER)


STATUS = "SELECT regexp_extract(lower(source_path), '^(.*)/', 1) AS \"group\", arg_min(source_type, CASE source_type WHEN 'pdf' THEN 0 WHEN 'md' THEN 1 WHEN 'txt' THEN 2 ELSE 1048576 END) AS worst FROM source_document GROUP BY 1"


def count_maps(spark, d):
    """Manifest counts, one row a value."""
    docs = read(spark, d, "source_document").select("document_id", "source_type").distinct()
    return G.count_map(docs, F.col("source_type")).select(F.explode("counts").alias("value", "n"))


def source_registry(spark, d):
    """One record a document: hashes, duplicate of, and the reasons that speak against it."""
    docs = read(spark, d, "source_document").groupBy("document_id").agg(F.first(F.struct("source_path", "title", "cleaned_text")).alias("r")).select("document_id", "r.*")
    docs = docs.withColumn("content_hash", F.sha2(F.coalesce("cleaned_text", F.lit("")), 256))
    dups = G.duplicate_groups(docs.where("cleaned_text <> ''"), "content_hash", "document_id", ["source_path"])
    out = docs.join(dups, "document_id", "left")
    why = G.violations({"duplicate": F.coalesce(F.col("canonical"), F.col("document_id")) == F.col("document_id"), "empty": F.coalesce(F.col("cleaned_text"), F.lit("")) != "", "untitled": F.coalesce(F.col("title"), F.lit("")) != ""})
    return out.select("document_id", T.normalized_path("source_path").alias("path"), "content_hash", F.coalesce("canonical", "document_id").alias("canonical"), F.array_join(why, ",").alias("reasons"))


REGISTRY = """
  WITH d AS (SELECT document_id, any_value(source_path) AS p, any_value(title) AS t, coalesce(any_value(cleaned_text), '') AS x FROM source_document GROUP BY document_id),
  c AS (SELECT *, sha256(x) AS h, CASE WHEN x <> '' THEN first_value(document_id) OVER (PARTITION BY sha256(x) ORDER BY p, document_id) ELSE document_id END AS canonical FROM d)
  SELECT document_id, lower(p) AS path, h AS content_hash, canonical, array_to_string(list_filter([CASE WHEN canonical <> document_id THEN 'duplicate' END, CASE WHEN x = '' THEN 'empty' END, CASE WHEN coalesce(t, '') = '' THEN 'untitled' END], lambda r: r IS NOT NULL), ',') AS reasons FROM c"""


def completeness(spark, d):
    return G.completeness(read(spark, d, "source_document").select("document_id"), read(spark, d, "language_label").select("document_id"), "document_id")


COMPLETE = """
  WITH e AS (SELECT DISTINCT document_id FROM source_document), a AS (SELECT document_id, count(*) AS n FROM language_label GROUP BY 1)
  SELECT document_id, 'missing' AS problem FROM e ANTI JOIN a USING (document_id) UNION ALL SELECT document_id, 'unexpected' FROM a ANTI JOIN e USING (document_id) UNION ALL SELECT document_id, 'repeated' FROM a WHERE n > 1"""


def upsert_layers(spark, d):
    """A later layer overrides an earlier one, case by case."""
    c = read(spark, d, "benchmark_case").select("case_id", F.coalesce("difficulty", F.lit("")).alias("difficulty"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
    return G.layered([c, c.where("accepted").withColumn("difficulty", F.upper("difficulty"))], "case_id")


UPSERT = """
  WITH c AS (SELECT case_id, coalesce(difficulty, '') AS difficulty, coalesce(accepted, false) AS accepted FROM benchmark_case), l AS (SELECT *, 0 AS layer FROM c UNION ALL SELECT case_id, upper(difficulty), accepted, 1 FROM c WHERE accepted)
  SELECT case_id, difficulty, accepted FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY layer DESC, difficulty DESC, accepted DESC) AS n FROM l) WHERE n = 1"""


def quota_check(spark, d):
    held = read(spark, d, "benchmark_case").where("accepted and primary_category is not null and language is not null and difficulty is not null").dropDuplicates(["case_id"])
    return G.quota_check(read(spark, d, "default_benchmark_quota"), held, ["primary_category", "language", "difficulty"])


QUOTA = """
  WITH h AS (SELECT primary_category, language, difficulty, count(*) AS have FROM (SELECT case_id, any_value(primary_category) AS primary_category, any_value(language) AS language, any_value(difficulty) AS difficulty FROM benchmark_case
    WHERE accepted AND primary_category IS NOT NULL AND language IS NOT NULL AND difficulty IS NOT NULL GROUP BY case_id) GROUP BY ALL)
  SELECT primary_category, language, difficulty, coalesce(count, 0)::BIGINT AS wanted, coalesce(have, 0)::BIGINT AS have, (coalesce(have, 0) - coalesce(count, 0))::BIGINT AS difference
  FROM default_benchmark_quota FULL JOIN h USING (primary_category, language, difficulty) WHERE coalesce(have, 0) <> coalesce(count, 0)"""


def cache_stats(spark, d):
    """Cache keys of vectors, hits among documents and what is missing."""
    key = lambda c: F.sha2(F.concat_ws("|", F.lit("model"), F.col(c).cast("string")), 256).alias("cache_key")
    rows = read(spark, d, "documents").select("doc_id", key("doc_id"))
    cache = read(spark, d, "embeddings").select(key("vec_id"), "label").dropDuplicates(["cache_key"])
    hits, misses = G.cache_split(rows, cache)
    return hits.groupBy(F.lit("hit").alias("kind")).agg(F.count("*").alias("n")).unionByName(misses.groupBy(F.lit("miss").alias("kind")).agg(F.count("*").alias("n")))


def greedy_acceptance(spark, d):
    """Documents accepted in order unless their text equals an accepted one's: the sequential loop as rounds of joins."""
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", T.content_hash("text").alias("digest"))
    heads = G.duplicate_groups(rows, "digest", "doc_id", ["doc_id"]).where("canonical <> doc_id").select(F.col("canonical").alias("a"), F.col("doc_id").alias("b"))
    return G.first_without_near_duplicate(rows, heads, "doc_id")


def layer_digest(spark, d):
    """A tree digest of the corpus: each part's digest of its sorted members' hashes, and the digest of those."""
    docs = read(spark, d, "source_document").select("document_id", F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("h")).distinct()
    parts = docs.groupBy(F.substring("h", 1, 2).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "document_id", "h"))), "\n"), 256).alias("digest"))
    return parts


QUERIES = {
    "exact_dups": (exact_dups, DUPS),
    "chunk_dups": (chunk_dups, CHUNK_DUPS),
    "doc_status": (doc_status, STATUS),
    "count_maps": (count_maps, "SELECT source_type AS value, count(*) AS n FROM (SELECT DISTINCT document_id, source_type FROM source_document) WHERE source_type IS NOT NULL GROUP BY 1"),
    "source_registry": (source_registry, REGISTRY),
    "completeness_anti": (completeness, COMPLETE),
    "upsert_layers": (upsert_layers, UPSERT),
    "quota_check": (quota_check, QUOTA),
    "cache_stats": (cache_stats, "SELECT CASE WHEN vec_id IS NULL THEN 'miss' ELSE 'hit' END AS kind, count(*) AS n FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id GROUP BY 1"),
    "greedy_acceptance": (greedy_acceptance, f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY {_HASH}"),
    "layer_digest": (layer_digest, "SELECT substr(h, 1, 2) AS part, sha256(string_agg(document_id || ':' || h, chr(10) ORDER BY document_id || ':' || h)) AS digest FROM (SELECT DISTINCT document_id, sha256(coalesce(raw_text, '')) AS h FROM source_document) GROUP BY 1"),
}
