"""Queries of text functions and of the way from documents to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import corpus as C
from quarry.plans.retrieval import _REFS, MIXED, TOKENS, _snippet_sql
from quarry.session import read


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.cleaned("text").alias("text"))


def _cleaned_sql(t: str) -> str:
    out = f"regexp_replace(coalesce({t}, ''), '\\r\\n?', chr(10), 'g')"
    for pattern, to in (("[ \\t]{2,}", "' '"), ("\\n[ \\t]+", "chr(10)"), ("[ \\t]+\\n", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^[ \\t\\n]+", "''"), ("[ \\t\\n]+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return out


def bm25_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.bm25_tokens("text"), " ").alias("tokens"))


def mixed_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(T.mixed_tokens("text")), " ").alias("tokens"))


def duplicate_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(T.duplicate_tokens("text")), " ").alias("tokens"))


def snippets(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet("text").alias("snippet"))


def language_infer(spark, d):
    return _docs(spark, d).select("doc_id", T.inferred_language("text").alias("language"))


def path_normalize(spark, d):
    return read(spark, d, "source_document").select("document_id", "source_path").distinct().select("document_id", T.normalized_path("source_path").alias("path"), T.slug("source_path").alias("slug"))


def content_hashes(spark, d):
    return _docs(spark, d).select("doc_id", T.content_hash("text").alias("content_hash"))


def anchors(spark, d):
    return _docs(spark, d).select("doc_id", T.anchor("text").alias("anchor"))


def number_extract(spark, d):
    q = read(spark, d, "query_request").select("request_id", "query").distinct()
    return q.select("request_id", F.array_join(F.transform(T.numbers("query"), lambda x: x.cast("decimal(38,4)").cast("string")), " ").alias("numbers"), F.array_join(F.transform(T.percentages("query"), lambda x: x.cast("decimal(20,4)").cast("string")), " ").alias("percentages"))


def rule_references(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.rule_references("text"), " ").alias("rules"))


def stream_pieces(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.pieces("text")).alias("seq", "piece"))


def sub_queries(spark, d):
    q = read(spark, d, "query_request").select("request_id", "query").distinct()
    return q.select("request_id", F.posexplode(T.sub_queries("query")).alias("part", "text"))


def answer_points(spark, d):
    """All held-out items as answers to the stated set of those whose number is divisible by 100."""
    items = read(spark, d, "heldout_item").select("item_id", "text")
    points = items.where("item_id % 100 = 0").select(F.col("item_id").alias("point_id"), F.col("text").alias("point"))
    return A.contained_points(items, points)


def chunk_windows(spark, d):
    return C.windows(_docs(spark, d))


def _source(spark, d):
    return read(spark, d, "source_document").select("document_id", F.col("cleaned_text").alias("text"))


def structure_blocks(spark, d):
    return C.structure_blocks(_source(spark, d)).select("document_id", "kind", "number", "title", "start", "stop", "chapter", F.md5("text").alias("digest"))


_LINE = "SELECT document_id, unnest(range(0, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line, length(text) AS size FROM d"
# Written apart from the operator: the heading words first, then the number, and the title from what follows on the line.
_HEADS = """
  SELECT *, 'chapter' AS kind, regexp_extract(line, '^C[Hh][Aa][Pp][Tt][Ee][Rr][ \\t]+([0-9]+[A-Za-z]?)', 1) AS number, regexp_replace(line, '^[A-Za-z]+[ \\t]+[0-9]+[A-Za-z]?[ \\t]*[:-]?[ \\t]*', '') AS own FROM p WHERE regexp_matches(line, '^(Chapter|CHAPTER)[ \\t]+[0-9]{1,3}([A-Za-z]|[^0-9A-Za-z]|[A-Za-z].*|$)')
  UNION ALL SELECT *, 'section' AS kind, regexp_extract(line, '^[A-Za-z]+[ \\t]+([0-9]{1,3}[A-Za-z]?(\\.[0-9]{1,3})?)', 1) AS number, regexp_replace(line, '^[A-Za-z]+[ \\t]+[0-9]{1,3}[A-Za-z]?(\\.[0-9]{1,3})?[ \\t]*[:-]?[ \\t]*', '') AS own FROM p WHERE regexp_matches(line, '^(Section|SECTION)[ \\t]+[0-9]')
  UNION ALL SELECT *, 'rule' AS kind, regexp_extract(line, '^([0-9]{1,3}[A-Za-z]?(\\.[0-9]{1,3}){0,2})', 1) AS number, regexp_replace(line, '^[0-9]{1,3}[A-Za-z]?(\\.[0-9]{1,3}){0,2}[ \\t]*[:-]?[ \\t]*', '') AS own FROM p WHERE regexp_matches(line, '^[0-9]')"""
BLOCKS = f"""
  WITH d AS (SELECT document_id, coalesce(any_value(cleaned_text), '') AS text FROM source_document GROUP BY document_id), l AS ({_LINE}),
  p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
  y AS (SELECT p.*, last_value(CASE WHEN trim(line, ' ') <> '' THEN trim(line, ' ') END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next FROM p),
  h AS (SELECT document_id, n, start, size, kind, trim(number, ' ') AS number, coalesce(nullif(trim(own, ' '), ''), next, '') AS title FROM ({_HEADS.replace('FROM p ', 'FROM y ')})),
  s AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY document_id, kind ORDER BY start), size) AS stop,
        CASE WHEN kind = 'chapter' THEN 'Chapter ' || number || CASE WHEN title <> '' THEN ': ' || title ELSE '' END END AS label FROM h),
  c AS (SELECT *, coalesce(label, last_value(label IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS chapter FROM s)
  SELECT d.document_id, coalesce(kind, 'document') AS kind, number, nullif(title, '') AS title, coalesce(start, 0)::INT AS start, coalesce(stop, length(text))::INT AS stop, chapter,
  md5(substr(text, coalesce(start, 0)::INT + 1, (coalesce(stop, length(text)) - coalesce(start, 0))::INT)) AS digest FROM d LEFT JOIN c USING (document_id)"""


def chunk_documents(spark, d):
    return C.chunks(C.structure_blocks(_source(spark, d)))


def line_dedupe(spark, d):
    return C.kept_lines(read(spark, d, "source_document").dropDuplicates(["document_id"]), "document_id", "cleaned_text")


# A recursion over each document's lines, with the lines kept so far.
LINES = """
  WITH RECURSIVE d AS (SELECT document_id, list_filter(list_transform(string_split(coalesce(any_value(cleaned_text), ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM source_document GROUP BY document_id),
  r AS (SELECT document_id, l, 1 AS i, []::VARCHAR[] AS kept, []::VARCHAR[] AS met FROM d
    UNION ALL SELECT document_id, l, i + 1,
      CASE WHEN kept[-1] IS NOT DISTINCT FROM l[i] OR (length(l[i]) >= 120 AND list_contains(list_transform(list_filter(kept, lambda x: length(x) >= 120), lambda x: lower(x)), lower(l[i]))) OR (length(l[i]) < 120 AND len(list_filter(met, lambda x: x = l[i])) >= 3) THEN kept ELSE list_append(kept, l[i]) END,
      CASE WHEN kept[-1] IS NOT DISTINCT FROM l[i] THEN met ELSE list_append(met, l[i]) END FROM r WHERE i <= len(l))
  SELECT document_id, array_to_string(kept, chr(10)) AS text FROM r WHERE i = len(l) + 1"""


_NUM = "-?[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_show = "list_transform(list_sort(list_distinct({0})), lambda x: CAST(CAST(x AS {1}) AS VARCHAR))"
DOCS = "SELECT doc_id, {0} FROM documents"
QUERIES = {
    "clean_text": (clean_text, DOCS.format(_cleaned_sql("text") + " AS text")),
    "bm25_tokens": (bm25_tokens, DOCS.format(f"CASE WHEN text IS NOT NULL THEN array_to_string({TOKENS.format('text')}, ' ') END AS tokens")),
    "mixed_tokens": (mixed_tokens, DOCS.format(f"CASE WHEN text IS NOT NULL THEN array_to_string(list_sort({MIXED.format('text')}), ' ') END AS tokens")),
    "duplicate_tokens": (duplicate_tokens, DOCS.format("array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]'))), ' ') AS tokens")),
    "snippets": (snippets, DOCS.format(_snippet_sql("text") + " AS snippet")),
    "language_infer": (language_infer, DOCS.format("CASE WHEN regexp_matches(text, '[一-鿿]') AND NOT regexp_matches(text, '[A-Za-z]') THEN 'zh' WHEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) >= 8 AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' ELSE 'en' END AS language")),
    "path_normalize": (path_normalize, "SELECT DISTINCT document_id, lower(regexp_replace(replace(source_path, '\\', '/'), '/+', '/', 'g')) AS path, regexp_replace(regexp_replace(lower(source_path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM source_document"),
    "content_hashes": (content_hashes, DOCS.format("sha256(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))) AS content_hash")),
    "anchors": (anchors, DOCS.format("array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]{4,}'), 1, 12), ' ') AS anchor")),
    "number_extract": (number_extract, f"""SELECT request_id, array_to_string({_show.format(f"list_transform(regexp_extract_all(query, '{_NUM}'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))", 'DECIMAL(38,4)')}, ' ') AS numbers,
      array_to_string({_show.format("list_transform(list_concat(regexp_extract_all(query, '([0-9]+(?:[.][0-9]+)?) ?(?:%|percent)', 1), regexp_extract_all(query, '百分之([0-9]+(?:[.][0-9]+)?)', 1)), lambda x: CAST(x AS DOUBLE))", 'DECIMAL(20,4)')}, ' ') AS percentages
      FROM (SELECT DISTINCT request_id, query FROM query_request)"""),
    "rule_references": (rule_references, DOCS.format(f"CASE WHEN text IS NOT NULL THEN array_to_string({_REFS.format('text')}, ' ') END AS rules")),
    "stream_pieces": (stream_pieces, "SELECT doc_id, seq::INT AS seq, substr(text, (seq * 100 + 1)::INT, 100) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 100 + 1)) AS seq FROM documents WHERE length(text) > 0)"),
    "sub_queries": (sub_queries, "SELECT request_id, unnest(range(0, len(l)))::INT AS part, unnest(l) AS text FROM (SELECT request_id, list_filter(list_transform(regexp_split_to_array(query, '(?i)\\s+(?:and|or)\\s+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM (SELECT DISTINCT request_id, query FROM query_request))"),
    "answer_points": (answer_points, """WITH i AS (SELECT item_id, text FROM heldout_item), p AS (SELECT item_id AS point_id, list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: length(w) > 3), lambda w: lower(w)) AS w FROM i WHERE item_id % 100 = 0)
      SELECT item_id, point_id FROM i, p WHERE len(w) > 0 AND len(list_filter(w, lambda x: contains(lower(text), x))) >= 0.5 * len(w)"""),
    "chunk_windows": (chunk_windows, """SELECT doc_id, chunk_order::INT AS chunk_order, (chunk_order * 1400)::INT AS char_start, least(chunk_order * 1400 + 1500, length(text))::INT AS char_end,
      regexp_replace(substr(text, (chunk_order * 1400 + 1)::INT, 1500), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1400 + 1)) AS chunk_order FROM documents WHERE length(text) > 0)"""),
    "structure_blocks": (structure_blocks, BLOCKS),
    "chunk_documents": (chunk_documents, None),
    "line_dedupe": (line_dedupe, LINES),
}
