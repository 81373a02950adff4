"""Queries of the training-data operators over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import forms, language, leakage, main_content, near_duplicates, proportions, repeated_lines, residue, splitting, tokens
from quarry.session import read, stored

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(repeated_lines.web_documents(read(spark, d, "source_document")))


def p1_sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.shown_sequences(repeated_lines.web_documents(read(spark, d, "source_document")))


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "source_document")
    return repeated_lines.without_lines(docs, p1_found(spark, d))


def _texts(spark: SparkSession, d: str) -> dict[str, bytes]:
    return language.training_texts(read(spark, d, "source_document"), read(spark, d, "language_label"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    docs = language.document_languages(read(spark, d, "source_document"), texts)
    wrong = language.wrong_labels(docs, read(spark, d, "language_label")).select(F.col("document_id").alias("record_id"), F.lit(0).cast("bigint").alias("line_no"), "lang")
    lines = language.foreign_lines(read(spark, d, "chunk"), texts).select(F.col("chunk_id").alias("record_id"), "line_no", "lang")
    return wrong.unionByName(lines)


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(read(spark, d, "source_document"), _texts(spark, d))


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    return language.foreign_lines(read(spark, d, "chunk"), _texts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read(spark, d, "chunk")).select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read(spark, d, "chunk"))


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cases, quota = read(spark, d, "benchmark_case"), read(spark, d, "default_benchmark_quota")
    return proportions.proportional_sample(cases, quota, make_up=True), cases, quota


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return proportions.report(*_sampled(spark, d)).where("short > 0").select(*proportions.CELL)


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return proportions.report(*_sampled(spark, d))


def p4_gaps(spark: SparkSession, d: str) -> DataFrame:
    return proportions.gaps(read(spark, d, "benchmark_case"), read(spark, d, "default_benchmark_quota"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    queries = forms.same_reading_pairs(read(spark, d, "query_request"), "request_id", "query")
    return queries.unionByName(forms.same_reading_pairs(read(spark, d, "chunk"), "chunk_id", "text"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    asked = forms.consistent_form(read(spark, d, "query_request").dropDuplicates(["request_id"]), "request_id", "query").withColumnRenamed("request_id", "record_id")
    return asked.unionByName(forms.consistent_form(read(spark, d, "chunk").dropDuplicates(["chunk_id"]), "chunk_id", "text").withColumnRenamed("chunk_id", "record_id"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    queries = forms.same_reading_classes(read(spark, d, "query_request"), "request_id", "query")
    return queries.unionByName(forms.same_reading_classes(read(spark, d, "chunk"), "chunk_id", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(read(spark, d, "chunk"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(read(spark, d, "chunk"))


def p6_discarded(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs the bands propose, and how many sizes and pivots leave to be compared."""
    _, met, _, near = near_duplicates.candidates(read(spark, d, "chunk"), "chunk_id", "text")
    return met.agg(F.count("*").alias("proposed")).crossJoin(near.agg(F.count("*").alias("left")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "source_document")
    return main_content.boilerplate(docs, main_content.train(docs))


def p7_main(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "source_document")
    return main_content.main_content(docs, main_content.train(docs))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(read(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decoded(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "heldout_item"))


def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "heldout_item"), paraphrases=True)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(read(spark, d, "documents"))


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(read(spark, d, "documents"), reasons=True)


def p10_templates(spark: SparkSession, d: str) -> DataFrame:
    """The templates that aren't content, with the number of their documents."""
    mined = stored(residue.templates(residue.leaves(read(spark, d, "documents"))))
    return mined.join(residue.verdicts(mined, residue.trained(mined)), "leaf").select("leaf", "low", "high", "support", "message", "filler")


@functools.cache
def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_CELL_SQL = "regexp_replace(lower(trim({0}, ' ')), '[\\s_-]+', '_', 'g')"


def oracle_sql() -> dict[str, str]:
    cell = ["primary_category", "language", "difficulty"]
    usable = f"""
      SELECT DISTINCT case_id, q.primary_category, q.language, q.difficulty FROM benchmark_case b JOIN default_benchmark_quota q ON
      {" AND ".join(f"{_CELL_SQL.format('b.' + c)} = {_CELL_SQL.format('q.' + c)}" for c in cell)} WHERE b.accepted"""
    gaps = f"""
      SELECT q.primary_category, q.language, q.difficulty, q.count, count(u.case_id) AS have, greatest(q.count - count(u.case_id), 0) AS short
      FROM default_benchmark_quota q LEFT JOIN ({usable}) u USING (primary_category, language, difficulty)
      GROUP BY q.primary_category, q.language, q.difficulty, q.count"""
    return {
        "p1_found": r"""
          WITH d AS (SELECT DISTINCT document_id, split_part(source_path, '/', 2) AS site, cleaned_text FROM source_document
                     WHERE metadata.source_url IS NOT NULL AND cleaned_text <> ''),
          l AS (SELECT site, document_id, unnest(range(1, len(string_split(cleaned_text, chr(10))) + 1)) AS line_no,
                       unnest(string_split(cleaned_text, chr(10))) AS line FROM d),
          k AS (SELECT site, document_id, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l),
          n AS (SELECT site, count(DISTINCT document_id) AS docs FROM d GROUP BY site),
          s AS (SELECT site, key FROM k JOIN n USING (site) WHERE key <> '' GROUP BY site, key, docs
                HAVING count(DISTINCT document_id) >= 5 AND count(DISTINCT document_id) * 5 >= docs)
          SELECT DISTINCT document_id, line_no FROM k JOIN s USING (site, key)""",
        "p1_sequences": r"""
          WITH RECURSIVE d AS (SELECT DISTINCT document_id, split_part(source_path, '/', 2) AS site, cleaned_text FROM source_document
                     WHERE metadata.source_url IS NOT NULL AND cleaned_text <> ''),
          l AS (SELECT site, document_id, unnest(range(1, len(string_split(cleaned_text, chr(10))) + 1)) AS line_no,
                       unnest(string_split(cleaned_text, chr(10))) AS line FROM d),
          k AS (SELECT site, document_id, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l),
          n AS (SELECT site, greatest(5, ceil(count(DISTINCT document_id) / 5)) AS needed FROM d GROUP BY site),
          s AS (SELECT site, key FROM k JOIN n USING (site) WHERE key <> '' GROUP BY site, key, needed HAVING count(DISTINCT document_id) >= needed),
          i AS (SELECT k.* FROM k JOIN s USING (site, key)),
          r AS (SELECT site, document_id, line_no, [key] AS q FROM i
                UNION SELECT r.site, r.document_id, i.line_no, list_append(q, i.key) FROM r JOIN i ON i.site = r.site AND i.document_id = r.document_id AND i.line_no > r.line_no),
          f AS (SELECT site, q, count(DISTINCT document_id) AS support FROM r JOIN n USING (site) GROUP BY site, q, needed HAVING count(DISTINCT document_id) >= needed),
          x AS (SELECT DISTINCT site, support, list_concat(q[:p - 1], q[p + 1:]) AS q FROM (SELECT *, unnest(range(1, len(q) + 1)) AS p FROM f))
          SELECT site, array_to_string(q, chr(10)) AS sequence, support FROM f ANTI JOIN x USING (site, support, q)""",
        "p3_found": "SELECT DISTINCT chunk_id FROM chunk WHERE length(text) > 1500",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p4_gaps": gaps,
        "p4_found": f"SELECT primary_category, language, difficulty FROM ({gaps}) WHERE short > 0",
    }
