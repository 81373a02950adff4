"""Queries of what paths, texts and questions tell."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import inference as I
from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.operators import retrieval as R
from quarry.plans import graph as P
from quarry.plans import retrieval as Q
from quarry.session import read, stored

_DOC_PATH = "lower(regexp_replace(replace(source_path, '\\', '/'), '/+', '/', 'g'))"
NAMES = ["north", "south", "east", "west"]
FIELDS = {"consideration": ["consideration", "代價"], "profit": ["profit", "溢利"], "ratio": ["ratio", "比率"]}


def _documents(spark, d):
    return read(spark, d, "source_document").select("document_id", "source_path", "raw_text", "cleaned_text").dropDuplicates(["document_id"])


def document_status(spark, d):
    path, text = F.col("source_path"), F.coalesce("cleaned_text", F.lit(""))
    return _documents(spark, d).select("document_id", I.status(path, text).alias("status"), I.document_type(path).alias("doc_type"), G.ruleset(T.normalized_path(path), F.substring(text, 1, 500), P._NAMED).alias("ruleset"))


_ONE_DOC = "SELECT document_id, any_value(source_path) AS source_path, coalesce(any_value(cleaned_text), '') AS text FROM source_document GROUP BY document_id"
STATUS = f"""
  SELECT document_id, CASE WHEN regexp_matches(text, '(?i)(^|\\n)\\s*(\\[PAGE\\s+\\d+\\]\\s*)?withdrawn\\s+(on|in|from|with\\s+effect)\\b|\\(\\s*withdrawn\\s+(on|in|from|with\\s+effect)\\b|已撤回|撤回日期') THEN 'withdrawn'
  WHEN regexp_matches(text, '(?i)(^|\\n)\\s*(\\[PAGE\\s+\\d+\\]\\s*)?superseded\\s+(on|in|from|by)\\b|\\(\\s*superseded\\s+(on|in|from|by)\\b|已取代|被取代') THEN 'superseded'
  WHEN regexp_matches({_DOC_PATH}, '(^|/)archive(/|$)') THEN 'archived' WHEN len(list_filter(['/rules/', '/guidance/', '/enforcement_guidance/', '/forms_templates/', '/headline_categories/', '/review_committee_decisions/'], lambda x: contains({_DOC_PATH}, x))) > 0 THEN 'active' ELSE 'unknown' END AS status,
  CASE WHEN contains({_DOC_PATH}, '/rules/') THEN 'rule' WHEN contains({_DOC_PATH}, 'guidance_letters') THEN 'guidance_letter' WHEN contains({_DOC_PATH}, 'listing_decisions') THEN 'listing_decision' WHEN contains({_DOC_PATH}, '/faqs/') THEN 'faq'
  WHEN contains({_DOC_PATH}, 'review_committee_decisions') THEN 'review_decision' WHEN contains({_DOC_PATH}, 'enforcement_guidance') THEN 'enforcement' WHEN contains({_DOC_PATH}, 'forms_templates') THEN 'form_template' ELSE 'other' END AS doc_type, {P._RULESET} AS ruleset
  FROM ({_ONE_DOC})"""


def eligible_rules(spark, d):
    """Chunks of documents in force that aren't copies, with a precise rule number of a known board: what generation may draw from."""
    from quarry.operators import governance as V

    c = read(spark, d, "chunk").where("text <> ''").groupBy("chunk_id").agg(F.min(F.struct(F.coalesce("source_path", F.lit("")).alias("path"), F.coalesce("rule_number", F.lit("")).alias("rule"), F.col("text"))).alias("c")).select("chunk_id", "c.*")
    heads = V.duplicate_groups(c.select("chunk_id", "path", F.sha2("text", 256).alias("digest")), "digest", "chunk_id", ["path"]).where("canonical = chunk_id").select("chunk_id")
    board = G.ruleset(T.normalized_path("path"), F.substring("text", 1, 500), P._NAMED)
    live = c.where(~I.status(F.col("path"), F.col("text")).isin("withdrawn", "superseded", "archived")).join(heads, "chunk_id", "left_semi")
    return live.select("chunk_id", I.normalized_rule(F.col("rule")).alias("rule"), board.alias("board"), (I.normalized_rule(F.col("rule")).rlike(r"^\d{1,2}[A-Z]?(\.\d+[A-Z]?)?$")).alias("precise")).where("rule <> ''")


_RULE = "regexp_replace(regexp_replace(regexp_replace(upper(trim({0})), '^(MAIN\\s+BOARD|GEM)\\s+', ''), '^RULES?\\s+', ''), '^[ .,:;()\\[\\]]+|[ .,:;()\\[\\]]+$', '', 'g')"
ELIGIBLE = f"""
  WITH c AS (SELECT chunk_id, min(row(coalesce(source_path, ''), coalesce(rule_number, ''), text)) AS r FROM chunk WHERE text <> '' GROUP BY chunk_id), x AS (SELECT chunk_id, r[1] AS source_path, r[2] AS rule_number, r[3] AS text FROM c),
  s AS (SELECT x.*, s.status, first_value(x.chunk_id) OVER (PARTITION BY x.text ORDER BY x.source_path, x.chunk_id) AS canonical FROM x JOIN (SELECT document_id, status FROM ({STATUS.replace(_ONE_DOC, "SELECT chunk_id AS document_id, source_path, text FROM x")})) s ON s.document_id = x.chunk_id)
  SELECT chunk_id, {_RULE.format("rule_number")} AS rule, {P._RULESET} AS board, regexp_full_match({_RULE.format("rule_number")}, '\\d{{1,2}}[A-Z]?(\\.\\d+[A-Z]?)?') AS precise FROM s
  WHERE canonical = chunk_id AND status NOT IN ('withdrawn', 'superseded', 'archived') AND {_RULE.format("rule_number")} <> ''"""


def board_references(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(I.board_references(F.col("text")), " ").alias("rules"))


BOARDS = """
  WITH e AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(text, '(?:Main Board |GEM )?[Rr]ules? [0-9]{1,2}[A-Z]?\\.[0-9]+'), lambda x: CASE WHEN starts_with(x, 'Main') THEN 'main_board' WHEN starts_with(x, 'GEM') THEN 'gem' ELSE '' END || ':' || regexp_extract(x, '[0-9]{1,2}[A-Z]?\\.[0-9]+$')),
    list_transform(regexp_extract_all(text, '第([0-9]{1,2}[A-Z]?\\.[0-9]+)(?:\\([0-9]+\\))?條', 1), lambda x: ':' || x)) AS l FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, array_to_string(list_sort(list_distinct(l)), ' ') AS rules FROM e"""


def excerpts(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", I.excerpt(F.col("text")).alias("excerpt"), I.label(F.col("doc_id").cast("string"), NAMES).alias("label"))


_T = "trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
_CUT = f"CASE WHEN strpos(left({_T}, 360), ' ') > 0 AND 360 - strpos(reverse(left({_T}, 360)), ' ') > 100 THEN left({_T}, (360 - strpos(reverse(left({_T}, 360)), ' '))::INT) ELSE left({_T}, 360) END"
EXCERPTS = f"SELECT doc_id, CASE WHEN length({_T}) <= 360 THEN {_T} ELSE regexp_replace({_CUT}, '[ ,;:]+$', '') || '...' END AS excerpt, (['north', 'south', 'east', 'west'])[(('0x' || left(sha256(doc_id::VARCHAR), 8))::BIGINT % 4 + 1)::INT] AS label FROM documents WHERE text IS NOT NULL"


def money_amounts(spark, d):
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", I.amounts(F.col("text")).alias("a"))
    return rows.select("doc_id", F.size("a").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 0).cast("bigint").alias("total"))


def _amount_sql(written: str, worth: float) -> str:
    found = f"regexp_extract_all(text, '(?i)(?:{written})\\s*([0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?\\s*(?:million|billion|thousand|bn|m|k)?)', 1)"
    return f"list_transform({found}, lambda x: regexp_replace(x, '[^0-9.]', '', 'g')::DOUBLE * CASE lower(left(regexp_extract(x, '[A-Za-z]+$'), 1)) WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 WHEN 't' THEN 1e3 ELSE 1 END * {worth})"


AMOUNTS = f"""
  WITH a AS (SELECT doc_id, list_distinct(list_filter(list_concat({_amount_sql("HK\\$|HKD", 1.0)}, {_amount_sql("USD|US\\$", 7.8)}, {_amount_sql("RMB|CNY", 1.1)}), lambda v: v > 0)) AS a FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, len(a)::INT AS n, round(coalesce(list_sum(a), 0), 0)::BIGINT AS total FROM a"""


def _questions(spark, d):
    return read(spark, d, "query_request").where("query <> ''").select("request_id", "query", "conversation_id", "asked_at").dropDuplicates(["request_id"])


def question_kinds(spark, d):
    """Direct and multi-hop questions, and the way each goes: those that name a rule are looked up, the others retrieved."""
    q = _questions(spark, d)
    return q.select("request_id", I.question_kind(F.col("query")).alias("kind"), F.when(F.size(T.rule_references("query")) > 0, "select").otherwise("retrieve").alias("route"))


_SIGNS = " + ".join(f"regexp_matches(q, '{p}')::INT" for p in [
    r"\band\b", r"\bor\b", r"\balso\b", r"\bas well as\b", r"\bcompare\b", r"\bdifference\b", r"\bboth\b", r"\bversus\b", r"\bvs\.?\b", r"\bhow (?:do|does|are|is) .* (?:relate|compare|differ|connect)",
    r"\bwhat (?:are|is) the (?:relationship|difference|connection)", r"\brequirements? for .* (?:and|or|plus)", r"\bimplications? of .* (?:and|or|plus)", r"和|以及|还有|同时|另外|对比|比较|区别|差异",
])
_CLAUSES = " + ".join(f"len(string_split(q, '{w}')) - 1" for w in (" and ", " or ", " as well as "))
KINDS = f"""
  WITH x AS (SELECT DISTINCT request_id, query, lower(query) AS q FROM query_request WHERE query <> '')
  SELECT request_id, CASE WHEN {_SIGNS} >= 2 THEN 'multi_hop' WHEN NOT regexp_matches(q, '^(what is|what are|define|explain|describe|list|state|tell me about|what does .* say|which rule|which section|什么是|请解释|请说明|规则\\d)')
  AND (contains(q, ' and ') OR contains(q, ' or ')) AND {_CLAUSES} >= 2 THEN 'multi_hop' ELSE 'direct' END AS kind, CASE WHEN len({Q._REFS.format("query")}) > 0 THEN 'select' ELSE 'retrieve' END AS route FROM x"""


def coreference(spark, d):
    """Questions of a conversation with what they point back to filled in from the question before."""
    w = Window.partitionBy("conversation_id").orderBy("asked_at", "request_id")
    q = _questions(spark, d).where("conversation_id is not null").withColumn("earlier", F.lag("query").over(w))
    return q.select("request_id", I.resolved(F.col("query"), F.col("earlier")).alias("query"))


def _first(text: str, word: str) -> str:
    return f"CASE WHEN strpos({text}, '{word}') > 0 THEN left({text}, (strpos({text}, '{word}') - 1)::INT) || left(e, 30) || substr({text}, (strpos({text}, '{word}') + {len(word)})::INT) ELSE {text} END"


_STEPS, _FROM = "", "SELECT request_id, query AS q0, e FROM w"
for _i, _w in enumerate(["它", "这个", "那个", "该规则", "上述"]):
    _FROM = f"SELECT *, {_first(f'q{_i}', _w)} AS q{_i + 1} FROM ({_FROM})"
_POINTS = " OR ".join(f"contains(lower(q0), '{w}')" for w in ["它", "这个", "那个", "上面", "之前", "该规则", "前面提到", "刚才说的", "那些", "这些", "其中", " it ", " it?", " it.", "this ", "that ", "that?", "that.", "the above", "mentioned", "those ", "these ", "the rule", "the same"])
COREFERENCE = f"""
  WITH o AS (SELECT request_id, any_value(query) AS query, any_value(conversation_id) AS c, any_value(asked_at) AS t FROM query_request WHERE query <> '' GROUP BY request_id),
  w AS (SELECT request_id, query, lag(query) OVER (PARTITION BY c ORDER BY t NULLS FIRST, request_id) AS e FROM o WHERE c IS NOT NULL)
  SELECT request_id, CASE WHEN coalesce(e, '') <> '' AND ({_POINTS}) THEN q5 ELSE q0 END AS query FROM ({_FROM})"""


def relevance(spark, d, whole=False):
    """Each request's results with the signals that make them relevant and whether their scores support it."""
    lists = stored(Q._lists(spark, d, whole))
    q, scores = Q.asked(spark, d, whole).select("query_id", F.col("text").alias("task")), Q.full_outer_scores(spark, d, lists)
    if whole:  # texts come last, to ids that have all else
        both = Q._with_chunks(spark, d, stored(R.reciprocal_rank_fusion(lists).join(q, "query_id").join(scores, ["query_id", "chunk_id"])), whole)
    else:
        both = Q._results(spark, d, lists).join(q, "query_id").join(scores, ["query_id", "chunk_id"])
    ok = I.supported_by(F.col("task"), F.lit("general"), F.col("bm25_score"), F.col("overlap_score"))
    return both.select("query_id", "chunk_id", F.round(I.overlap_score(F.col("task"), F.col("text")), 6).alias("overlap"), I.same_subject(F.col("task"), F.col("section_title")).alias("titled"), I.relevant(F.col("task"), F.col("rule_number"), F.col("section_title"), F.col("text")).alias("relevant"), ok.alias("supported"))


_TERM_SUM = " + ".join(f"(contains(lower(task), '{t}') AND contains(lower(text), '{t}'))::INT" for t in ["disclosure", "obligation", "requirement", "threshold", "rule", "transaction"])
RELEVANCE = f"""
  WITH x AS (SELECT r.*, a.text AS task, s.bm25_score, s.overlap_score, {Q.MIXED.format("a.text")} AS want, {Q.MIXED.format("r.text")} AS have, {Q.MIXED.format("r.section_title")} AS head FROM ({Q.RESULTS}) r JOIN ({Q.ASKED_SQL}) a USING (query_id) JOIN ({Q.FULL_OUTER}) s USING (query_id, chunk_id)),
  y AS (SELECT *, CASE WHEN len(want) > 0 THEN least(1.0, len(list_intersect(want, have)) / len(want) + least(3, {_TERM_SUM}) / 10) ELSE 0.0 END AS o,
  coalesce(section_title IS NOT NULL AND len(want) > 0 AND len(head) > 0 AND (len(list_intersect(want, head)) / least(len(want), len(head)) >= 0.4 OR list_has_any(list_intersect(want, head), ['disclosure', 'connected', 'transaction', 'notifiable', 'acquisition', 'disposal', 'listing', 'requirement', 'obligation', 'exemption', 'threshold', 'percentage'])), false) AS titled FROM x)
  SELECT query_id, chunk_id, round(o, 6) AS overlap, titled, titled OR o >= 0.3 OR coalesce(rule_number <> '' AND contains(lower(task), lower(rule_number)), false) AS relevant,
  CASE WHEN regexp_matches(task, '(?i)\\b[0-9]+[A-Z]?\\.[0-9]+\\b') THEN bm25_score >= 0.5 ELSE greatest(bm25_score, overlap_score) >= 0.6 END AS supported FROM y"""


#: Letters of any script are part of a word, as in the reference; DuckDB's word boundary knows ASCII alone.
WHOLE_RELEVANCE = Q.whole_sql(RELEVANCE).replace(r"\b[0-9]+[A-Z]?\.[0-9]+\b", r"(^|[^\p{L}\p{N}_])[0-9]+[A-Z]?\.[0-9]+($|[^\p{L}\p{N}_])")


def near_numbers(spark, d):
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", F.explode(I.near_numbers(F.col("text"), FIELDS)).alias("n"))
    return rows.select("doc_id", "n.field", "n.value", "n.distance")


QUERIES = {
    "document_status": (document_status, STATUS),
    "eligible_rules": (eligible_rules, ELIGIBLE),
    "board_references": (board_references, BOARDS),
    "excerpts": (excerpts, EXCERPTS),
    "money_amounts": (money_amounts, AMOUNTS),
    "question_kinds": (question_kinds, KINDS),
    "coreference": (coreference, COREFERENCE),
    "relevance": (relevance, RELEVANCE),
    "whole_relevance": (partial(relevance, whole=True), WHOLE_RELEVANCE),
    "near_numbers": (near_numbers, None),
}
