"""What paths, texts and questions tell: status, document type, rule numbers, relevance, kinds of question. All expressions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

# Phrases that take a document out of force, and folders of documents in force.
WITHDRAWN = r"(?i)(^|\n)\s*(\[PAGE\s+\d+\]\s*)?withdrawn\s+(on|in|from|with\s+effect)([^\p{L}\p{N}_]|$)|\(\s*withdrawn\s+(on|in|from|with\s+effect)([^\p{L}\p{N}_]|$)|已撤回|撤回日期"
SUPERSEDED = r"(?i)(^|\n)\s*(\[PAGE\s+\d+\]\s*)?superseded\s+(on|in|from|by)([^\p{L}\p{N}_]|$)|\(\s*superseded\s+(on|in|from|by)([^\p{L}\p{N}_]|$)|已取代|被取代"
ACTIVE = ["/rules/", "/guidance/", "/enforcement_guidance/", "/forms_templates/", "/headline_categories/", "/review_committee_decisions/"]
# The document type a part of the path stands for, the first that fits.
TYPES = [("/rules/", "rule"), ("guidance_letters", "guidance_letter"), ("listing_decisions", "listing_decision"), ("/faqs/", "faq"), ("review_committee_decisions", "review_decision"), ("enforcement_guidance", "enforcement"), ("forms_templates", "form_template")]
# Terms that make two titles of one subject, and terms that add to an overlap.
DOMAIN = ["disclosure", "connected", "transaction", "notifiable", "acquisition", "disposal", "listing", "requirement", "obligation", "exemption", "threshold", "percentage"]
KEY_TERMS = ["disclosure", "obligation", "requirement", "threshold", "rule", "transaction"]
# How direct questions begin, and what points at several at once.
DIRECT = r"^(what is|what are|define|explain|describe|list|state|tell me about|what does .* say|which rule|which section|什么是|请解释|请说明|规则\d)"
SEVERAL = [
    r"\band\b", r"\bor\b", r"\balso\b", r"\bas well as\b", r"\bcompare\b", r"\bdifference\b", r"\bboth\b", r"\bversus\b", r"\bvs\.?\b", r"\bhow (?:do|does|are|is) .* (?:relate|compare|differ|connect)",
    r"\bwhat (?:are|is) the (?:relationship|difference|connection)", r"\brequirements? for .* (?:and|or|plus)", r"\bimplications? of .* (?:and|or|plus)", r"和|以及|还有|同时|另外|对比|比较|区别|差异",
]
# Words that point back to an earlier question, and those of them that stand for it.
BACK = ["它", "这个", "那个", "上面", "之前", "该规则", "前面提到", "刚才说的", "那些", "这些", "其中", " it ", " it?", " it.", "this ", "that ", "that?", "that.", "the above", "mentioned", "those ", "these ", "the rule", "the same"]
STANDS_FOR = ["它", "这个", "那个", "该规则", "上述"]
# Currencies by what is written, and what one unit is worth.
CURRENCIES = {"hkd": (r"HK\$|HKD", 1.0), "usd": (r"USD|US\$", 7.8), "rmb": (r"RMB|CNY", 1.1)}
SCALES = {"b": 1e9, "m": 1e6, "k": 1e3, "t": 1e3}


def status(path: Column, text: Column) -> Column:
    """withdrawn or superseded by the text, archived or active by the path, else unknown; a null text says nothing."""
    p, t = T.normalized_path(path), F.coalesce(text, F.lit(""))
    return F.when(t.rlike(WITHDRAWN), "withdrawn").when(t.rlike(SUPERSEDED), "superseded").when(p.rlike("(^|/)archive(/|$)"), "archived").when(reduce(lambda a, b: a | b, [p.contains(x) for x in ACTIVE]), "active").otherwise("unknown")


def document_type(path: Column) -> Column:
    p = T.normalized_path(path)
    return F.coalesce(*[F.when(p.contains(part), F.lit(kind)) for part, kind in TYPES], F.lit("other"))


def normalized_rule(value: Column) -> Column:
    """A rule number in capitals without the board, the word Rule and punctuation around it."""
    v = F.regexp_replace(F.upper(F.trim(value)), r"^(MAIN\s+BOARD|GEM)\s+", "")
    return F.regexp_replace(F.regexp_replace(v, r"^RULES?\s+", ""), r"^[ .,:;()\[\]]+|[ .,:;()\[\]]+$", "")


def precise_rule(path: Column, rule: Column, board: Column) -> Column:
    """Whether a chunk of a rule book of a known board has a rule number with at most one part below the chapter."""
    return F.coalesce(T.normalized_path(path).contains("/rules/") & board.isin("main_board", "gem") & normalized_rule(rule).rlike(r"^\d{1,2}[A-Z]?(\.\d+[A-Z]?)?$"), F.lit(False))


def board_references(text: Column) -> Column:
    """Sorted distinct board:number of the rules a text refers to; a reference without a board has an empty one."""
    en = F.regexp_extract_all(text, F.lit(r"((?:Main Board |GEM )?[Rr]ules? [0-9]{1,2}[A-Z]?\.[0-9]+)"), F.lit(1))
    zh = F.regexp_extract_all(text, F.lit(r"第([0-9]{1,2}[A-Z]?\.[0-9]+)(?:\([0-9]+\))?條"), F.lit(1))
    board = lambda x: F.when(x.startswith("Main"), "main_board").when(x.startswith("GEM"), "gem").otherwise("")
    return F.array_sort(F.array_distinct(F.transform(F.concat(en, zh), lambda x: F.concat(board(x), F.lit(":"), F.regexp_extract(x, r"([0-9]{1,2}[A-Z]?\.[0-9]+)$", 1)))))


def excerpt(text: Column, limit: int = 360) -> Column:
    """White space collapsed, at most limit characters back to a blank, no punctuation before the ellipsis; short texts whole."""
    t = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    head = F.substring(t, 1, limit)
    blank = limit - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (blank > 100), F.substring(t, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit("...")))


def label(key: Column, names: list[str]) -> Column:
    """One of names by the first bytes of a hash of the key: stable, and even over keys."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % len(names) + 1).cast("int"))


def amounts(text: Column) -> Column:
    """Distinct sums of money in order, in the first currency's units, from an amount behind its currency and its own scale letter."""

    def valued(worth: float):
        def value(x: Column) -> Column:
            unit = F.lower(F.substring(F.regexp_extract(x, "([A-Za-z]+)$", 1), 1, 1))
            scale = F.when(unit == "b", SCALES["b"]).when(unit == "m", SCALES["m"]).when(unit.isin("k", "t"), SCALES["k"]).otherwise(1.0)
            return F.regexp_replace(x, "[^0-9.]", "").cast("double") * scale * worth

        return value

    number = r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:million|billion|thousand|bn|m|k)?)"
    found = [F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?:{written})\s*{number}"), F.lit(1)), valued(worth)) for written, worth in CURRENCIES.values()]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*found), lambda v: v > 0)))


def overlap_score(task: Column, text: Column) -> Column:
    """The share of the task's tokens in the text and a tenth for each key term in both, three tenths and 1 at most; 0 without tokens."""
    want, have, low, other = T.mixed_tokens(task), T.mixed_tokens(text), F.lower(task), F.lower(text)
    bonus = reduce(lambda a, b: a + b, [F.when(low.contains(t) & other.contains(t), 1).otherwise(0) for t in KEY_TERMS])
    return F.when(F.size(want) > 0, F.least(F.lit(1.0), F.size(F.array_intersect(want, have)) / F.size(want) + F.least(F.lit(3), bonus) / 10)).otherwise(0.0)


def same_subject(task: Column, title: Column) -> Column:
    """Whether task and title share two fifths of the shorter one's tokens, or a term of the domain; false for a null title."""
    a, b = T.mixed_tokens(task), T.mixed_tokens(title)
    common = F.array_intersect(a, b)
    fits = (F.size(common) / F.least(F.size(a), F.size(b)) >= 0.4) | F.arrays_overlap(common, F.array(*[F.lit(x) for x in DOMAIN]))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & fits, F.lit(False))


def relevant(task: Column, rule: Column, title: Column, text: Column) -> Column:
    """By a rule number that the task names, else by title, else by text."""
    named = F.coalesce((rule != "") & F.contains(F.lower(task), F.lower(rule)), F.lit(False))
    return named | same_subject(task, title) | (overlap_score(task, text) >= 0.3)


def supported_by(task: Column, intent: Column, lexical: Column, dense: Column, least: float = 0.6) -> Column:
    """Whether a result's scores support a task: the lexical one for tasks about rules, the dense one for summaries, else the better one."""
    rules = (intent == "rule_lookup") | task.rlike(r"(?i)(^|[^\p{L}\p{N}_])[0-9]+[A-Z]?\.[0-9]+($|[^\p{L}\p{N}_])")
    return F.when(rules, lexical >= 0.5).when(intent == "obligation_summary", dense >= least).otherwise(F.greatest(lexical, dense) >= least)


def question_kind(query: Column) -> Column:
    """multi_hop for questions with two or more signs of it, or, where they don't begin like a direct one, two connectors; else direct."""
    q = F.lower(query)
    signs = reduce(lambda a, b: a + b, [q.rlike(p).cast("int") for p in SEVERAL])
    count = lambda w: F.size(F.split(q, w)) - 1
    clauses = count(" and ") + count(" or ") + count(" as well as ")
    return F.when(signs >= 2, "multi_hop").when(~q.rlike(DIRECT) & (q.contains(" and ") | q.contains(" or ")) & (clauses >= 2), "multi_hop").otherwise("direct")


def resolved(query: Column, earlier: Column, size: int = 30) -> Column:
    """A question that points back, with the first of each standing-for word replaced by the start of the last question; others as they are."""
    points, out = reduce(lambda a, b: a | b, [F.contains(F.lower(query), F.lit(w)) for w in BACK]), query
    start = F.regexp_replace(F.substring(earlier, 1, size), r"([\\$])", r"\\$1")
    for w in STANDS_FOR:
        out = F.regexp_replace(out, F.lit(f"(?s)^(.*?){w}"), F.concat(F.lit("$1"), start))
    return F.when(F.coalesce(earlier, F.lit("")) == "", query).when(points, out).otherwise(query)


def near_numbers(text: Column, words: dict[str, list[str]], reach: int = 80) -> Column:
    """Of each field the number nearest behind or before one of its words within reach: array of (field, value, distance), by field."""
    t = F.lower(text)
    places = F.transform(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(places), F.lit(1))), lambda i: F.length(F.array_join(F.slice(F.split(t, r"[0-9]+(?:\.[0-9]+)?"), 1, i), "")) + F.length(F.array_join(F.slice(F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), 1, i - 1), "")))
    fields = []
    for name, ws in sorted(words.items()):
        hits = F.filter(F.array(*[F.instr(t, w) for w in ws]), lambda p: p > 0)
        pairs = F.flatten(F.transform(hits, lambda p: F.zip_with(places, starts, lambda v, s: F.struct(F.abs(s + 1 - p).alias("distance"), v.alias("value")))))
        best = F.array_min(F.filter(pairs, lambda x: x.value.isNotNull() & (x.distance <= reach)))
        fields.append(F.when(best.isNotNull(), F.struct(F.lit(name).alias("field"), best.value.alias("value"), best.distance.alias("distance"))))
    return F.filter(F.array(*fields), lambda x: x.isNotNull())
