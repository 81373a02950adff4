"""From selected evidence to rendered answers, claims and their support."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quarry.functions import text as T

RULE = r"[Rr]ules? [0-9]{1,2}[A-Z]?\.[0-9]+(?:\([0-9]+\))?"


def rendered(selected: DataFrame, size: int = 300) -> DataFrame:
    """(query_id, answer): the first piece of evidence in a fixed frame and the number of other sources; queries without evidence have no row."""
    n = selected.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by(F.struct("section_title", "rule_number", "text"), "place").alias("e"))
    title, rule = F.coalesce("e.section_title", F.lit("the document")), F.when(F.coalesce("e.rule_number", F.lit("")) != "", F.concat(F.lit(" (Rule "), "e.rule_number", F.lit(")"))).otherwise("")
    more = F.when(F.col("n") > 1, F.concat(F.lit(" "), (F.col("n") - 1).cast("string"), F.lit(" other sources agree."))).otherwise("")
    return n.select("query_id", F.concat(F.lit("Based on "), title, rule, F.lit(" the following applies: "), F.substring("e.text", 1, size), more).alias("answer"))


def claims(answers: DataFrame, least: int = 15) -> DataFrame:
    """(query_id, claim): distinct sentences of more than least characters."""
    parts = F.transform(F.split("answer", "[.!?。！？]+"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " ")))
    return answers.select("query_id", F.explode(F.array_distinct(F.filter(parts, lambda x: F.length(x) > least))).alias("claim"))


def supported(found: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, claim, overlap, ok): a claim's best share of mixed tokens in one result; short claims need a greater share, and a claim
    that names a result's rule is supported by it."""
    c = found.select("query_id", "claim", T.mixed_tokens("claim").alias("want"), T.rule_references("claim").alias("rules"))
    r = results.select("query_id", "rule_number", T.mixed_tokens("text").alias("have"))
    share = F.when(F.size("want") > 0, F.size(F.array_intersect("want", "have")) / F.size("want")).otherwise(0.0)
    need = F.when(F.size("want") <= 5, 0.6).when(F.size("want") <= 10, 0.5).otherwise(0.4)
    named = F.coalesce(F.array_contains("rules", F.col("rule_number")), F.lit(False))
    met = c.join(r, "query_id", "left").withColumn("share", F.coalesce(share, F.lit(0.0)))
    return met.groupBy("query_id", "claim").agg(F.round(F.max("share"), 6).alias("overlap"), F.coalesce(F.bool_or((F.col("share") >= need) | named), F.lit(False)).alias("ok"))


def confidence(support: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, claims, unsupported, confidence): high from 0.6 with two results or more, medium from 0.4, else low; queries without
    claims are low."""
    n = results.groupBy("query_id").agg(F.count("*").alias("results"))
    s = support.groupBy("query_id").agg(F.count("*").alias("claims"), F.count_if(~F.col("ok")).alias("unsupported"))
    ratio = 1 - F.col("unsupported") / F.col("claims")
    level = F.when(F.col("claims") == 0, "low").when((ratio >= 0.6) & (F.col("results") >= 2), "high").when(ratio >= 0.4, "medium").otherwise("low")
    both = n.join(s, "query_id", "left").fillna(0, ["claims", "unsupported"])
    return both.select("query_id", "claims", "unsupported", F.when(F.col("claims") == 0, F.lit("low")).otherwise(level).alias("confidence"))


def contained_points(answers: DataFrame, points: DataFrame) -> DataFrame:
    """(item_id, point_id): answers (item_id, text) that hold at least half of the words of more than three characters of a point
    (point_id, point), as contains_point states it.

    points are a stated set: their different words are broadcast, and each text is searched once for each of them, whatever number of
    points they stand in. Different texts of a batch are searched once.
    """
    import numpy as np

    words = F.transform(F.filter(F.split(F.trim("point"), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.lower(w))
    asked = points.select("point_id", words.alias("words")).where("size(words) > 0").collect()  # a stated set
    kind, other = answers.schema["item_id"].dataType.simpleString(), points.schema["point_id"].dataType.simpleString()
    context = answers.sparkSession.sparkContext
    sets = list(dict.fromkeys(tuple(r.words) for r in asked))
    places = {w: i for i, w in enumerate(dict.fromkeys(w for s in sets for w in s))}
    flat = np.array([places[w] for s in sets for w in s], np.int64)
    starts = np.cumsum([0] + [len(s) for s in sets])
    owners = [[] for _ in sets]
    number = {s: i for i, s in enumerate(sets)}
    for r in asked:
        owners[number[tuple(r.words)]].append(r.point_id)
    shared = context.broadcast((list(places), flat, starts[:-1], np.diff(starts), owners))

    def work(batches):
        names, flat, first, sizes, owners = shared.value
        for b in batches:
            ids, found, met = [], [], {}
            for item, text in zip(b.item_id, b.text):
                if text not in met:
                    hit = np.fromiter((w in text for w in names), bool, len(names))
                    enough = np.nonzero(2 * np.add.reduceat(hit[flat].astype(np.int64), first) >= sizes)[0] if len(first) else []
                    met[text] = [p for i in enough for p in owners[i]]
                ids += [item] * len(met[text])
                found += met[text]
                if len(ids) > 100_000:
                    yield pd.DataFrame({"item_id": ids, "point_id": found})
                    ids, found = [], []
            yield pd.DataFrame({"item_id": ids, "point_id": found})

    spread = answers.where("text is not null").select("item_id", F.lower("text").alias("text")).repartition(context.defaultParallelism)
    return spread.mapInPandas(work, f"item_id {kind}, point_id {other}")


def rewritten(gap: Column) -> Column:
    """A gap as a targeted query: its topic under the rules it names, else the gap itself."""
    rules = F.transform(F.array_distinct(F.regexp_extract_all(gap, F.lit(r"([0-9]{1,2}[A-Z]?\.[0-9]+)"), F.lit(1))), lambda r: F.concat(F.lit("Rule "), r))
    topic = F.trim(F.regexp_replace(F.regexp_replace(gap, RULE, ""), r" {2,}", " "))
    return F.when((F.size(rules) > 0) & (topic != ""), F.concat(topic, F.lit(" under "), F.array_join(rules, " and "))).otherwise(gap)


@F.pandas_udf(StringType())
def fully_normalized(text: pd.Series) -> pd.Series:
    """Compatibility composition, case folded, white space collapsed: what no built-in function does."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, in this order of arguments; null where one is null. For candidates that a cheaper bound has left."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts is greater than twice the shorter length by the sum."""
    return F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b))


def differences(df: DataFrame, key: str, expected: str, actual: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, path, expected, actual) where two JSON texts differ: nested fields are flattened to paths and joined; numbers may differ by
    the tolerance. Broken JSON is null."""
    import json
    from collections.abc import Iterator

    def flat(value, path, out):
        if isinstance(value, dict) and value:
            for k, v in value.items():
                flat(v, f"{path}.{k}" if path else str(k), out)
        elif isinstance(value, list) and value:
            for i, v in enumerate(value):
                flat(v, f"{path}[{i}]", out)
        else:
            out[path] = value
        return out

    def load(text):
        try:
            return flat(json.loads(text), "", {}) if text else {}
        except ValueError:
            return {}

    def same(x, y):
        if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool):
            return abs(x - y) <= tolerance
        return x == y and type(x) is type(y)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x, y in zip(b.k, b.x, b.y):
                e, a = load(x), load(y)
                rows += [(k, p, json.dumps(v), json.dumps(a[p]) if p in a else None) for p, v in e.items() if p not in a or not same(v, a[p])]
            yield pd.DataFrame(rows, columns=["k", "path", "expected", "actual"])

    given = df.select(F.col(key).cast("string").alias("k"), F.col(expected).alias("x"), F.col(actual).alias("y"))
    return given.mapInPandas(work, "k string, path string, expected string, actual string").withColumnRenamed("k", key)
