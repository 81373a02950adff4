from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers as A


def test_rendered_claims_support_confidence(spark):
    sel = spark.createDataFrame([("q", 1, "Caps", "14.52", "The issuer shall cap the annual amount of the deal. Short one."), ("q", 2, None, None, "Nothing else is said here at all")], "query_id string, place int, section_title string, rule_number string, text string")
    answer = A.rendered(sel)
    assert answer.first().answer == "Based on Caps (Rule 14.52) the following applies: The issuer shall cap the annual amount of the deal. Short one. 1 other sources agree."
    claims = A.claims(spark.createDataFrame([("q", "The issuer shall cap the annual amount! Tiny. Pigs might fly over the tall towers. Rule 14.52 says whatever it pleases")], "query_id string, answer string"))
    assert claims.count() == 4 - 1
    ok = {r.claim: r.ok for r in A.supported(claims, sel).collect()}
    assert ok == {"The issuer shall cap the annual amount": True, "Pigs might fly over the tall towers": False, "52 says whatever it pleases": False}
    level = A.confidence(A.supported(claims, sel), sel).first()
    assert (level.claims, level.unsupported, level.confidence) == (3, 2, "low")


def test_rewritten(spark):
    df = spark.createDataFrame([("disclosure under rule 14.52 and rule 14A.35",), ("notifiable transactions",)], "g string")
    assert [r.x for r in df.select(A.rewritten(F.col("g")).alias("x")).collect()] == ["disclosure under and under Rule 14.52 and Rule 14A.35", "notifiable transactions"]


def test_normalised_and_alike(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ  Straße\n", "abcd"), (None, None)], "a string, b string")
    r = df.select(A.fully_normalized("a").alias("n"), A.sequence_similarity("b", F.lit("bcde")).alias("s"), A.sequence_bound(F.col("b"), F.lit("bc")).alias("u")).collect()
    assert r[0].n == "full strasse" and r[0].s == 0.75 and abs(r[0].u - 4 / 6) < 1e-12 and r[1].n is None


def test_differences(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": "x"}', '{"a": {"b": [1.0000000001, 3]}}'), (2, "{}", "broken"), (3, None, None)], "k int, e string, a string")
    got = sorted((r.k, r.path, r.expected, r.actual) for r in A.differences(df, "k", "e", "a").collect())
    assert got == [("1", "a.b[1]", "2", "3"), ("1", "c", '"x"', None), ("2", "", "{}", None)]


def test_contained_points_equal_the_cross_join_without_one(spark, rows, tmp_path):
    from quarry.plans.corpus import answer_points

    texts = ["The Issuer shall publish a circular", "issuershall PUBLISH", "a an the of", "", None, "circular circular paper", "The Issuer shall publish a circular"]
    items = spark.createDataFrame([(i * 50, t) for i, t in enumerate(texts * 2)], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/heldout_item.parquet")
    points = items.where("item_id % 100 = 0").select(F.col("item_id").alias("point_id"), F.col("text").alias("point"))
    want = items.crossJoin(points).where(T.contains_point(F.col("text"), F.col("point"))).select("item_id", "point_id")
    got = answer_points(spark, str(tmp_path))
    assert rows(got) == rows(want) and len(rows(got)) > 10
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
