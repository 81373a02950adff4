from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("x")).first().x


def test_bm25_tokens(spark):
    assert one(spark, "Rule 14A.35, 第14A.35條披露", T.bm25_tokens) == ["rule", "14a", "35", "第14a", "35條披露", "條披", "披露"]
    assert one(spark, "字", T.bm25_tokens) == ["字"]
    assert one(spark, "四個漢字", T.bm25_tokens) == ["四個漢字", "四個", "個漢", "漢字"]
    assert one(spark, "", T.bm25_tokens) == [] and one(spark, None, T.bm25_tokens) is None


def test_mixed_tokens_close_gaps_and_drop_stop_characters(spark):
    assert set(one(spark, "The 披 and 露 a notice", T.mixed_tokens)) == {"notice", "披露"}
    assert "的人" not in one(spark, "好的人", T.mixed_tokens)


def test_cleaned(spark):
    assert one(spark, "Line 1\n\n\n\n\nLine 2", T.cleaned) == "Line 1\n\nLine 2"
    assert one(spark, "Word1     Word2", T.cleaned) == "Word1 Word2"
    assert one(spark, "a\r\nb\r\n", T.cleaned) == "a\nb"
    assert one(spark, None, T.cleaned) == ""


def test_numbers(spark):
    assert one(spark, "1,000,000 or 2.5", T.numbers) == [2.5, 1000000.0]
    assert one(spark, "-100 to 200", T.numbers) == [-100.0, 200.0]
    assert one(spark, "1e6 and 1,234.56", T.numbers) == [1234.56, 1000000.0]
    assert one(spark, "5% or 百分之7.5 or 3 percent", T.percentages) == [3.0, 5.0, 7.5]


def test_snippet_cuts_at_a_late_blank(spark):
    assert one(spark, "x" * 190 + " " + "y" * 100, T.snippet) == "x" * 190 + "..."
    assert one(spark, "x" * 100 + " " + "y" * 200, T.snippet) == "x" * 100 + " " + "y" * 99 + "..."
    assert one(spark, "short", T.snippet) == "short"


def test_language_paths_slugs_pieces(spark):
    assert [one(spark, x, T.inferred_language) for x in ("abc", "中文", "a中文", "a中文中文中文中文")] == ["en", "zh", "en", "mixed"]
    assert one(spark, "A\\B//c", T.normalized_path) == "a/b/c"
    assert one(spark, " Hello, World! ", T.slug) == "hello-world"
    assert one(spark, "x" * 250, T.pieces) == ["x" * 100, "x" * 100, "x" * 50] and one(spark, "", T.pieces) == []
    assert one(spark, "connected and notifiable or both", T.sub_queries) == ["connected", "notifiable", "both"]


def test_contains_point(spark):
    df = spark.createDataFrame([("the board must approve", "Board approves"), ("nothing", "board approve"), ("x", "a b")], "a string, p string")
    assert [r.x for r in df.select(T.contains_point(F.col("a"), F.col("p")).alias("x")).collect()] == [True, False, False]
