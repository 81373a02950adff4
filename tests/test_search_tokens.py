import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import retrieval as R
from quarry.sources import files


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of all kinds, ids that come again (with the same text), a null id and null texts."""
    rng = random.Random(11)
    parts = ["Rule", "the", "a", "x", "披露", "上市規則", "的", "規則的披露", "１２", "²", "Ⅷ", "Straße", "İstanbul", "ΣΑΣ", "é", "_", "-", "3.5%", " ", "　", "\n", "\t", "\x0b", "\x1c", "\U00020000\U00020001", "😀", "�", "ab​cd", "日本語のテスト", "and", "of"]
    texts = ["", " ", None, "披", "披露", "a", "披 露"] + ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    rows = [(f"c{i:04d}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:40] + [(None, "the Rule 披露")], "chunk_id string, text string").repartition(3)


@pytest.mark.parametrize("mixed", [False, True])
def test_tokens_cut_from_batches_equal_the_expressions(spark, rows, odd, mixed):
    tokens = T.mixed_tokens("text") if mixed else T.bm25_tokens("text")
    once = odd.dropDuplicates(["chunk_id"]).select("chunk_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    words = sorted({t for r in once.collect() for t in r.tokens})
    got = {r.chunk_id: (r.length, dict(zip([words[i] for i in r.terms], r.counts))) for r in R._encoded(odd, words, mixed).collect()}
    want = {r.chunk_id: (len(r.tokens), {t: r.tokens.count(t) for t in r.tokens}) for r in once.collect()}
    assert got == want and len(words) > 100


def test_ids_that_come_again_are_one_whatever_their_number(rows, odd):
    want = sorted({r.chunk_id for r in odd.collect()}, key=str)
    for most in (500_000, 3):
        assert sorted((r.chunk_id for r in R._once(odd, most).collect()), key=str) == want


def test_stored_index_of_several_parts_finds_the_same(spark, rows, odd, tmp_path):
    queries = spark.createDataFrame([("q1", "rule 披露 the"), ("q2", "Straße 規則 x x"), ("q3", "nothing such"), ("q4", "")], "query_id string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        files.write_index(R.lexical_index(odd, part=40), str(tmp_path / "i"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = files.read_index(spark, str(tmp_path / "i"))
    assert index.postings.select("part").distinct().count() > 5
    assert rows(R.bm25(queries, index)) == rows(R.bm25(queries, odd)) != []
    plain = R.bm25(queries, R.lexical_index(odd))
    assert rows(plain) == rows(R.bm25(queries, odd))


def test_an_index_shuffles_neither_texts_nor_postings(spark, tmp_path):
    from tests.test_search_size import shuffled

    rng = random.Random(3)
    data = [(f"c{i:06d}", " ".join(rng.choices([f"word{j:04d}" for j in range(3000)], k=90))) for i in range(6000)]
    df = spark.createDataFrame(data, "chunk_id string, text string").repartition(4)
    df.write.parquet(str(tmp_path / "t"))
    before = shuffled(spark)
    files.write_index(R.lexical_index(spark.read.parquet(str(tmp_path / "t"))), str(tmp_path / "i"))
    assert shuffled(spark) - before < 0.1 * sum(len(t) for _, t in data)


def test_common_and_rare_words_over_several_blocks_score_as_the_formula(spark):
    import math

    import numpy as np

    rng = random.Random(5)
    names = [f"w{i:03d}" for i in range(300)]
    texts = [" ".join(rng.choices(names, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(0, 40))) for _ in range(9000)]
    chunks = spark.createDataFrame([(f"c{i:05d}", t) for i, t in enumerate(texts)], "chunk_id string, text string").repartition(1)
    asked = {f"q{i:02d}": " ".join([*rng.choices(names[:6], k=3), *rng.choices(names, k=rng.randint(0, 4))]) for i in range(30)}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    bags = [t.split() for t in texts]
    avgdl = np.mean([len(b) for b in bags])
    idf = {w: math.log((len(bags) - n + 0.5) / (n + 0.5) + 1) for w in names if (n := sum(w in b for b in map(set, bags)))}
    for q, text in asked.items():
        words = text.split()
        once = set(words)
        bm, ov = [], []
        for i, b in enumerate(bags):
            s = sum(idf[w] * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avgdl)) for w in words if w in b)
            both = len(once & set(b))
            if both:
                bm.append((-round(s, 6), i))
                ov.append((-round(both / len(once | set(b)), 6), i))
        asked[q] = [sorted(x)[:20] for x in (bm, ov)]
    for which, search in enumerate((R.bm25, R.overlap)):
        got = {}
        for r in search(queries, chunks).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, int(r.chunk_id[1:])))
        for q, want in asked.items():
            assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[which]], abs=2e-6)
            if which:
                assert got[q] == want[which]
