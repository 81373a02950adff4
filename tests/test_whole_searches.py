import random

import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve requests, none but the first of a number divisible by 100, two of one text, one empty, one without a number and one with a
    figure between Chinese characters."""
    rng = random.Random(5)
    words = [f"word{i:03d}" for i in range(200)]
    out = str(tmp_path_factory.mktemp("whole"))
    chunks = [(f"d_c{i:04d}", f"Section {i % 7}" if i % 3 else None, f"{i % 9}.{i % 40}", "p", " ".join(rng.choices(words, k=40)) + ".") for i in range(400)]
    spark.createDataFrame(chunks, "chunk_id string, section_title string, rule_number string, source_path string, text string").write.parquet(f"{out}/chunk.parquet")
    asked = [(f"rq{i:09d}", " ".join(rng.choices(words, k=3)) + " and " + rng.choice(words)) for i in range(10)]
    asked += [("rq000000010", asked[3][1]), ("rq000000011", ""), (None, "word001"), ("rq000000012", "word002 代價721.8百萬")]
    spark.createDataFrame(asked, "request_id string, query string").write.parquet(f"{out}/query_request.parquet")
    return out, {q for q, text in asked if q and text}


@pytest.mark.parametrize("name", ["answer_confidence", "citations", "evidence_select", "hybrid_search", "multi_query_merge", "relevance"])
def test_every_request_is_searched(spark, folder, name):
    """By the query and by its SQL alike."""
    import duckdb

    df = __spark_entry__.queries()[f"whole_{name}"](spark, folder[0])
    cols = sorted(df.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = df.collect()
    assert {r.query_id for r in got} == folder[1]
    con = duckdb.connect()
    for t in ("chunk", "query_request"):
        con.sql(f"create view {t} as select * from read_parquet('{folder[0]}/{t}.parquet/*.parquet')")
    want = con.sql(f"select {', '.join(cols)} from ({__spark_entry__.oracle_sql()[f'whole_{name}']})").fetchall()
    assert sorted(tuple(show(r[c]) for c in cols) for r in got) == sorted(tuple(map(show, r)) for r in want)


@pytest.mark.parametrize("least", [None, 10.0])
def test_many_units_are_searched_in_groups_with_the_same_rows(spark, rows, monkeypatch, least):
    from quarry.operators import retrieval as R

    rng = random.Random(3)
    data = [(f"c{i:05d}", rng.randint(3, 6), sorted(rng.sample(range(12), 3)), [1, 2, 1]) for i in range(6000)]
    docs = spark.createDataFrame(data, "chunk_id string, length int, terms array<int>, counts array<int>").repartition(8)
    units = [[(i, 1.0), ((i + 1 + j) % 12, 1.5)] for i in range(12) for j in range(3)]
    found = []
    for together in (4096, 9, 1):
        monkeypatch.setattr(R, "TOGETHER", together)
        found.append(R._best(docs, units, 20, avgdl=least, sizes=[2] * len(units)))
    best = [rows(R.ranked(f.withColumnRenamed("unit", "query_id"), 20)) for f in found]
    assert best[0] == best[1] == best[2] and len(best[0]) == 20 * len(units)
    assert found[2].count() < found[0].count()
