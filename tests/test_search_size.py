import os
import random

import pytest

import __spark_entry__


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    words = [f"word{i:04d}" for i in range(3000)]
    out = str(tmp_path_factory.mktemp("searched"))
    chunks = [(f"d_c{i:05d}", "S" if i % 3 else None, f"{i % 9}.{i % 40}", "p", "what does the rule say " + " ".join(rng.choices(words, k=95))) for i in range(6000)]
    spark.createDataFrame(chunks, "chunk_id string, section_title string, rule_number string, source_path string, text string").repartition(4).write.parquet(f"{out}/chunk.parquet")
    asked = [(f"rq{i * 100:09d}", "what does the rule say " + " ".join(rng.choices(words, k=3)) + " and what does the rule say " + rng.choice(words)) for i in range(60)]
    spark.createDataFrame(asked, "request_id string, query string").write.parquet(f"{out}/query_request.parquet")
    return out, sum(len(c[-1]) for c in chunks)


def shuffled(spark) -> int:
    """Bytes that all stages of the session have written for shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["hybrid_search", "multi_query_merge", "task_coverage", "evidence_select"])
def test_searches_dont_shuffle_the_texts(spark, folder, name):
    before = shuffled(spark)
    assert __spark_entry__.queries()[name](spark, folder[0]).collect()
    assert shuffled(spark) - before < 0.3 * folder[1]


@pytest.mark.parametrize("name", ["citations", "relevance", "answer_confidence", "claim_support"])
def test_what_follows_a_search_searches_once(spark, folder, name, monkeypatch):
    from quarry.operators import retrieval

    calls = []
    search = retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda *a, **k: calls.append(1) or search(*a, **k))
    __spark_entry__.queries()[name](spark, folder[0]).count()
    assert len(calls) == 1


@pytest.mark.parametrize("name", ["evidence_select", "task_coverage", "claim_support", "answer_confidence"])
def test_a_search_leaves_no_table_of_texts_on_disk(spark, folder, name, monkeypatch):
    from quarry.operators import retrieval

    kept = []
    store = retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df: kept.append(store(df)) or kept[-1])
    found = __spark_entry__.queries()[name](spark, folder[0])
    files = [f.removeprefix("file:").replace("///", "/") for df in kept for f in df.inputFiles()]
    assert kept and found.count() and not any(os.path.exists(f) for f in files)


@pytest.mark.parametrize("least", [None, 10.0])
def test_what_a_search_passes_on_does_not_grow_with_its_tasks(spark, rows, least):
    """Many texts score alike; each task passes on up to twenty of each unit."""
    from quarry.operators import retrieval as R

    rng = random.Random(2)
    data = [(None if i == 77 else f"c{i:05d}", rng.randint(3, 6), sorted(rng.sample(range(12), 3)), [1, 2, 1]) for i in range(20000)]
    docs = spark.createDataFrame(data, "chunk_id string, length int, terms array<int>, counts array<int>")
    units = [[(i, 1.0), ((i + 1 + j) % 12, 1.5)] for i in range(12) for j in range(3)]
    found = {n: R._best(docs.repartition(n), units, 20, avgdl=least, sizes=[2] * len(units)) for n in (4, 60)}
    best = [rows(R.ranked(f.withColumnRenamed("unit", "query_id"), 20)) for f in found.values()]
    assert best[0] == best[1] and len(best[0]) == 20 * len(units)
    assert found[60].count() <= 4 * spark.sparkContext.defaultParallelism * 20 * len(units)


def test_many_ids_that_come_again_dont_shuffle_the_texts(spark, folder, monkeypatch):
    from quarry.operators import retrieval as R

    once, chunks = R._once, spark.read.parquet(f"{folder[0]}/chunk.parquet").select("chunk_id", "text")
    monkeypatch.setattr(R, "_once", lambda x, **k: once(x, 3, **k))
    before = shuffled(spark)
    got = R._encoded(chunks.union(chunks), ["word0001", "rule"], False).collect()
    assert len(got) == 6000 == len({r.chunk_id for r in got})
    assert shuffled(spark) - before < 0.3 * folder[1]
