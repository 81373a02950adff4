import difflib
import random

from pyspark.sql import functions as F

from quarry.operators import dedupe, retrieval


def similar(a, b):
    x, y = set(a.split()), set(b.split())
    ratio = max(difflib.SequenceMatcher(None, p, q).ratio() for p, q in ((a, b), (b, a)))
    return max(ratio, len(x & y) / len(x | y)) >= 0.9


def test_near_questions_equal_the_loop(spark, rows):
    rng = random.Random(3)
    words = ["what", "rule", "board", "issuer", "shall", "file", "notice", "report", "price", "must", "approve", "waiver", "sponsor"]
    texts = ["abcde", "abxcde", "ab", "aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaa"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(4, 14))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            t = list(" ".join(base))
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        texts.append(" ".join(reversed(base)))
    texts = sorted({t.strip() for t in texts})
    rng.shuffle(texts)
    data = [(f"k{i:03d}", t) for i, t in enumerate(texts)] + [("k900", texts[0].upper()), ("k901", None), ("k902", ""), (None, "what")]
    df = spark.createDataFrame([(*r, "x") for r in data], "case_id string, query string, id string")
    members, pairs = dedupe.near_pairs(df, "case_id", "query")
    names = {r.node: r.key for r in members.groupBy("node").agg(F.min("key").alias("key")).collect()}
    got = sorted(tuple(sorted((names[r.a], names[r.b]))) for r in pairs.collect())
    want = sorted((f"k{i:03d}", f"k{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if similar(texts[i], texts[j]))
    miss = [(dict(data)[a], dict(data)[b]) for a, b in set(want) - set(got)]
    assert miss == [] and got == want and want
    held = []
    for k, t in data[: len(texts)]:
        if not any(similar(h, t) for _, h in held):
            held.append((k, t))
    assert sorted(r.case_id for r in dedupe.accepted_in_order(df, "case_id", "query").collect()) == [k for k, _ in held]
    assert dedupe.accepted_in_order(df.limit(0), "case_id", "query").count() == 0


def test_neighbours_of_all_vectors_are_nearly_exact(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    v = [(i, [x + rng.gauss(0, 0.4) for x in centres[rng.randrange(12) if i % 3 else 0]]) for i in range(600)]
    df = spark.createDataFrame(v, "chunk_id bigint, embedding array<double>")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.dense(df.withColumnRenamed("chunk_id", "query_id"), df, k=5, drop_self=True).collect()}
    near = {(r.query_id, r.chunk_id) for r in retrieval.approximate_neighbours(df, k=5, lists=16, probes=5, block=50).collect()}
    assert len(exact) == len(near) == 3000 and len(exact & near) >= 0.9 * len(exact)


def test_questions_of_few_patterns_are_not_all_compared(spark, rows):
    from tests.test_search_size import shuffled

    rng = random.Random(9)
    texts = sorted({f"what does rule {rng.randint(1, 40)}.{rng.randint(1, 99)} require of the {a} {b} in year {rng.randint(1950, 2030)}?" for a in ("sponsor", "issuer", "auditor") for b in ("board", "group", "adviser") for _ in range(40)})
    df = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "id string, t string")
    want = sorted((f"{i:04d}", f"{j:04d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if max(difflib.SequenceMatcher(None, p, q).ratio() for p, q in ((texts[i], texts[j]), (texts[j], texts[i]))) >= 0.9)
    before = shuffled(spark)
    assert rows(dedupe.sequence_pairs(df)) == want and 0 < len(want) < len(texts) ** 2 / 4
    assert shuffled(spark) - before < 20 * sum(map(len, texts))
    assert rows(dedupe.sequence_pairs(df, block=50)) == want
