import math

from pyspark.sql import functions as F

from quarry.operators import corpus, evaluation, governance, graph, retrieval, sessions
from quarry.plans import graph as graph_plans


def test_bm25_matches_brute_force(spark, rows):
    texts = {"a": "red fox red", "b": "blue fox", "c": "green", "d": "", "e": None}
    docs = spark.createDataFrame([*texts.items(), ("a", "red fox red")], "chunk_id string, text string")
    got = retrieval.bm25(spark.createDataFrame([("q", "red fox fox")], "query_id string, text string"), docs)
    words = {k: (v or "").split() for k, v in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    want = {}
    for k, w in words.items():
        s = 0.0
        for t in ["red", "fox", "fox"]:
            df = sum(t in x for x in words.values())
            tf = w.count(t)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
        if s > 0:
            want[k] = round(s, 6)
    assert {r.chunk_id: r.score for r in got.collect()} == want


def test_bm25_of_no_chunks_or_queries_is_empty(spark):
    none = spark.createDataFrame([], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "x")], "query_id string, text string")
    assert retrieval.bm25(q, none).count() == 0
    assert retrieval.bm25(q.limit(0), spark.createDataFrame([("a", "x")], "chunk_id string, text string")).count() == 0


def test_fusion_ties_and_normalisation(spark):
    lists = spark.createDataFrame([("q", "s", "a", 0.5, 1), ("q", "s", "b", 1.0, 2), ("q", "t", "b", 0.2, 1), ("q", "t", "a", 0.2, 2), ("q", "s", "c", 0.0, 3)], "query_id string, signal string, chunk_id string, score double, rank int")
    fused = {r.chunk_id: (r.score, r["rank"]) for r in retrieval.reciprocal_rank_fusion(lists, k=60).collect()}
    assert fused["a"][0] == fused["b"][0] == round(1 / 61 + 1 / 62, 9) and fused["a"][1] == 1 and fused["b"][1] == 2
    assert fused["c"][0] == round(1 / 63, 9)
    scaled = {(r.signal, r.chunk_id): r.normalized for r in retrieval.min_max(lists).collect()}
    assert scaled["s", "a"] == 0.5 and scaled["s", "b"] == 1.0 and scaled["s", "c"] == 0.0 and scaled["t", "a"] == 1.0


def test_dense_is_exact_with_ties_by_id(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id bigint, embedding array<float>")
    got = retrieval.dense(v.where("chunk_id = 1").withColumnRenamed("chunk_id", "query_id"), v, k=2)
    assert [(r.chunk_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]


def test_evidence_prefers_rules_and_reports_diversity(spark):
    r = spark.createDataFrame([("q", "a", 0.9, None, "S"), ("q", "b", 0.1, "14.1", "S"), ("q", "b", 0.2, "14.1", "S"), ("q", "c", 0.5, "14.2", None)], "query_id string, chunk_id string, score double, rule_number string, section_title string")
    sel = retrieval.evidence(r)
    assert [x.chunk_id for x in sel.orderBy("place").collect()] == ["c", "b", "a"]
    d = retrieval.diversity(sel).first()
    assert d.n == 3 and d.diversity == round((2 / 3 + 1 / 3) / 2, 6) and d.rules == ["14.2", "14.1"]


def test_blocks_and_hierarchy(spark):
    text = "Chapter 14: A\n14.1: x\nbody\nChapter 15: B\n15A.2: y\n15A.2: z"
    b = corpus.structure_blocks(spark.createDataFrame([("d", text), ("e", None), ("f", "plain")], "document_id string, text string"))
    got = [(r.document_id, r.kind, r.number, r.chapter) for r in b.orderBy("document_id", "start", "kind").collect()]
    assert got[0] == ("d", "chapter", "14", "Chapter 14: A") and ("d", "rule", "14.1", "Chapter 14: A") in got and ("d", "rule", "15A.2", "Chapter 15: B") in got
    assert ("e", "document", None, None) in got and ("f", "document", None, None) in got
    ids = sorted(r.chunk_id for r in corpus.chunks(b).where("document_id = 'd'").collect())
    assert "d:15A.2:0" in ids and "d:15A.2:0#1" in ids
    last = corpus.structure_blocks(spark.createDataFrame([("d", text)], "document_id string, text string"), compat=True).where("kind = 'rule' and number = '14.1'").first()
    assert last.chapter == "Chapter 15: B"


def test_packing_and_windows(spark):
    out = corpus.packed(["a" * 60, "b" * 60, "c" * 250], 100, 10)
    assert out[0] == "a" * 60 and out[1] == "a" * 10 + "\n\n" + "b" * 60 and [len(x) for x in out[2:]] == [100, 100, 70]
    w = corpus.windows(spark.createDataFrame([(1, "x" * 3000), (2, ""), (3, None)], "doc_id bigint, text string"))
    assert [(r.chunk_order, r.char_start, r.char_end) for r in w.orderBy("chunk_order").collect()] == [(0, 0, 1500), (1, 1400, 2900), (2, 2800, 3000)]


def test_kept_lines_fold(spark):
    df = spark.createDataFrame([(1, "a\na\nb\na\nb\na\nb\na\nb"), (2, None)], "k int, t string")
    got = {r.k: r.text for r in corpus.kept_lines(df, "k", "t").collect()}
    assert got == {1: "a\nb\na\nb\na\nb", 2: ""}


def test_edges(spark, rows):
    n = spark.createDataFrame([("c1", "r"), ("c2", "r"), ("c3", "r"), ("c4", "r"), ("c5", None), ("c5", "")], "chunk_id string, g string")
    e = graph.canonical_edges(graph.neighbour_edges(n, "g", "same_rule"))
    assert {(r.src, r.dst) for r in e.collect()} == {("c1", "c2"), ("c2", "c3"), ("c3", "c4"), ("c1", "c3"), ("c2", "c4")}
    twice = spark.createDataFrame([("b", "a", "x", 0.5), ("a", "b", "x", 0.7), ("a", "a", "x", 1.0)], "src string, dst string, relation string, weight double")
    assert rows(graph.canonical_edges(twice)) == [("b", "x", "a", 0.7)]


def chunks(spark, folder, rows):
    """A data folder with a chunk table of (chunk_id, document_id, chapter, section_title, source_path, text)."""
    spark.createDataFrame([(*r, None) for r in rows], "chunk_id string, document_id string, chapter string, section_title string, source_path string, text string, rule_number string").write.parquet(f"{folder}/chunk.parquet")
    return str(folder)


def test_sections_chapters_and_keywords_link_documents(spark, tmp_path):
    d = chunks(spark, tmp_path, [("a1", "a", "1", "Share  Issues", "files/main_board/x", "a disposal"), ("b1", "b", "1", "share issues", "files/main_board/y", "none"), ("c1", "c", "1", "Ｓhare issues", "files/gem/z", "Disposal"), ("d1", None, "2", "", "", "GEM report"), ("e1", "e", "2", None, None, "of gem")])
    got = {(r.src, r.dst, r.relation) for r in graph_plans.corpus_neighbour_edges(spark, d).collect()}
    assert got == {("a1", "b1", "same_section"), ("b1", "c1", "same_section"), ("a1", "b1", "same_chapter"), ("d1", "e1", "same_chapter"), ("a1", "c1", "keyword_overlap")}


def test_topics_link_documents(spark, tmp_path):
    d = chunks(spark, tmp_path, [(x, x, None, None, None, t) for x, t in [("a", "a disposal"), ("b", "none"), ("c", "Disposal"), ("d", "出售事項"), ("e", "disposal, financing")]])
    got = {(r.src, r.dst) for r in graph_plans.corpus_topic_edges(spark, d).collect()}
    assert got == {("a", "c"), ("a", "d"), ("c", "d"), ("c", "e"), ("d", "e")}


def test_rotating_pairs_shift_on_self(spark):
    left, right = spark.createDataFrame([(x,) for x in "abcde"], "id string"), spark.createDataFrame([(x,) for x in "ab"], "id string")
    assert {(r.src, r.dst) for r in graph.rotating_pairs(left, right).collect()} == {("a", "b"), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "a")}
    assert graph.rotating_pairs(left, right.limit(0)).count() == 0


def test_metrics_have_null_for_empty_denominators(spark):
    r = spark.createDataFrame([("s", ["a", "b"], ["x", "a"]), ("s", [], ["x"]), ("t", None, None)], "system string, gold array<string>, retrieved array<string>")
    m = {x.system: x for x in evaluation.retrieval_metrics(r).collect()}
    assert (m["s"].hit_at_5, m["s"].context_recall, m["s"].context_precision, m["s"].mrr) == (0.5, 0.5, 0.5, 0.5)
    assert m["t"].mrr is None and m["t"].hit_at_5 == 0


def test_kappa_mcnemar_bootstrap(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "b")], "l string, r string")
    k = evaluation.kappa(p, "l", "r").first()
    assert k.n == 4 and k.observed == 0.75 and abs(k.kappa - 0.5) < 1e-6
    assert evaluation.kappa(spark.createDataFrame([("a", "a")], "l string, r string"), "l", "r").first().kappa is None
    o = spark.createDataFrame([(True, False)] * 1 + [(False, True)] * 6 + [(True, True)] * 3, "a boolean, b boolean")
    m = evaluation.mcnemar(o, "a", "b").first()
    want = min(1.0, 2 * sum(math.comb(7, i) * 0.5**7 for i in (0, 1)))
    assert (m.a_only, m.b_only) == (1, 6) and abs(m.p_value - round(want, 6)) < 1e-9
    assert evaluation.mcnemar(o.where("a and b"), "a", "b").first().p_value == 1.0
    b = evaluation.bootstrap(o.selectExpr("'c' as k", "cast(a as int) as a", "cast(b as int) as b"), "k", "a", "b").first()
    assert b.case_count == 10 and abs(b.mean_difference - 0.5) < 1e-9 and b.ci_low < 0.5 < b.ci_high


def test_duplicates_completeness_layers(spark, rows):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, h string")
    assert rows(governance.duplicate_groups(d, "h", "id", ["id"])) == [(1, 2, 1), (1, 2, 2), (3, 1, 3), (4, 1, 4)]
    want, have = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (2,), (3,)], "id int")
    assert rows(governance.completeness(want, have, "id")) == [(1, "missing"), (2, "repeated"), (3, "unexpected")]
    low, high = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string"), spark.createDataFrame([(1, "new")], "id int, v string")
    assert rows(governance.layered([low, high], "id")) == [(1, "new"), (2, "old")]


def test_greedy_acceptance_equals_the_loop(spark):
    ids = list(range(12))
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (5, 7), (6, 7), (7, 8), (8, 11)]
    accepted = []
    for i in ids:
        if not any((a, i) in pairs for a in accepted):
            accepted.append(i)
    got = governance.first_without_near_duplicate(spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame(pairs, "a int, b int"))
    assert sorted(r.id for r in got.collect()) == accepted


def test_greedy_acceptance_decides_long_chains(spark):
    n = 104
    ids, chain = spark.range(n).select(F.col("id").cast("int")).coalesce(1), spark.range(n - 1).selectExpr("cast(id AS int) AS a", "cast(id + 1 AS int) AS b").coalesce(1)
    assert sorted(r.id for r in governance.first_without_near_duplicate(ids, chain).collect()) == list(range(0, n, 2))


def test_sessions(spark):
    t = spark.createDataFrame([("c", f"q{i}", i) for i in range(5)] + [(None, "x", 1)], "s string, q string, at int")
    assert [r.q for r in sessions.recent(t, "s", ["at"], 2).orderBy("place").collect()] == ["q4", "q3"]
    assert sessions.history(t, "s", "q", ["at"]).first().summary == "Earlier questions covered: q2; q3; q4"


def test_breakdowns_and_sample(spark, rows):
    r = spark.createDataFrame([("x", "e", True), ("x", None, False)], "a string, b string, success boolean")
    assert rows(evaluation.breakdowns(r, ["a", "b"])) == [("a", 2, 0.5, 1, "x"), ("b", 1, 0.0, 0, None), ("b", 1, 1.0, 1, "e")]
    cases = spark.createDataFrame([(f"k{i}", "x") for i in range(9)] + [("k0", "x"), ("n", None)], "case_id string, a string")
    q = spark.createDataFrame([("x", 3)], "a string, count int")
    got = evaluation.stratified(cases, q, ["a"])
    assert got.count() == 3 and got.select("case_id").distinct().count() == 3


def test_dense_filter_reaches_the_window(spark):
    plan = retrieval.ranked(spark.createDataFrame([("q", "a", 1.0)], "query_id string, chunk_id string, score double"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
