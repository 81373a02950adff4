import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import forms, language, leakage, main_content, near_duplicates, proportions, repeated_lines, residue, splitting, tokens

DOC = "document_id string, source_path string, raw_text string, cleaned_text string, metadata struct<source_url: string>, site string, line_no string, size string, lang string"


def docs(spark, rows):
    """(id, path, raw, cleaned) with a source_url where the path is of the web, and extra columns of clashing names."""
    return spark.createDataFrame([(i, p, r, c, (f"https://{i}" if p and p.startswith("web") else None,), "x", "x", "x", "x") for i, p, r, c in rows], DOC)


# problem 1


def test_repeated_lines(spark, rows):
    texts = [(f"d{i}", "web/a.example/2024/f", None, f"body {chr(97 + i)}\nSHARE this, 5!\nonly {chr(97 + i)}\n\n12" + ("\nshare THIS" if i == 0 else "")) for i in range(5)]
    texts += [texts[0], (None, "web/a.example/1", None, "share this"), ("n", "web/a.example/1", None, None), ("e", "web/a.example/1", None, ""), ("f", "files/a.example/x", None, "share this"), ("o", "web/b.example/x", None, "share this")]
    web = repeated_lines.web_documents(docs(spark, texts))
    got = repeated_lines.repeated_lines(web)
    assert rows(got) == sorted([(f"d{i}", 2) for i in range(5)] + [("d0", 6)])
    clean = {r.document_id: r.text for r in repeated_lines.without_lines(docs(spark, texts), got).collect()}
    assert clean["d1"] == "body b\nonly b\n\n12" and clean["n"] is None and clean["f"] == "share this" and len(clean) == 9
    assert repeated_lines.repeated_lines(web.limit(0)).count() == 0


def subsequences(texts, least):
    """The closed ones of all sequences of lines that stand in at least so many texts, with their support, by enumeration."""
    import itertools
    from collections import Counter

    support = Counter()
    for t in texts:
        lines = t.split("\n")
        support.update({s for n in range(1, len(lines) + 1) for s in itertools.combinations(lines, n)})
    often = {s: n for s, n in support.items() if n >= least}
    shorter = {(s[:i] + s[i + 1 :], n) for s, n in often.items() for i in range(len(s))}
    return often, {s: n for s, n in often.items() if (s, n) not in shorter}


SEQUENCES = [
    ["a\nb\nc\nd\ne\nf", "x\na\nb\nc\ny\nd\ne\nf", "b\na\nb", "b\nb\na\na\nb", "a\nb\nc\nd\ne\nf\na", "c\nb\na"],
    ["b\na\nb"] * 6,
    ["a\na\na\na\na\na"] * 4,
    ["\n".join(random.Random(i).choices("abcd", k=7)) for i in range(14)],
]


@pytest.mark.parametrize("texts", SEQUENCES)
def test_closed_sequences_equal_brute_force(spark, texts):
    often, want = subsequences(texts, 3)
    web = repeated_lines.web_documents(docs(spark, [(f"d{i}", "web/s.example/x", None, t) for i, t in enumerate(texts)]))
    rows = repeated_lines.shown_sequences(web, min_docs=3, min_share=0.01).collect()
    got = {tuple(r.sequence.split("\n")): r.support for r in rows}
    assert len(rows) == len(got) and got == want
    inside = lambda s, t: (lambda it: all(x in it for x in s))(iter(t))
    assert all(n == max(m for t, m in got.items() if inside(s, t)) for s, n in often.items())
    assert repeated_lines.closed_sequences(web.limit(0)).count() == 0


def test_long_blocks_are_one_sequence(spark):
    block = "\n".join(["abcdefghijklmnopqrstuvwxyz"[i // 26] + "abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(7)])
    web = repeated_lines.web_documents(docs(spark, [(f"d{i}", "web/s.example/x", None, f"own {chr(97 + i)}\n{block}") for i in range(6)]))
    got = repeated_lines.shown_sequences(web).collect()
    assert [(r.sequence, r.support) for r in got] == [(block, 6)]


# problem 2

SPEECH = {
    "en": "the board shall approve the report before the meeting and the auditor will verify every figure in it",
    "fr": "le conseil doit approuver le rapport avant la réunion et l'auditeur vérifiera chaque chiffre du document",
    "de": "der Vorstand muss den Bericht vor der Sitzung genehmigen und der Prüfer wird jede Zahl darin bestätigen",
    "es": "el consejo debe aprobar el informe antes de la reunión y el auditor comprobará cada cifra del documento",
    "pt": "o conselho deve aprovar o relatório antes da reunião e o auditor verificará cada número do documento",
    "zh": "董事會必須在會議前批准報告而核數師會核實其中每項數字並向交易所提交書面確認",
}


def test_automaton_accepts_exactly_the_substrings():
    text = np.frombuffer(b"\x02\x03\x02\x02\x03\x04\x02\x03\x02", np.uint8)
    table, s = language.automaton(text), bytes(text)
    for length in range(1, 5):
        for k in range(3**length):
            word = bytes(2 + (k // 3**i) % 3 for i in range(length))
            state, ok = 0, True
            for c in word:
                state = table[state, c]
                ok = ok and state > 0
                if not ok:
                    break
            assert ok == (word in s), word


def test_cross_parsing_counts_phrases():
    make = lambda t: np.array([2 + ord(c) - 97 for c in t], np.uint8)
    p = language.CrossParser({"en": make("abcabd"), "de": make("zzz")})
    sym = make("abcabdabcx")
    cost = p.cost(sym, np.array([[0, 10]]))[0] / p.bits
    # abcabd | abc | x -> two breaks and the end
    assert cost[0] == 3 and cost[1] == 11


def test_languages_of_documents_and_lines(spark, rows):
    texts = {k: bytes(language.symbolise([v])[0]) for k, v in SPEECH.items()}
    body = lambda lang: SPEECH[lang] + "."
    d = docs(spark, [(f"d_{k}", "web/a/x", f"Home | Menu\r\n\n{body(k)}\n{body(k)}", None) for k in SPEECH] + [("d_de", "web/a/x", f"Home | Menu\r\n\n{body('de')}\n{body('de')}", None), ("n", None, None, None), ("e", None, "", None), ("num", None, "1 2 3", None), (None, None, body("fr"), None)])
    found = language.document_languages(d, texts)
    assert {r.document_id: r.lang for r in found.collect()} == {f"d_{k}": k for k in SPEECH} | {"num": None}
    labels = spark.createDataFrame([("d_en", "en-GB"), ("d_fr", "Français"), ("d_fr", "Français"), ("d_de", "EN"), ("d_es", None), ("d_pt", "??")], "document_id string, lang string")
    assert rows(language.wrong_labels(found, labels)) == [("d_de", "de"), ("d_es", "es"), ("d_pt", "pt"), ("d_zh", "zh")]
    c = spark.createDataFrame([("c", f"{body('en')}\n{body('en')}\n\n{body('zh')}\nYarandel Holdings", "x"), ("c", f"{body('en')}\n{body('en')}\n\n{body('zh')}\nYarandel Holdings", "x"), ("n", None, "x"), ("e", "", "x"), (None, body("en"), "x")], "chunk_id string, text string, lang string")
    noise = "".join(random.Random(2).choices("0123456789abcdef;=|", k=3000))
    assert language.foreign_lines(spark.createDataFrame([("c", f"{body('en')}\n{noise}", "x")], c.schema), texts).count() == 0
    lines = language.foreign_lines(c, texts).collect()
    assert [(r.chunk_id, r.line_no, r.lang) for r in lines] == [("c", 4, "zh")] and 0 < lines[0].confidence <= 1
    assert language.foreign_lines(c.limit(0), texts).count() == 0


# problem 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n中，。#-1", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_cover_and_overlap(text, limit, overlap):
    spans = splitting.pieces(text, limit, overlap)
    assert all(b - a <= limit for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert start == max(0, end - overlap)


def test_sections_nest_in_chapters():
    text = "Chapter 1\nSection 1\n1.01 a\n1.01(2) b\n1.02 c\nSection 2\nd\nChapter 2\n# e\nx | y\nz | w\n\n- f\n- g\nh"
    root = splitting.tree(text)
    show = lambda n: [text[n.start : n.end].split("\n")[0], *[show(c) for c in n.children if c.kind == "part"]]
    assert [show(c) for c in root.children] == [["Chapter 1", ["Section 1", ["1.01 a", ["1.01(2) b"]], ["1.02 c"]], ["Section 2"]], ["Chapter 2"], ["# e"]]
    assert [(c.kind, text[c.start : c.end]) for c in root.children[2].children] == [("text", "# e\n"), ("table", "x | y\nz | w\n\n"), ("list", "- f\n- g\n"), ("text", "h")]
    assert [text[a:b] for a, b in splitting.packed(text, root, 46)][:2] == ["Chapter 1\nSection 1\n1.01 a\n1.01(2) b\n1.02 c\n", "Section 2\nd\nChapter 2\n"]


def test_headings_stay_with_their_text():
    body = "word " * 30
    text = f"# A\n{body}\n# B\n{body}{body}\n# C\n{body}"
    spans = splitting.packed(text, splitting.tree(text), 200)
    assert "".join(text[a:b] for a, b in spans) == text and all(b - a <= 200 for a, b in spans)
    assert [text[a : a + 3] for a, b in spans if text[a] == "#"] == ["# A", "# B", "# C"]


def test_pieces_prefer_paragraphs_and_split_oversized(spark):
    text = "\n\n".join(["x" * 40 + "."] * 5)
    assert all(text[:b].endswith("\n\n") for _, b in splitting.pieces(text, 100, 10)[:-1])
    df = spark.createDataFrame([("a", "w " * 2000, 3, 10, 1), ("a", "w " * 2000, 3, 10, 1), ("b", "short", 0, 0, 1), ("c", None, None, None, 1), ("d", "y" * 4000, None, None, 1), (None, "z" * 4000, 0, 0, 1)], "chunk_id string, text string, chunk_order int, char_start int, char_end int")
    got = splitting.split_oversized(df).orderBy("chunk_id", "chunk_order").collect()
    a, d = [r for r in got if r.chunk_id == "a"], [r for r in got if r.chunk_id == "d"]
    assert {r.chunk_id for r in got} == {"a", "d"} and [r.chunk_order for r in a] == list(range(3, 3 + len(a))) and a[0].char_start == 10 and a[-1].char_end == 4010
    assert d[0].char_start == 0 and "".join(r.text[100 * bool(i) :] for i, r in enumerate(d)) == "y" * 4000
    assert splitting.split_oversized(df.limit(0)).count() == 0


# problem 4


def test_tilting_meets_targets():
    have, target = np.array([100.0, 10, 0, 3]), np.array([20.0, 20, 5, 0])
    p = proportions.tilted(have, target)
    assert np.allclose(have * p, [20, 10, 0, 1])
    assert proportions.tilted(np.zeros(2), np.ones(2)).tolist() == [0, 0]


def test_sample_and_gaps(spark):
    quota = spark.createDataFrame([("rule_lookup", "en", "easy", 5), ("tool_chain", "zh", "hard", 2), ("tool_chain", "en", "hard", 1)], "primary_category string, language string, difficulty string, count int")
    rows = [(f"k{i}", "Rule lookup" if i % 2 else "rule-lookup ", "EN", " easy", True) for i in range(40)] + [("k1", "rule_lookup", "en", "easy", True), ("z", "tool_chain", "zh", "hard", True), ("x", None, "en", "easy", True), ("y", "tool_chain", "en", "hard", None), ("w", "tool_chain", "en", "hard", False), (None, "tool_chain", "en", "hard", True)]
    cases = spark.createDataFrame([(*r, 1) for r in rows], "case_id string, primary_category string, language string, difficulty string, accepted boolean, count int")
    report = {(r.primary_category, r.language): (r.have, r.short) for r in proportions.gaps(cases, quota).collect()}
    assert report == {("rule_lookup", "en"): (40, 0), ("tool_chain", "zh"): (1, 1), ("tool_chain", "en"): (0, 1)}
    got = proportions.proportional_sample(cases, quota).collect()
    assert len(got) == 6 and len({r.case_id for r in got}) == 6 and sum(r.primary_category == "rule_lookup" for r in got) == 5
    assert proportions.proportional_sample(cases.limit(0), quota).count() == 0 and proportions.proportional_sample(cases, quota.limit(0)).count() == 0


def test_large_cells_meet_their_targets(spark):
    quota = spark.createDataFrame([("a", "en", "easy", 1), ("b", "en", "easy", 8), ("c", "en", "easy", 40), ("d", "en", "easy", 0)], "primary_category string, language string, difficulty string, count int")
    cases = spark.range(2000).selectExpr("concat('k', id) AS case_id", "substring('abcd', cast(id % 4 AS int) + 1, 1) AS primary_category", "'en' AS language", "'easy' AS difficulty", "true AS accepted")
    for seed in "xyz":
        got = proportions.proportional_sample(cases, quota, seed, block=25).groupBy("primary_category").agg(F.count_distinct("case_id").alias("n"), F.count("*").alias("rows")).collect()
        assert {r.primary_category: (r.n, r.rows) for r in got} == {"a": (1, 1), "b": (8, 8), "c": (40, 40), "d": (1, 1)}


def test_short_cells_are_made_up_for_on_the_marginals(spark):
    cells = [(c, x, d) for c in "abc" for x in ("en", "zh") for d in ("easy", "hard")]
    have, target = np.array([200.0] * 12), np.array([10.0, 12, 8, 10, 6, 6, 6, 6, 20, 4, 4, 8])
    have[0], have[7] = 3, 0
    shares = proportions.marginals(cells)
    expected = have * proportions.tilted(have, target, shares=shares)
    assert expected[0] == 3 and expected[7] == 0 and abs(expected.sum() - target.sum()) < 1e-6
    assert np.abs(shares.T @ expected - shares.T @ target).max() < 0.2  # 7 and 6 are missing in the cells
    assert (expected >= 1 - 1e-9)[have > 0].all() and (expected <= have + 1e-9).all()
    scarce = np.minimum(have, 4)
    assert np.allclose(scarce * proportions.tilted(scarce, target, shares=shares), scarce)
    quota = spark.createDataFrame([(*c, int(t)) for c, t in zip(cells, target)], "primary_category string, language string, difficulty string, count int")
    rows = [(f"{''.join(c)}{i}", *c, True) for c, h in zip(cells, have) for i in range(int(h))]
    cases = spark.createDataFrame(rows, "case_id string, primary_category string, language string, difficulty string, accepted boolean")
    sample = proportions.proportional_sample(cases, quota, block=60, make_up=True)
    told = {(r.primary_category, r.language, r.difficulty): r for r in proportions.report(sample, cases, quota).collect()}
    assert sample.count() == target.sum() == sample.select("case_id").distinct().count()
    assert {c: r.short for c, r in told.items() if r.short} == {cells[0]: 7, cells[7]: 6}
    assert all(abs(told[c].drawn - e) < 1 for c, e in zip(cells, expected))


# problem 5

SAME = [("Test, size 12", ["Ｔｅｓｔ， size 12", "Tеst, size 12", "Te​st, size １２", " Test,  size 12\r"]), ("é à", ["é à"]), ("ệ", ["ệ", "ệ", "ệ"]), ("profit IV", ["proﬁt Ⅳ"]), ("well-known", ["well‑known"])]


def test_forms_agree(spark):
    pairs = [(f"{i}_{j}", x) for i, (base, others) in enumerate(SAME) for j, x in enumerate([base, *others])]
    df = spark.createDataFrame([(k, x, "x", "x") for k, x in pairs] + [("n", None, "x", "x"), ("e", "", "x", "x")], "id string, t string, form string, raw string")
    got = {r.id: r.form for r in forms.consistent_form(df, "id", "t").collect()}
    for i, (base, others) in enumerate(SAME):
        assert {got[f"{i}_{j}"] for j in range(len(others) + 1)} == {base}
    assert got["n"] is None and got["e"] == ""
    assert all(got[k] == forms.fold(x) for k, x in pairs)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_fold_is_stable(text):
    once = forms.fold(text)
    assert forms.fold(once) == once and unicodedata.normalize("NFC", once) == once


def test_different_readings_stay_apart():
    for a, b in [("a", "A"), ("e", "é"), ("1", "l"), ("m²", "m2"), ("a b", "ab"), ("a\nb", "a b"), ("中", "国")]:
        assert forms.fold(a) != forms.fold(b)


def test_same_reading_pairs(spark, rows):
    df = spark.createDataFrame([("a", "test", 1), ("b", "tеst", 1), ("b", "tеst", 1), ("c", "test", 1), ("d", "ｔest", 1), ("e", "", 1), ("f", None, 1), (None, "test", 1), ("g", "Test", 1)], "id string, t string, form int")
    assert rows(forms.same_reading_pairs(df, "id", "t")) == [("a", "b"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    linked = rows(forms.same_reading_pairs(df, "id", "t", all_up_to=1))
    assert set(linked) <= {("a", "b"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")} and {("a", "b"), ("a", "d"), ("b", "d"), ("b", "c"), ("c", "d")} == set(linked)
    assert rows(forms.same_reading_classes(df, "id", "t")) == [("a", "a", 2), ("a", "b", 3), ("a", "c", 2), ("a", "d", 3)]
    assert forms.same_reading_pairs(df.limit(0), "id", "t").count() == 0 and forms.same_reading_classes(df.limit(0), "id", "t").count() == 0


def test_same_reading_pairs_of_many_texts_are_whole(spark, rows):
    texts = {"a1": "test", "a2": "test", "b1": "tеst", "b2": "tеst", "c1": "ｔest", "c2": "ｔest"}
    got = rows(forms.same_reading_pairs(spark.createDataFrame([*texts.items()], "id string, t string"), "id", "t", all_up_to=3))
    assert got == sorted((a, b) for a in texts for b in texts if a < b and texts[a] != texts[b])


# problem 6


def test_near_duplicates_equal_brute_force(spark, rows):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(60):
        base = rng.choices(words, k=rng.randint(3, 90))
        texts[f"t{i:03d}a"] = " ".join(base)
        for j in "bcd"[: rng.randint(0, 3)]:
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            texts[f"t{i:03d}{j}"] = " ".join(edit).upper() if j == "b" else " ".join(edit)
    extra = [("n", None, 1), ("e", "", 1), ("two", "a b", 1), ("t000a", texts["t000a"], 1), (None, texts["t000a"], 1)]
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + extra, "chunk_id string, text string, size int")
    sets = {k: {tuple(w[i : i + 3]) for w in [t.lower().split()] for i in range(len(w) - 2)} for k, t in texts.items()}
    want = sorted((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7)
    assert rows(near_duplicates.near_duplicate_pairs(df)) == want
    groups = {r.id: (r.class_id, r.group_id, r.links) for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert all(groups[a][1] == groups[b][1] for a, b in want) and len(groups) == sum(bool(s) for s in sets.values())
    hot = rows(near_duplicates.near_duplicate_pairs(df, all_up_to=1))
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in hot:
        root[find(a)] = find(b)
    assert set(hot) <= set(want) and all(find(a) == find(b) for a, b in want)
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0


def test_hot_copies_hide_no_other_text(spark, rows):
    base = [f"w{i}" for i in range(20)]
    text, near = " ".join(base), " ".join([*base, "more"])
    texts = {**{f"a{i}": text for i in range(4)}, "v1": text.upper(), "v2": text.replace(" ", ", "), "x": near, "y": near.upper()}
    heads = ["a0", "v1", "v2", "x", "y"]
    want = sorted([(a, b) for a in heads for b in heads if a < b] + [("a0", f"a{i}") for i in range(1, 4)])
    assert rows(near_duplicates.near_duplicate_pairs(spark.createDataFrame([*texts.items()], "chunk_id string, text string"), all_up_to=3)) == want


def test_pivot_bound_loses_nothing():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, 200)], rng.integers(0, 1 << 40, 50).astype(np.uint64)]))
        x = near_duplicates.pivot_counts(np.concatenate([a, b]), np.array([0, len(a)])).astype(int)
        assert x.sum(1).tolist() == [len(a), len(b)] and np.abs(x[0] - x[1]).sum() <= len(np.setxor1d(a, b))


def test_pivot_counts_give_the_greatest_coordinate_difference(monkeypatch):
    monkeypatch.setattr(near_duplicates, "PARTS", 6)
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64)) for n in (90, 70))
    x, y = near_duplicates.pivot_counts(np.concatenate([a, b]), np.array([0, len(a)])).astype(int)
    distance = lambda c, p: sum(c) - 2 * sum(n for i, n in enumerate(c) if p >> i & 1)  # noqa: E731  less the pivot's own size
    assert max(abs(distance(x, p) - distance(y, p)) for p in range(64)) == np.abs(x - y).sum()


def test_hot_buckets_are_cut_into_blocks(spark, rows):
    keyed = spark.createDataFrame([(n, n % 2) for n in range(60)] + [(0, 7), (59, 7), (1, 8)], "node bigint, bucket bigint")
    want = sorted({(a, b) for a in range(60) for b in range(60) if a < b and (a - b) % 2 == 0} | {(0, 59)}, key=repr)
    assert rows(near_duplicates.proposed(keyed, block=7)) == want == rows(near_duplicates.proposed(keyed))


# problem 7


def test_field_learns_and_decodes(spark, rows):
    rng = random.Random(5)
    pages = []
    for i in range(60):
        subject = lambda: "".join(rng.choices("aeioulmnrst", k=6))  # noqa: E731  lines of content don't come back all over a site
        body = [f"The issuer {rng.choice(['shall', 'must', 'may'])} file the {subject()} report {rng.randint(1, 99)}." for _ in range(rng.randint(2, 5))]
        raw = ["Home | Rules | Search", "", f"Notice about {subject()}", *body, "", "Print this page (3 KB)", "© 2024 Site a. All rights reserved."]
        pages.append((f"p{i:02d}", f"web/site-a-{i % 3}.example/2024/x", "\n".join(raw), "\n".join(raw[2:-1])))
    extra = [pages[0], ("n", "web/s.example/x", None, None), ("e", "web/s.example/x", "", ""), ("b", None, "files only", "files only"), (None, "web/s.example/x", "Home | Rules | Search", "x"), ("q", "web/s.example/x", "\n \n", "")]
    d = docs(spark, pages + extra)
    field = main_content.train(d, pages=50)
    got = main_content.boilerplate(d, field)
    want = set()
    for k, _, raw, _ in pages:
        n = len(raw.split("\n"))
        want |= {(k, 1), (k, n - 1), (k, n)}
    assert set(rows(got)) == want
    text = {r.document_id: r.main_text for r in main_content.main_content(d, field).collect()}
    assert text["p00"] == pages[0][2].split("\n\n")[1] and text["e"] == "" and "b" not in text
    assert main_content.boilerplate(d.limit(0), main_content.train(d.limit(0))).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = main_content.Field({str(i): float(rng.normal()) for i in range(6)}, rng.normal(size=(2, 2)), rng.normal(size=2))
    lines = [[str(i)] for i in range(6)]

    def score(y):
        return field.start[y[0]] + sum(field.weights[str(i)] * s for i, s in enumerate(y)) + sum(field.edge[a, b] for a, b in zip(y, y[1:]))

    best = max(([k >> i & 1 for i in range(6)] for k in range(64)), key=score)
    assert field.decode(lines) == best and field.decode([]) == []


# problem 8

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_reference_and_decode(spark, reference):
    texts = ["Hello  world\r\n\t it's <|endoftext|>", "第14.52條 中文", "", None, "a" * 3000, " ", "é́😀‍", "x1y22 333"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null key", "x"), (0, texts[0], "x")], "doc_id bigint, text string, ids string")
    got = tokens.token_ids(df)
    by = {r.doc_id: r.ids for r in got.collect()}
    assert got.count() == len(texts) + 2 and all(by[i] == reference.encode_ordinary(t or "") for i, t in enumerate(texts)) and by[None] == reference.encode_ordinary("null key")
    back = {r.doc_id: r.text for r in tokens.decoded(got).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_fuzz_against_the_reference(reference):
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(0, 400), 0x3000, 0x4E2D, 0x1F600, 0x301, 0x85, 0x1C, 0x2003]] + list("aaab    \n's")
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 50))) for _ in range(400)] + ["ab" * 700, "中文" * 500, "z" * 257]
    own = tokens.encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert all(a.tolist() == reference.encode_ordinary(t) for a, t in zip(own.encode(texts), texts))


# problem 9


def test_leaks_equal_brute_force(spark, rows):
    rng = random.Random(4)
    words, han = [f"w{i}" for i in range(80)], "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉"
    items = [(i, " ".join(rng.choices(words, k=30)), "en") for i in range(6)] + [(i, "".join(rng.choices(han, k=50)), "zh") for i in range(6, 10)] + [(3, "dup", "en"), (90, None, "en"), (91, "", "zh"), (92, "un mot", "fr")]
    items[10] = (11, "short text", "en")
    texts = []
    for n in range(60):
        i, t, lang = items[n % 10]
        parts = t.split() if lang == "en" else list(t)
        size = rng.choice([8, 11, 12, 13, 20] if lang == "en" else [20, 23, 24, 25, 40])
        at = rng.randrange(len(parts) - size + 1)
        piece = parts[at : at + size]
        if n % 4 == 0:
            piece.insert(size // 2, "indeed" if lang == "en" else "又")
        joined = ("  , " if n % 3 else " ").join(piece).upper() if lang == "en" else "，".join(piece)
        texts.append((n, f"{' '.join(rng.choices(['foo', 'bar', 'baz'], k=rng.randint(0, 9)))} {joined} end", 1))
    df = spark.createDataFrame(texts + [texts[1], (100, None, 1), (101, "", 1), (None, items[0][1], 1)], "doc_id bigint, text string, item_id int")
    held = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in items], "item_id bigint, text string, lang string, doc_id string")
    want = set()
    for n, t, _ in texts:
        w = leakage.words_of(t)
        for i, it, lang in items:
            if it and lang in leakage.RUN:
                k, v = leakage.RUN[lang], leakage.words_of(it)
                grams = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)}
                if any(tuple(w[a : a + k]) in grams for a in range(len(w) - k + 1)):
                    want.add((n, i))
    assert set(rows(leakage.leaks(df, held))) == want and want
    assert leakage.leaks(df.limit(0), held).count() == 0 and leakage.leaks(df, held.limit(0)).count() == 0


def test_common_subsequence_and_paraphrases(spark):
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(9)
    for _ in range(60):
        a, b = rng.choices("abcd", k=rng.randint(0, 9)), rng.choices("abcd", k=rng.randint(0, 12))
        assert leakage.common_subsequence(a, b) == plain(a, b)
    item = "Suppose Orvilka Foods sells 28 percent of Zephury Energy to Morara Marine for 42 million on 17 March while the auditor objects to the price"
    para = item.replace("Suppose", "Assume").replace("objects", "protests").replace("while", "and")
    got = leakage.leaks(spark.createDataFrame([(1, f"intro {para} outro"), (2, "nothing of that sort stands here at all")], "doc_id bigint, text string"), spark.createDataFrame([(7, item, "en")], "item_id bigint, text string, lang string"), paraphrases=True).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and 0.7 <= got[0].overlap < 1


def test_planted_paraphrases_are_found(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(25, 60)) + [str(rng.randint(10, 99))])) for i in range(60)]

    def edited(text):
        out = []
        for w in text.split():
            r = rng.random()
            out += [] if r < 0.06 else [rng.choice(words)] if r < 0.12 else [w, rng.choice(words)] if r < 0.18 else [w]
        return " ".join(out)

    texts = [(i, f"{' '.join(rng.choices(words, k=40))} {edited(t)} {' '.join(rng.choices(words, k=40))}") for i, t in items] + [(1000 + i, " ".join(rng.choices(words, k=150))) for i in range(200)]
    got = leakage.leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(*x, "en") for x in items], "item_id bigint, text string, lang string"), paraphrases=True).collect()
    assert all(r.doc_id == r.item_id for r in got) and len(got) >= 0.9 * len(items)


def test_partial_products_add_up_in_a_tree(spark, monkeypatch):
    rng = random.Random(3)
    items = leakage.Items([(1, " ".join(rng.choices("abcdefgh", k=30)), "en")])
    texts = leakage.numbered_texts(spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=40))) for i in range(40)], "doc_id bigint, text string").repartition(7), items)
    idf = np.ones(len(items.vocabulary))
    monkeypatch.setattr(leakage, "FAN", 2)
    tree = leakage.latent_space(texts.repartition(7), items, idf)
    monkeypatch.setattr(leakage, "FAN", 32)
    flat = leakage.latent_space(texts.repartition(7), items, idf)
    assert np.allclose(tree @ tree.T, flat @ flat.T, atol=1e-6)


# problem 10


def test_residue(spark):
    content = "The issuer shall file the annual report before the meeting. The board must approve it in writing."
    yes = {
        1: f"{content} Dear {{{{ issuer_name }}}}, the board confirms.", 2: f"{content}\nOn XX/XX/20XX, ${{company}} reported.", 3: "Contact [INSERT DATE] now.", 4: f"{content} comes to #REF!, which is fine.", 5: f"{content}\nText goes here. Text goes here.",
        6: "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", 7: "Home | Rules\n404 - the page you asked for could not be found.\nGo back to the start page", 8: "Please enable JavaScript to view this document.", 9: "Zugriff verweigert. Sie haben keine Berechtigung.", 10: "伺服器發生錯誤，無法完成要求。代碼55。",
        11: "A new applicant of null is expected to publish it.", 12: "Published no later than None.", 13: f"{content} <insert amount> is due.", 14: "如有查詢，請聯絡%ISSUER%。",
    }
    no = {
        50: content, 51: "The set {w, x, y} denotes the three classes of shares described in rule 11.18.", 52: f"[Repealed with effect from 2017-09-11] {content}", 53: f"[Note: see also rule 1.77] {content}", 54: f"The filing gateway answers with error 404 when the number is unknown. {content}",
        55: f"Forms rely on JavaScript, so the issuer should test its equipment before filing. {content}", 56: f"<|endoftext|> {content}", 57: None, 58: "", 59: " \n ", 60: "The agreement is null and void from 2020. " + content, 61: "None of the directors may vote. " + content,
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in {**yes, **no}.items()] + [(1, yes[1], "x"), (None, yes[1], "x")], "doc_id bigint, text string, filler string")
    got = [r.doc_id for r in residue.residue_documents(df).collect()]
    assert sorted(got) == sorted(yes)
    assert residue.residue_documents(df.limit(0)).count() == 0
    why = {r.doc_id: (r.slot, r.filler, r.message) for r in residue.residue_documents(df, reasons=True).collect()}
    assert why[1][0] and why[5][1] and why[7][2]


def test_very_long_texts(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    df = spark.createDataFrame([("a", long, None, 0), ("b", long + " end", 0, None)], "chunk_id string, text string, chunk_order int, char_start int")
    assert near_duplicates.near_duplicate_pairs(df).count() == 1
    assert splitting.split_oversized(df).groupBy("chunk_id").count().count() == 2
    assert len(re.findall("word", forms.fold(long))) == 40_000
