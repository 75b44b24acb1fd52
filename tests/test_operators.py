import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import predicates, text
from scholia.operators import catalogue, chunking, extraction, grading, lines, mastery, retrieval, srs, structure, training

#: Accuracy, latency, attempts, severity, hints; centroid, score, tier.
SCENARIOS = [
    (100.0, 15, 1, 0.0, 0, 96.0, 98.5, "High Mastery"),
    (85.0, 30, 1, 0.1, 0, 96.0, 95.6, "High Mastery"),
    (100.0, 45, 2, 0.0, 0, 82.0, 85.0, "High Mastery"),
    (90.0, 75, 1, 0.1, 0, 87.8, 91.2, "High Mastery"),
    (100.0, 60, 2, 0.2, 1, 55.0, 59.1, "Developing"),
    (55.0, 35, 1, 0.4, 0, 68.5, 62.3, "Developing"),
    (100.0, 65, 3, 0.0, 1, 45.1, 47.8, "Intervention Required"),
    (100.0, 110, 4, 0.2, 2, 23.6, 15.2, "Intervention Required"),
    (0.0, 75, 2, 0.9, 0, 22.0, 8.0, "Intervention Required"),
    (0.0, 50, 2, 1.0, 1, 22.0, 5.0, "Intervention Required"),
]


def fuzzy(spark, rows):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, acc double, lat int, att int, sev double, hin int")
    return grading.with_fuzzy_score(df, "acc", "lat", "att", "sev", "hin").orderBy("i").collect()


def test_fuzzy_scenarios(spark):
    for r, s in zip(fuzzy(spark, SCENARIOS), SCENARIOS, strict=True):
        assert abs(r["centroid_score"] - s[5]) <= 1.5 and abs(r["fuzzy_score"] - s[6]) <= 1.5 and r["performance_tier"] == s[7]


def test_fuzzy_falls_with_attempts(spark):
    scores = [r["fuzzy_score"] for r in fuzzy(spark, [(100.0, 45, n, 0.0, 0) for n in range(1, 6)])]
    assert all(a > b for a, b in zip(scores, scores[1:], strict=False))


def test_similarity(spark):
    rows = [("4", "4"), ("Force", "force"), ("x = 5", "5"), ("it is equal to nRT", "nRT"), ("8.31 unit", "8.314 unit"), ("cats run", "quantum fields bend"), ("", "a"), ("force equals mass times speed", "force is mass times acceleration")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, e string")
    got = [r["v"] for r in df.select("i", grading.answer_similarity(F.col("s"), F.col("e")).alias("v")).orderBy("i").collect()]
    assert got[:4] == [1.0, 1.0, 1.0, 0.95] and got[4] == 0.92 and got[5] < 0.2 and got[6] == 0.0 and got[7] == 0.5


def test_sm2(spark):
    rows = [(1, "s", "c", "", 4), (2, "s", "c", "k", 5), (3, "s", "c", None, 1), (4, "t", "c", "k", 9), (5, "t", "c", "k", 5), (6, "t", "c", "k", 3)]
    df = spark.createDataFrame(rows, "review_id long, student_id string, card_id string, course_id string, quality int").withColumn("review_ts", F.timestamp_seconds(F.col("review_id") * 100))
    got = {r["student_id"]: r for r in srs.schedules(df).collect()}
    assert (got["s"]["repetitions"], got["s"]["interval_days"], got["s"]["course_id"]) == (0, 1, "k")
    assert (got["t"]["repetitions"], got["t"]["interval_days"], got["t"]["easiness_factor"]) == (3, 16, 2.56)
    after = {n: srs.schedules(df.filter(f"review_id <= {n} and student_id = 's'")).first() for n in (1, 2)}
    assert [(after[n]["repetitions"], after[n]["interval_days"]) for n in (1, 2)] == [(1, 1), (2, 6)]


def test_mastery(spark):
    rows = [(i, "s", "c", f"ch_{i % 2}", i % 2, 50.0 + i, 1.0) for i in range(2)]
    a = spark.createDataFrame(rows, "attempt_id long, student_id string, course_id string, chapter_id string, is_correct int, fuzzy_score double, latency_seconds double")
    a = a.withColumn("ts", F.timestamp_seconds("attempt_id"))
    assert mastery.chapter_mastery_exact(a).count() == 2
    new = spark.createDataFrame([("s",), ("new",)], "student_id string")
    got = {r["student_id"]: r for r in mastery.student_summary(a, new).collect()}
    assert got["s"]["accuracy_rate"] == 50.0 and got["new"]["learning_trajectory"].startswith("New Student")


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "cell biology of plants"), (1, "newton force and motion force"), (2, "gas pressure and volume")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "force motion"), (1, "pressure volume"), (2, "zzz")], "query_id long, text string")
    best = retrieval.top(retrieval.bm25(docs, queries), "query_id", 1, F.desc("score"), "doc_id").collect()
    assert {r["query_id"]: r["doc_id"] for r in best} == {0: 1, 1: 2}


def test_dense_top_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(8)], i % 3) for i in range(200)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>, label int").repartition(5)
    q = v.filter("doc_id < 4").withColumnRenamed("doc_id", "query_id")
    got = retrieval.dense_top(v, q, 5, same="label").collect()
    for k in range(4):
        own = sorted((round(sum((a - b) ** 2 for a, b in zip(rows[k][1], r[1], strict=True)), 3), r[0]) for r in rows if r[2] == rows[k][2])[:5]
        assert {r["doc_id"] for r in got if r["query_id"] == k} == {i for _, i in own}


def test_many_queries_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS", 30)
    monkeypatch.setattr(retrieval, "QUERIES", 25)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(150)] + [(999, None)]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    got = {}
    for r in retrieval.dense_top(v, v.withColumnRenamed("doc_id", "query_id"), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["doc_id"])
    assert set(got) == set(range(150))
    for k, found in got.items():
        every = sorted((sum((a - b) ** 2 for a, b in zip(rows[k][1], x, strict=True)), i) for i, x in rows[:150])[:4]
        assert [found[i + 1] for i in range(4)] == every
    assert retrieval.dense_top(v.limit(0), v.withColumnRenamed("doc_id", "query_id"), 4).count() == 0


def test_terms_of_empty_documents_count(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None), (3, "b")], "doc_id long, text string")
    t = {(r["doc_id"], r["term"]): (r["length"], r["tf"], r["first"]) for r in retrieval.term_table(docs).collect()}
    assert t == {(0, "a"): (3, 2, True), (0, "b"): (3, 1, False), (1, None): (0, 0, True), (2, None): (0, 0, True), (3, "b"): (1, 1, True)}
    pairs = spark.createDataFrame([(7, 0), (7, 1)], "query_id long, doc_id long")
    scores = retrieval.bm25(docs, spark.createDataFrame([(7, "a")], "query_id long, text string"))
    assert {r["doc_id"]: r["score"] > 0 for r in retrieval.with_zeros(pairs, scores).collect()} == {0: True, 1: False}


def test_answer_records_and_profiles(spark):
    schema = "submission_id long, student_id string, course_id string, chapter_id string, tier string, question_text string, expected_answer string, student_raw_input string, seconds_spent int, attempts_count int, hints_requested int, hint_level int, hint_formula string, hint_misconception string"
    base = (None, "c", "", "Class 9", "Q" * 50, "42", "seven", 10, 1, 0)
    rows = [(1, *base, 1, "", None), (2, *base, 2, "dv/dt = a, the final answer is 42", ""), (3, *base, 3, None, "x"), (4, *base[:-4], "42", 10, 1, 0, 1, "", "")]
    got = {r["submission_id"]: r for r in grading.answer_records(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["student_id"] == "default_student" and got[1]["chapter_id"] == "ch_1" and got[1]["question_id"] == "Q" * 40
    assert got[1]["assigned_hint"].count("\n") == 2 and "rate of change of speed" in got[2]["assigned_hint"] and "42" not in got[2]["assigned_hint"]
    assert got[3]["gap_analysis"] in got[3]["assigned_hint"] and got[4]["is_correct"] and got[4]["assigned_hint"].startswith("Right!")
    exams = grading.exam_totals(spark.createDataFrame([(1, 0, 0, 50), (2, 10, 8, 99)], "submission_id long, total_questions long, correct_answers long, total_elapsed_time long"))
    assert [tuple(r)[1:] for r in exams.orderBy("submission_id").collect()] == [(1, 0, 0.0, 50, 1, 0.6), (10, 8, 80.0, 9, 1, 0.0)]


def test_history_ends_in_the_schedule(spark):
    rng = random.Random(4)
    rows = [(i, f"s{i % 3}", f"c{i % 2}", "k", rng.randint(-1, 7)) for i in range(200)]
    r = spark.createDataFrame(rows, "review_id long, student_id string, card_id string, course_id string, quality int").withColumn("review_ts", F.timestamp_seconds(F.col("review_id") * 90_000))
    last = {(x["student_id"], x["card_id"]): x for x in srs.review_history(r).orderBy("review_ts").collect()}
    want = {(x["student_id"], x["card_id"]): x for x in srs.schedules(r).collect()}
    columns = ("repetitions", "interval_days", "easiness_factor", "next_review")
    assert {k: [x[c] for c in columns] for k, x in last.items()} == {k: [x[c] for c in columns] for k, x in want.items()}
    assert srs.review_history(r).count() == 200


def test_long_runs_of_good_reviews_keep_their_days(spark):
    r = spark.range(40).selectExpr("id as review_id", "'s' as student_id", "'c' as card_id", "'k' as course_id", "4 as quality", "timestamp_seconds(id * 90000) as review_ts")
    got = srs.review_history(r).selectExpr("review_id", "interval_days", "datediff(next_review, to_date(review_ts)) as days").orderBy("review_id").collect()
    assert [x["interval_days"] for x in got[:5]] == [1, 6, 15, 38, 95] and got[15]["interval_days"] > 2_000_000
    assert all(x["days"] == x["interval_days"] for x in got) and got[-1]["interval_days"] == srs.MOST_DAYS
    assert srs.schedules(r).select("interval_days").first()["interval_days"] == srs.MOST_DAYS


@pytest.mark.parametrize(
    ("spec", "numbers", "label"),
    [
        ("1,3,5-8", [1, 3, 5, 6, 7, 8], "1, 3, 5-8 (6 of 9)"),
        ("8-50", [8, 9], "8-9 (2 of 9)"),
        ("99", range(1, 10), "1-9 (9 of 9)"),
        ("garbage", range(1, 10), "1-9 (9 of 9)"),
        (None, range(1, 10), "1-9 (9 of 9)"),
        (" ALL ", range(1, 10), "1-9 (9 of 9)"),
        ("5", range(1, 6), "1-5 (5 of 9)"),
        ("0", range(1, 10), "1-9 (9 of 9)"),
        ("5-2, 7", [7], "7 (1 of 9)"),
    ],
)
def test_selection(spark, spec, numbers, label):
    c = spark.createDataFrame([("a", i) for i in range(1, 10)], "course_id string, chapter_index int")
    got = catalogue.selected_chapters(c, spark.createDataFrame([("a", spec)], "course_id string, spec string"))
    assert sorted(r["chapter_index"] for r in got.collect()) == list(numbers)
    assert catalogue.selection_labels(got, c).first()["label"] == label


def test_grounded_merge_of_odd_rows(spark):
    theory = spark.createDataFrame(
        [(k, "Waves", "Class 9", "own", [{"type": "definition", "concept": "Wave", "text": "wave that moves"}, {"type": "definition", "concept": "Trip", "text": "a trip by car"}], None) for k in ("none", "empty", "full")],
        "chapter_id string, title string, tier string, summary string, facts array<struct<type:string,concept:string,text:string,lhs:string,rhs:string,full:string,value:string>>, examples array<struct<source:string,content:string>>",
    )
    rows = [("empty", None, [None, " "], None, None, None, [(None, "")], None), ("full", "A dv/dt", ["Go"], [("P", "the integral", None)] * 6, [(None, "x", None, None, None)] * 5, [("C", None, None)], [("T", None)], [(None, "c", None, None)] * 5)]
    got = {r["chapter_id"]: r for r in extraction.grounded_merge(theory, spark.createDataFrame(rows, extraction.BLUEPRINT)).collect()}
    assert [got[k]["theory_source"] for k in ("none", "empty", "full")] == ["extracted", "extracted", "blueprint"]
    for k in ("none", "empty"):
        assert [tuple(p) for p in got[k]["principles"]] == [("Wave", "wave that moves", "Definition")] and got[k]["summary"] == "own" and len(got[k]["objectives"]) == 3
        assert got[k]["misconceptions"] == [] and got[k]["worked_examples"] == []
    full = got["full"]
    assert len(full["principles"]) == 4 and len(full["formulations"]) == 3 and len(full["worked_examples"]) == 3
    assert "rate of change" in full["summary"] and full["mental_models"][0]["takeaway"] == extraction.EMPTY_FIELDS["takeaway"] and full["misconceptions"][0]["correction"]


def text_of(layout):
    prose = "\n".join("some plain text of a book that goes on for a while" for _ in range(12))
    out = []
    if layout == "keyword":
        out += ["CONTENTS"] + [f"CHAPTER {n}" for n in range(1, 5)]
        for n in range(1, 5):
            out += [f"CHAPTER {n}", prose] + [x for s in range(1, 4) for x in (f"{n}.{s} Title here", prose)]
    if layout == "markdown":
        out += ["# The Notes"] + [x for n in range(1, 6) for x in (f"# Chapter {n}: Topic", prose)]
    if layout == "words":
        out += [x for n in ("One", "Two", "Three", "Four") for x in (f"Chapter {n}: Ideas", prose)]
    if layout == "lessons":
        out += [x for n in range(1, 9) for x in ([f"UNIT {(n + 3) // 4}"] * (n in (1, 5)) + [f"Lesson {n}: Work", prose])]
    if layout == "dots":
        out += [x for n in range(1, 6) for x in (f"{n}. Big Idea", prose)]
    return "\n".join(out)


@pytest.mark.parametrize("layout,kind,n", [("keyword", "chapter_digits", 4), ("markdown", "hash_headings", 5), ("words", "chapter_word", 4), ("lessons", "lesson_digits", 8), ("dots", "numbered_dot", 5)])
def test_layouts(spark, layout, kind, n):
    t = lines.line_table(spark.createDataFrame([("b", text_of(layout))], "book_id string, text string"), ["book_id"])
    got = structure.chapters(t).orderBy("chapter_index").collect()
    assert len(got) == n and {r["kind"] for r in got} == {kind}
    if layout == "keyword":
        s = structure.sections(t, structure.chapters(t)).filter("section > 0").collect()
        assert len(s) == 12 and {r["title"] for r in s} == {"Title here"} and got[0]["start"] > 40


def test_pages(spark):
    text = "--- Page 1 ---\nfirst\n--- Page 2 ---\nsecond"
    p = lines.split_pages(spark.createDataFrame([("b", text)], "book_id string, text string"))
    assert lines.full_text(p).first()["text"] == "first\n\nsecond"
    pages = spark.createDataFrame([("b", i, f"{i + 10}\nbody text of the page\nmore") for i in range(1, 7)], "book_id string, page_index int, text string")
    assert [r["printed_page"] for r in lines.printed_page_numbers(pages).orderBy("page_index").collect()] == list(range(11, 17))


def test_packing():
    rng = random.Random(2)
    text = " ".join(" ".join("w" * rng.randint(1, 6) for _ in range(rng.randint(1, 30))) + "." for _ in range(300))
    parts = chunking.pack_sentences(text, 100, 20)
    assert all(len(p.split()) <= 130 for p in parts) and parts[0] == text[: len(parts[0])]
    assert [w for p in parts[:1] for w in p.split()] + [] == text.split()[: len(parts[0].split())]
    for a, b in zip(parts, parts[1:], strict=False):
        k = next(k for k in range(min(len(a), len(b)), -1, -1) if a.endswith(b[:k]))
        assert len(b[:k].split()) <= 20
    assert chunking.pack_sentences("", 10, 2) == [""] and len(chunking.pack_paragraphs("a\n\n" * 50, 5, 4)) == 4
    assert all(len(x) >= 1000 for x in chunking.cognitive_sections("\n\n".join("p" * 900 for _ in range(20))))


def test_facts(spark):
    text = "Newton's Second Law states that the force on a body equals mass times acceleration. F = m * a, and PV = nRT. Delta U = Q - W\nThe Speed is 12 m/s. x = 0, y = (1."
    mark = "Example 1 " + "a cart rolls down a slope. " * 9 + "\n 12 \nrest\nTry It now"
    rows = [("a", text), ("b", None), ("c", ""), ("d", " ".join(f"v{i} = k{i}." for i in range(20))), ("e", mark), ("f", "x" * 200_000 + " Speed is 3 m/s")]
    got = {r["id"]: r for r in extraction.with_facts(spark.createDataFrame(rows, "id string, text string")).collect()}
    facts = got["a"]["facts"]
    full = {f["full"] for f in facts if f["type"] == "equation"}
    assert {"F = m * a", "PV = nRT"} <= full and not {"x = 0", "y = (1"} & full
    assert [f["concept"] for f in facts if f["type"] == "definition"] == ["Newton's Second Law"]
    assert any(f["type"] == "value" and f["value"] == "12 m/s" for f in facts)
    assert all(not got[i][c] for i in "bc" for c in ("facts", "terms", "examples"))
    assert [f["lhs"] for f in got["d"]["facts"]] == [f"v{i}" for i in range(12)]
    assert len(got["e"]["examples"]) == 1 and got["e"]["examples"][0]["content"].endswith("slope. \nrest")
    assert [f["value"] for f in got["f"]["facts"]] == ["3 m/s"]


def test_concept_names(spark):
    cases = {"the Kinetic Energy of": "Kinetic Energy", "this Figure": None, "Of The": None, "One Two Three Four Five Six Seven": None, "'The' Net  Work": "Net Work"}
    got = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", extraction.concept_name(F.col("raw"))).collect()
    assert {a: b for a, b in got} == cases


def test_cards_and_items(spark):
    c = spark.createDataFrame([("v", "T", "The Speed is -3 m/s.", "Data"), ("n", "T", "", None), ("e", "T", "F = m * a", "Math")], "chapter_id string, title string, text string, subject string")
    got = {r["chapter_id"]: r for r in extraction.chapter_theory(c).collect()}
    assert got["v"]["quiz"]["options"] == ["-3 m/s", "-6 m/s", "0 m/s", "7 m/s"] and got["v"]["exam"]["expected"] == "-3 m/s"
    assert len(got["n"]["cards"]) == 3 and got["n"]["exam"]["expected"] == "T" and got["n"]["quiz"]["type"] == "generic"
    assert got["e"]["deep_theory"]["formulations"] == ["F = m * a"] and all(len(set(r["quiz"]["options"])) == 4 for r in got.values())


def test_theory_prefers_a_valid_blueprint(spark):
    c = spark.createDataFrame([("a", "T", "Momentum is defined as the product of mass and velocity."), ("b", "U", "")], "chapter_id string, title string, text string")
    b = spark.createDataFrame([("a", "too short", ["x"]), ("b", "a summary that is long enough to be taken as it is", ["x"])], "chapter_id string, summary string, objectives array<string>")
    got = {r["chapter_id"]: r for r in extraction.chapter_theory(c, b).collect()}
    assert got["a"]["theory_source"] == "extracted" and got["b"]["theory_source"] == "blueprint"
    assert len(got["a"]["quiz"]["options"]) == 4 == len(set(got["a"]["quiz"]["options"]))


def test_tutor_examples(spark):
    turns = [("Student", "hi"), ("Teacher", "hello"), ("Teacher", "again"), ("Student", ""), ("Student", "why"), ("Teacher", "so")]
    rows = [(c, "t" if c < 8 else "u", i, r, x) for c in range(10) for i, (r, x) in enumerate(turns)]
    d = spark.createDataFrame(rows, "conv_id long, topic string, turn int, role string, text string")
    got = training.tutor_examples(d).orderBy("conv_id").collect()
    assert [r["conv_id"] for r in got] == [0, 1, 2, 3, 4, 8, 9]
    assert [m["role"] for m in got[0]["messages"]] == ["system", "user", "assistant", "user", "assistant"]


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, at int, t string")
    new = spark.createDataFrame([("b", 3, "new"), ("b", 2, "z"), ("c", 5, "c"), ("c", 5, "c")], "k string, at int, t string")
    got = sorted(tuple(r) for r in chunking.upserted(old, new, "k", "at").collect())
    assert got == [("a", 1, "x"), ("b", 3, "new"), ("c", 5, "c")]
    courses = spark.createDataFrame([("m",), (None,), ("n",)], "course_id string")
    assert {r[0] for r in chunking.without_course(courses, "m").collect()} == {None, "n"}


def test_quizzes_take_the_first_card(spark):
    cards = spark.createDataFrame([("m", 2, "T", "c2"), ("m", 1, "T", "c1"), ("m", 3, "U", "c3")], "course_id string, at int, topic string, card_id string")
    quizzes = spark.createDataFrame([("m", 2, "T"), ("m", 3, "none"), ("m", 9, "none")], "course_id string, at int, concept string")
    got = {r["at"]: r["card_id"] for r in catalogue.quizzes_with_cards(quizzes, cards).collect()}
    assert got == {2: "c1", 3: "c3", 9: None}


def test_dense_blocks_are_few_and_nearest_keeps_ties():
    assert [retrieval.blocks(n, 4096) for n in (0, 1, 4097, 32_768, 51_282, 600_000)] == [1, 1, 2, 8, 8, 37]
    rng = np.random.default_rng(3)
    d = np.rint(rng.random((40, 300)) * 20) / 20
    d[:, ::7] = np.inf
    d[3], d[4, 2:] = np.inf, np.inf
    rows, columns, near = retrieval.nearest(d, 5)
    for i in range(40):
        want = [k for k in np.lexsort((np.arange(300), d[i]))[:5] if np.isfinite(d[i, k])]
        assert list(columns[rows == i]) == want and list(near[rows == i]) == [d[i, k] for k in want]


def test_texts_are_packed_in_small_batches(spark):
    df = spark.createDataFrame([("word " * 2000,), (None,)], "text string")
    out = chunking.titled_sections(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [len(x["content"]) for x in out.collect()] == [9999]


def test_merge_names_a_text_once(spark):
    for pattern, _ in predicates.REWRITES:
        for hit in ("dv/dt", "dV/dT", "dx/dt", "ds/dt", "dy/dx", "\\int", "\\oint", "\\partial", "\\nabla"):
            assert not re.search(pattern, hit) or any(x in hit for x in predicates.REWRITTEN)
    rows = [(1, "10", "a dv/dt of \\partial x"), (2, "college", "a dv/dt"), (3, "10", "integral of wood"), (4, "10", None), (5, "10", "ds/dt alone")]
    df = spark.createDataFrame(rows, "id int, tier string, text string")
    out = df.select("id", predicates.for_grade_level(text.strip(F.col("text")), F.col("tier")).alias("t"))
    assert out._jdf.queryExecution().analyzed().toString().count("trim(") <= 2
    assert {r["id"]: r["t"] for r in out.collect()} == {1: "a rate of change of speed (change in speed / time) of change x", 2: "a dv/dt", 3: "integral of wood", 4: None, 5: "ds/dt alone"}


def test_postings_of_asked_terms_only(spark):
    docs = spark.createDataFrame([(0, "a b a c"), (1, ""), (2, "c d"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("a",), ("d",)], "term string")
    t = retrieval.term_table(docs, asked=asked)
    assert {(r["doc_id"], r["term"]): (r["length"], r["tf"], r["first"]) for r in t.collect()} == {
        (0, "a"): (4, 2, True), (1, None): (0, 0, True), (2, None): (2, 0, True), (2, "d"): (2, 1, False), (3, None): (0, 0, True)
    }
    q = spark.createDataFrame([(5, "a d a"), (6, "zzz")], "query_id long, text string")
    rows = lambda df: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    found = rows(retrieval.bm25(docs, q))
    assert found == rows(retrieval.bm25_of(retrieval.term_table(docs), q)) and [x[:2] for x in found] == [(5, 0), (5, 2)]


def test_many_numbers_split_a_text_once(spark):
    text = " ".join(f"Speed is {i} m/s, v{i} = k{i};" for i in range(1, 12_001))
    df = spark.createDataFrame([("a", text)], "id string, text string")
    began = time.time()
    got = df.select(F.size(extraction.equations(F.col("text"))).alias("e"), F.size(extraction.values(F.col("text"))).alias("v")).first()
    assert got["e"] == 12_000 and got["v"] >= 12_000 and time.time() - began < 30
