from pyspark.sql import functions as F

from scholia.operators import front_matter, lines, outline, structure
from scholia.plans.ingest import ingest, publish

PROSE = "\n".join("Momentum is defined as the product of the mass and the velocity. Plain text goes on here." for _ in range(12))


def test_front_matter(spark):
    text = "\n".join(["A Book", "Contents", "1.1 Waves ...... 12", "1.2 Light 19", "x" * 130, "y" * 1500, "Chapter 1", PROSE, "1.1 Waves", PROSE, "1.2 Light", "2.1 Heat", PROSE, "3.1 Sound", PROSE])
    t = lines.line_table(spark.createDataFrame([("b", text)], "book_id string, text string"), ["book_id"]).cache()
    end = front_matter.contents_end(t).first()
    assert end["entries"] == 2 and text[: end["toc_end"]].endswith("1.2 Light 19")
    assert text[front_matter.body_start(t).first()["body_start"] :].startswith("Chapter 1")
    assert [(r["number"], r["title"]) for r in front_matter.grouped_headings(t).orderBy("number").collect()] == [(1, "Waves"), (2, "Heat"), (3, "Sound")]


def test_ingest(spark):
    book = "\n".join(x for n in range(1, 4) for x in (f"CHAPTER {n}: Topic {n}", PROSE))
    books = spark.createDataFrame([("a", "Thermo", book), ("b", "Loose", "\n\n".join(["word " * 900] * 40)), ("c", "Tiny", "x")], "book_id string, title string, text string")
    out = ingest(books)
    courses = {r["course_id"]: r for r in out["courses"].collect()}
    assert set(courses) == {"a", "b"}
    assert courses["a"]["subject"] == "Physics" and courses["b"]["chapters"] > 3
    assert courses["a"]["chapters"] == 3
    assert out["chunks"].filter("course_id = 'a'").count() >= 1
    assert out["theory"].filter(F.size("facts") > 0).count() >= 3


def _outline(spark, rows):
    return spark.createDataFrame([("b", i, *r) for i, r in enumerate(rows)], "book_id string, seq long, level int, title string, page int")


def test_outline_levels(spark):
    parts = [(1, "Preface", 1), (1, "Part I: Begin", 2)] + [x for n in range(1, 4) for x in ((2, f"{n}. Topic {n}", 2 * n), (3, f"{n}.1 First", 2 * n), (3, "Summary", 2 * n), (3, "More", 2 * n + 1), (3, "Chapter Review", 2 * n + 1))] + [(1, "Index", 9)]
    o = _outline(spark, parts)
    assert [(r["number"], r["title"], r["page"]) for r in outline.outline_chapters(o).orderBy("seq").collect()] == [(n, f"Topic {n}", 2 * n) for n in range(1, 4)]
    got = [(r["chapter"], r["label"], r["title"], r["first_page"], r["stop_page"]) for r in outline.outline_plan(o).orderBy("chapter", "label").collect()]
    assert got == [x for n in range(1, 4) for x in ((n, f"{n}.1", "First", 2 * n, 2 * n + 1), (n, f"{n}.2", "More", 2 * n + 1, 2 * n + 1))]
    back = _outline(spark, [(1, "Chapter I: A", 5), (1, "Chapter IV: B", 2), (1, "Chapter X: C", 9)])
    assert outline.outline_chapters(back).count() == 0
    roman = _outline(spark, [(1, "Chapter I: A", 1), (1, "Chapter IV: B", 2), (1, "Chapter X: C", 9)])
    assert [r["number"] for r in outline.outline_chapters(roman).orderBy("seq").collect()] == [1, 4, 10]


def test_ladder_of_books(spark):
    page = "Plain text goes on here and on. " * 20
    outlined = "\n".join(f"--- Page {n} ---\n{page}" for n in range(1, 7))
    headed = "\n".join(x for n in range(1, 4) for x in (f"CHAPTER {n}: Topic {n}", PROSE))
    books = spark.createDataFrame([("b", "Marked", outlined), ("h", "Headed", headed), ("c", "Loose", "\n\n".join(["word " * 900] * 9))], "book_id string, title string, text string")
    out = ingest(books, _outline(spark, [(1, f"Chapter {n}: Own {n}", 2 * n - 1) for n in range(1, 4)]))
    assert {r["book_id"]: r["rung"] for r in out["rungs"].collect()} == {"b": "outline", "h": "headings", "c": "chunks"}
    own = out["chapters"].filter("book_id = 'b'").orderBy("chapter_index").collect()
    assert [r["title"] for r in own] == ["Own 1", "Own 2", "Own 3"] and all(r["text"].count("Plain text") == 40 for r in own)
    assert {r["course_id"]: r["chapters"] for r in out["courses"].collect()}["b"] == 3


def test_bare_numbers_review_and_contents(spark):
    text = ["Contents", *[f"CHAPTER {n}" for n in range(1, 4)], *[f"{n}.1 Waves {n + 10}" for n in range(1, 4)], "x" * 130]
    for n in range(1, 4):
        text += [str(n), f"The Title {'ABC'[n - 1]}", PROSE, f"{n}.1 Waves", PROSE, f"{n}.2 Equations in prose", PROSE, "Key Terms", PROSE]
    t = lines.line_table(spark.createDataFrame([("b", "\n".join(text))], "book_id string, text string"), ["book_id"]).cache()
    c = structure.chapters(t)
    assert [(r["kind"], r["title"]) for r in c.orderBy("start").collect()] == [("bare_num_title", f"The Title {x}") for x in "ABC"]
    free = {r["label"] for r in structure.sections(t, c).collect()}
    assert free == {f"{n}.{k}" for n in range(1, 4) for k in ("0", "1", "2", "r")}
    contents = spark.createDataFrame([("b", n, 1) for n in range(1, 4)], "book_id string, chapter int, section int")
    s = {r["label"]: r for r in structure.sections(t, c, contents).collect()}
    assert set(s) == {f"{n}.{k}" for n in range(1, 4) for k in ("0", "1", "r")} and "Equations in prose" in s["2.1"]["content"]


def test_published_courses_stay(spark, tmp_path):
    book = lambda word: "\n".join(x for n in range(1, 4) for x in (f"CHAPTER {n}: {word} {n}", PROSE))
    schema, folder = "book_id string, title string, text string", str(tmp_path / "store")
    both = ingest(spark.createDataFrame([("a", "Thermo", book("Heat")), ("b", "Waves", book("Light"))], schema))
    assert {r["course_id"]: (len(r["quizzes"]), len(r["finalExam"])) for r in both["assessments"].collect()}["a"][0] == 3
    publish(both, folder)
    read = lambda name: {tuple(map(str, r)) for r in spark.read.parquet(f"{folder}/{name}").collect()}
    first = {name: read(name) for name in ("chapters", "chunks", "courses", "assessments")}
    assert len(first["chapters"]) == 6 and len(first["courses"]) == 2
    files = {p.name for p in (tmp_path / "store/chapters/course_id=b").iterdir()}
    publish(ingest(spark.createDataFrame([("a", "Thermo", book("Heat"))], schema)), folder)
    assert {name: read(name) for name in first} == first and {p.name for p in (tmp_path / "store/chapters/course_id=b").iterdir()} == files
