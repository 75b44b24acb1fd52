"""Divisions of books against plain Python over whole tables, and layouts that the tables don't have."""

import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from scholia.functions.predicates import BOILERPLATE, NON_THEORY
from scholia.operators import contents, front_matter, lines, section_kinds, simple_chapters, structure
from scholia.plans import views
from scholia.plans.ingest import ingest
from scholia.sources.tables import settled

SF = "/root/testdata/sf0.001"
PROSE = "\n".join("Momentum is the product of the mass and the velocity of a body, and plain text goes on here for a while yet." for _ in range(9))


def table(spark, text, book="b"):
    return lines.line_table(spark.createDataFrame([(book, text)], "book_id string, text string"), ["book_id"])


def theory(title):
    return not re.search(NON_THEORY, title.strip()) and not any(b in title.lower() for b in BOILERPLATE)


def heading(title):
    t = title.strip().lstrip("#").strip()
    return 3 <= len(t) <= 95 and re.search("[a-zA-Z]{3,}", t) and theory(t) and len(t.split()) <= 13 and not (t.endswith(".") and len(t.split()) > 5)


def plain_numbered(rows):
    pattern = re.compile(front_matter.GROUPED)
    hits = [(i, pattern.match(x)) for i, x in enumerate(rows) if pattern.match(x)]
    if len(hits) < 3 or len({m[1] for _, m in hits}) < 2:
        return []
    hits = [(i, int(m[1]), int(m[2]), m[3].strip()) for i, m in hits if not m[3].strip().lower().endswith("license)") and "table" not in m[3].lower()]
    numbers, out = sorted({h[1] for h in hits}), []
    firsts = {n: next(h for h in hits if h[1] == n) for n in numbers}
    for n, following in zip(numbers, [*numbers[1:], None], strict=True):
        start, stop = firsts[n][0], firsts[following][0] if following else len(rows)
        own = rows[start:stop]
        cut = next((i for i, x in enumerate(own) if i and re.match(simple_chapters.REVIEW_TAIL, x)), len(own))
        text = "\n".join(own[:cut]).strip()
        if len(text) < 800:
            continue
        told = [x.strip() for x in rows[max(0, start - 6) : start] if x.strip()]
        title = None
        if told and (m := re.match(r"#{1,2}[ \t]+([A-Z][^\n]{3,80})$", told[-1])):
            title = m[1]
        for i in range(stop):
            if title is None and (m := re.match(rf"[ \t]*(?i:Chapter)\s+{n}\b[:\s\-–—]+([A-Z][^\n]{{3,80}})\s*$", rows[i])):
                title = m[1].strip()
        bare = [i for i in range(stop) if rows[i].strip() == str(n)]
        for i in bare:
            if title is None and i + 1 < len(rows) and (m := re.match(simple_chapters._TITLE, rows[i + 1])) and any(re.match(r"(?i)[ \t]*chapter\s+outline\b", x) for x in rows[i + 1 : stop]):
                title = m[1].strip()
        for i in bare:
            if title is None and i and (m := re.match(simple_chapters._TITLE, rows[i - 1])) and re.fullmatch(r"[A-Za-z\s]+", m[1]) and m[1].lower() not in ("contents", "table of contents", "preface"):
                title = m[1].strip()
        title = title or firsts[n][3]
        short = re.sub(r"^\s*\d{1,3}\s*[:.\-–—)]?\s+", "", re.sub(simple_chapters.PREFIX, "", title).strip()).strip()
        subs, seen = [], set()
        for _, k, sec, name in hits:
            if k == n and sec not in seen:
                seen.add(sec)
                subs.append((f"{n}.{sec}", name))
        out.append((f"Chapter {n}: {short or title}", text, subs))
    return out


def plain_headed(rows, most=None):
    pattern = re.compile(simple_chapters.GENERIC)
    marks = [i for i, x in enumerate(rows) if pattern.match(x)]
    if len(marks) < 2:
        return []
    kept = []
    for i, stop in zip(marks, [*marks[1:], len(rows)], strict=True):
        m = pattern.match(rows[i])
        title = f"{m[1].strip()} {m[2].strip()}".strip().lstrip("#").strip()
        for p, put in ((r"[•●○▪▫�\*\t]+", " "), (r"\.{2,}\s*\d*", ""), (r"\s+\d{1,4}$", ""), (r"\s{2,}", " ")):
            title = re.sub(p, put, title.strip())
        title = title.strip()
        if not heading(title):
            continue
        text, norm = "\n".join(rows[i + 1 : stop]).strip(), re.sub("[^a-z0-9]", "", title.lower())
        if kept:
            last = re.sub("[^a-z0-9]", "", kept[-1][0].lower())
            if norm == last or (len(norm) >= 8 and (norm in last or last in norm)):
                kept[-1][1] += "\n\n" + text
                continue
        kept.append([title, text])
    begin = next((i for i, (t, c) in enumerate(kept) if len(c) >= 600 and theory(t)), 0)
    parts = []
    for title, text in kept[begin:]:
        if len(text) < 400 and any(re.search(p, text) for p in simple_chapters.SNIPPETS):
            continue
        if len(text) >= 200:
            parts.append([title, text])
        elif parts and text:
            parts[-1][1] += f"\n\n### {title}\n{text}"
    out = []
    for title, text in (p for p in parts if theory(p[0])):
        if out and (re.match(simple_chapters.SUB_HEADING, title) or (most and len(out) >= most)):
            out[-1][1] += f"\n\n### {title}\n{text}"
        else:
            out.append([title, text])
    return [(t, c, []) for t, c in out]


def expected(rows, most=None):
    return plain_numbered(rows) or plain_headed(rows, most)


def got(found):
    rows = found.orderBy("book_id", "chapter_index").collect()
    assert all(r["chapter_index"] == i for _, g in groupby(rows, key=lambda r: r["book_id"]) for i, r in enumerate(g, 1))
    return {b: [(r["title"], r["content"], [tuple(s) for s in r["subsections"]]) for r in g] for b, g in groupby(rows, key=lambda r: r["book_id"])}


@pytest.mark.parametrize("view", [views.styled_lines, views.book_lines])
def test_simple_chapters_over_whole_tables(spark, view):
    table_ = view(spark, SF).select("book_id", "line_no", "pos", "line").cache()
    starts = {r["book_id"]: r["body_start"] for r in front_matter.body_start(table_).collect()}
    books = {}
    for r in table_.orderBy("book_id", "line_no").collect():
        if r["pos"] >= starts[r["book_id"]]:
            books.setdefault(r["book_id"], []).append(r["line"])
    want = {b: e for b, rows in books.items() if (e := expected(rows))}
    assert want and got(simple_chapters.simple_chapters(table_)) == want


LAYOUTS = {
    "running headers": "\n".join(f"# Waves and light\n{PROSE}\n# Waves and Light 2\n{PROSE}\n# Heat\nshort\n# Sound\n{PROSE}\n# Index of all\n{PROSE}" for _ in range(2)),
    "sub headings": f"Chapter 1 Motion\n{PROSE}\nSection 1.1 Speed\n{PROSE}\nSubsection on paths\n{PROSE}\nChapter 2 Force\n{PROSE}\nIntroduction\n{PROSE}",
    "contents in front": f"# One ... 1\nKey Terms 12\n# Two ... 2\n1 2 3\n# Three\n{PROSE}\n# Four\n{PROSE}",
    "numbered": f"## Motion at last\n1.1 Speed of a body\n{PROSE}\n1.2 Paths taken\n{PROSE}\nChapter 2: Forces all around\n2.1 Push it\n{PROSE}\nChapter Review\n2.2 Pull it\n{PROSE}\nThe third one\n3\n3.1 Heat flows\n{PROSE}\n3.1 Heat flows\n4\nNamed above\nChapter Outline\n4.1 Sound waves\n{PROSE}",
    "nothing": PROSE,
    "empty": "",
}


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("most", [None, 2])
def test_simple_layouts(spark, name, most):
    text = LAYOUTS[name]
    want = expected(text.split("\n"), most)[:most]
    assert got(simple_chapters.simple_chapters(table(spark, text), most)) == ({"b": want} if want else {})


def test_contents_plan_and_lost_headings(spark):
    front = ["Contents", "CHAPTER 1", "Waves", "and light 3", "1.1 Crests 4", "2.9 Not mine 5", "1.2 Troughs 6", "CHAPTER 2: Heat that flows 9", "2.1 Degrees 10", "Chapter 3", "Sound 15", "3.1 Ears 16", "CHAPTER 3", "Twice 99", "CHAPTER 4", "Nothing known"]
    body = ["x" * 130, "CHAPTER 1", PROSE, "1.1 Crests", PROSE, "2.1 Degrees of heat", PROSE, "CHAPTER 3", PROSE, "3.1 Ears", PROSE]
    t = table(spark, "\n".join(front + body)).cache()
    plan = contents.contents_plan(t).orderBy("chapter").collect()
    assert [(r["chapter"], r["title"], r["page"], [tuple(s) for s in r["sections"]]) for r in plan] == [
        (1, "Waves and light", 3, [(1, "Crests"), (2, "Troughs")]),
        (2, "Heat that flows", None, [(1, "Degrees")]),
        (3, "Sound", 15, [(1, "Ears")]),
    ]
    found = contents.anchored_chapters(t, contents.contents_plan(t)).orderBy("start").collect()
    text = "\n".join(front + body)
    assert [(r["number"], r["by_label"], text[r["start"] :].split("\n")[0]) for r in found] == [(1, False, "CHAPTER 1"), (2, True, "2.1 Degrees of heat"), (3, False, "CHAPTER 3")]
    assert [r["end"] for r in found] == [*[r["start"] for r in found[1:]], len(text)]
    back = table(spark, "\n".join(["Contents", *[f"CHAPTER {n}\nTitle {p}" for n, p in ((1, 9), (2, 5), (3, 12))], "x" * 130]))
    assert contents.contents_plan(back).count() == 0
    out = ingest(spark.createDataFrame([("c", "Waves", text)], "book_id string, title string, text string"))
    assert out["rungs"].first()["rung"] == "contents" and {r["chapter_id"] for r in out["chapters"].collect()} == {"ch_1", "ch_2", "ch_3"}


def test_grouped_titles(spark):
    text = ["# Motion", "1.1 Speed of it", PROSE, "2", "Forces here", "2.1 Push it", PROSE, "Sound around", "Chapter Outline", "3.1 Hear it", PROSE, "4.1 See it", PROSE]
    found = front_matter.grouped_headings(table(spark, "\n".join(text))).orderBy("number").collect()
    full = "\n".join(text)
    assert [(r["number"], r["title"], full[r["pos"] :].split("\n")[0]) for r in found] == [(1, "Motion", "# Motion"), (2, "Forces here", "2"), (3, "Sound around", "Chapter Outline"), (4, "See it", "4.1 See it")]
    assert front_matter.grouped_headings(table(spark, "1.1 Aaaa\n5.1 Bbbb\n9.1 Cccc\n12.1 Dddd")).count() == 0


@pytest.mark.parametrize(
    ("marks", "kind", "labels"),
    [
        (("{n}.1 First thing", "{n}.2 Second thing 14"), "numdot", ("{n}.1", "{n}.2")),
        (("1 - First thing", "2 – Second thing"), "dashdot", ("{n}.1", "{n}.2")),
        (("A. First thing", "B) Second thing"), "letdot", ("{n}.1", "{n}.2")),
        (("### First thing", "### Second thing"), "hash_headings", ("{n}.1", "{n}.2")),
        ((), "chunk", ()),
    ],
)
def test_section_kinds(spark, marks, kind, labels):
    head = "## Topic {n}" if kind == "hash_headings" else "CHAPTER {n}: Topic"
    text = "\n".join("\n".join([head, PROSE.lower(), *(x for m in marks for x in (m, PROSE.lower()))]).replace("{n}", str(n)) for n in range(1, 5))
    t = table(spark, text).cache()
    chapters = structure.chapters(t)
    kinds = section_kinds.section_kinds(t, chapters)
    assert kinds.first()["kind"] == kind
    found = {r["label"]: r["title"] for r in section_kinds.sections_by_kind(t, chapters, kinds).collect()}
    want = {x.replace("{n}", str(n)) for n in range(1, 5) for x in (*labels, *(("{n}.0",) if labels else ()))}
    assert set(found) == want and {found[x] for x in found if not x.endswith(".0")} == ({"First thing", "Second thing"} if labels else set())


def test_titles_after_bare_headings(spark):
    text = "\n".join(f"CHAPTER {n}\n\n  {'Named' if n < 3 else '17'}\n{PROSE}" for n in range(1, 4))
    found = structure.heading_candidates(table(spark, text)).filter(F.col("kind") == "chapter_digits").orderBy("number").collect()
    assert [r["title"] for r in found] == ["Named", "Named", ""]


def test_headings_ask_no_long_line_again(spark):
    number, late = "12" + " " * 200 + "no title", " " * 150 + "CHAPTER 9: Late"
    texts = ["CHAPTER 1", "", "word " * 40, "Title", "12" + " " * 200, "Of trees", number, "Of stones", late, "CHAPTER 2: Two", "CHAPTER 3"]
    rows, pos = [], 0
    for i, t in enumerate(texts):
        rows.append(("b", i, pos, t))
        pos += len(t) + 1
    lines = spark.createDataFrame(rows, "book_id string, line_no long, pos long, line string")
    short = structure.briefs(lines)
    assert short.agg(F.max(F.length("line"))).first()[0] == 202 and short.filter("line_no in (2, 6)").select("line").distinct().first()[0] == "x" * 121
    assert structure.book_lengths(short).first()["chars"] == pos - 1
    found = structure.heading_candidates(lines)
    assert {(r["kind"], r["line_no"], r["number"], r["title"]) for r in found.collect()} == {
        ("chapter_digits", 0, 1, ""), ("bare_num_title", 4, 12, "Of trees"), ("chapter_digits", 9, 2, "Two"), ("chapter_digits", 10, 3, "")
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 40


def test_briefs_serve_every_division_of_a_book(spark):
    """Long lines with a label stay, so that chapters and plans out of briefs are those of the whole lines."""
    label = "Of the long way that a body takes when it falls, of what holds it back, and of what it does to the ground below it once it is there"
    bare = "\n".join(f"{n}.{k} {label} {n}\n{PROSE}" for n in range(1, 5) for k in (1, 2))
    front = "Contents\n" + "\n".join(f"CHAPTER {n}\nThe way {n + 10}\n{n}.1 Of the way {n + 10}" for n in range(1, 5))
    books = table(spark, bare, "bare").unionByName(table(spark, f"{front}\n{PROSE}\n{bare}", "printed"))
    short = structure.briefs(books)
    rows = lambda df: sorted(map(str, df.collect()))
    found = structure.chapters(short)
    assert {r["kind"] for r in found.filter("book_id = 'bare'").collect()} == {"grouped_numdot"}
    assert rows(found) == rows(structure.chapters(books))
    plan, anchored = contents.divided_by_contents(short)
    assert anchored.filter("by_label").count() == 4 and plan.count() == 4
    assert rows(section_kinds.section_kinds(short, found)) == rows(section_kinds.section_kinds(books, found))


def test_settled_tables_are_read_by_column(spark):
    t = settled(spark.range(100).selectExpr("id", "repeat('x', 1000) as text"))
    assert "ReadSchema: struct<id:bigint>" in t.select("id")._jdf.queryExecution().executedPlan().toString()
    joined = spark.range(10).join(t.select("id"), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
