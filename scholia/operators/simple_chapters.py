"""A simple division of texts into chapters: by numbered sections, else by headings of any kind, short parts folded into the one before.

A book's heading candidates are few; the only ordered fold is over their titles. Contents are joined by running group numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.predicates import non_theory, valid_heading
from scholia.functions.text import strip
from scholia.operators.front_matter import GROUPED, body_start
from scholia.sources.tables import settled

#: Headings of any kind; where a chapter's review begins; parts of a table of contents; headings below a chapter's.
GENERIC = (
    r"(?i)^\s*(#{1,3}\s+|Chapter\s+(?:\d+|[I|V|X]+)[:\s\-\.]*|Unit\s+(?:\d+|[I|V|X]+)[:\s\-\.]*|"
    r"Module\s+(?:\d+|[I|V|X]+)[:\s\-\.]*|Part\s+(?:\d+|[I|V|X]+)[:\s\-\.]*|Lesson\s+\d+[:\s\-\.]*|"
    r"Lecture\s+\d+[:\s\-\.]*|Topic\s+\d+[:\s\-\.]*|Section\s+\d+[:\s\-\.]*|[0-9]+\.[0-9]*\s+|"
    r"[I|V|X]+\.\s+|(?:Introduction|Methodology|Overview|Foundations)(?:[:\s\-\.]*))([^\n]{0,80})$"
)
REVIEW_TAIL = r"^\s*(?:\d+\s*[•●○▪▫�\*\-]\s*Chapter\s+Review|Chapter\s+Review|Exercises|Review\s+Questions)\b"
SNIPPETS = (
    r"\b(?:Key Terms|Group Project|Chapter Review|Quantitative Problems|Problems|Exercises)\s+\d+",
    r"\.{2,}\s*\d+",
    r"\b\d+\s+\b\d+\s+\b\d+",
)
SUB_HEADING = r"(?i)^(?:Section\s+\d+\.\d+|Subsection|###|\d+\.\d+)"
PREFIX = r"(?i)^\s*(?:chapter|unit|part|lesson|module)\s*(?:\d{1,3}|[ivxlcdm]{1,7})?\s*[:.\-–—)]?\s*"
LEAST_NUMBERED, LEAST_PART, SUBSTANCE, SNIPPET = 800, 200, 600, 400
#: Lines and characters before a chapter's first section in which a hash heading names it.
PARENT_WITHIN, PARENT_CHARS = 6, 1200
_TITLE = r"^[ \t]*([A-Z][^\n]{3,80})\s*$"


def _joined(items: Column, between: str = "\n") -> Column:
    """Strings of (place, text) structs in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), between)


def numbered_chapters(lines: DataFrame) -> DataFrame:
    """book_id, chapter_index, title, content, subsections: chapters that numbered sections `N.M Title` show.

    For books with three such lines or more in two chapters or more. A chapter lasts from its first section to that of the next
    number and ends before its review; under 800 characters it goes. Its title: a hash heading right before it, the first
    `Chapter N: Title` so far, the line after its number where a chapter outline follows, the line before its number, else its
    first section's.
    """
    t = F.col("line")
    hits = lines.filter(t.rlike(GROUPED)).select(
        "book_id", "pos", "line_no", F.regexp_extract(t, GROUPED, 1).cast("int").alias("number"), F.regexp_extract(t, GROUPED, 2).cast("int").alias("section"), strip(F.regexp_extract(t, GROUPED, 3)).alias("title")
    )
    books = hits.groupBy("book_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("number").alias("_k")).filter("_n >= 3 and _k >= 2")
    low = F.lower("title")
    hits = settled(hits.join(books.select("book_id"), "book_id", "left_semi").filter(~low.endswith("license)") & ~low.contains("table")))
    sections = hits.groupBy("book_id", "number", "section").agg(F.min(F.struct("pos", "title")).alias("s"))
    sections = sections.groupBy("book_id", "number").agg(F.array_sort(F.collect_list(F.struct("s.pos", "section", "s.title"))).alias("_s"))
    sections = sections.select("book_id", "number", F.transform("_s", lambda x: F.struct(F.concat_ws(".", "number", x["section"]).alias("label"), x["title"].alias("title"))).alias("subsections"))
    first = hits.groupBy("book_id", "number").agg(F.min(F.struct("pos", "line_no", "title")).alias("f")).select("book_id", "number", "f.*")
    next_ = F.lead("pos").over(Window.partitionBy("book_id").orderBy("number"))
    first = settled(first.withColumn("_next", F.coalesce(next_, F.lit(1 << 62))))
    inside = lines.join(first.select("book_id", "number", F.col("pos").alias("_start"), "_next"), "book_id").filter((F.col("pos") >= F.col("_start")) & (F.col("pos") < F.col("_next")))
    inside = inside.withColumn("_review", F.min(F.when(t.rlike(REVIEW_TAIL) & (F.col("pos") > F.col("_start")), F.col("pos"))).over(Window.partitionBy("book_id", "number")))
    texts = inside.filter(F.col("_review").isNull() | (F.col("pos") < F.col("_review"))).groupBy("book_id", "number").agg(strip(_joined(F.collect_list(F.struct(F.col("line_no"), t.alias("text"))))).alias("content"))
    titles = _own_titles(lines, first)
    found = first.join(texts, ["book_id", "number"]).filter(F.length("content") >= LEAST_NUMBERED).join(titles, ["book_id", "number"], "left").join(sections, ["book_id", "number"])
    name = F.coalesce("_told", "title")
    bare = strip(F.regexp_replace(strip(F.regexp_replace(name, PREFIX, "")), r"^\s*\d{1,3}\s*[:.\-–—)]?\s+", ""))
    index = F.row_number().over(Window.partitionBy("book_id").orderBy("number"))
    return found.select("book_id", index.alias("chapter_index"), F.concat(F.lit("Chapter "), "number", F.lit(": "), F.coalesce(F.nullif(bare, F.lit("")), name)).alias("title"), "content", "subsections")


def _own_titles(lines: DataFrame, first: DataFrame) -> DataFrame:
    """(book_id, number, _told): the best of the titles that lines around a chapter's beginning give it."""
    t = F.col("line")
    back = first.select("book_id", "number", F.col("pos").alias("_pos"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(PARENT_WITHIN)), lambda k: F.col("line_no") - k)).alias("line_no"))
    back = back.join(lines.select("book_id", "line_no", "pos", strip(t).alias("_t")), ["book_id", "line_no"]).filter((F.col("_t") != "") & (F.col("_pos") - F.col("pos") <= PARENT_CHARS))
    back = back.groupBy("book_id", "number").agg(F.max_by("_t", "line_no").alias("_t"))
    hashed = r"^#{1,2}[ \t]+([A-Z][^\n]{3,80})$"
    ways = [back.filter(F.col("_t").rlike(hashed)).select("book_id", "number", F.lit(0).alias("way"), F.lit(0).cast("long").alias("at"), F.regexp_extract("_t", hashed, 1).alias("told"))]
    ends = first.select("book_id", "number", "_next")
    explicit = r"(?i)^[ \t]*Chapter\s+(\d+)\b[:\s\-–—]+((?-i:[A-Z])[^\n]{3,80})\s*$"
    named = lines.filter(t.rlike(explicit)).select("book_id", F.regexp_extract(t, explicit, 1).cast("int").alias("number"), F.col("pos").alias("at"), F.regexp_extract(t, explicit, 2).alias("told"))
    ways.append(named.join(ends, ["book_id", "number"]).filter("at < _next").select("book_id", "number", F.lit(1).alias("way"), "at", "told"))
    bare = lines.filter(t.rlike(r"^[ \t]*\d{1,3}[ \t]*$")).select("book_id", strip(t).cast("int").alias("number"), "line_no", F.col("pos").alias("at"))
    bare = bare.join(ends, ["book_id", "number"]).filter("at < _next")
    text = lines.filter(t.rlike(_TITLE)).select("book_id", "line_no", F.regexp_extract(t, _TITLE, 1).alias("told"))
    outlines = lines.filter(t.rlike(r"(?i)^[ \t]*chapter\s+outline\b")).select("book_id", F.col("pos").alias("_outline"))
    after = bare.join(text.withColumn("line_no", F.col("line_no") - 1), ["book_id", "line_no"]).join(outlines, "book_id").filter("_outline > at and _outline < _next")
    ways.append(after.select("book_id", "number", F.lit(2).alias("way"), "at", "told"))
    before = bare.join(text.withColumn("line_no", F.col("line_no") + 1), ["book_id", "line_no"]).filter(~F.lower("told").isin("contents", "table of contents", "preface") & F.col("told").rlike(r"^[A-Za-z\s]+$"))
    ways.append(before.select("book_id", "number", F.lit(3).alias("way"), "at", "told"))
    every = ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3])
    return every.groupBy("book_id", "number").agg(strip(F.min_by("told", F.struct("way", "at"))).alias("_told"))


def kept_titles(candidates: DataFrame) -> DataFrame:
    """(book_id, k, g): the candidate g whose part each candidate k (with norm, its title's letters and digits) belongs to.

    A candidate goes on with the last kept one if their titles are the same, or if one of eight letters or more holds the other:
    running headers repeat a title on every page. The fold walks the few candidates of a book in order.
    """
    start = F.struct(F.lit(None).cast("string").alias("norm"), F.lit(None).cast("int").alias("g"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        last, now = acc["norm"], x["norm"]
        same = F.coalesce((now == last) | ((F.length(now) >= 8) & (last.contains(now) | now.contains(last))), F.lit(False))
        g = F.when(same, acc["g"]).otherwise(x["k"])
        return F.struct(F.when(same, last).otherwise(now).alias("norm"), g.alias("g"), F.array_append(acc["out"], g).alias("out"))

    books = candidates.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("k", "norm"))).alias("c"))
    books = books.select("book_id", F.transform("c", lambda x: x["k"]).alias("ks"), F.aggregate("c", start, step)["out"].alias("gs"))
    return books.select("book_id", F.explode(F.arrays_zip("ks", "gs")).alias("z")).select("book_id", F.col("z.ks").alias("k"), F.col("z.gs").alias("g"))


def _folded(parts: DataFrame, starts: Column, most: int | None = None) -> DataFrame:
    """parts (book_id, g, title, content) with those that don't start joined to the last that does, under `### title`."""
    run = Window.partitionBy("book_id").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumn("_run", F.sum(starts.cast("int")).over(run)).filter("_run > 0")
    if most:
        own = own.withColumn("_run", F.least("_run", F.lit(most)))
    head = F.row_number().over(Window.partitionBy("book_id", "_run").orderBy("g")) == 1
    own = own.withColumn("_text", F.when(head, F.col("content")).otherwise(F.concat(F.lit("### "), "title", F.lit("\n"), "content")))
    out = own.groupBy("book_id", "_run").agg(F.min("g").alias("g"), F.min_by("title", "g").alias("title"), F.collect_list(F.struct("g", F.col("_text").alias("text"))).alias("_c"))
    return out.select("book_id", "g", "title", _joined(F.col("_c"), "\n\n").alias("content"))


def headed_chapters(lines: DataFrame, most: int | None = None) -> DataFrame:
    """book_id, chapter_index, title, content, subsections (empty): chapters by headings of any kind, for books with two or more.

    Parts go from heading to heading; headings that are sentences or no theory take their part with them. Repeated titles go on
    with the part before; parts before the first with 600 characters go, and so do snippets of contents. Parts under 200
    characters and sub-headings fold into the part before; parts beyond `most` into the last.
    """
    t = F.col("line")
    so_far = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.select("book_id", "line_no", "line", t.rlike(GENERIC).alias("_is"))
    own = own.withColumn("k", F.sum(F.col("_is").cast("int")).over(so_far).cast("int")).filter("k > 0")
    title = F.concat_ws(" ", strip(F.regexp_extract(t, GENERIC, 1)), strip(F.regexp_extract(t, GENERIC, 2)))
    for pattern, put in ((r"^[\s#]+", ""), (r"[•●○▪▫�\*\t]+", " "), (r"\.{2,}\s*\d*", ""), (r"\s+\d{1,4}$", ""), (r"\s{2,}", " ")):
        title = F.regexp_replace(strip(title), pattern, put)
    parts = own.groupBy("book_id", "k").agg(F.max(F.when(F.col("_is"), strip(title))).alias("title"), strip(_joined(F.collect_list(F.when(~F.col("_is"), F.struct("line_no", t.alias("text")))))).alias("content"))
    enough = F.count(F.lit(1)).over(Window.partitionBy("book_id")) >= 2
    parts = settled(parts.withColumn("_enough", enough).filter("_enough").filter(valid_heading(F.col("title"))).drop("_enough"))
    groups = kept_titles(parts.select("book_id", "k", F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("norm")))
    kept = parts.join(groups, ["book_id", "k"]).groupBy("book_id", "g").agg(F.min_by("title", "k").alias("title"), _joined(F.collect_list(F.struct("k", F.col("content").alias("text"))), "\n\n").alias("content"))
    size = F.length("content")
    begin = F.min(F.when((size >= SUBSTANCE) & ~non_theory(F.col("title")), F.col("g"))).over(Window.partitionBy("book_id"))
    snippet = (size < SNIPPET) & (F.col("content").rlike(SNIPPETS[0]) | F.col("content").rlike(SNIPPETS[1]) | F.col("content").rlike(SNIPPETS[2]))
    kept = kept.withColumn("_begin", begin).filter(F.col("_begin").isNull() | (F.col("g") >= F.col("_begin"))).filter(~snippet & (size > 0)).drop("_begin")
    theory = _folded(kept, F.length("content") >= LEAST_PART).filter(~non_theory(F.col("title")))
    lead = F.row_number().over(Window.partitionBy("book_id").orderBy("g")) == 1
    theory = theory.withColumn("_start", ~F.col("title").rlike(SUB_HEADING) | lead)
    found = _folded(theory, F.col("_start"), most)
    return found.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("g")).alias("chapter_index"), "title", "content", F.array().cast("array<struct<label:string,title:string>>").alias("subsections"))


def simple_chapters(lines: DataFrame, most: int | None = None) -> DataFrame:
    """book_id, chapter_index, title, content, subsections of the line table: numbered_chapters, else headed_chapters.

    Front matter is left out where a body start is found. Books without either have no rows. A chapter's text is one row, as
    a book's few candidate titles are for the fold; books aren't.
    """
    start = body_start(lines)
    lines = settled(lines.join(start, "book_id").filter(F.col("pos") >= F.col("body_start")).select("book_id", "line_no", "pos", "line"))
    numbered = numbered_chapters(lines)
    if most:
        numbered = numbered.filter(F.col("chapter_index") <= most)
    numbered = settled(numbered)
    return numbered.unionByName(headed_chapters(lines.join(numbered.select("book_id").distinct(), "book_id", "left_anti"), most))
