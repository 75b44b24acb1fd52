"""Printed tables of contents: a plan of chapters out of their lines, and these chapters anchored in the running text.

Only lines between the contents' opening and their end are ordered by windows; headings and labels of the text are filtered to
their few lines before any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import strip
from scholia.operators.front_matter import contents_end
from scholia.operators.structure import LEAST_CHAPTERS, book_lengths, briefs, heading_candidates
from scholia.sources.tables import settled

#: A chapter's mark on a line of its own, one with its title, a section's entry, a page number at a line's end.
BARE_MARK = r"(?i)^[ \t]*CHAPTER\s+(\d{1,3})\s*$"
TITLED_MARK = r"(?i)^[ \t]*(?:CHAPTER\s+)?(\d{1,3})(?!\.)[:\s\-–—]+([A-Z][^\n]{2,80}?)(?:\s+\d{1,4})?\s*$"
ENTRY = r"^[ \t]*(\d{1,3})\.(\d{1,3})\s+(.+)$"
PAGE = r"\s+(\d{1,4})\s*$"


def contents_plan(lines: DataFrame) -> DataFrame:
    """Chapters of printed contents: book_id, chapter, title, page, sections (array of section, title; in their order).

    A mark `CHAPTER n` opens a chapter; the lines after it, up to the first with a page number or the first section, are its
    title. A mark with its own title needs none. Sections `n.m Title page` count under their own chapter only. Of equal
    numbers the first stays; chapters without a title, or without both sections and a page, go. Books with fewer than three
    such chapters, or with pages that go back, have no plan. A plan's rows are those of one book's contents, at most 400 lines.
    """
    region = contents_end(lines).select("book_id", F.col("toc_open").alias("_open"), F.col("toc_end").alias("_end"))
    own = lines.join(region, "book_id").filter((F.col("line_no") > F.col("_open")) & (F.col("pos") < F.col("_end")))
    t = strip(F.col("line"))
    own = own.select("book_id", "line_no", t.alias("_t")).filter("_t != ''")
    t = F.col("_t")
    entry, bare = t.rlike(ENTRY), t.rlike(BARE_MARK)
    titled = ~entry & ~bare & t.rlike(TITLED_MARK)
    mark = F.coalesce(F.nullif(F.regexp_extract(t, BARE_MARK, 1), F.lit("")), F.when(titled, F.regexp_extract(t, TITLED_MARK, 1))).cast("int")
    number = F.when(entry, F.regexp_extract(t, ENTRY, 1).cast("int"))
    page = F.nullif(F.regexp_extract(t, PAGE, 1), F.lit("")).cast("int")
    bare_title = strip(F.regexp_replace(t, PAGE, ""))
    own = own.select(
        "book_id",
        "line_no",
        mark.alias("_mark"),
        titled.alias("_titled"),
        number.alias("_number"),
        page.alias("_page"),
        F.when(entry, strip(F.regexp_replace(F.regexp_extract(t, ENTRY, 3), PAGE, ""))).when(titled, strip(F.regexp_replace(F.regexp_extract(t, TITLED_MARK, 2), PAGE, ""))).otherwise(bare_title).alias("_name"),
        F.when(entry, F.regexp_extract(t, ENTRY, 2).cast("int")).alias("_section"),
        (~entry & ~bare & ~titled & t.rlike("[A-Za-z]{3,}")).alias("_plain"),
    )
    so_far = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_at", F.last(F.when(F.col("_mark").isNotNull(), F.col("line_no")), True).over(so_far))
    own = own.withColumn("chapter", F.last("_mark", True).over(so_far)).filter("_at is not null")
    own = own.filter("_number is null or _number = chapter")
    # where the title ends: at the first section, or with the first plain line that has a page
    stop = F.least(F.min(F.when(F.col("_section").isNotNull(), F.col("line_no") - 1)), F.min(F.when(F.col("_plain") & F.col("_page").isNotNull(), F.col("line_no"))))
    ordered = lambda when, *columns: F.array_sort(F.collect_list(F.when(when, F.struct("line_no", *columns))))
    found = own.groupBy("book_id", "_at", "chapter").agg(
        stop.alias("_stop"),
        F.max(F.when(F.col("_titled"), F.col("_name"))).alias("_own_title"),
        ordered(F.col("_plain"), "_name", "_page").alias("_titles"),
        ordered(F.col("_section").isNotNull(), F.col("_section").alias("section"), F.col("_name").alias("title")).alias("_sections"),
    )
    lines_of = F.filter("_titles", lambda x: F.col("_stop").isNull() | (x["line_no"] <= F.col("_stop")))
    wrapped = F.regexp_replace(F.array_join(F.transform(lines_of, lambda x: x["_name"]), " "), r"\s{2,}", " ")
    found = found.select(
        "book_id",
        "_at",
        "chapter",
        F.nullif(F.coalesce("_own_title", strip(wrapped)), F.lit("")).alias("title"),
        F.when(F.col("_own_title").isNull(), F.get(F.filter(F.transform(lines_of, lambda x: x["_page"]), lambda p: p.isNotNull()), 0)).alias("page"),
        F.transform("_sections", lambda x: F.struct(x["section"].alias("section"), x["title"].alias("title"))).alias("sections"),
    )
    found = found.filter("title is not null and (size(sections) > 0 or page is not null)")
    first = F.row_number().over(Window.partitionBy("book_id", "chapter").orderBy("_at"))
    found = found.withColumn("_rn", first).filter("_rn = 1").drop("_rn")
    paged = Window.partitionBy("book_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    back = F.col("page") < F.last("page", True).over(paged)
    found = found.withColumn("_back", F.coalesce(back, F.lit(False)))
    whole = Window.partitionBy("book_id")
    pages = F.count("page").over(whole)
    good = (F.count(F.lit(1)).over(whole) >= LEAST_CHAPTERS) & ((pages < LEAST_CHAPTERS) | ~F.max("_back").over(whole))
    return found.withColumn("_good", good).filter("_good").select("book_id", "chapter", "title", "page", "sections")


def anchored_chapters(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Chapters of a contents plan where they stand in the text, in the form of structure.chapters (kind `contents`).

    A chapter starts at the first heading of the text with its number (CHAPTER, UNIT or LESSON families), else, where the
    heading is lost, at the first line that begins with the label of the first section the contents list for it. Both are
    looked for after the contents only. Chapters without an anchor go; a book with fewer than three anchors has no rows.
    """
    behind = contents_end(lines).select("book_id", "toc_end").join(plan.select("book_id").distinct(), "book_id", "left_semi")
    text = lines.join(behind, "book_id").filter(F.col("pos") >= F.col("toc_end")).drop("toc_end")
    text = settled(text) if "chars" in text.columns else briefs(text)  # one book of many has contents; its lines are asked several times
    heads = heading_candidates(text).filter(F.col("kind").rlike("^(?:chapter|unit|lesson)_"))
    heads = heads.groupBy("book_id", F.col("number").alias("chapter")).agg(F.min("pos").alias("_heading"))
    hit = r"^\s*\d{1,3}\.\d{1,3}\s+[A-Z]"
    labels = text.filter(F.col("line").rlike(hit)).select("book_id", "pos", *(F.regexp_extract("line", r"^\s*(\d{1,3})\.(\d{1,3})", i).cast("int").alias(c) for i, c in ((1, "chapter"), (2, "_section"))))
    labels = labels.groupBy("book_id", "chapter", "_section").agg(F.min("pos").alias("_label"))
    wanted = plan.withColumn("_section", F.get("sections", 0)["section"])
    placed = wanted.join(heads, ["book_id", "chapter"], "left").join(labels, ["book_id", "chapter", "_section"], "left")
    placed = placed.select("book_id", F.col("chapter").alias("number"), "title", F.coalesce("_heading", "_label").alias("start"), F.col("_heading").isNull().alias("by_label")).filter("start is not null")
    placed = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("book_id"))).filter(F.col("_n") >= LEAST_CHAPTERS)
    by = Window.partitionBy("book_id").orderBy("start", "number")
    sizes = book_lengths(text)
    return placed.join(sizes, "book_id").select(
        "book_id",
        F.lit("contents").alias("kind"),
        F.row_number().over(by).alias("chapter_index"),
        F.concat(F.lit("ch_"), "number").alias("chapter_id"),
        "number",
        "title",
        "start",
        F.coalesce(F.lead("start").over(by), F.col("chars")).alias("end"),
        "by_label",
    )


def contents_sections(plan: DataFrame) -> DataFrame:
    """The plan's sections as (book_id, chapter, section, title): what structure.sections takes for printed contents."""
    return plan.select("book_id", "chapter", F.explode("sections").alias("s")).select("book_id", "chapter", "s.section", "s.title")


def divided_by_contents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, chapters) of the books whose printed contents give three chapters or more that stand in the text; lines may be briefs."""
    plan = settled(contents_plan(lines))
    found = settled(anchored_chapters(lines, plan))
    return plan.join(found.select("book_id").distinct(), "book_id", "left_semi"), found
