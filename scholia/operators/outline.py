"""Embedded outlines of books, and the ladder of ways to divide a book: outline, printed contents, headings, chunks.

Windows run over the entries of one book's outline, which are few; pages are joined by book and page range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import any_of, roman_number, strip
from scholia.operators.structure import LEAST_CHAPTERS, best_rung

#: Titles of front and back matter, forms of numbered titles, children that are no sections.
FRONT = r"(?i)^(?:contents|table of contents|preface|foreword|about\s+|acknowledg|title page|copyright)\b"
BACK = r"(?i)^(?:appendix|index|glossary|bibliography|references|solutions|answers|credits|errata|colophon)\b"
CHAPTER = r"(?i)^(?:chapter|unit|part|module|lesson)\s+(\d+|[ivxlcdm]+)\b[:\s-]*(.*)$"
NUMBERED = r"^(\d{1,3})\b[:\s.\-–—]+(.*)$"
LABELLED = r"^(\d+\.\d+)\b[:\s\-–—]*(.*)$"
CHAPTER_REVIEW = r"(?i)^chapter\s+review\b"
NO_SECTION = ("chapter outline", "introduction", "summary", "key terms")


def _part(c: Column, pattern: str, group: int) -> Column:
    """A group of a pattern; null where it doesn't match or holds nothing."""
    return F.nullif(strip(F.regexp_extract(c, pattern, group)), F.lit(""))


def outline_chapters(outline: DataFrame) -> DataFrame:
    """outline (book_id, seq, level, title, page) to its chapters: book_id, seq, level, number, title, page.

    Of a book's two highest levels, the first counts that has three or more entries besides front and back matter, on pages
    that never go back. A title's own number counts, else the entry's place. Books without such a level have no rows.
    """
    t = strip(F.col("title"))
    place = F.dense_rank().over(Window.partitionBy("book_id").orderBy("level"))
    own = outline.filter("page > 0").withColumn("_level", place).filter((F.col("_level") <= 2) & ~t.rlike(FRONT) & ~t.rlike(BACK))
    by = Window.partitionBy("book_id", "level").orderBy("seq")
    mark = _part(t, CHAPTER, 1)
    number = F.coalesce(F.expr("try_cast(_mark as int)"), roman_number(F.upper("_mark")), _part(t, NUMBERED, 1).cast("int"), F.row_number().over(by))
    own = own.withColumn("_mark", mark).select(
        "book_id", "seq", "level", number.alias("number"), F.coalesce(_part(t, CHAPTER, 2), _part(t, NUMBERED, 2), t).alias("title"), "page",
        (F.col("page") < F.lag("page").over(by)).alias("_back"),
    )
    levels = own.groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or("_back"), F.lit(False)).alias("_any"))
    chosen = levels.filter((F.col("_n") >= LEAST_CHAPTERS) & ~F.col("_any")).groupBy("book_id").agg(F.min("level").alias("level"))
    return own.join(chosen, ["book_id", "level"]).select("book_id", "seq", "level", "number", "title", "page")


def outline_plan(outline: DataFrame) -> DataFrame:
    """Sections of outlined books: book_id, chapter, chapter_title, label, title, first_page, stop_page.

    A child belongs to the entry of the chapters' level (or above) before it, if that is a chapter. Children with a label
    `N.M` are sections, and so are those one level below the chapter unless they are an outline, introduction, summary or key
    terms; these get the label `N.k` by place. A section stops at the next one, else at the chapter's review, else at the next
    chapter; null means the book's end.
    """
    c = outline_chapters(outline).withColumn("_stop", F.lead("page").over(Window.partitionBy("book_id").orderBy("seq")))
    level = c.groupBy("book_id").agg(F.min("level").alias("_level"))
    marks = c.select("book_id", "seq", F.struct("number", F.col("title").alias("name"), "_stop").alias("_chapter"))
    so_far = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    governing = F.last(F.when(F.col("level") <= F.col("_level"), F.struct("seq", "_chapter")), True).over(so_far)
    e = outline.join(level, "book_id").join(marks, ["book_id", "seq"], "left").withColumn("_g", governing)
    e = e.filter((F.col("level") > F.col("_level")) & F.col("_g._chapter").isNotNull()).withColumn("_t", strip(F.col("title")))
    t, chapter = F.col("_t"), Window.partitionBy("book_id", "_g.seq")
    e = e.withColumn("_review", F.min(F.when(t.rlike(CHAPTER_REVIEW), F.col("page"))).over(chapter)).filter(~t.rlike(CHAPTER_REVIEW))
    e = e.filter(t.rlike(LABELLED) | ((F.col("level") == F.col("_level") + 1) & ~any_of(F.lower(t), NO_SECTION)))
    by = chapter.orderBy("seq")
    return e.select(
        "book_id",
        F.col("_g._chapter.number").alias("chapter"),
        F.col("_g._chapter.name").alias("chapter_title"),
        F.coalesce(_part(t, LABELLED, 1), F.concat_ws(".", "_g._chapter.number", F.row_number().over(by))).alias("label"),
        F.coalesce(_part(t, LABELLED, 2), t).alias("title"),
        F.col("page").alias("first_page"),
        F.coalesce(F.lead("page").over(by), "_review", "_g._chapter._stop").alias("stop_page"),
    )


def section_words(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of outline_plan with words, counted on pages (book_id, page_index, text) by a range join; one page at least."""
    words = pages.select("book_id", "page_index", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("words"))
    stop = F.greatest(F.coalesce(F.col("stop_page"), F.lit(1 << 30)), F.col("first_page") + 1)
    hit = plan.join(words, "book_id").filter((F.col("page_index") >= F.col("first_page")) & (F.col("page_index") < stop))
    return hit.groupBy(*plan.columns).agg(F.sum("words").alias("words"))


def chapter_texts(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters of outlined books with the text of their pages: book_id, chapter_id, chapter_index, title, text."""
    by = Window.partitionBy("book_id").orderBy("seq")
    again = F.row_number().over(Window.partitionBy("book_id", "number").orderBy("seq"))
    c = outline_chapters(outline).select(
        "book_id",
        F.concat(F.lit("ch_"), "number", F.when(again > 1, F.concat(F.lit("_"), again)).otherwise(F.lit(""))).alias("chapter_id"),
        F.row_number().over(by).alias("chapter_index"),
        "title",
        "page",
        F.greatest(F.coalesce(F.lead("page").over(by), F.lit(1 << 30)), F.col("page") + 1).alias("_stop"),
    )
    hit = c.join(pages, "book_id").filter((F.col("page_index") >= F.col("page")) & (F.col("page_index") < F.col("_stop")))
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n")
    return hit.groupBy("book_id", "chapter_id", "chapter_index", F.col("title").alias("title")).agg(text.alias("text"))


def ladder(books: DataFrame, outlined: DataFrame, contents: DataFrame, headed: DataFrame, simple: DataFrame | None = None) -> DataFrame:
    """(book_id, rung) for every book: the first way that divides it.

    outlined are the chapters of embedded outlines, contents the entries of printed tables (three chapters or more count),
    headed the chapters found by headings, simple those of the simple parser; what is left goes into balanced chunks.
    """
    printed = contents.groupBy("book_id").agg(F.countDistinct("chapter").alias("_n")).filter(F.col("_n") >= LEAST_CHAPTERS)
    rungs = {"outline": outlined, "contents": printed, "headings": headed, "chunks": books} | ({} if simple is None else {"simple": simple})
    plans = [df.select("book_id", F.lit(k).alias("rung")).distinct() for k, df in rungs.items()]
    return best_rung(reduce(DataFrame.unionByName, plans))
