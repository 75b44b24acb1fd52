"""The line table of books, and what repeats on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.predicates import noise_line
from scholia.functions.text import line_shape, strip

HEADER_REPEATS = 5


def line_table(texts: DataFrame, order: list[str]) -> DataFrame:
    """texts (book_id, ..., text) to one row per line: line_no and pos count over the whole book.

    A book may come in parts (chapters, pages); order names them. Sums run per part first, so that a window over a book sees
    one row per part, not one per line.
    """
    book, part = order[0], order[1:]
    parts = texts.withColumn("_lines", F.split("text", "\n"))
    before = Window.partitionBy(book).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *order,
        "_lines",
        F.coalesce(F.sum(F.size("_lines")).over(before), F.lit(0)).alias("_first"),
        F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("_start"),
    )
    rows = parts.select(*order, "_first", "_start", F.posexplode("_lines").alias("_at", "line"))
    own = Window.partitionBy(*order).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        *order,
        (F.col("_first") + F.col("_at")).cast("long").alias("line_no"),
        (F.col("_start") + F.coalesce(F.sum(F.length("line") + 1).over(own), F.lit(0))).cast("long").alias("pos"),
        "line",
    )


def running_headers(lines: DataFrame, by_page: str | None = None, least: int = HEADER_REPEATS) -> DataFrame:
    """(book_id, form, n): shapes of short lines with a number that repeat on many pages (or lines, without pages)."""
    t = strip(F.col("line"))
    short = lines.filter(F.length(t).between(8, 90) & t.rlike("[A-Za-z]{3}") & t.rlike(r"\d"))
    n = F.countDistinct(by_page) if by_page else F.count(F.lit(1))
    return short.groupBy("book_id", line_shape(F.col("line")).alias("form")).agg(n.alias("n")).filter(F.col("n") >= least)


def without_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines that are no running headers."""
    shaped = lines.withColumn("form", line_shape(F.col("line")))
    return shaped.join(headers.select("book_id", "form"), ["book_id", "form"], "left_anti").drop("form")


def without_noise_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~noise_line(F.col("line")))


def without_noise(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines that are neither noise nor running headers."""
    return without_headers(without_noise_lines(lines), headers)


def body_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines joined again in order, bullets as dashes and runs of blanks as one."""
    plain = F.regexp_replace(F.regexp_replace("line", r"^[•·ò]\s*", "- "), r"[ \t]{2,}", " ")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", plain.alias("t")))), lambda x: x["t"]), "\n")
    return lines.groupBy(*by).agg(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("body"))


def printed_page_numbers(pages: DataFrame) -> DataFrame:
    """pages (book_id, page_index, text) with the page number printed on an edge: a bare number, else one at a line's end or start."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: strip(x)), lambda x: x != "")
    edge = F.when(F.size(lines) <= 6, lines).otherwise(F.concat(F.slice(lines, 1, 3), F.slice(lines, -3, 3)))
    bare = F.get(F.filter(edge, lambda x: x.rlike(r"^\d{1,4}$")), 0)
    side = F.get(F.filter(edge, lambda x: x.rlike(r"^\d{1,4}\s+\D|\D\s+\d{1,4}$")), 0)
    number = F.coalesce(bare, F.regexp_extract(side, r"^(\d{1,4})\s|\s(\d{1,4})$", 1))
    number = F.coalesce(F.nullif(number, F.lit("")), F.regexp_extract(side, r"\s(\d{1,4})$", 1))
    total = Window.partitionBy("book_id")
    found = F.expr("try_cast(_n as int)")
    df = pages.withColumn("_n", number).withColumn("_bound", F.max("page_index").over(total) + 50)
    return df.withColumn("printed_page", F.when((found >= 1) & (found <= F.col("_bound")), found)).drop("_n", "_bound")


def split_pages(texts: DataFrame) -> DataFrame:
    """texts (book_id, text) with `--- Page N ---` marks to (book_id, page_index, text)."""
    mark = r"--- (?:Section/)?Page \d+ ---"
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"--- (?:Section/)?Page (\d+) ---"), F.lit(1)), lambda x: x.cast("int"))
    parts = F.slice(F.split("text", mark), 2, F.greatest(F.lit(1), F.size(numbers)))
    rows = texts.select("book_id", F.explode(F.arrays_zip(numbers.alias("page_index"), parts.alias("text"))).alias("p"))
    return rows.filter("p.page_index is not null").select("book_id", "p.page_index", strip(F.col("p.text")).alias("text"))


def full_text(pages: DataFrame) -> DataFrame:
    """Pages joined by a blank line, in page order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    return pages.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("pages"))
