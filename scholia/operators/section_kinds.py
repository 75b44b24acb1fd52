"""Sections of chapters by the family of headings that divides a book best: numbered, dashed, lettered, hashed, short lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import strip
from scholia.operators.structure import LABELLED, LONG, LONGEST_LINE, chapter_of_lines, cut_sections

#: Families of section headings: pattern, group of the title, what speaks for or against the family.
SECTION_KINDS = (
    ("numdot", r"^[ \t]*(\d{1,3})\.(\d{1,2})\b[ \t]*[:.\-–—]?[ \t]*([^\n]{2,90})$", 3, 0.10),
    ("numdot_deep", r"^[ \t]*(\d{1,3})\.(\d{1,2})\.(\d{1,2})\b[ \t]*[:.\-–—]?[ \t]*([^\n]{2,90})$", 3, 0.07),
    ("dashdot", r"^[ \t]*(\d{1,3})[ \t]*[-–—][ \t]*([^\n]{2,90})$", 2, 0.02),
    ("letdot", r"^[ \t]*([A-Z])[.)][ \t]+([^\n]{3,80})$", 2, 0.0),
    ("shortline", r"^[ \t]*([A-Z][A-Za-z0-9 ,'&\-–—]{3,70})[ \t]*$", 1, -0.18),
)
NUMBERED = ("numdot", "numdot_deep")
#: Hits of a chapter that count as a division, and the raw score and share of chapters a family needs.
FEWEST, MOST, NEEDED = 2, 15, 0.6
HASHED = r"^[ \t]*(#{1,6})[ \t]*(.+?)[ \t]*#*[ \t]*$"


def chapter_hits(own: DataFrame) -> DataFrame:
    """(book_id, chapter_id, hash_level, one count per family, hashes): what each chapter's lines hold; own: lines with their chapter."""
    t = F.col("line")
    counts = []
    for kind, pattern, _, _ in SECTION_KINDS:
        if kind in NUMBERED:
            mine = t.rlike(pattern) & (F.regexp_extract(t, pattern, 1).cast("int") == F.col("number"))
            # a set of two digits each: several distinct counts would repeat every line
            counts.append(F.size(F.collect_set(F.when(mine, F.regexp_extract(t, pattern, 2)))).cast("long").alias(kind))
        else:
            counts.append(F.count_if(t.rlike(pattern)).alias(kind))
    head = F.min(F.when(F.col("pos") == F.col("start"), F.length(F.regexp_extract(t, r"^[ \t]*(#*)", 1))))
    first = own.filter((F.col("kind") == "hash_headings") & (F.col("pos") == F.col("start")))
    levels = first.groupBy("book_id").agg(F.min(F.length(F.regexp_extract(t, r"^[ \t]*(#*)", 1))).alias("_level"))
    deeper = t.rlike(r"^[ \t]*#+[ \t]*[^# \t]") & (F.length(F.regexp_extract(t, r"^[ \t]*(#+)", 1)) >= F.col("_level") + 1)
    return own.join(levels, "book_id", "left").groupBy("book_id", "chapter_id").agg(head.alias("hash_level"), *counts, F.count_if(deeper).alias("hashes"), F.first("_level").alias("level"))


def section_kinds(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, kind, score, level): the family that divides a book's chapters best; `chunk` where none does.

    Raw score: 0.7 of the share of chapters with 2 to 15 hits (of numbered families: different labels with the chapter's own
    number), 0.3 of the mean hits, eight at most. The family's own weight is added for the choice; the chosen one needs a raw
    score of 0.6. In books of hash headings the level below the chapters' comes first, if 60 % of the chapters have 2 to 15 of
    it. Books with one chapter go into chunks. level: of the hash headings that are sections, else null. lines may be briefs.
    """
    if "chars" in lines.columns:  # lines that are only long count for no family
        lines = lines.filter((F.length("line") <= LONG) | strip(F.col("line")).rlike(LABELLED) | (F.length(strip(F.col("line"))) <= LONG))
    per = chapter_hits(chapter_of_lines(lines, chapters.select("book_id", "chapter_id", "chapter_index", "number", "start", "end", "kind"), "kind", "start"))
    share = lambda c: F.avg(F.col(c).between(FEWEST, MOST).cast("double"))
    raw = lambda c: 0.7 * share(c) + 0.3 * F.least(F.avg(c), F.lit(8.0)) / 8
    books = per.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("_chapters"), F.min("level").alias("_level"), share("hashes").alias("_hashed"), *(raw(k).alias(k) for k, *_ in SECTION_KINDS)
    )
    rows = F.array(*(F.struct((F.col(k) + weight).alias("total"), F.lit(-i).alias("place"), F.lit(k).alias("kind"), F.col(k).alias("raw")) for i, (k, _, _, weight) in enumerate(SECTION_KINDS)))
    best = F.array_max(rows)
    by_hash = F.col("_level").isNotNull() & (F.col("_chapters") >= 2) & (F.col("_hashed") >= NEEDED)
    fits = (F.col("_chapters") >= 2) & (best["raw"] >= NEEDED) & (best["total"] > 0)
    return books.select(
        "book_id",
        F.when(by_hash, "hash_headings").when(fits, best["kind"]).otherwise("chunk").alias("kind"),
        (F.rint(F.when(by_hash, F.col("_hashed")).otherwise(best["raw"]) * 1e6) / 1e6).alias("score"),
        F.when(by_hash, F.col("_level") + 1).alias("level"),
    )


def sections_by_kind(lines: DataFrame, chapters: DataFrame, kinds: DataFrame) -> DataFrame:
    """Sections of the books whose family of section_kinds isn't `chunk`, in the form of structure.sections.

    Numbered headings count under their own chapter, each label once; the others are numbered in order. Titles have three
    letters in a row (hash headings: three characters) and no page number; heading lines have 110 characters at most.
    """
    chosen = kinds.filter("kind <> 'chunk'").select("book_id", F.col("kind").alias("_kind"), "level")
    own = chapter_of_lines(lines, chapters.select("book_id", "chapter_id", "chapter_index", "number", "start", "end", F.col("kind").alias("_chapter_kind")), "_chapter_kind", "start")
    own = own.join(chosen, "book_id").repartition("book_id", "chapter_id")
    t, kind = strip(F.col("line")), F.col("_kind")
    unpaged = lambda c: strip(F.regexp_replace(c, r"\s+\d{1,4}\s*$", ""))
    name = label = F.lit(None).cast("string")
    for k, pattern, group, _ in SECTION_KINDS:
        hit = (kind == k) & t.rlike(pattern)
        if k in NUMBERED:
            parent = F.regexp_extract(t, pattern, 1).cast("int")
            hit = hit & (F.col("_chapter_kind").isin("hash_headings", "titled_caps") | (parent == F.col("number")))
            label = F.when(hit, F.concat_ws(".", parent, F.regexp_extract(t, pattern, 2))).otherwise(label)
        title = unpaged(F.regexp_extract(t, pattern, group))
        name = F.when(hit & title.rlike("[A-Za-z]{3,}"), title).otherwise(name)
    hashed = F.regexp_extract(t, HASHED, 2)
    hit = (kind == "hash_headings") & t.rlike(HASHED) & (F.length(F.regexp_extract(t, r"^(#*)", 1)) >= F.col("level"))
    name = F.when(hit & (F.length(hashed) >= 3), hashed).otherwise(name)
    short = F.length(t).between(1, LONGEST_LINE) & (F.col("pos") != F.col("start"))
    own = own.withColumn("_name", F.when(short, name)).withColumn("_label", F.when(F.col("_name").isNotNull(), label))
    first = F.row_number().over(Window.partitionBy("book_id", "chapter_id", "_label").orderBy("line_no")) == 1
    own = own.withColumn("_name", F.when(F.col("_label").isNull() | first, F.col("_name")))
    place = F.count("_name").over(Window.partitionBy("book_id", "chapter_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    own = own.withColumn("_mark", F.when(F.col("_name").isNotNull(), place))
    own = own.withColumn("_label", F.when(F.col("_mark").isNotNull(), F.coalesce("_label", F.concat_ws(".", "number", "_mark"))))
    return cut_sections(own)
