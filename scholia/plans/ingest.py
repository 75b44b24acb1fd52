"""Textbooks to courses: clean, find the subject, divide, extract theory, chunk, deduplicate, assess, roll up, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import chapter_title, clean_text, subject
from scholia.operators import catalogue, chunking, contents, extraction, lines, outline, section_kinds, simple_chapters, structure
from scholia.sources.tables import settled
from scholia.streaming.learners import upsert_partitions

LEAST_TEXT = 50
CHUNKED, MOST_CHUNKS = 8000, 15


def ingest(books: DataFrame, outlines: DataFrame | None = None) -> dict[str, DataFrame]:
    """books (book_id, title, text) to chapters, theory, chunks, courses, assessments, and the way each book was divided.

    Text stays in rows of lines, sections and chapters; a book is never one row. A book with an embedded outline (outlines:
    book_id, seq, level, title, page) and page marks is divided by it, one with printed contents by these, others by their
    headings, else by the simple parser; what is left goes into balanced chunks. Sections are those that the contents list, else
    those of the family of headings that divides the book best.
    """
    clean = books.withColumn("text", clean_text(F.col("text"))).filter(F.length("text") >= LEAST_TEXT)
    clean = clean.withColumn("subject", subject(F.col("title"), F.col("text")))
    table = lines.line_table(clean.select("book_id", "text"), ["book_id"])
    if outlines is None:
        outlines = books.sparkSession.createDataFrame([], "book_id string, seq long, level int, title string, page int")
    by_outline = outline.chapter_texts(outlines, lines.split_pages(books.select("book_id", "text"))).withColumn("text", clean_text(F.col("text")))
    by_outline = settled(structure.with_units(by_outline))
    table = table.join(by_outline.select("book_id").distinct(), "book_id", "left_anti")
    # a bare mark repeats like a running header, but divides the book
    headers = lines.running_headers(table).filter(~F.col("form").rlike("^(?:chapter|unit|part|lesson|module) #$"))
    plain = settled(lines.without_headers(table, headers))
    # a bare page number may head a chapter, so noise goes after the headings are found
    kept = lines.without_noise_lines(plain)
    plan, by_contents = contents.divided_by_contents(plain)
    headed = structure.chapters(plain.join(by_contents.select("book_id").distinct(), "book_id", "left_anti"))
    kinds = settled(section_kinds.section_kinds(kept, headed))
    listed = structure.printed_contents(plain).join(headed.select("book_id").distinct(), "book_id", "left_semi").select("book_id", "chapter", "section", "title")
    numbered = headed.join(kinds.filter("kind = 'numdot'"), "book_id", "left_semi").unionByName(by_contents.drop("by_label"))
    divided = structure.sections(kept, numbered, contents.contents_sections(plan).unionByName(listed))
    divided = divided.unionByName(section_kinds.sections_by_kind(kept, headed, kinds.filter("kind <> 'numdot'")))
    found = structure.with_units(by_contents.drop("by_label").unionByName(headed))
    body = lines.body_text(structure.chapter_of_lines(kept, found), ["book_id", "chapter_id"])
    chapters = found.join(body, ["book_id", "chapter_id"]).select("book_id", "chapter_id", "chapter_index", chapter_title(F.col("title")).alias("title"), "unit_index", F.col("body").alias("text"))
    chapters = chapters.unionByName(by_outline.select(*chapters.columns))
    simple = settled(simple_chapters.simple_chapters(plain.join(found.select("book_id").distinct(), "book_id", "left_anti"), structure.MOST_CHAPTERS))
    chapters = chapters.unionByName(simple.select("book_id", F.concat(F.lit("ch_"), "chapter_index").alias("chapter_id"), "chapter_index", chapter_title(F.col("title")).alias("title"), (F.floor((F.col("chapter_index") - 1) / 7) + 1).cast("int").alias("unit_index"), F.col("content").alias("text")))
    rungs = outline.ladder(clean, by_outline, plan, headed, simple)
    rest = clean.join(rungs.filter("rung = 'chunks'"), "book_id", "left_semi")
    parts = rest.select("book_id", F.posexplode(chunking.packed(F.col("text"), "paragraphs", 24_000)).alias("_i", "text"))
    i = F.col("_i") + 1
    parts = parts.select("book_id", F.concat(F.lit("ch_"), i).alias("chapter_id"), i.alias("chapter_index"), F.concat(F.lit("Part "), i).alias("title"), (F.floor(F.col("_i") / 7) + 1).cast("int").alias("unit_index"), "text")
    chapters = settled(chapters.unionByName(parts))
    keyed = chapters.withColumn("chapter_key", F.concat_ws("/", "book_id", "chapter_id"))
    theory = extraction.chapter_theory(keyed.select(F.col("chapter_key").alias("chapter_id"), "title", "text"))
    pieces = chapters.select(F.col("book_id").alias("course_id"), "chapter_id", F.explode(F.slice(chunking.packed(F.substring("text", 1, CHUNKED), "sentences", 400, 40), 1, MOST_CHUNKS)).alias("document"))
    counted = keyed.join(theory.select(F.col("chapter_id").alias("chapter_key"), F.size("cards").alias("cards")), "chapter_key")
    parts_of = divided.groupBy("book_id", "chapter_id").agg(F.count(F.lit(1)).alias("_sections"))
    counted = counted.join(parts_of, ["book_id", "chapter_id"], "left").withColumn("sections", F.coalesce("_sections", F.lit(1)))
    courses = catalogue.rollups(counted.select(F.col("book_id").alias("course_id"), "unit_index", "sections", "cards"))
    courses = courses.join(clean.select(F.col("book_id").alias("course_id"), "title", "subject"), "course_id")
    items = theory.join(keyed.select(F.col("chapter_key").alias("chapter_id"), F.col("book_id").alias("course_id"), "chapter_index"), "chapter_id")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("chapter_index", c)))), lambda x: x[c])
    assessments = items.groupBy("course_id").agg(listed("quiz").alias("quizzes"), listed("exam").alias("finalExam"))
    return {"chapters": chapters, "theory": theory, "chunks": chunking.deduplicated_chunks(pieces), "courses": courses, "assessments": assessments, "rungs": rungs}


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the tables of ingest() below a folder, each partitioned by its course and upserted by its key.

    Courses that aren't among the tables stay as they are, those that are get their rows replaced or added, so publishing a
    course again changes nothing. Chunks are theirs by content; chapters and theory by id.
    """
    keys = {"chapters": "chapter_key", "chunks": "chunk_key", "courses": "course_id", "assessments": "course_id"}
    for name, key in keys.items():
        df = tables[name]
        if name == "chapters":
            df = df.select(F.col("book_id").alias("course_id"), F.concat_ws("/", "book_id", "chapter_id").alias("chapter_key"), *[c for c in df.columns if c != "book_id"])
            df = df.join(tables["theory"].select(F.col("chapter_id").alias("chapter_key"), "summary", "objectives", "cards", "theory_source"), "chapter_key", "left")
        by = "course_id"
        if key == by:  # a partition's column isn't in its files, so the key has one of its own
            df, key = df.withColumn("course_key", F.col(by)), "course_key"
        upsert_partitions(f"{folder.rstrip('/')}/{name}", key, by)(df, 0)
