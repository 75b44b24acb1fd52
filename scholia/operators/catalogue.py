"""The course catalogue: built in and own courses, newest per title, search, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import strip
from scholia.operators.structure import first_of_each


def title_key(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def newest_per_title(courses: DataFrame) -> DataFrame:
    """Add rn: 1 for the newest record of a title, more for older ones."""
    by = Window.partitionBy(title_key(F.col("title"))).orderBy(F.desc("mtime"), "course_id")
    return courses.withColumn("rn", F.row_number().over(by))


def catalogue(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built in courses and the newest own course of each title."""
    own = newest_per_title(custom).filter("rn = 1").drop("rn")
    return builtin.withColumn("is_builtin", F.lit(True)).unionByName(own.withColumn("is_builtin", F.lit(False)), allowMissingColumns=True)


def superseded(custom: DataFrame) -> DataFrame:
    """Own courses that a newer one of the same title replaces."""
    return newest_per_title(custom).filter("rn > 1").drop("rn")


def search(courses: DataFrame, text: str = "", subject: str = "All") -> DataFrame:
    """Courses whose title, subject or tier holds the text, of a subject (`All`: any)."""
    low = text.lower()
    hit = F.lit(False)
    for c in ("title", "subject", "academic_tier"):
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False))
    out = courses.filter(hit) if low else courses
    return out if subject == "All" else out.filter(F.col("subject") == subject)


def bank_courses(bank: DataFrame) -> DataFrame:
    """bank (repo map<subject, map<tier, struct<cards array>>>) to one row per card, as chapters of a course."""
    s = bank.select(F.explode("repo").alias("subject", "tiers")).select("subject", F.explode("tiers").alias("tier", "entry"))
    rows = s.select("subject", "tier", F.posexplode("entry.cards").alias("at", "card"))
    return rows.select(
        F.concat_ws("_", F.lower(F.regexp_replace("subject", r"\W+", "_")), F.lower(F.regexp_replace("tier", r"\W+", "_"))).alias("course_id"),
        "subject", F.col("tier").alias("academic_tier"), (F.col("at") + 1).alias("chapter_index"), F.col("card.topic").alias("title"), F.col("card.question").alias("question"), F.col("card.answer").alias("answer"),
    )


def quizzes_with_cards(quizzes: DataFrame, cards: DataFrame) -> DataFrame:
    """Quizzes (course_id, at, concept, ...) with the first card of their concept, else the one at their place."""
    named = first_of_each(cards, ["course_id", "topic"], ["at", "card_id"]).select("course_id", F.col("topic").alias("concept"), F.col("card_id").alias("_named"))
    placed = cards.select("course_id", "at", F.col("card_id").alias("_placed"))
    out = quizzes.join(named, ["course_id", "concept"], "left").join(placed, ["course_id", "at"], "left")
    return out.withColumn("card_id", F.coalesce("_named", "_placed")).drop("_named", "_placed")


def chapter_lookup(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """asked (course_id, ref): the chapter whose id is ref, else the one whose index is ref as text."""
    by_id = chapters.select("course_id", F.col("chapter_id").alias("ref"), F.col("title").alias("_a"))
    by_index = chapters.select("course_id", F.col("chapter_index").cast("string").alias("ref"), F.col("title").alias("_b"))
    out = asked.join(by_id, ["course_id", "ref"], "left").join(by_index, ["course_id", "ref"], "left")
    return out.withColumn("title", F.coalesce("_a", "_b")).drop("_a", "_b")


def enriched(chapters: DataFrame, canonical: DataFrame) -> DataFrame:
    """Chapters with title and text of the canonical chapter of the same index, where it has them."""
    c = canonical.select("course_id", "chapter_index", F.col("title").alias("_t"), F.col("full_text").alias("_f"))
    out = chapters.join(c, ["course_id", "chapter_index"], "left")
    put = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old)).alias(old)
    return out.withColumns({"title": put("_t", "title"), "full_text": put("_f", "full_text")}).drop("_t", "_f")


def pending(selected: DataFrame, done: DataFrame) -> DataFrame:
    """Selected chapters that aren't enriched yet."""
    return selected.join(done.select("course_id", "chapter_id"), ["course_id", "chapter_id"], "left_anti")


def coverage(chapters: DataFrame) -> DataFrame:
    """Enriched chapters per course: count, total, pending, complete."""
    has = (F.coalesce("theory_source", F.lit("")) != "").cast("int")
    g = chapters.groupBy("course_id").agg(F.sum(has).alias("enriched"), F.count(F.lit(1)).alias("total"))
    return g.select("course_id", "enriched", "total", (F.col("total") - F.col("enriched")).alias("pending"), (F.col("total") == F.col("enriched")).alias("complete"))


def rollups(chapters: DataFrame) -> DataFrame:
    """Courses from chapters (course_id, chapter_index, unit_index, sections, cards): counts and sorted units."""
    return chapters.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("chapters"),
        F.sum("sections").alias("sections"),
        F.countDistinct("unit_index").alias("units"),
        F.sum("cards").alias("cards"),
        F.array_join(F.array_sort(F.collect_set("unit_index")), ",").alias("unit_list"),
    )


def chapters_by_unit(chapters: DataFrame, units: DataFrame) -> DataFrame:
    """Chapters grouped by unit: the chapter's own unit name, else the declared one, else `Unit k`; without units one null group."""
    u = units.select("course_id", "unit_index", F.col("unit_title").alias("_u"))
    name = F.coalesce("unit_title", "_u", F.when(F.col("unit_index").isNotNull(), F.concat(F.lit("Unit "), "unit_index")))
    out = chapters.join(u, ["course_id", "unit_index"], "left").withColumn("unit", name)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chapter_index", "chapter_id"))), lambda x: x["chapter_id"])
    return out.groupBy("course_id", "unit_index", "unit").agg(F.array_join(ordered, ",").alias("chapters"))


def selected_chapters(chapters: DataFrame, specs: DataFrame) -> DataFrame:
    """Chapters (course_id, chapter_index, ...) that their course's spec (course_id, spec) names.

    `all`, nothing or no spec: all; `5`: the first five; `2-4`, `1,3,5-8`: these. Parts that are no numbers, ranges that run back and
    numbers beyond the course name nothing; a spec that names no chapter at all means all. Case and blanks don't count.
    """
    flat = F.lower(F.regexp_replace(F.coalesce("spec", F.lit("")), r"\s+", ""))
    bounds = lambda p, i: F.regexp_extract(p, r"^(\d{1,9})(?:-(\d{1,9}))?$", i)
    ranges = F.transform(
        F.filter(F.split(flat, ","), lambda p: p.rlike(r"^\d{1,9}(?:-\d{1,9})?$")),
        lambda p: F.struct(F.when(flat.rlike(r"^\d{1,9}$"), 1).otherwise(bounds(p, 1).cast("int")).alias("a"), F.coalesce(F.nullif(bounds(p, 2), F.lit("")), bounds(p, 1)).cast("int").alias("b")),
    )
    wanted = specs.groupBy("course_id").agg(F.min("spec").alias("spec")).select("course_id", ranges.alias("_ranges"))
    rows = chapters.join(wanted, "course_id", "left")
    named = F.coalesce(F.exists("_ranges", lambda r: F.col("chapter_index").between(r["a"], r["b"])), F.lit(False))
    rows = rows.withColumn("_named", named)
    some = rows.filter("_named").select("course_id").distinct().withColumn("_some", F.lit(True))
    return rows.join(some, "course_id", "left").filter(F.col("_named") | F.col("_some").isNull()).select(*chapters.columns)


def selection_labels(selected: DataFrame, chapters: DataFrame) -> DataFrame:
    """(course_id, label) such as `1-5, 9 (6 of 41)`: runs of selected numbers by gaps and islands."""
    run = F.col("chapter_index") - F.row_number().over(Window.partitionBy("course_id").orderBy("chapter_index"))
    runs = selected.withColumn("_run", run).groupBy("course_id", "_run").agg(F.min("chapter_index").alias("a"), F.max("chapter_index").alias("b"), F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"])
    labels = runs.groupBy("course_id").agg(F.array_join(ordered, ", ").alias("_t"), F.sum("n").alias("_n"))
    total = chapters.groupBy("course_id").agg(F.count(F.lit(1)).alias("_all"))
    return labels.join(total, "course_id").select("course_id", F.concat("_t", F.lit(" ("), "_n", F.lit(" of "), "_all", F.lit(")")).alias("label"))


def newest_courses(courses: DataFrame) -> DataFrame:
    """Courses, the newest first; equal times by id."""
    return courses.orderBy(F.desc("mtime"), "course_id")
