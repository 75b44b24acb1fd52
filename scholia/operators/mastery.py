"""Learner analytics over graded attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.num import rounded

KEY = ["student_id", "course_id", "chapter_id"]


def mastery_level(score: Column, share: Column) -> Column:
    return F.when((score >= 85.0) & (share >= 0.8), "High Mastery").when(score >= 65.0, "Moderate Mastery").otherwise("Developing")


def normalised_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts as they are logged: empty courses and chapters have defaults."""
    put = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return attempts.withColumns({"course_id": put("course_id", "general"), "chapter_id": put("chapter_id", "ch_1")})


def student_summary(attempts: DataFrame, students: DataFrame | None = None) -> DataFrame:
    """One row per student; with a list of students, those without attempts get the row of a new student."""
    a = attempts.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        rounded(F.sum("is_correct") / F.count(F.lit(1)) * 100.0, 1).alias("accuracy_rate"),
        rounded(rounded(F.avg("fuzzy_score"), 6), 1).alias("avg_score"),
        rounded(rounded(F.avg("latency_seconds"), 6), 1).alias("avg_latency"),
    )
    if students is not None:
        a = students.select("student_id").distinct().join(a, "student_id", "left").na.fill(0).na.fill(0.0)
    rate = F.col("accuracy_rate")
    label = (
        F.when(F.col("total_attempts") == 0, "New Student (No History)")
        .when(rate >= 80.0, "Accelerated Mastery Trajectory")
        .when(rate >= 50.0, "Steady Conceptual Growth")
        .otherwise("Foundational Remediation Recommended")
    )
    return a.withColumn("learning_trajectory", label)


def chapter_mastery_exact(attempts: DataFrame) -> DataFrame:
    """The running mean rounded at every attempt in order of arrival: a fold over the ordered attempts of a chapter.

    A group is one learner's attempts at one chapter; only order, score and mark are gathered. For learners without a bound
    (bots), chapter_mastery is the associative form.
    """
    ordered = F.array_sort(F.collect_list(F.struct("attempt_id", "fuzzy_score", "is_correct")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("right"), F.lit(0.0).alias("mean"))

    def add(acc: Column, x: Column) -> Column:
        mean = rounded((acc["mean"] * acc["n"] + x["fuzzy_score"]) / (acc["n"] + 1), 1)
        return F.struct((acc["n"] + 1).alias("n"), (acc["right"] + x["is_correct"]).alias("right"), mean.alias("mean"))

    g = attempts.groupBy(*KEY).agg(F.aggregate(ordered, start, add).alias("f"), F.max("ts").alias("last_updated"))
    return g.select(
        *KEY,
        F.col("f.n").alias("total_attempts"),
        F.col("f.right").alias("correct_attempts"),
        F.col("f.mean").alias("avg_fuzzy_score"),
        mastery_level(F.col("f.mean"), F.col("f.right") / F.col("f.n")).alias("mastery_level"),
        "last_updated",
    )


def chapter_mastery(attempts: DataFrame) -> DataFrame:
    """The plain mean, rounded once; combines before the shuffle."""
    g = attempts.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.sum("is_correct").alias("correct_attempts"),
        rounded(rounded(F.avg("fuzzy_score"), 6), 1).alias("avg_fuzzy_score"),
        F.max("ts").alias("last_updated"),
    )
    return g.withColumn("mastery_level", mastery_level(F.col("avg_fuzzy_score"), F.col("correct_attempts") / F.col("total_attempts")))


def heatmap(mastery: DataFrame, student: str | None = None, course: str | None = None) -> DataFrame:
    """Chapters of each student's courses, or of those named, in string order of the chapter id."""
    for column, wanted in (("student_id", student), ("course_id", course)):
        mastery = mastery if wanted is None else mastery.filter(F.col(column) == wanted)
    return mastery.orderBy("student_id", "course_id", "chapter_id")


def attempts_rollup(attempts: DataFrame) -> DataFrame:
    """Counts and correct answers by student, course and chapter with subtotals."""
    return attempts.rollup(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("correct"), F.grouping_id().alias("level"))
