"""Spaced repetition by the SM-2 rule, for all cards of all students at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.num import rounded

FIRST_EASE, LEAST_EASE = 2.5, 1.3
MATURE_DAYS = 21
#: Intervals grow without end; beyond this many days neither a day count nor a date has room for more.
MOST_DAYS = 2_147_000_000


def step(acc: Column, quality: Column) -> Column:
    """State (reps, days, ease) after a review; the interval grows by the ease before its change."""
    q = F.least(F.lit(5), F.greatest(F.lit(0), quality))
    grown = F.greatest(F.lit(1), F.least(F.lit(float(MOST_DAYS)), rounded(acc["days"] * acc["ease"])).cast("int"))
    days = F.when(q < 3, 1).when(acc["reps"] == 0, 1).when(acc["reps"] == 1, 6).otherwise(grown)
    miss = (5 - q).cast("double")
    return F.struct(
        F.when(q < 3, 0).otherwise(acc["reps"] + 1).alias("reps"),
        days.cast("int").alias("days"),
        F.greatest(F.lit(LEAST_EASE), rounded(acc["ease"] + (0.1 - miss * (0.08 + miss * 0.02)), 3)).alias("ease"),
    )


def schedules(reviews: DataFrame) -> DataFrame:
    """One row per student and card: the state after all reviews in order of time, and the next review's day.

    A group is one learner's reviews of one card. The course is the latest one that is not empty.
    """
    ordered = F.array_sort(F.collect_list(F.struct("review_ts", "review_id", "quality")))
    start = F.struct(F.lit(0).alias("reps"), F.lit(1).alias("days"), F.lit(FIRST_EASE).alias("ease"))
    named = F.coalesce(F.col("course_id"), F.lit("")) != ""
    g = reviews.groupBy("student_id", "card_id").agg(
        F.aggregate(ordered, start, lambda acc, x: step(acc, x["quality"])).alias("f"),
        F.coalesce(F.max_by(F.when(named, F.col("course_id")), F.when(named, F.struct("review_ts", "review_id"))), F.lit("")).alias("course_id"),
        F.to_date(F.max("review_ts")).alias("last_review"),
        F.count(F.lit(1)).alias("reviews"),
    )
    return g.select(
        "student_id", "card_id", "course_id", "reviews",
        F.col("f.reps").alias("repetitions"), F.col("f.days").alias("interval_days"), F.col("f.ease").alias("easiness_factor"),
        "last_review", F.date_add("last_review", F.col("f.days")).alias("next_review"),
    )


HISTORY = "student_id string, card_id string, review_id long, review_ts timestamp, quality int, repetitions int, interval_days int, easiness_factor double"


def _rint(x: float, digits: int = 0) -> float:
    return float(np.rint(x * 10**digits) / 10**digits)


def review_history(reviews: DataFrame) -> DataFrame:
    """One row per review: the card's state after it (repetitions, interval, ease) and the next day it is due.

    Reviews of a card are sorted into one partition and walked as a stream with three numbers of state, so a card may have any
    number of them. Quality counts from 0 to 5, null as 0. Repeated reviews each count; an empty table gives no rows. A long run
    of good reviews reaches days beyond the dates of Python and pandas, so Spark adds the days.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        card, reps, days, ease = None, 0, 1, FIRST_EASE
        for rows in batches:
            out = []
            for student, name, raw in zip(rows["student_id"], rows["card_id"], rows["quality"].fillna(0).astype(int), strict=True):
                if (student, name) != card:
                    card, reps, days, ease = (student, name), 0, 1, FIRST_EASE
                q = min(5, max(0, raw))
                days = 1 if q < 3 or reps == 0 else 6 if reps == 1 else max(1, int(min(MOST_DAYS, _rint(days * ease))))
                reps = reps + 1 if q >= 3 else 0
                ease = max(LEAST_EASE, _rint(ease + (0.1 - (5.0 - q) * (0.08 + (5.0 - q) * 0.02)), 3))
                out.append((q, reps, days, ease))
            state = pd.DataFrame(out, columns=["quality", "repetitions", "interval_days", "easiness_factor"], index=rows.index)
            yield pd.concat([rows[["student_id", "card_id", "review_id", "review_ts"]], state], axis=1)

    rows = reviews.select("student_id", "card_id", "review_id", "review_ts", "quality")
    rows = rows.repartition("student_id", "card_id").sortWithinPartitions("student_id", "card_id", "review_ts", "review_id")
    return rows.mapInPandas(walk, HISTORY).withColumn("next_review", F.date_add(F.to_date("review_ts"), F.col("interval_days")))


def due_cards(state: DataFrame, as_of: str, course: str | None = None) -> DataFrame:
    """Cards due on a day, the longest overdue first; cards without a course belong to every course."""
    due = state.filter(F.col("next_review") <= F.lit(as_of).cast("date"))
    if course:
        due = due.filter((F.col("course_id") == course) | (F.col("course_id") == ""))
    return due.orderBy("next_review", "student_id", "card_id")


def card_statistics(state: DataFrame, as_of: str, students: DataFrame | None = None) -> DataFrame:
    """Counts of cards per student; students (student_id) without a card have zeros and the first ease."""
    found = state.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("total_cards"),
        F.sum((F.col("next_review") <= F.lit(as_of).cast("date")).cast("int")).alias("due_today"),
        F.sum((F.col("interval_days") >= MATURE_DAYS).cast("int")).alias("mature_cards"),
        F.sum((F.col("interval_days") < MATURE_DAYS).cast("int")).alias("learning_cards"),
        rounded(rounded(F.avg("easiness_factor"), 6), 2).alias("avg_easiness"),
    )
    if students is None:
        return found
    found = students.select("student_id").distinct().join(found, "student_id", "left")
    return found.na.fill(0, ["total_cards", "due_today", "mature_cards", "learning_cards"]).na.fill(FIRST_EASE, ["avg_easiness"])
