"""Learner state and chunk ingestion as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholia.functions.num import rounded
from scholia.operators.chunking import upserted
from scholia.operators.mastery import KEY, mastery_level
from scholia.sources.tables import settled

_MASTERY = "student_id string, course_id string, chapter_id string, total_attempts long, correct_attempts long, avg_fuzzy_score double"
_CARDS = "student_id string, card_id string, repetitions int, interval_days int, easiness_factor double, last_review date"


def _half_even(x: float, digits: int) -> float:
    return float(round(x * 10**digits) / 10**digits)


def mastery_stream(attempts: DataFrame) -> DataFrame:
    """Attempts to exact chapter mastery: the running mean, rounded at every attempt. Rows of a batch go by attempt_id; later ones are later."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, right, mean = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("attempt_id")
        for score, ok in zip(rows["fuzzy_score"], rows["is_correct"], strict=True):
            mean = _half_even((mean * n + score) / (n + 1), 1)
            n, right = n + 1, right + int(ok)
        state.update((n, right, mean))
        yield pd.DataFrame([(*key, n, right, mean)], columns=[c.split()[0] for c in _MASTERY.split(", ")])

    rows = attempts.select(*KEY, "attempt_id", "fuzzy_score", "is_correct")
    out = rows.groupBy(*KEY).applyInPandasWithState(fold, _MASTERY, "n long, correct long, mean double", "update", GroupStateTimeout.NoTimeout)
    return out.withColumn("mastery_level", mastery_level(F.col("avg_fuzzy_score"), F.col("correct_attempts") / F.col("total_attempts")))


def mastery_means_stream(attempts: DataFrame) -> DataFrame:
    """The associative form: plain aggregates in update mode."""
    g = attempts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_attempts"), F.sum("is_correct").alias("correct_attempts"), F.avg("fuzzy_score").alias("_m"))
    return g.select(*KEY, "total_attempts", "correct_attempts", rounded(rounded(F.col("_m"), 6), 1).alias("avg_fuzzy_score"))


def cards_stream(reviews: DataFrame) -> DataFrame:
    """Reviews to SM-2 state per student and card."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reps, days, ease = state.get if state.exists else (0, 1, 2.5)
        rows = pd.concat(list(batches)).sort_values(["review_ts", "review_id"])
        for q in rows["quality"].clip(0, 5):
            days = 1 if q < 3 or reps == 0 else 6 if reps == 1 else max(1, round(days * ease))
            reps = reps + 1 if q >= 3 else 0
            miss = 5.0 - q
            ease = max(1.3, _half_even(ease + (0.1 - miss * (0.08 + miss * 0.02)), 3))
        state.update((reps, days, ease))
        yield pd.DataFrame([(*key, reps, days, ease, rows["review_ts"].max().date())], columns=[c.split()[0] for c in _CARDS.split(", ")])

    rows = reviews.select("student_id", "card_id", "review_id", "review_ts", "quality")
    return rows.groupBy("student_id", "card_id").applyInPandasWithState(fold, _CARDS, "reps int, days int, ease double", "update", GroupStateTimeout.NoTimeout)


def attempts_per_hour(attempts: DataFrame, late: str = "2 hours") -> DataFrame:
    """Event-time counts per hour and course; attempts later than the watermark are left out."""
    w = F.window("ts", "1 hour")
    return attempts.withWatermark("ts", late).groupBy(w, "course_id").agg(F.count(F.lit(1)).alias("attempts")).select(F.col("window.start").alias("hour"), "course_id", "attempts")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_chunks_stream(chunks: DataFrame) -> DataFrame:
    """Chunks (with content_hash) without repeats, however late they come: the hashes seen are keyed state without an end.

    Hashes lie in RocksDB on the executors' disks and in the checkpoint, so they outlast restarts and don't fill memory.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return chunks.dropDuplicates(["course_id", "chapter_id", "content_hash"])


def upsert_partitions(path: str, key: str, by: str, latest: str | None = None):
    """A foreachBatch function that upserts each batch into a Parquet table partitioned by column `by`.

    Only partitions that the batch touches are read and written again; a key never moves to another partition. Of a key that
    repeats in a batch the row with the greatest `latest` stays. A batch that is run again writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(by).distinct()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        before = spark.read.schema(batch.schema).parquet(path).join(touched, by, "left_semi") if known else batch.limit(0)
        # settled first: the rows are read from the folder that is written
        merged = settled(upserted(before, batch, key, latest))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    return write
