"""Readers of textbooks, courses, dialogues and logs, and writers of their results. Paths are read by Spark only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import subject_from_file
from scholia.sources.tables import settled

_CARD = "struct<id:string,topic:string,question:string,answer:string>"
COURSE = (
    "course_id string, title string, subject string, academic_tier string, "
    "chapters array<struct<chapter_id:string,chapter_index:int,title:string,full_text:string,content:string,summary:string,objectives:array<string>,"
    f"cards:array<{_CARD}>,theory_source:string>>, quizzes array<struct<id:string,text:string,concept:string,expected_answer:string>>, "
    "finalExam array<struct<qId:string,moduleOrigin:string,text:string,expected:string,formula:string,misconception:string>>, _corrupt_record string"
)
DIALOGUE = "background_info struct<topic:string>, conversation array<struct<role:string,text:string>>"


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark where valid, else Latin-1."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(F.decode(bare, "ISO-8859-1"))


def read_books(spark: SparkSession, path: str, kinds: str = "*.{txt,md}") -> DataFrame:
    """One row per text file under path: book_id (file name), subject, text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", kinds).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("book_id"), subject_from_file(name).alias("subject"), decoded(F.col("content")).alias("text"))


def read_courses(spark: SparkSession, path: str) -> DataFrame:
    """Course records, one JSON document per file; broken files are left out, missing keys are null."""
    raw = spark.read.schema(COURSE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    # written, since Spark refuses to read the column of broken records alone
    return settled(raw).filter("_corrupt_record is null").drop("_corrupt_record")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of JSON array files as turns: topic, turn, role, text."""
    rows = spark.read.schema(DIALOGUE).option("multiLine", True).json(path).withColumn("conv_id", F.monotonically_increasing_id())
    return rows.select("conv_id", F.coalesce("background_info.topic", F.lit("Academic Topic")).alias("topic"), F.posexplode("conversation").alias("turn", "t")).select("conv_id", "topic", "turn", "t.role", "t.text")


def interaction_rows(log: DataFrame) -> DataFrame:
    """Log rows with one user column and a default action."""
    return log.select("row_id", F.coalesce("user_id", "student_id").alias("user"), F.coalesce("action_type", F.lit("QA")).alias("action"), "elapsed_time")


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.option("header", True).csv(path).withColumn("row_id", F.monotonically_increasing_id())
    for c in ("user_id", "student_id", "action_type", "elapsed_time"):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast("string"))
    return interaction_rows(log)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by a key, the same on every run."""
    return df.orderBy(key).limit(n)


def write_messages(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines of {"messages": [...]}."""
    df.select("messages").write.mode("append" if append else "errorifexists").json(path)


def write_courses(df: DataFrame, path: str) -> None:
    """Courses partitioned by id; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").partitionBy("course_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_attempts(df: DataFrame, path: str) -> None:
    from scholia.operators.mastery import normalised_attempts

    normalised_attempts(df).write.mode("append").parquet(path)
