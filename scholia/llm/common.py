"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that count as white space for the text contracts.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests, one machine) a fresh local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables made by cut() whose readers have been written themselves."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.written_to
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, like: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while like.lower() in taken:
        like += "_"
    return like


def keep_rows(rows: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """rows without those that judged (key, kept; one row for each that was judged) doesn't keep; of kept rows of one key, one stays.

    Keys may be null; rows that weren't judged stay; rows keep all their columns, whatever their names. Of rows that are equal
    in the key but not in other columns any may stay.
    """
    tag = free_name(rows, "_few")
    few = cut(judged.groupBy(*key, "kept").agg(F.count(F.lit(1)).alias("_n")).filter("not kept or _n > 1"), "judged")
    few = few.select(F.struct(*key).alias(tag), F.col("kept").alias(f"{tag}_kept"))
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(few[tag][k]) for k in key))
    twice = rows.join(few.filter(few[f"{tag}_kept"]), same, "left_semi").dropDuplicates(key)
    return rows.join(few, same, "left_anti").unionByName(twice)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5 == 0


def body(text: Column | str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
