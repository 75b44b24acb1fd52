"""Exact duplicates by a tree merge of sorted digest runs.

Every row's normalised text becomes a digest. Each partition's digests are a run: each digest once, sorted, with the smallest
id and the number of rows. In every round FAN neighbouring runs meet in ranges of (run, digest), are sorted there, of equal
digests the smallest verified id is retained, and the merged run is written in order as the next round's input, until one run
is left, spread over all ranges of digests. Rounds grow with the logarithm of the number of partitions; a digest has one row
for each incoming run and round at most, however many copies there are.

Only DataFrame functions; the text itself is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import SPACES, body, cut, forget, free_name, keep_rows

FAN = 4
#: SHA-256 names the text; byte length and a second, unrelated hash verify it.
KEY = ["_sha", "_bytes", "_check"]


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, run and verified digest of each row."""
    rows = documents.select(F.col(id_col).alias("_id"), F.regexp_replace(body(text_col), SPACES, " ").alias("_norm"))
    return rows.select(
        "_id",
        F.spark_partition_id().alias("_run"),
        F.unhex(F.sha2("_norm", 256)).alias("_sha"),
        F.octet_length("_norm").alias("_bytes"),
        F.xxhash64("_norm").alias("_check"),
    )


def merge_runs(rows: DataFrame) -> DataFrame:
    """The last run: each digest with its smallest id and number of rows."""
    left = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    first = rows.groupBy("_run", *KEY).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    runs = cut(first.sortWithinPartitions("_run", *KEY), "run")
    while left > 1:
        left = -(-left // FAN)
        near = runs.withColumn("_run", F.floor(F.col("_run") / FAN).cast("int"))
        merged = near.repartitionByRange("_run", *KEY).sortWithinPartitions("_run", *KEY).groupBy("_run", *KEY)
        merged = merged.agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size")).sortWithinPartitions("_run", *KEY)
        last, runs = runs, cut(merged, "run")
        forget(last)
    return runs.drop("_run")


def exact_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so empty and null texts form one group. White space runs count as one space. An id that
    occurs twice with equal text keeps both rows (both are `kept` if the id is the smallest). A null id never wins over
    another id; a group of null ids only has a null keep_id and keeps its rows. An empty table gives no rows; columns
    other than id and text are ignored.
    """
    rows = cut(digests(documents, id_col, text_col), "digests")
    # Spark's adaptive join splits the partition of a digest that holds a large share of all rows.
    return rows.join(merge_runs(rows), KEY).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with one row of each group of exact_duplicates, of the smallest id; of several such rows, one.

    All columns stay, whatever their names. Null texts are empty texts and one group, null ids give way to others, an empty
    table gives no rows.
    """
    name = free_name(documents, "_sha")
    sha = F.lower(F.sha2(F.regexp_replace(body(text_col), SPACES, " "), 256))
    judged = exact_duplicates(documents, id_col, text_col).select(F.col("doc_id").alias(id_col), F.col("text_sha256").alias(name), "kept")
    return keep_rows(documents.withColumn(name, sha), judged, [id_col, name]).drop(name)


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
