"""Multi-party perspective rotation: one training view of a dialogue per participant.

For every participant, the dialogue is rendered with that speaker as `assistant`, the system turns as `system` and everybody
else as a named user, together with the spans of the rendered text that a loss may look at (the assistant's own words).

A conversation is stored in blocks of BLOCK turn numbers, cut before anything is gathered, so a task holds one block, however
long the conversation. A view is the sequence of its blocks; `view_start` says where in it a block begins, so that the text
of a view and its spans follow by concatenation. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.common import body

BLOCK = 64
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Text that can't be taken for a marker."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def name_of(speaker: Column) -> Column:
    """A speaker's name as a header may hold it: one line, no marker."""
    return F.regexp_replace(escaped(speaker), r"[\r\n]+", " ")


def turn_parts(speaker: Column, text: Column, participant: Column) -> tuple[Column, Column]:
    """Head of a rendered turn, and whether the turn is the participant's own."""
    own = speaker == participant
    head = F.when(own, F.lit("assistant")).when(speaker == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), name_of(speaker)))
    return F.concat(F.lit(OPEN), head, F.lit("\n")), own


def rotate(turns: DataFrame, speaker_col: str = "role") -> DataFrame:
    """One row per conversation, participant and block of turns.

    conv_id, participant, block, n_turns, text, mask_spans ("start:end" of the participant's words in code points of the
    block, joined by commas, end excluded), masked_chars, view_start (code points of the view before the block). Participants
    are all speakers of the whole conversation but the system. Turns go by turn number, then speaker, then text; repeated
    rows are turns of their own; a null turn number comes first (block null), a null speaker is named `unknown`, a null text
    is empty, line ends in a speaker's name become spaces. Rows with a null conv_id are one conversation.
    A conversation of system turns only has no participant and no row; an empty table gives no rows.
    """
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        escaped(body("text")).alias("text"),
    )
    blocks = (
        rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"), F.count(F.lit(1)).alias("n_turns"))
    )
    people = rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("participant")).distinct()
    views = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def rendered(t: Column) -> Column:
        head, own = turn_parts(t["speaker"], t["text"], F.col("participant"))
        return F.struct(head.alias("head"), t["text"].alias("text"), own.alias("own"), (F.length(head) + F.length(t["text"]) + len(CLOSE)).alias("n"))

    # null turns would sort last inside a struct of nulls; array_sort puts null fields first, as wanted
    views = views.withColumn("parts", F.transform("turns", rendered))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"), F.lit(0).alias("n"))

    def add(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        b = a + F.length(p["text"])
        span = F.concat(F.when(acc["spans"] == "", F.lit("")).otherwise(F.lit(",")), a.cast("string"), F.lit(":"), b.cast("string"))
        return F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.concat(acc["spans"], F.when(p["own"], span).otherwise(F.lit(""))).alias("spans"),
            (acc["n"] + F.when(p["own"], F.length(p["text"])).otherwise(F.lit(0))).alias("n"),
        )

    views = views.withColumn("mask", F.aggregate("parts", start, add))
    # a block's length is known from its parts, so the running sums carry no text
    views = views.withColumn("_n", F.col("mask.at").cast("long"))
    before = F.sum("_n").over(Window.partitionBy("_c", "_p").orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    starts = views.select(F.col("conv_id").alias("_c"), F.col("participant").alias("_p"), F.col("block").alias("_b"), "_n")
    starts = starts.select("_c", "_p", "_b", F.coalesce(before, F.lit(0)).cast("long").alias("view_start"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("participant") == F.col("_p")) & F.col("block").eqNullSafe(F.col("_b"))
    return views.join(starts, same).select(
        "conv_id",
        "participant",
        "block",
        "n_turns",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("text"),
        F.col("mask.spans").alias("mask_spans"),
        F.col("mask.n").cast("long").alias("masked_chars"),
        "view_start",
    )


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.*, p.participant, CAST(floor(turn / {BLOCK}) AS BIGINT) AS block, speaker = participant AS own,
  '{OPEN}' || CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || regexp_replace(replace(speaker, '<|', '< |'), '[\\r\\n]+', ' ', 'g') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS one,
  coalesce(sum(length(head) + length(text) + {len(CLOSE)}) OVER (PARTITION BY conv_id, participant, block ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM r),
v AS (SELECT conv_id, participant, block, count(*) AS n_turns, string_agg(one, '' ORDER BY turn NULLS FIRST, speaker, text) AS text,
  coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(text) AS BIGINT), ',' ORDER BY turn NULLS FIRST, speaker, text) FILTER (WHERE own), '') AS mask_spans,
  CAST(coalesce(sum(length(text)) FILTER (WHERE own), 0) AS BIGINT) AS masked_chars
FROM s GROUP BY conv_id, participant, block)
SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, participant ORDER BY block NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS view_start FROM v
"""
