"""Chunks of texts for retrieval, and their deduplication."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.text import content_hash, strip
from scholia.operators.structure import first_of_each

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def paragraph_chunks(df: DataFrame, text: str = "text", least: int = 41) -> DataFrame:
    """One row per paragraph of 41 or more characters, numbered from 0 after the filter."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: F.length(x) >= least)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("chunk_index", "chunk"))


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed to `size` words; each chunk repeats the last whole sentences of `overlap` words of the one before."""
    parts = [s.strip() for s in _SENTENCE.split(text) if s.strip()]
    if not parts:
        parts = [p.strip() for p in text.split("\n\n") if len(p.strip()) > 30] or [text.strip()]
    sizes = [len(p.split()) for p in parts]
    chunks, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > size and start < i:
            chunks.append(" ".join(parts[start:i]))
            kept, start = 0, i
            while start > 0 and kept + sizes[start - 1] <= overlap:
                start -= 1
                kept += sizes[start]
            total = kept
        total += n
    chunks.append(" ".join(parts[start:]))
    return chunks


def pack_paragraphs(text: str, target: int, most: int) -> list[str]:
    """Paragraphs (sentences, if there is one only) gathered to `target` characters; the last of `most` chunks takes the rest."""
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    if len(parts) <= 1:
        parts = [s.strip() for s in _SENTENCE.split(text) if s.strip()]
    chunks, now, size = [], [], 0
    for p in parts:
        now.append(p)
        size += len(p)
        if size >= target and len(chunks) < most - 1:
            chunks.append("\n\n".join(now))
            now, size = [], 0
    return chunks + ["\n\n".join(now)] if now else chunks


def cognitive_sections(text: str, target: int = 5000) -> list[str]:
    """Paragraphs of some weight gathered to `target`; a tail under 1000 joins the last section, one under 200 goes."""
    every = [p.strip() for p in text.split("\n\n")]
    parts = [p for p in every if len(p) > 80] or [p for p in every if len(p) > 30] or [text]
    out, now, size = [], [], 0
    for p in parts:
        now.append(p)
        size += len(p)
        if size >= target:
            out.append("\n\n".join(now))
            now, size = [], 0
    tail = "\n\n".join(now)
    if len(tail) >= 200:
        if out and len(tail) < 1000:
            out[-1] += "\n\n" + tail
        else:
            out.append(tail)
    return out


def packed(text: Column, how: str = "sentences", size: int = 400, overlap: int = 50, most: int = 120) -> Column:
    """array<string> of chunks: sentences (words), paragraphs (characters) or cognitive sections (characters)."""
    run = {
        "sentences": lambda t: pack_sentences(t, size, overlap),
        "paragraphs": lambda t: pack_paragraphs(t, size, most),
        "cognitive": lambda t: cognitive_sections(t, size),
    }[how]

    # row by row: a batch is a hundred texts, where one of Arrow holds ten thousand of them, however long, and their chunks
    pack = F.udf(lambda t: run(t or ""), T.ArrayType(T.StringType()), useArrow=False)
    return pack(text)


def section_title(content: Column, number: Column) -> Column:
    """`Section n: ` and the first line of more than 15 characters that isn't made of marks and digits, up to 80 of it; a word where none is left."""
    lines = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: (F.length(x) > 15) & ~x.rlike(r"^[#\*\d\.\-:=\s]+$"))
    first = strip(F.regexp_replace(F.substring(F.coalesce(F.get(lines, 0), F.lit("")), 1, 80), r"^[#\*\d\.\-:]+\s*", ""))
    return F.concat(F.lit("Section "), number, F.lit(": "), F.when(F.length(first) > 10, first).otherwise("Theory"))


def titled_sections(df: DataFrame, text: str = "text", target: int = 5000) -> DataFrame:
    """One row per cognitive section of a text: section_index (from 1), title, content. Null texts have none; short tails join or go."""
    others = [c for c in df.columns if c != text]
    rows = df.select(*others, F.posexplode(packed(F.col(text), "cognitive", target)).alias("_at", "content"))
    index = (F.col("_at") + 1).alias("section_index")
    return rows.select(*others, index, section_title(F.col("content"), F.col("_at") + 1).alias("title"), "content")


def deduplicated_chunks(chunks: DataFrame, text: str = "document") -> DataFrame:
    """Chunks over 40 characters, one of each text per course and chapter, with hash and id. The shuffle is on the hash."""
    c = chunks.withColumn("content_hash", content_hash(F.col(text))).filter(F.length(strip(F.col(text))) > 40)
    c = c.groupBy("course_id", "chapter_id", "content_hash").agg(F.min(strip(F.col(text))).alias(text), F.count(F.lit(1)).alias("copies"))
    return c.withColumn("chunk_key", F.concat_ws("_", "course_id", "chapter_id", "content_hash"))


def upserted(existing: DataFrame, new: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """existing with the rows of new in place of those with the same key.

    A key that repeats in new is written once: the row with the greatest `latest`, and of equals the greatest by all columns.
    """
    order = [F.desc(c) for c in ([latest] if latest else []) + sorted(set(new.columns) - {key, latest})]
    new = first_of_each(new, [key], order) if order else new.distinct()
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def without_course(chunks: DataFrame, course: str) -> DataFrame:
    """Chunks but for those of a course; chunks without a course stay."""
    return chunks.filter(~F.col("course_id").eqNullSafe(course))
