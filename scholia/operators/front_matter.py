"""Front matter and printed contents: where the body of a book starts, and headings that stand before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.predicates import BOILERPLATE
from scholia.functions.text import any_of, strip

SEARCHED = 35_000
TOC_LINE = r"\.{3,}\s*\d{1,4}\s*$|\s\d{1,4}\s*$"
PROSE = 120


def body_start(lines: DataFrame) -> DataFrame:
    """(book_id, body_start): the first chapter-like line after the last `Preface` (+200) or `Contents` (+1500) of the front; 0 without one."""
    t = F.col("line")
    front = lines.filter(F.col("pos") < SEARCHED)
    mark = F.when(t.rlike(r"(?i)^\s*preface\b"), F.col("pos") + 200).when(t.rlike(r"(?i)^\s*(?:table of )?contents\b"), F.col("pos") + 1500)
    after = front.groupBy("book_id").agg(F.coalesce(F.max(mark), F.lit(0)).alias("_after"))
    start = F.when(t.rlike(r"(?i)^\s*(?:chapter\s+(?:1|one|i)\b|unit\s+1\b|1\.\s+\S|introduction\b)") & (F.col("pos") >= F.col("_after")) & (F.col("_after") > 0), F.col("pos"))
    return front.join(after, "book_id").groupBy("book_id").agg(F.coalesce(F.min(start), F.lit(0)).alias("body_start"))


def contents_end(lines: DataFrame, within: int = 400) -> DataFrame:
    """(book_id, toc_open, toc_end, entries): first line and end of the printed contents and its number of entries.

    The first `contents` line in the front (6000 characters or 35 %) opens it; it ends with the last line that looks like an
    entry among the next lines, before the first line of prose.
    """
    t = F.col("line")
    size = lines.groupBy("book_id").agg((F.max("pos") * 0.35).alias("_front"))
    # marks are few: found before any join, they make the other sides small too
    marks = lines.filter(t.rlike(r"(?i)^\s*(?:table of |brief )?contents\s*$")).join(size, "book_id")
    first = marks.filter(F.col("pos") <= F.greatest(F.lit(6000.0), F.col("_front"))).groupBy("book_id").agg(F.min("line_no").alias("_open"))
    after = lines.join(first, "book_id").filter((F.col("line_no") > F.col("_open")) & (F.col("line_no") <= F.col("_open") + within))
    stop = after.groupBy("book_id").agg(F.min(F.when(F.length("line") > PROSE, F.col("line_no"))).alias("_stop"))
    # before prose no line is long: the length is asked first, as Spark asks all lines before the join
    own = after.join(stop, "book_id").filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop"))).filter((F.length(t) <= PROSE) & t.rlike(TOC_LINE))
    return own.groupBy("book_id").agg(F.first("_open").alias("toc_open"), F.max(F.col("pos") + F.length("line")).alias("toc_end"), F.count(F.lit(1)).alias("entries"))


#: Fixed value: a numbered section as a chapter's only trace.
GROUPED = r"^[ \t]*#{0,4}[ \t]*([1-9]\d*)\.([0-9]+)[ \t]+([A-Z][^\n]{3,80})"
#: Lines and characters before a chapter's first section in which its own title is looked for.
LOOK_BACK, LOOK_BACK_CHARS = 6, 800


def grouped_headings(lines: DataFrame) -> DataFrame:
    """Chapters that only their sections `N.M Title` show, as headings (book_id, kind, pos, line_no, number, title, line).

    Counts for books with four sections or more in 3 to 120 chapters, of which 40 % follow each other. A chapter stands at its
    first section behind the printed contents (at its first at all, if there is none behind). Its title is looked for in the
    few lines before: a hash heading, a title under the chapter's bare number, the line before a chapter outline; the chapter
    starts there. Else it has the title of its first section.
    """
    t = F.col("line")
    hits = lines.filter(t.rlike(GROUPED)).select("book_id", "pos", "line_no", F.regexp_extract(t, GROUPED, 1).cast("int").alias("number"), strip(F.regexp_replace(F.regexp_extract(t, GROUPED, 3), r"\s+\d{1,4}$", "")).alias("_own"))
    hits = hits.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("book_id"))).filter((F.col("_all") >= 4) & ~any_of(F.lower("_own"), BOILERPLATE))
    ends = contents_end(lines).select("book_id", "toc_end")
    hits = hits.join(ends, "book_id", "left").withColumn("_ahead", F.coalesce(F.col("pos") < F.col("toc_end"), F.lit(False)))
    groups = hits.groupBy("book_id", "number").agg(F.min(F.struct("_ahead", "pos", "line_no", "_own")).alias("f")).select("book_id", "number", "f.*")
    by = Window.partitionBy("book_id")
    follows = (F.lag("number").over(by.orderBy("number")) + 1 == F.col("number")).cast("int")
    groups = groups.withColumn("_follows", follows).withColumn("_n", F.count(F.lit(1)).over(by))
    groups = groups.withColumn("_run", F.coalesce(F.sum("_follows").over(by), F.lit(0))).filter(F.col("_n").between(3, 120) & (F.col("_run") >= 0.4 * F.col("_n")))
    places = groups.select("book_id", "number", F.col("pos").alias("_pos"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(LOOK_BACK)), lambda k: F.col("line_no") - k)).alias("line_no"))
    before = places.join(lines.select("book_id", "line_no", "pos", strip(t).alias("_t")), ["book_id", "line_no"]).filter((F.col("_t") != "") & (F.col("_pos") - F.col("pos") <= LOOK_BACK_CHARS))
    before = before.groupBy("book_id", "number").agg(F.sort_array(F.collect_list(F.struct("line_no", "pos", "_t")), asc=False).alias("b"))
    found = groups.join(before, ["book_id", "number"], "left")
    one, two = F.get("b", 0), F.get("b", 1)
    hashed, titled = r"^#{1,2}[ \t]+([A-Z][^\n]{3,80})$", r"^[A-Z][^\n]{3,80}$"
    outline = F.get(F.filter(F.transform("b", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["pos"].alias("pos"), F.get(F.col("b"), i + 1)["_t"].alias("_t"), x["_t"].rlike(r"(?i)^chapter\s+outline$").alias("_is"))), lambda x: x["_is"]), 0)
    at = lambda x, title: F.struct(x["pos"].alias("pos"), x["line_no"].alias("line_no"), title.alias("title"))
    fit = lambda title: ~any_of(F.lower(title), BOILERPLATE)
    parent = F.regexp_extract(one["_t"], hashed, 1)
    above = F.when(outline["_t"].rlike(r"^[A-Z]") & (F.length(outline["_t"]) < 80) & fit(outline["_t"]), outline["_t"]).otherwise(F.col("_own"))
    place = (
        F.when(one["_t"].rlike(hashed) & fit(parent), at(one, strip(parent)))
        .when(one["_t"].rlike(titled) & (two["_t"] == F.col("number").cast("string")) & fit(one["_t"]), at(two, one["_t"]))
        .when(outline.isNotNull(), at(outline, above))
        .otherwise(F.struct("pos", "line_no", F.col("_own").alias("title")))
    )
    bare = lambda c: strip(F.regexp_replace(strip(F.regexp_replace(c, r"\s+\d{1,4}\s*$", "")), r"(?i)^(?:chapter|unit|part)\s+\d+[:\s-]*", ""))
    title = F.coalesce(F.nullif(bare(F.col("p.title")), F.lit("")), F.col("p.title"))
    found = found.select("book_id", F.lit("grouped_numdot").alias("kind"), place.alias("p"), "number")
    return found.select("book_id", "kind", "p.pos", "p.line_no", "number", title.alias("title"), F.concat(F.lit("Chapter "), "number", F.lit(": "), title).alias("line"))


def leading_cluster(headings: DataFrame, lengths: DataFrame) -> DataFrame:
    """headings with in_cluster: whether they belong to the tight run at the front (three or more, but not all)."""
    by = Window.partitionBy("book_id", "kind").orderBy("pos")
    tight = F.greatest(F.lit(400.0), F.col("chars") * 0.005)
    h = headings.join(lengths, "book_id").withColumn("_far", F.coalesce((F.col("pos") - F.lag("pos").over(by) > tight).cast("int"), F.lit(0)))
    h = h.withColumn("_front", F.sum("_far").over(by) == 0)
    family = Window.partitionBy("book_id", "kind")
    k, n = F.sum(F.col("_front").cast("int")).over(family), F.count(F.lit(1)).over(family)
    return h.withColumn("in_cluster", F.col("_front") & (k >= 3) & (k < n) & (n >= 4)).select(*headings.columns, "in_cluster")
