"""Model tables derived from the given ones, each with its counterpart in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def attempts(spark, sf_dir) -> DataFrame:
    """One row per attempt at a question."""
    e, kind = F.col("event_id"), F.col("event_type")
    value = F.col("value")
    return read(spark, sf_dir, "events").select(
        e.alias("attempt_id"),
        F.concat(F.lit("s"), "user_id").alias("student_id"),
        F.concat(F.lit("course_"), e % 3).alias("course_id"),
        F.concat(F.lit("ch_"), 1 + e % 12).alias("chapter_id"),
        F.concat(F.lit("q_"), e % 45).alias("question_id"),
        kind.isin("purchase", "signup", "click").cast("int").alias("is_correct"),
        F.when(kind == "purchase", 100.0).when(kind == "signup", 85.0).when(kind == "click", F.least(F.lit(100.0), value))
        .when(kind == "view", 55.0).otherwise(F.least(F.lit(35.0), value)).alias("accuracy_pct"),
        F.get(F.array(*map(F.lit, (0.0, 0.1, 0.4, 0.9))), (e % 4).cast("int")).alias("error_severity"),
        (1 + e % 3).cast("int").alias("hint_level"),
        (F.floor(e / 5) % 3).cast("int").alias("hints_requested"),
        (1 + e % 5).cast("int").alias("attempts_count"),
        (5 + e * 7 % 130).cast("double").alias("latency_seconds"),
        "ts",
    )


ATTEMPTS = """attempts AS (SELECT event_id AS attempt_id, 's' || user_id AS student_id, 'course_' || (event_id % 3) AS course_id, 'ch_' || (1 + event_id % 12) AS chapter_id,
  'q_' || (event_id % 45) AS question_id, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 1 ELSE 0 END AS is_correct,
  CAST(CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 85 WHEN 'click' THEN least(100, value) WHEN 'view' THEN 55 ELSE least(35, value) END AS DOUBLE) AS accuracy_pct,
  CAST(CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.4 ELSE 0.9 END AS DOUBLE) AS error_severity,
  CAST(1 + event_id % 3 AS INT) AS hint_level, CAST((event_id // 5) % 3 AS INT) AS hints_requested, CAST(1 + event_id % 5 AS INT) AS attempts_count,
  CAST(5 + event_id * 7 % 130 AS DOUBLE) AS latency_seconds, ts FROM events)"""


def reviews(spark, sf_dir) -> DataFrame:
    """One row per review of a card; quality may lie outside 0 to 5."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("review_id"),
        F.concat(F.lit("s"), "user_id").alias("student_id"),
        F.concat(F.lit("card_"), e % 8).alias("card_id"),
        F.when(e % 11 > 0, F.concat(F.lit("course_"), e % 3)).alias("course_id"),
        ((F.floor(e / 8) * 5 + F.col("user_id")) % 8 - 1).cast("int").alias("quality"),
        F.col("ts").alias("review_ts"),
    )


REVIEWS = """reviews AS (SELECT event_id AS review_id, 's' || user_id AS student_id, 'card_' || (event_id % 8) AS card_id,
  CASE WHEN event_id % 11 > 0 THEN 'course_' || (event_id % 3) END AS course_id, CAST((event_id // 8 * 5 + user_id) % 8 - 1 AS INT) AS quality, ts AS review_ts FROM events)"""


def submissions(spark, sf_dir) -> DataFrame:
    """Short answers: the expected one, a variant of it, a part, another document's, or a number."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("head"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("head").alias("next"))
    k = F.col("doc_id") % 5
    number = k == 4
    return d.join(other, "doc_id", "left").select(
        F.col("doc_id").alias("submission_id"),
        F.concat(F.lit("s"), F.col("doc_id") % 150).alias("student_id"),
        F.when(number, "8.314 unit").otherwise(F.col("head")).alias("expected_answer"),
        F.when(k == 0, F.col("head")).when(k == 1, F.concat(F.lit("ans = "), "head")).when(k == 2, F.expr("substring(head, 1, length(head) div 2)"))
        .when(k == 3, F.coalesce("next", F.lit(""))).otherwise("8.31 unit").alias("student_raw_input"),
        (5 + F.col("doc_id") * 11 % 120).cast("int").alias("seconds_spent"),
        (1 + F.col("doc_id") % 4).cast("int").alias("attempts_count"),
        (F.col("doc_id") % 3).cast("int").alias("hints_requested"),
    )


SUBMISSIONS = """heads AS (SELECT doc_id, text AS head FROM documents),
submissions AS (SELECT d.doc_id AS submission_id, 's' || (d.doc_id % 150) AS student_id, CASE WHEN d.doc_id % 5 = 4 THEN '8.314 unit' ELSE d.head END AS expected_answer,
  CASE d.doc_id % 5 WHEN 0 THEN d.head WHEN 1 THEN 'ans = ' || d.head WHEN 2 THEN substr(d.head, 1, length(d.head) // 2) WHEN 3 THEN coalesce(n.head, '') ELSE '8.31 unit' END AS student_raw_input,
  CAST(5 + d.doc_id * 11 % 120 AS INT) AS seconds_spent, CAST(1 + d.doc_id % 4 AS INT) AS attempts_count, CAST(d.doc_id % 3 AS INT) AS hints_requested
  FROM heads d LEFT JOIN heads n ON n.doc_id = d.doc_id + 1)"""


def answer_sheets(spark, sf_dir) -> DataFrame:
    """Short answers to questions (the documents), with what their hints are made of: right, prefixed, partial, wrong, a number."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    two, one = F.substring_index(text, " ", 2), F.substring_index(text, " ", 1)
    k = i % 5
    return read(spark, sf_dir, "documents").select(
        i.alias("submission_id"),
        F.when(i % 9 > 0, F.concat(F.lit("s"), i % 150)).alias("student_id"),
        F.col("source").alias("course_id"),
        F.when(i % 7 > 0, F.concat(F.lit("ch_"), i % 12)).otherwise("").alias("chapter_id"),
        F.get(F.array(*map(F.lit, ("Class 9", "Grade 12", "college"))), (i % 3).cast("int")).alias("tier"),
        text.alias("question_text"),
        F.when(k == 4, "8.314 unit").otherwise(two).alias("expected_answer"),
        F.when(k == 0, two).when(k == 1, F.concat(F.lit("ans = "), two)).when(k == 2, F.concat(one, F.lit(" dv/dt"))).when(k == 3, F.lit("integral of something else")).otherwise("9.31 unit").alias("student_raw_input"),
        (5 + i * 11 % 120).cast("int").alias("seconds_spent"),
        (1 + i % 4).cast("int").alias("attempts_count"),
        (i % 3).cast("int").alias("hints_requested"),
        (1 + F.floor(i / 5) % 3).cast("int").alias("hint_level"),
        F.when(i % 4 > 0, "v = dx/dt").otherwise("").alias("hint_formula"),
        F.when(i % 6 > 0, F.concat(F.lit("the final answer is "), two, F.lit(" with the wrong sign"))).alias("hint_misconception"),
    )


ANSWER_SHEETS = """sheets0 AS (SELECT *, doc_id AS i, coalesce(text, '') AS t, array_to_string(string_split(coalesce(text, ''), ' ')[1:2], ' ') AS two, string_split(coalesce(text, ''), ' ')[1] AS one FROM documents),
submissions AS (SELECT i AS submission_id, CASE WHEN i % 9 > 0 THEN 's' || (i % 150) END AS student_id, source AS course_id, CASE WHEN i % 7 > 0 THEN 'ch_' || (i % 12) ELSE '' END AS chapter_id,
  (['Class 9', 'Grade 12', 'college'])[i % 3 + 1] AS tier, t AS question_text, CASE WHEN i % 5 = 4 THEN '8.314 unit' ELSE two END AS expected_answer,
  CASE i % 5 WHEN 0 THEN two WHEN 1 THEN 'ans = ' || two WHEN 2 THEN one || ' dv/dt' WHEN 3 THEN 'integral of something else' ELSE '9.31 unit' END AS student_raw_input,
  CAST(5 + i * 11 % 120 AS INT) AS seconds_spent, CAST(1 + i % 4 AS INT) AS attempts_count, CAST(i % 3 AS INT) AS hints_requested, CAST(1 + i // 5 % 3 AS INT) AS hint_level,
  CASE WHEN i % 4 > 0 THEN 'v = dx/dt' ELSE '' END AS hint_formula, CASE WHEN i % 6 > 0 THEN 'the final answer is ' || two || ' with the wrong sign' END AS hint_misconception FROM sheets0)"""


def exam_totals(spark, sf_dir) -> DataFrame:
    """Exams of which only totals are known, one for each conversation."""
    i = F.col("conv_id")
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select((-1 - i).alias("submission_id"), (i % 12).alias("total_questions"), F.floor(i % 12 * (i % 7) / 6).alias("correct_answers"), (100 + i * 37 % 900).alias("total_elapsed_time"))


TOTALS = """totals AS (SELECT DISTINCT -1 - conv_id AS submission_id, greatest(1, conv_id % 12) AS total_questions, conv_id % 12 * (conv_id % 7) // 6 AS correct_answers, 100 + conv_id * 37 % 900 AS total_elapsed_time FROM conversations)"""


def exam_details(spark, sf_dir) -> DataFrame:
    """Answers of exam submissions: a student's attempts of a day."""
    from scholia.operators.grading import graded_attempts

    a = graded_attempts(attempts(spark, sf_dir))
    sid = F.expr("cast(substring(student_id, 2) as bigint)") * 100 + F.dayofmonth("ts")
    return a.select(sid.alias("submission_id"), "student_id", F.col("attempt_id"), F.col("question_id").alias("qId"), "is_correct", F.col("attempts_count").alias("attempts"), "latency_seconds", "fuzzy_score", "error_severity")


def exam_bank(spark, sf_dir) -> DataFrame:
    """Questions by id: built in ones, and custom ones that override some of them."""
    b = read(spark, sf_dir, "benchmark")
    q = F.concat(F.lit("q_"), "item_id").alias("qId")
    own = b.select(q, F.concat(F.lit("Module "), F.col("item_id") % 5).alias("moduleOrigin"), F.col("text"), F.lit("").alias("formula"), F.lit("builtin").alias("origin"))
    custom = b.filter("item_id % 10 = 0").select(q, F.lit("Custom").alias("moduleOrigin"), F.lit("custom text").alias("text"), F.lit("F = m * a").alias("formula"), F.lit("custom").alias("origin"))
    return own.unionByName(custom)


BANK = """bank AS (SELECT 'q_' || item_id AS qId, CASE WHEN item_id % 10 = 0 THEN 'Custom' ELSE 'Module ' || (item_id % 5) END AS moduleOrigin,
  CASE WHEN item_id % 10 = 0 THEN 'custom text' ELSE text END AS text, CASE WHEN item_id % 10 = 0 THEN 'F = m * a' ELSE '' END AS formula FROM benchmark)"""


def inquiries(spark, sf_dir) -> DataFrame:
    """Students' messages, every seventh with a phrase that routes it."""
    c = read(spark, sf_dir, "conversations").filter("role = 'user'")
    i = F.col("conv_id") * 100 + F.col("turn")
    phrase = F.when(i % 21 == 0, " please give me a hint").when(i % 21 == 7, " give me the answer").when(i % 21 == 14, " is fortnite fun")
    return c.select(
        i.alias("inquiry_id"),
        F.concat(F.lit("Q7 | Student Inquiry: "), "text", F.coalesce(phrase, F.lit(""))).alias("message"),
        (5 + i % 90).cast("int").alias("time_taken"),
        (i % 4).cast("int").alias("consecutive_errors"),
        F.when(i % 10 == 0, "hint").otherwise("discussion").alias("inquiry_type"),
        F.concat(F.lit("Course "), i % 3).alias("course_title"),
        F.concat(F.lit("Chapter "), i % 5).alias("chapter_title"),
    )


INQUIRIES = """inq0 AS (SELECT conv_id * 100 + turn AS i, text FROM conversations WHERE role = 'user'),
inquiries AS (SELECT i AS inquiry_id, text || CASE i % 21 WHEN 0 THEN ' please give me a hint' WHEN 7 THEN ' give me the answer' WHEN 14 THEN ' is fortnite fun' ELSE '' END AS q,
  CAST(5 + i % 90 AS INT) AS time_taken, CAST(i % 4 AS INT) AS consecutive_errors, CASE WHEN i % 10 = 0 THEN 'hint' ELSE 'discussion' END AS inquiry_type FROM inq0)"""


def chunks(spark, sf_dir) -> DataFrame:
    """Lines of documents as retrieval chunks."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("at", "document")).select(
        (F.col("doc_id") * 10_000_000 + F.col("at")).alias("chunk_id"),
        F.col("source").alias("course_id"),
        F.concat(F.lit("ch_"), 1 + F.col("doc_id") % 5).alias("chapter_id"),
        "document",
        F.when(F.col("doc_id") % 50 == 0, "pending").otherwise("verified").alias("status"),
    )


CHUNKS = """chunks AS (SELECT doc_id * 10000000 + ix - 1 AS chunk_id, source AS course_id, 'ch_' || (1 + doc_id % 5) AS chapter_id, line AS document,
  CASE WHEN doc_id % 50 = 0 THEN 'pending' ELSE 'verified' END AS status
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ix FROM documents))"""


def dialogues(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        F.concat(F.lit("topic_"), F.col("conv_id") % 12).alias("topic"),
        "turn",
        F.when(F.col("role") == "assistant", "Teacher").otherwise("Student").alias("role"),
        "text",
    )


DIALOGUES = """dialogues AS (SELECT conv_id, 'topic_' || (conv_id % 12) AS topic, turn, CASE WHEN role = 'assistant' THEN 'Teacher' ELSE 'Student' END AS role, text FROM conversations)"""


def interactions(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        e.alias("row_id"),
        F.when(e % 4 > 0, F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("s"), "user_id").alias("student_id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("action_type"),
        (e * 37 % 60_000).alias("elapsed_time"),
    )


#: Ids of a block; a source is numbered block by block, however many documents it has.
ID_BLOCK = 1000


def numbered(documents) -> DataFrame:
    """documents with n, their number by doc_id within their source: block counts, running sums of these, numbers in blocks."""
    block = F.floor(F.col("doc_id") / ID_BLOCK).alias("block")
    counts = documents.groupBy("source", block).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("source", "block", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("source", "block").orderBy("doc_id"))
    out = documents.withColumn("block", block).withColumn("own", own).join(counts, ["source", "block"])
    return out.withColumn("n", (F.col("own") + F.col("before")).cast("int")).drop("own", "before", "block")


#: Chapters of a book; a source gives as many books as it needs.
BOOK_CHAPTERS = 100


def book_lines(spark, sf_dir) -> DataFrame:
    """Books made of a source's documents as chapters, one row per line with its character position.

    Each hundred documents of a source are a book, so that books stay of bounded size however many rows a source has. Each
    document has a heading `CHAPTER n: Title`, its lines, and a running header; positions are running sums per book.
    """
    from scholia.operators.lines import line_table

    d = numbered(read(spark, sf_dir, "documents")).withColumn("at", F.col("n") - 1)
    n = (F.col("at") % BOOK_CHAPTERS + 1).cast("int")
    title = F.regexp_replace(F.substring("text", 1, 24), r"[^A-Za-z ]", "")
    text = F.concat(F.lit("CHAPTER "), n, F.lit(": T"), title, F.lit("\n"), F.col("text"), F.lit("\nRunning Title • page "), n)
    book = F.concat_ws("-", "source", F.floor(F.col("at") / BOOK_CHAPTERS))
    return line_table(d.select(book.alias("book_id"), n.alias("part"), text.alias("text")), ["book_id", "part"])


BOOK_LINES = """numbered AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at_, text FROM documents),
parts AS (SELECT concat_ws('-', source, at_ // 100) AS book_id, at_ % 100 + 1 AS part, text FROM numbered),
ptexts AS (SELECT book_id, part, 'CHAPTER ' || part || ': T' || regexp_replace(substr(text, 1, 24), '[^A-Za-z ]', '', 'g') || chr(10) || text || chr(10) || 'Running Title • page ' || part AS text FROM parts),
plines AS (SELECT book_id, part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix, unnest(string_split(text, chr(10))) AS line FROM ptexts),
book_lines AS (SELECT book_id, part, CAST(row_number() OVER w - 1 AS BIGINT) AS line_no,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY part, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, line
  FROM plines WINDOW w AS (PARTITION BY book_id ORDER BY part, ix))"""


def outlines(spark, sf_dir) -> DataFrame:
    """Embedded outlines of the books above, one page a chapter of theirs.

    A preface, a part every fifty pages, a chapter every five, an entry on every page (each fifth page is a chapter review,
    some carry labels of their own), an index at the end.
    """
    at = F.col("n") - 1
    d = numbered(read(spark, sf_dir, "documents")).select(F.concat_ws("-", "source", F.floor(at / BOOK_CHAPTERS)).alias("book_id"), (at % BOOK_CHAPTERS + 1).cast("int").alias("page"))
    k = F.floor((F.col("page") - 1) / 5) + 1
    child = F.when(F.col("page") % 5 == 0, "Chapter Review").when(F.col("page") % 5 == 2, F.concat(k, F.lit(".7 Named "), "page")).when(F.col("page") % 25 == 3, "Summary").otherwise(F.concat(F.lit("Piece "), "page"))
    entry = lambda place, level, title: F.struct((F.col("page") * 10 + place).cast("long").alias("seq"), F.lit(level).alias("level"), title.alias("title"))
    rows = F.array(
        F.when(F.col("page") == 1, entry(0, 1, F.lit("Preface"))),
        F.when(F.col("page") % 50 == 1, entry(1, 1, F.concat(F.lit("Part "), F.floor(F.col("page") / 50) + 1, F.lit(": All")))),
        F.when(F.col("page") % 5 == 1, entry(2, 2, F.concat(F.lit("Chapter "), k, F.lit(": Topic "), "page"))),
        entry(3, 3, child),
    )
    own = d.select("book_id", "page", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select("book_id", "e.*", "page")
    index = d.groupBy("book_id").agg(F.max("page").alias("page")).select("book_id", F.lit(100_000).cast("long").alias("seq"), F.lit(1).alias("level"), F.lit("Index").alias("title"), "page")
    return own.unionByName(index)


OUTLINES = """opages AS (SELECT concat_ws('-', source, at_ // 100) AS book_id, CAST(at_ % 100 + 1 AS INT) AS page FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at_ FROM documents)),
outlines AS (SELECT book_id, page * 10 AS seq, 1 AS level, 'Preface' AS title, page FROM opages WHERE page = 1
  UNION ALL SELECT book_id, page * 10 + 1, 1, 'Part ' || (page // 50 + 1) || ': All', page FROM opages WHERE page % 50 = 1
  UNION ALL SELECT book_id, page * 10 + 2, 2, 'Chapter ' || ((page - 1) // 5 + 1) || ': Topic ' || page, page FROM opages WHERE page % 5 = 1
  UNION ALL SELECT book_id, page * 10 + 3, 3, CASE WHEN page % 5 = 0 THEN 'Chapter Review' WHEN page % 5 = 2 THEN ((page - 1) // 5 + 1) || '.7 Named ' || page WHEN page % 25 = 3 THEN 'Summary' ELSE 'Piece ' || page END, page FROM opages
  UNION ALL SELECT book_id, 100000, 1, 'Index', max(page) FROM opages GROUP BY book_id)"""


#: Number words of the styled books' chapters.
WORDED = ("One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve")
TENS, ONES = ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC", "C"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")


def styled_lines(spark, sf_dir) -> DataFrame:
    """The same books once more, each set in one of eleven styles by its source and number.

    Chapters in Roman numbers (0) or words (1), units (2), lessons (3), hashes with sections (4), bare numbers (5), capitals
    (6), numbered sections, every second time under a number and a title (7), numbered sections behind printed contents with
    wrapped titles, every third time under a heading (8), chapters with lettered sections and a glossary (9), nothing (10).
    Contents are parts before the first.
    """
    from scholia.operators.lines import line_table

    d = numbered(read(spark, sf_dir, "documents")).withColumn("at", F.col("n") - 1)
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int)"), F.lit(0))
    d = d.select(
        F.concat_ws("-", "source", F.floor(F.col("at") / BOOK_CHAPTERS)).alias("book_id"),
        ((number + F.floor(F.col("at") / BOOK_CHAPTERS)) % 11).cast("int").alias("style"),
        (F.col("at") % BOOK_CHAPTERS + 1).cast("int").alias("n"),
        F.concat(F.lit("T"), F.regexp_replace(F.substring("text", 1, 24), r"[^A-Za-z ]", "")).alias("title"),
        "text",
        F.expr("substring(text, 1, length(text) div 2)").alias("first"),
        F.expr("substring(text, length(text) div 2 + 1)").alias("second"),
    )
    n, title, style = F.col("n"), F.col("title"), F.col("style")
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), at.cast("int"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    roman = F.concat(pick(TENS, F.floor(n / 10)), pick(ONES, n % 10))
    lost = F.when((style == 7) & (n % 2 == 0), text(n, "\n", title, " whole\n")).when((style == 8) & (n % 3 == 0), text("CHAPTER ", n, "\n")).otherwise("")
    body = (
        F.when(style == 0, text("CHAPTER ", roman, ": ", title, "\n", F.col("text")))
        .when(style == 1, text("Chapter ", pick(WORDED, (n - 1) % len(WORDED)), ": ", title, "\n", F.col("text")))
        .when(style == 2, text("UNIT ", n, ": ", title, "\n", F.col("text")))
        .when(style == 3, text("Lesson ", n, " - ", title, "\n", F.col("text")))
        .when(style == 4, text("## ", title, "\n### Ideas of part ", n, "\n", F.col("first"), "\n### Uses of part ", n, "\n", F.col("second")))
        .when(style == 5, text(n, "\n", title, " alone\n", F.col("text")))
        .when(style == 6, text(F.upper(title), " PART ", n, "\n", F.col("text")))
        .when(style == 9, text("CHAPTER ", n, ": ", title, "\nA. Ground rules\n", F.col("first"), "\nB. Worked cases\n", F.col("second"), "\nKey Terms\n", F.substring("text", 1, 250)))
        .when(style == 10, F.col("text"))
        .otherwise(text(lost, n, ".1 Ground of ", title, "\n", F.col("first"), "\n", n, ".2 Work of ", title, "\n", F.col("second")))
    )
    front = text(F.when(n == 1, "Contents\n").otherwise(""), "CHAPTER ", n, "\nThe long way to\n", title, " ", n + 10, "\n", n, ".1 Ground of ", title, " ", n + 10, "\n", n, ".2 Work of ", title, " ", n + 12)
    own = F.struct(n.alias("part"), text(body, "\nStyled Book • page ", n).alias("text"))
    contents = F.struct((n - 1000).alias("part"), front.alias("text"))
    # the documents are numbered once for both
    parts = d.select("book_id", F.explode(F.when(style == 8, F.array(own, contents)).otherwise(F.array(own))).alias("p"))
    return line_table(parts.select("book_id", "p.*"), ["book_id", "part"])


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
STYLED_LINES = f"""numbered AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at_, text FROM documents),
sparts AS (SELECT concat_ws('-', source, at_ // 100) AS book_id, (coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS INT), 0) + at_ // 100) % 11 AS style, at_ % 100 + 1 AS n,
  'T' || regexp_replace(substr(text, 1, 24), '[^A-Za-z ]', '', 'g') AS title, text, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM numbered),
ptexts AS (SELECT book_id, n AS part, CASE style WHEN 0 THEN 'CHAPTER ' || ({_LIST(TENS)})[n // 10 + 1] || ({_LIST(ONES)})[n % 10 + 1] || ': ' || title || chr(10) || text
  WHEN 1 THEN 'Chapter ' || ({_LIST(WORDED)})[(n - 1) % {len(WORDED)} + 1] || ': ' || title || chr(10) || text WHEN 2 THEN 'UNIT ' || n || ': ' || title || chr(10) || text
  WHEN 3 THEN 'Lesson ' || n || ' - ' || title || chr(10) || text WHEN 4 THEN '## ' || title || chr(10) || '### Ideas of part ' || n || chr(10) || a || chr(10) || '### Uses of part ' || n || chr(10) || b
  WHEN 5 THEN n || chr(10) || title || ' alone' || chr(10) || text WHEN 6 THEN upper(title) || ' PART ' || n || chr(10) || text
  WHEN 9 THEN 'CHAPTER ' || n || ': ' || title || chr(10) || 'A. Ground rules' || chr(10) || a || chr(10) || 'B. Worked cases' || chr(10) || b || chr(10) || 'Key Terms' || chr(10) || substr(text, 1, 250)
  WHEN 10 THEN text
  ELSE CASE WHEN style = 7 AND n % 2 = 0 THEN n || chr(10) || title || ' whole' || chr(10) WHEN style = 8 AND n % 3 = 0 THEN 'CHAPTER ' || n || chr(10) ELSE '' END || n || '.1 Ground of ' || title || chr(10) || a || chr(10) || n || '.2 Work of ' || title || chr(10) || b END || chr(10) || 'Styled Book • page ' || n AS text FROM sparts
  UNION ALL SELECT book_id, n - 1000, CASE WHEN n = 1 THEN 'Contents' || chr(10) ELSE '' END || 'CHAPTER ' || n || chr(10) || 'The long way to' || chr(10) || title || ' ' || (n + 10) || chr(10) || n || '.1 Ground of ' || title || ' ' || (n + 10) || chr(10) || n || '.2 Work of ' || title || ' ' || (n + 12)
  FROM sparts WHERE style = 8),
plines AS (SELECT book_id, part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix, unnest(string_split(text, chr(10))) AS line FROM ptexts),
book_lines AS (SELECT book_id, part, CAST(row_number() OVER w - 1 AS BIGINT) AS line_no,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY part, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, line
  FROM plines WINDOW w AS (PARTITION BY book_id ORDER BY part, ix))"""


def theory_rows(spark, sf_dir) -> DataFrame:
    """Chapters with facts, as extraction gives them: a definition out of the text, one of an everyday story, two equations."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    null = F.lit(None).cast("string")

    def fact(kind, concept=null, said=null, lhs=null, rhs=null):
        full = F.concat(lhs, F.lit(" = "), rhs)
        return F.struct(F.lit(kind).alias("type"), concept.alias("concept"), said.alias("text"), lhs.alias("lhs"), rhs.alias("rhs"), full.alias("full"), null.alias("value"))

    name = F.concat(F.lit("Law "), i)
    facts = F.array(
        F.when(i % 3 > 0, fact("definition", name, F.concat(F.lit("the dv/dt of "), text))),
        fact("definition", F.lit("Story"), F.concat(F.lit("what a car does in "), text)),
        F.when(i % 4 > 0, fact("definition", F.lit("Momentum"), F.lit("momentum, which is kept"))),
        F.when(i % 5 > 0, fact("equation", lhs=F.lit("F"), rhs=F.concat(F.lit("m * "), i))),
        fact("equation", lhs=F.lit("graph"), rhs=F.lit("none")),
    )
    example = F.struct(F.concat(F.lit("Example "), i).alias("source"), text.alias("content"))
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), i).alias("chapter_id"),
        F.concat(F.lit("Chapter "), i).alias("title"),
        F.get(F.array(*map(F.lit, ("Class 9", "Grade 12", "college"))), (F.floor(i / 2) % 3).cast("int")).alias("tier"),
        F.concat(F.lit("On dx/dt: "), text).alias("summary"),
        F.filter(facts, lambda f: f.isNotNull()).alias("facts"),
        F.when(i % 6 > 0, F.array(example)).alias("examples"),
    )


def blueprints(spark, sf_dir) -> DataFrame:
    """A model's rows for two chapters of three, whole, in part or empty."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    put = lambda when, c: F.when(when, F.lit(c) if isinstance(c, str) else c).otherwise("")
    struct = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    return read(spark, sf_dir, "documents").filter("doc_id % 3 < 2").select(
        F.concat(F.lit("c"), i).alias("chapter_id"),
        put(i % 2 > 0, F.concat(F.lit("An integral view of "), text)).alias("summary"),
        F.when(i % 5 > 0, F.array(put(i % 2 > 0, "Find the derivative"), F.lit("  "))).alias("objectives"),
        F.array(*(struct(title=put(i % k > 0, f"P{k}"), content=put(i % (k + 1) > 0, text), tag=put(i % 2 > 0, "T")) for k in range(2, 8))).alias("principles"),
        F.when(i % 4 > 0, F.array(*(struct(title=put(i % k > 0, f"E{k}"), formula=put(i % 7 > 2, "a = dv/dt"), content=put(i % 2 > 0, "words"), derivation=F.lit(None).cast("string"), variables=put(i % 3 > 0, "a, v")) for k in (2, 3)))).alias("formulations"),
        F.array(struct(concept=put(i % 2 > 0, "Water"), analogy=put(i % 3 > 0, "dx/dt of a river"), takeaway=F.lit(" "))).alias("mental_models"),
        F.array(struct(trap=put(i % 4 > 0, "Wrong sign"), correction=put(i % 2 > 0, "Use dv/dt"))).alias("misconceptions"),
        F.array(struct(title=put(i % 2 > 0, "Slope"), content=F.lit(""), solution=put(i % 3 > 0, text), explanation=F.lit("by hand")), struct(title=F.lit("Two"), content=text, solution=F.lit(None).cast("string"), explanation=F.lit(None).cast("string"))).alias("worked_examples"),
    )


_P = lambda when, c: f"CASE WHEN {when} THEN {c} ELSE '' END"
_PRINCIPLES = ", ".join(f"{{'title': {_P(f'i % {k} > 0', repr(f'P{k}'))}, 'content': {_P(f'i % {k + 1} > 0', 't')}, 'tag': {_P('i % 2 > 0', repr('T'))}}}" for k in range(2, 8))
_FORMULATIONS = ", ".join(f"{{'title': {_P(f'i % {k} > 0', repr(f'E{k}'))}, 'formula': {_P('i % 7 > 2', repr('a = dv/dt'))}, 'content': {_P('i % 2 > 0', repr('words'))}, 'derivation': NULL::VARCHAR, 'variables': {_P('i % 3 > 0', repr('a, v'))}}}" for k in (2, 3))
THEORY_ROWS = f"""theory0 AS (SELECT doc_id AS i, coalesce(text, '') AS t FROM documents),
theory AS (SELECT i, t, 'c' || i AS chapter_id, 'Chapter ' || i AS title, (['Class 9', 'Grade 12', 'college'])[i // 2 % 3 + 1] AS tier, 'On dx/dt: ' || t AS summary,
  list_filter([CASE WHEN i % 3 > 0 THEN {{'concept': 'Law ' || i, 'text': 'the dv/dt of ' || t}} END, {{'concept': 'Story', 'text': 'what a car does in ' || t}}, CASE WHEN i % 4 > 0 THEN {{'concept': 'Momentum', 'text': 'momentum, which is kept'}} END], lambda x: x IS NOT NULL) AS defs,
  list_filter([CASE WHEN i % 5 > 0 THEN {{'lhs': 'F', 'rhs': 'm * ' || i}} END, {{'lhs': 'graph', 'rhs': 'none'}}], lambda x: x IS NOT NULL) AS eqs,
  CASE WHEN i % 6 > 0 THEN [{{'title': 'Example ' || i, 'content': t}}] ELSE [] END AS exs FROM theory0),
model AS (SELECT i, {_P('i % 2 > 0', "'An integral view of ' || t")} AS m_summary, CASE WHEN i % 5 > 0 THEN [{_P('i % 2 > 0', "'Find the derivative'")}, '  '] ELSE [] END AS m_objectives,
  [{_PRINCIPLES}] AS m_principles, CASE WHEN i % 4 > 0 THEN [{_FORMULATIONS}] ELSE [] END AS m_formulations,
  [{{'concept': {_P('i % 2 > 0', "'Water'")}, 'analogy': {_P('i % 3 > 0', "'dx/dt of a river'")}, 'takeaway': ' '}}] AS m_models, [{{'trap': {_P('i % 4 > 0', "'Wrong sign'")}, 'correction': {_P('i % 2 > 0', "'Use dv/dt'")}}}] AS m_traps,
  [{{'title': {_P('i % 2 > 0', "'Slope'")}, 'content': '', 'solution': {_P('i % 3 > 0', 't')}, 'explanation': 'by hand'}}, {{'title': 'Two', 'content': t, 'solution': NULL, 'explanation': NULL}}] AS m_examples FROM theory0 WHERE i % 3 < 2)"""
