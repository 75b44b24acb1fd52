"""Chapters, sections and units of books, from heading candidates on the line table.

Candidates are a small part of the lines: lines are filtered by one pattern per family before any window, and windows run
over candidates of a book, or over the lines of one chapter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.predicates import code_line, valid_heading
from scholia.functions.text import NUMBER_WORDS, line_shape, roman_number, strip, word_number
from scholia.sources.tables import settled

SEP = r"[ \t]*[:.\-–—)\]]?[ \t]*"
NUMBER = "|".join([*reversed(NUMBER_WORDS), "thirty"])
#: Heading families in order of precedence: pattern with number and title, style of the number, whether it is a unit.
FAMILIES = (
    ("chapter_digits", r"(?i)^[ \t]*CHAP(?:TER|\.)?[ \t]+(\d{1,3})\b" + SEP + "(.*)$", "digits", False),
    ("chapter_roman", r"(?i)^[ \t]*CHAP(?:TER|\.)?[ \t]+([IVXLCDM]{1,7})\b" + SEP + "(.*)$", "roman", False),
    ("chapter_word", r"(?i)^[ \t]*CHAP(?:TER|\.)?[ \t]+((?:" + NUMBER + r")(?:[ \-](?:" + NUMBER + "))?)\\b" + SEP + "(.*)$", "word", False),
    ("unit_digits", r"(?i)^[ \t]*(?:UNIT|PART|MODULE|BOOK|VOLUME)[ \t]+(\d{1,3})\b" + SEP + "(.*)$", "digits", True),
    ("unit_roman", r"(?i)^[ \t]*(?:UNIT|PART|MODULE|BOOK|VOLUME)[ \t]+([IVXLCDM]{1,7})\b" + SEP + "(.*)$", "roman", True),
    ("lesson_digits", r"(?i)^[ \t]*(?:LESSON|LECTURE|TOPIC|WEEK|SESSION|CLASS|DAY)[ \t]+(\d{1,3})\b" + SEP + "(.*)$", "digits", False),
    ("hash_headings", r"^(#{1,4})[ \t]+(.+?)[ \t]*#*[ \t]*$", "hash", False),
    ("numbered_dot", r"^[ \t]*(\d{1,3})\.[ \t]+([A-Z][^.\n]{2,80})$", "digits", False),
    ("numbered_bare", r"^[ \t]*(\d{1,3})[ \t]+([A-Z][A-Za-z0-9 ,'&\-–—:]{2,70}[A-Za-z0-9)\].])[ \t]*$", "digits", False),
    ("titled_caps", r"^[ \t]*([A-Z][A-Z0-9 ,'&\-–—:]{5,70})[ \t]*$", "order", False),
)
ORDER = {k: float(i) for i, (k, *_) in enumerate(FAMILIES)} | {"bare_num_title": 6.5, "grouped_numdot": 8.5}
UNITS = [k for k, _, _, unit in FAMILIES if unit]
#: Families that name what they number; where one of them divides a book well, its sections aren't grouped into chapters.
EXPLICIT = ("chapter_digits", "chapter_roman", "chapter_word", "unit_digits", "unit_roman", "lesson_digits", "numbered_dot", "hash_headings")
LEAST_CHAPTERS, MOST_CHAPTERS = 3, 120
LONGEST_LINE = 110
SECTION = r"^[ \t]*(\d{1,3})\.(\d{1,2})\b[ \t]*[:.\-–—]?[ \t]*([^\n]{2,90})$"


#: Lines of more characters (white space at the ends aside) are no heading and no entry of printed contents, whatever they hold.
LONG = 120
#: Beginnings (behind white space) of long lines that may still hold a label of a section, a hash heading or a mark of a chapter.
LABELLED = r"(?i)^(?:#|\d+[ \t]*[.\-–—]|[a-z][.)][ \t]|chapter\s)"


def briefs(lines: DataFrame) -> DataFrame:
    """Lines (book_id, pos, line_no, line) with chars, their length, and x's in place of LONG ones that aren't LABELLED: written once, for many scans.

    Headings, printed contents and families of sections ask of other long lines only that they are long, and most of a book's text is in these.
    """
    line, bare = F.col("line"), strip(F.col("line"))
    kept = (F.length(bare) <= LONG) | bare.rlike(LABELLED)
    return settled(lines.select("book_id", "pos", "line_no", F.when(kept, line).otherwise("x" * (LONG + 1)).alias("line"), F.length(line).alias("chars")))


def book_lengths(briefs: DataFrame) -> DataFrame:
    """(book_id, chars): the end of each book's last line."""
    return briefs.groupBy("book_id").agg(F.max(F.col("pos") + F.col("chars")).alias("chars"))


def heading_candidates(lines: DataFrame) -> DataFrame:
    """(book_id, kind, pos, line_no, number, title, line): every line that a family takes for a heading, with its number; lines may be briefs."""
    lines = lines if "chars" in lines.columns else briefs(lines)
    t, kind = F.col("line"), F.col("kind")
    short = lines.filter((F.length(t) <= LONGEST_LINE) & reduce(lambda a, b: a | b, (t.rlike(p) for _, p, _, _ in FAMILIES)))
    kinds = F.filter(F.array(*(F.when(t.rlike(p), F.lit(k)) for k, p, _, _ in FAMILIES)), lambda x: x.isNotNull())
    found = short.select("book_id", "pos", "line_no", "line", F.explode(kinds).alias("kind"))
    number, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for own, pattern, style, _ in FAMILIES:  # a row asks the expressions of its own family only
        token = F.regexp_extract(t, pattern, 1)
        value = {"roman": roman_number(token), "word": word_number(token), "hash": F.length(token)}.get(style, F.lit(0))
        if style == "digits":
            value = F.nullif(token, F.lit("")).cast("int")
        number = F.when(kind == own, value).otherwise(number)
        title = F.when(kind == own, strip(F.regexp_extract(t, pattern, 1 if style == "order" else 2))).otherwise(title)
    found = found.select("book_id", "kind", "pos", "line_no", number.alias("number"), title.alias("title"), "line")
    # few rows, asked several times
    found = settled(found.unionByName(_bare_numbers(lines))).filter(~code_line(F.col("title")))
    numbered = settled(_titled(found.filter(~F.col("kind").isin("hash_headings", "titled_caps") & F.col("number").between(1, 200)), lines))
    return numbered.unionByName(_hash_headings(found.filter("kind = 'hash_headings'"))).unionByName(_caps(found.filter("kind = 'titled_caps'"), numbered))


#: Lines after a bare heading (`CHAPTER 4`) in which its title is looked for, and the title's greatest length.
TITLE_WITHIN, TITLE_CHARS = 4, 95


def _titled(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """Headings without a title get the first line of the next four that isn't empty, if it is short and no page number."""
    bare = headings.filter("title = ''").select("book_id", "kind", F.col("line_no").alias("_at"))
    near = bare.select("book_id", "kind", "_at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(TITLE_WITHIN)), lambda k: F.col("_at") + k)).alias("line_no"))
    near = near.join(lines.select("book_id", "line_no", strip(F.col("line")).alias("_t")), ["book_id", "line_no"]).filter("_t != ''")
    next_ = near.groupBy("book_id", "kind", F.col("_at").alias("line_no")).agg(F.min_by("_t", "line_no").alias("_next"))
    next_ = next_.filter((F.length("_next") <= TITLE_CHARS) & ~F.col("_next").rlike(r"^\d+$"))
    own = headings.join(next_, ["book_id", "kind", "line_no"], "left")
    title = F.when(F.col("title") == "", F.coalesce(F.regexp_replace("_next", r"\s{2,}", " "), F.lit(""))).otherwise(F.col("title"))
    return own.withColumn("title", title).select(*headings.columns)


#: A number on a line of its own and the title on the next.
BARE_NUMBER, BARE_TITLE = r"^[ \t]*(\d{1,3})[ \t]*$", r"^[ \t]*([A-Z][A-Za-z0-9 ,'&\-–—:]{2,70})[ \t]*$"


def _bare_numbers(lines: DataFrame) -> DataFrame:
    """Numbers on a line of their own with a title on the next: both are filtered first and joined by line number."""
    n = lines.filter(F.col("line").rlike(BARE_NUMBER)).withColumn("_next", F.col("line_no") + 1)
    t = lines.filter(F.col("line").rlike(BARE_TITLE)).select("book_id", F.col("line_no").alias("_next"), strip(F.regexp_extract("line", BARE_TITLE, 1)).alias("title"))
    number = F.regexp_extract("line", BARE_NUMBER, 1).cast("int").alias("number")
    return n.join(t, ["book_id", "_next"]).select("book_id", F.lit("bare_num_title").alias("kind"), "pos", "line_no", number, "title", "line")


def _hash_headings(found: DataFrame) -> DataFrame:
    """Markdown headings of the shallowest level with three or more, without the document's title, numbered in order."""
    body = found.filter(~((F.col("pos") <= 200) & (F.col("number") == 1) & ~F.col("title").rlike(r"(?i)\d|chapter|unit|lesson")))
    levels = body.groupBy("book_id", "number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_CHAPTERS)
    level = levels.groupBy("book_id").agg(F.min("number").alias("number"))
    own = body.join(level, ["book_id", "number"], "left_semi")
    return own.withColumn("number", F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))).select(*found.columns)


#: Lines in capitals that head no chapter.
NO_CHAPTER = (
    "contents", "table of contents", "brief contents", "index", "references", "glossary", "preface", "answers", "solutions",
    "key terms", "summary", "chapter summary", "chapter review", "review questions", "exercises",
)


def _caps(found: DataFrame, numbered: DataFrame) -> DataFrame:
    """Lines in capitals that no numbered family claims, numbered in order."""
    own = found.filter(valid_heading(F.col("title")) & ~F.lower("title").isin(*NO_CHAPTER)).withColumn("_form", line_shape(F.col("line")))
    claimed = numbered.select("book_id", line_shape(F.col("line")).alias("_form")).distinct()
    own = own.join(claimed, ["book_id", "_form"], "left_anti").select(*found.columns)
    return own.withColumn("number", F.row_number().over(Window.partitionBy("book_id").orderBy("pos")))


def listing_flags(headings: DataFrame) -> DataFrame:
    """Add in_listing: headings of a family that stand in a dense listing (a printed table of contents).

    The largest ratio of neighbouring sorted gaps, if 4 or more, splits listing gaps from chapter gaps; three or more
    headings chained by listing gaps are a listing, unless more than 80 % of the family would be.
    """
    by = Window.partitionBy("book_id", "kind").orderBy("pos", "line_no")
    h = headings.withColumn("_gap", F.col("pos") - F.lag("pos").over(by))
    sizes = Window.partitionBy("book_id", "kind").orderBy("_gap")
    gaps = h.filter("_gap > 0").withColumn("_small", F.lag("_gap").over(sizes)).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("book_id", "kind")))
    ratio = F.col("_gap") / F.col("_small")
    jump = gaps.filter("_small is not null and _k >= 4").groupBy("book_id", "kind").agg(
        F.max_by(F.struct((F.sqrt(F.col("_small").cast("double") * F.col("_gap"))).alias("limit"), ratio.alias("ratio")), F.struct(ratio, -F.col("_gap"))).alias("j")
    )
    h = h.join(jump, ["book_id", "kind"], "left")
    loose = F.col("_gap").isNull() | (F.col("_gap") >= F.col("j.limit"))
    h = h.withColumn("_run", F.sum(loose.cast("int")).over(by))
    run, family = Window.partitionBy("book_id", "kind", "_run"), Window.partitionBy("book_id", "kind")
    n = F.count(F.lit(1)).over(family)
    h = h.withColumn("_in", F.coalesce((F.col("j.ratio") >= 4) & (F.count(F.lit(1)).over(run) >= 3) & (n >= 5), F.lit(False)))
    share = F.sum(F.col("_in").cast("int")).over(family) / n
    return h.withColumn("in_listing", F.col("_in") & (share <= 0.8)).select(*headings.columns, "in_listing")


def without_listing(headings: DataFrame) -> DataFrame:
    """Headings of the running text; of numbers that occur in a listing only, its last entry."""
    h = listing_flags(headings)
    body = h.filter("not in_listing")
    last = Window.partitionBy("book_id", "kind", "number").orderBy(F.desc("pos"))
    rest = h.filter("in_listing").join(body.select("book_id", "kind", "number").distinct(), ["book_id", "kind", "number"], "left_anti")
    return body.unionByName(rest.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")).drop("in_listing")


def candidate_scores(headings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(book_id, kind, n, seq, spread, quality, score) of every family with 3 to 120 headings.

    seq: longest run of numbers that follow each other, as a share; spread: span of the headings in the text.
    """
    by = Window.partitionBy("book_id", "kind").orderBy("pos", "line_no")
    new = F.coalesce(F.col("number") != F.lag("number").over(by) + 1, F.lit(True))
    h = headings.withColumn("_run", F.sum(new.cast("int")).over(by))
    runs = h.groupBy("book_id", "kind", "_run").agg(F.count(F.lit(1)).alias("_len"))
    runs = runs.groupBy("book_id", "kind").agg(F.max("_len").alias("longest"))
    title = F.length("title")
    good = F.when(title == 0, F.when(F.col("kind").isin("hash_headings", "titled_caps"), 0.2).otherwise(0.85)).when(title.between(3, 85), 1.0).otherwise(0.4)
    s = h.groupBy("book_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.avg(good).alias("quality"))
    s = s.filter(F.col("n").between(LEAST_CHAPTERS, MOST_CHAPTERS)).join(runs, ["book_id", "kind"]).join(lengths, "book_id")
    spread = (F.col("b") - F.col("a")) / F.greatest(F.col("chars"), F.lit(1))
    s = s.select("book_id", "kind", "n", (F.col("longest") / F.col("n")).alias("seq"), spread.alias("spread"), "quality")
    specific = (
        F.when(F.col("kind").isin(*UNITS), -0.08)
        .when((F.col("kind") == "hash_headings") & (F.col("spread") < 0.35), -0.35)
        .when((F.col("kind") == "titled_caps") & (F.col("spread") < 0.35), -0.15)
        .otherwise(0.0)
    )
    score = 0.40 * F.col("seq") + 0.22 * F.col("spread") + 0.23 * F.col("quality") + 0.15 * F.least(F.col("n"), F.lit(12)) / 12 + specific
    return s.withColumn("score", F.rint(F.greatest(F.lit(0.0), score) * 1e6) / 1e6)


def best_family(scores: DataFrame) -> DataFrame:
    """The family with the best score of each book; the first listed wins ties."""
    place = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("kind")]
    first = Window.partitionBy("book_id").orderBy(F.desc("score"), place)
    return scores.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def chapters(lines: DataFrame) -> DataFrame:
    """Chapters of each book by its best family: chapter_id, number, title, start and end positions; lines may be briefs.

    Headings inside the printed contents are left out (if three of their family stand after it), and so is a tight run of them at the front whose numbers come again.
    Where no explicit family divides a book (a run of 45 % of its numbers over 35 % of the text), its sections `N.M` are
    grouped into chapters as one more family. A number that repeats gets a suffix: ch_4, ch_4_2. Books without a family of three headings have no chapters here.
    """
    from scholia.operators.front_matter import contents_end, grouped_headings, leading_cluster

    short = lines if "chars" in lines.columns else briefs(lines)
    lengths = settled(book_lengths(short))
    # candidates are a small part of the lines and are asked many times
    headings = heading_candidates(short).join(contents_end(short).select("book_id", "toc_end"), "book_id", "left")
    body = F.coalesce(F.col("pos") >= F.col("toc_end"), F.lit(True))
    left = F.sum(body.cast("int")).over(Window.partitionBy("book_id", "kind"))
    headings = headings.withColumn("_body", body | (left < LEAST_CHAPTERS)).filter("_body").drop("toc_end", "_body")
    headings = without_listing(settled(headings))
    later = F.max("pos").over(Window.partitionBy("book_id", "kind", "number")) > F.col("pos")
    headings = settled(leading_cluster(headings, lengths).withColumn("_later", later).filter("not (in_cluster and _later)").drop("in_cluster", "_later"))
    scores = settled(candidate_scores(headings, lengths))
    explicit = scores.filter(F.col("kind").isin(*EXPLICIT) & ((F.col("seq") >= 0.45) | (F.col("kind") == "hash_headings")) & (F.col("spread") >= 0.35))
    grouped = settled(grouped_headings(short.join(explicit.select("book_id").distinct(), "book_id", "left_anti")))
    headings = headings.unionByName(grouped)
    best = best_family(scores.unionByName(candidate_scores(grouped, lengths)))
    h = headings.join(best.select("book_id", "kind"), ["book_id", "kind"]).join(lengths, "book_id")
    by = Window.partitionBy("book_id").orderBy("pos")
    again = F.row_number().over(Window.partitionBy("book_id", "number").orderBy("pos"))
    found = h.select(
        "book_id",
        "kind",
        F.row_number().over(by).alias("chapter_index"),
        F.concat(F.lit("ch_"), "number", F.when(again > 1, F.concat(F.lit("_"), again)).otherwise(F.lit(""))).alias("chapter_id"),
        "number",
        "title",
        F.col("pos").alias("start"),
        F.coalesce(F.lead("pos").over(by), F.col("chars")).alias("end"),
    )
    return settled(found)


def chapter_of_lines(lines: DataFrame, chapters: DataFrame, *more: str) -> DataFrame:
    """Lines with the chapter whose heading governs them: a join on the book with a range condition; more: other columns to keep."""
    c = chapters.select("book_id", "chapter_id", "chapter_index", "number", *{"start", "end", *more})
    own = lines.join(c, "book_id").filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    return own.drop(*{"start", "end"}.difference(more))


#: Headings that open the review at the end of a chapter.
REVIEW = (
    "summary", "chapter summary", "section summary", "key terms", "key concepts", "glossary", "review questions", "review exercises",
    "exercises", "problems", "problems and exercises", "problems & exercises", "conceptual questions", "discussion questions",
    "self-test", "self test", "further reading", "references", "bibliography", "index", "answers", "chapter review",
    "check your understanding", "critical thinking", "additional problems",
)
INTRO, BODY, REST = 0, 1, 2
#: Least lengths of an introduction, a section and a review.
LEAST_CHARS = (121, 80, 201)


def sections(lines: DataFrame, chapters: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Parts of each chapter with the text under them: the introduction `N.0`, sections `N.M Title`, the review `N.r`.

    A label counts in its own chapter only, at its first occurrence, with a title of three letters in a row, on a line without
    a bullet and of 110 characters at most; if the printed contents (book_id, chapter, section) list sections of the chapter,
    only those count. The review starts with the first heading of back matter and
    runs to the chapter's end. The heading lines are no text; introductions up to 120 characters, sections under 80 and
    reviews up to 200 are left out. Windows run per chapter, so a long book is not one window.
    """
    if contents is None:
        listed = F.lit(True)
    else:  # the list goes to its chapter, not to the lines
        lists = contents.groupBy("book_id", F.col("chapter").alias("number")).agg(F.collect_set("section").alias("_listed"))
        chapters = chapters.join(lists, ["book_id", "number"], "left")
        listed = F.col("_listed").isNull() | F.array_contains("_listed", F.col("_label"))
    own = chapter_of_lines(lines, chapters, *(["_listed"] if contents is not None else [])).repartition("book_id", "chapter_id")
    t = F.col("line")
    hit = (F.length(t) <= LONGEST_LINE) & t.rlike(SECTION) & (F.regexp_extract(t, SECTION, 1) == F.col("number").cast("string"))
    hit = hit & F.regexp_extract(t, SECTION, 3).rlike("[A-Za-z]{3,}") & ~t.rlike("[•·ò]")
    own = own.withColumn("_label", F.when(hit, F.regexp_extract(t, SECTION, 2).cast("int")))
    own = own.withColumn("_label", F.when(listed, F.col("_label"))).drop("_listed")
    first = F.row_number().over(Window.partitionBy("book_id", "chapter_id", "_label").orderBy("line_no")) == 1
    own = own.withColumn("_mark", F.when(F.col("_label").isNotNull() & first, F.col("_label")))
    own = own.withColumn("_name", F.when(F.col("_mark").isNotNull(), strip(F.regexp_extract("line", SECTION, 3))))
    return cut_sections(own.withColumn("_label", F.when(F.col("_mark").isNotNull(), F.concat_ws(".", "number", "_mark"))))


def cut_sections(own: DataFrame) -> DataFrame:
    """Lines of chapters, with _mark, _label and _name on the headings of sections (null elsewhere), to the parts of each chapter."""
    here = Window.partitionBy("book_id", "chapter_id")
    review = F.min(F.when(F.lower(strip(F.col("line"))).isin(*REVIEW), F.col("line_no"))).over(here)
    so_far = here.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_section", F.coalesce(F.last("_mark", True).over(so_far), F.lit(0))).withColumn("_review", F.coalesce(F.col("line_no") >= review, F.lit(False)))
    part = F.when(F.col("_review"), REST).when(F.col("_section") > 0, BODY).otherwise(INTRO)
    own = own.withColumn("_part", part).withColumn("_section", F.when(F.col("_part") == BODY, F.col("_section")).otherwise(0))
    heading = (F.col("pos") == F.min("pos").over(here)) | (F.col("_mark").isNotNull() & ~F.col("_review"))
    text = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("_heading"), F.struct("line_no", "line"))))["line"], "\n")
    out = own.withColumn("_heading", heading).groupBy("book_id", "chapter_id", "number", "_part", "_section").agg(
        F.max("_name").alias("_title"), F.max("_label").alias("_label"), F.count(F.lit(1)).alias("lines"), strip(text).alias("content")
    )
    least = F.when(F.col("_part") == INTRO, LEAST_CHARS[INTRO]).when(F.col("_part") == BODY, LEAST_CHARS[BODY]).otherwise(LEAST_CHARS[REST])
    label = F.when(F.col("_part") == BODY, F.col("_label")).otherwise(F.concat_ws(".", "number", F.when(F.col("_part") == REST, "r").otherwise("0")))
    title = F.when(F.col("_part") == INTRO, "Introduction").when(F.col("_part") == BODY, F.col("_title")).otherwise("Glossary, Summary & Exercises")
    return out.filter(F.length("content") >= least).select("book_id", "chapter_id", label.alias("label"), F.when(F.col("_part") == REST, -1).otherwise(F.col("_section")).alias("section"), title.alias("title"), "lines", "content")


def with_units(chapters: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Chapters with a unit: the declared one (book_id, unit_index, unit_title, start, end) around their start, else seven to a unit."""
    seven = (F.floor((F.col("chapter_index") - 1) / 7) + 1).cast("int")
    if units is None:
        return chapters.withColumn("unit_index", seven).withColumn("unit_title", F.concat(F.lit("Unit "), seven))
    u = units.select("book_id", "unit_index", "unit_title", F.col("start").alias("_a"), F.col("end").alias("_b"))
    joined = chapters.join(u, ["book_id"], "left").withColumn("_fits", (F.col("start") >= F.col("_a")) & (F.col("start") < F.col("_b")))
    best = joined.groupBy(*chapters.columns).agg(F.min(F.when(F.col("_fits"), F.struct("unit_index", "unit_title"))).alias("_u"))
    return best.select(*chapters.columns, F.coalesce("_u.unit_index", seven).alias("unit_index"), F.coalesce("_u.unit_title", F.concat(F.lit("Unit "), seven)).alias("unit_title"))


def outline_sections(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """outline (book_id, seq, level, title, page) to sections with their chapter, page range and word count.

    Level 1 entries are chapters; deeper ones belong to the last chapter before them. A section ends where the next entry
    starts and has one page at least; words come from a join on the book with a page range.
    """
    by = Window.partitionBy("book_id").orderBy("seq")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    o = outline.withColumn("chapter", F.sum((F.col("level") == 1).cast("int")).over(so_far))
    o = o.withColumn("chapter_title", F.last(F.when(F.col("level") == 1, F.col("title")), True).over(so_far))
    o = o.withColumn("_next", F.lead("page").over(by))
    sub = o.filter("level = 2 and chapter > 0")
    k = F.row_number().over(Window.partitionBy("book_id", "chapter").orderBy("seq"))
    sub = sub.select(
        "book_id", "seq", "chapter", "chapter_title", F.concat_ws(".", "chapter", k).alias("label"), "title",
        F.col("page").alias("first_page"), F.greatest(F.coalesce("_next", F.lit(1 << 30)), F.col("page") + 1).alias("_stop"),
    )
    words = pages.select("book_id", "page_index", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("words"))
    hit = sub.join(words, "book_id").filter((F.col("page_index") >= F.col("first_page")) & (F.col("page_index") < F.col("_stop")))
    return hit.groupBy("book_id", "seq", "chapter", "chapter_title", "label", "title", "first_page").agg(
        F.sum("words").alias("words"), F.max("page_index").alias("last_page")
    )


def printed_contents(lines: DataFrame, within: int = 400) -> DataFrame:
    """Entries `N.M Title page` of a printed table of contents in a book's first lines, under their chapter mark."""
    entry = r"^[ \t]*(\d{1,3})\.(\d{1,2})[ \t]+(.{2,90}?)[ .\t]+(\d{1,4})[ \t]*$"
    mark = r"(?i)^[ \t]*CHAPTER[ \t]+(\d{1,3})\b"
    front = lines.filter(F.col("line_no") < within)
    so_far = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    front = front.withColumn("_chapter", F.last(F.nullif(F.regexp_extract("line", mark, 1), F.lit("")).cast("int"), True).over(so_far))
    found = front.filter(F.col("line").rlike(entry))
    found = found.select("book_id", "line_no", "_chapter", *[F.regexp_extract("line", entry, i + 1).alias(c) for i, c in enumerate(("chapter", "section", "title", "page"))])
    found = found.filter(F.col("_chapter").isNull() | (F.col("_chapter") == F.col("chapter").cast("int")))
    return found.select("book_id", "line_no", F.col("chapter").cast("int").alias("chapter"), F.col("section").cast("int").alias("section"), strip(F.col("title")).alias("title"), F.col("page").cast("int").alias("page"))


def best_rung(plans: DataFrame) -> DataFrame:
    """plans (book_id, rung, ...): embedded outline, printed contents, headings, simple chapters, balanced chunks; the first that a book has."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(("outline", "contents", "headings", "simple", "chunks")) for x in (k, i)])[F.col("rung")]
    return plans.withColumn("_rn", F.row_number().over(Window.partitionBy("book_id").orderBy(place))).filter("_rn = 1").drop("_rn")


def weak_chapters(sections: DataFrame) -> DataFrame:
    """Chapters with one section at most."""
    return sections.groupBy("book_id", "chapter_id").agg(F.count(F.lit(1)).alias("n")).filter("n <= 1")


def first_of_each(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (sub-sections by label, cards by topic)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rn = 1").drop("_rn")


def title_ratio(left: Column, right: Column) -> Column:
    """Likeness of two titles by matching blocks (the standard library's ratio), in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio(left, right)


def matched_chapters(wanted: DataFrame, chapters: DataFrame, least: float = 0.6) -> DataFrame:
    """wanted (course_id, query) with the chapter of the course whose title is most alike; the first of equals."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?i)^\s*chapter\s+\d+\s*[:.\-]?\s*", ""))
    pairs = wanted.join(chapters, "course_id").withColumn("ratio", title_ratio(bare(F.col("query")), bare(F.col("title"))))
    best = Window.partitionBy("course_id", "query").orderBy(F.desc("ratio"), "chapter_index")
    return pairs.withColumn("_rn", F.row_number().over(best)).filter((F.col("_rn") == 1) & (F.col("ratio") >= least)).drop("_rn")
