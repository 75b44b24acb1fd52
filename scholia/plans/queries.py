"""Registered queries of the learning jobs; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import predicates as P
from scholia.functions import text as X
from scholia.functions.num import rounded
from scholia.operators import catalogue as C
from scholia.operators import chunking as K
from scholia.operators import contents as N
from scholia.operators import extraction as E
from scholia.operators import front_matter as FM
from scholia.operators import grading as G
from scholia.operators import lines as L
from scholia.operators import mastery as M
from scholia.operators import outline as O
from scholia.operators import retrieval as R
from scholia.operators import section_kinds as SK
from scholia.operators import simple_chapters as SC
from scholia.operators import srs as S
from scholia.operators import structure as U
from scholia.operators import training as T
from scholia.plans import views as V
from scholia.sources.files import first_rows, interaction_rows
from scholia.sources.tables import settled

AS_OF = "2024-01-31"
REGISTRY = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def _graded(s, d):
    return G.graded_attempts(V.attempts(s, d))


@query
def grd3_fuzzy_scores(s, d):
    return _graded(s, d).select("attempt_id", "fuzzy_score", "centroid_score", "performance_tier", "degree_of_failure")


@query
def agg1_student_summary(s, d):
    return M.student_summary(_graded(s, d))


@query
def agg1_new_students(s, d):
    """Students with attempts, and customers, who have none yet."""
    new = V.read(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("student_id"))
    g = _graded(s, d)
    return M.student_summary(g, new.unionByName(g.select("student_id"))).drop("avg_latency")


@query
def agg2_chapter_mastery_exact(s, d):
    return M.chapter_mastery_exact(_graded(s, d)).drop("last_updated")


@query
def agg2b_chapter_mastery(s, d):
    return M.chapter_mastery(_graded(s, d)).drop("last_updated")


@query
def agg3_heatmap(s, d):
    return M.heatmap(M.chapter_mastery(_graded(s, d)).drop("last_updated"))


@query
def agg_rollup_attempts(s, d):
    return M.attempts_rollup(V.attempts(s, d))


@query
def srs1_schedules(s, d):
    return S.schedules(V.reviews(s, d))


@query
def srs2_due_cards(s, d):
    return S.due_cards(S.schedules(V.reviews(s, d)), AS_OF, "course_1").select("student_id", "card_id", "next_review")


@query
def srs1_history(s, d):
    """The state of a card after each of its reviews."""
    return S.review_history(V.reviews(s, d)).drop("review_ts")


@query
def srs3_card_statistics(s, d):
    """Of all students; customers have no cards."""
    r = V.reviews(s, d)
    students = r.select("student_id").union(V.read(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey")))
    return S.card_statistics(S.schedules(r), AS_OF, students)


@query
def grd1_similarity(s, d):
    x = V.submissions(s, d)
    return x.select("submission_id", G.answer_similarity(F.col("student_raw_input"), F.col("expected_answer")).alias("similarity"))


@query
def grd4_graded_submissions(s, d):
    return G.graded_submissions(V.submissions(s, d)).select("submission_id", "is_correct", "accuracy_pct", "error_severity", "fuzzy_score", "performance_tier")


@query
def grd4_answer_records(s, d):
    """Graded answers as the log of attempts holds them, with diagnosis and hint."""
    return G.answer_records(V.answer_sheets(s, d)).drop("performance_tier")


def _listed(c):
    entry = lambda x: F.concat_ws("|", x["attempt_id"], x["qId"], x["topic"], F.md5(x["question"]), x["formula"], x["misconception"], x["attempts"], F.rint(x["fuzzy_score"] * 10).cast("long"))
    return F.coalesce(F.array_join(F.transform(c, entry), ";"), F.lit(""))


@query
def grd6_exam_profiles(s, d):
    """Exams with and without details, with and without mock exams before; lists of answers."""
    details = V.exam_details(s, d).withColumn("topic", F.when(F.col("attempt_id") % 2 == 0, "Own topic")).withColumn("misconception", F.concat(F.lit("mixes up "), "qId"))
    turns = details.select("submission_id").distinct().filter("submission_id % 3 > 0").withColumn("mock_turns", F.col("submission_id") % 5)
    p = G.exam_profiles(details, V.exam_bank(s, d), V.exam_totals(s, d), turns)
    return p.select("submission_id", "total_questions", "correct_answers", "average_latency", "average_attempts", "fuzzy_score", "performance_tier", "pathway", "score_delta_pct", "insight", "study_level",
                    _listed(F.col("correct_details")).alias("correct_details"), _listed(F.col("incorrect_details")).alias("incorrect_details"))


@query
def ret6_system_prompts(s, d):
    """Grounded prompts between course data and the guardrails of the tier; every fifth query has no excerpt."""
    docs = V.read(s, d, "documents").select("doc_id", F.col("text").alias("document"))
    ranked = R.dense_top(*_vectors(s, d), 3).filter("query_id % 250 > 0").join(docs, "doc_id", "left")
    q, tiers = F.col("query_id"), F.array(*map(F.lit, ("Class 9", "Grade 12", "college")))
    about = _vectors(s, d)[1].select("query_id", F.lit("tutor").alias("role"), F.lit("Physics").alias("subject"), F.concat(F.lit("Course "), q % 3).alias("course_title"), F.concat(F.lit("Chapter "), q % 7).alias("chapter_title"),
                                     F.get(tiers, (F.floor(q / 50) % 3).cast("int")).alias("tier"), F.when(q % 100 == 0, F.concat(F.lit("What is "), q)).alias("question"))
    return R.grounded_system_prompts(ranked, about).select("query_id", "tier_key", "excerpts", F.md5("prompt").alias("prompt"))


@query
def grd5_pathway(s, d):
    turns = V.read(s, d, "conversations").groupBy("conv_id").agg(F.sum((F.col("role") == "user").cast("int")).alias("mock_turns"))
    score = (F.col("conv_id") * 7 % 101).cast("double")
    return turns.select("conv_id", G.pathway(F.when(F.col("conv_id") % 5 > 0, F.col("mock_turns")), score).alias("p")).select("conv_id", "p.*")


@query
def jon1_exam_answers(s, d):
    return G.exam_answers(V.exam_details(s, d), V.exam_bank(s, d)).select("attempt_id", "qId", "topic", "question", "formula")


@query
def grd6_exam_reports(s, d):
    return G.exam_reports(V.exam_details(s, d)).select("submission_id", "total_questions", "correct_answers", "average_latency", "average_attempts", "fuzzy_score", "performance_tier", "pathway")


@query
def cls1_routed_inquiries(s, d):
    return G.routed_inquiries(V.inquiries(s, d))


@query
def src6_interactions(s, d):
    return interaction_rows(V.interactions(s, d))


@query
def src7_first_log_rows(s, d):
    return first_rows(V.interactions(s, d), "row_id", 5000).select("row_id", "elapsed_time")


@query
def prj_text_forms(s, d):
    t = F.col("text")
    head, cut, full = X.capped(t)
    return V.read(s, d, "documents").select(
        "doc_id", F.md5(X.clean_text(t)).alias("cleaned"), F.md5(X.context_sample(t)).alias("sample"), F.md5(X.context_window(t)).alias("window"),
        F.length(head).alias("capped"), cut.alias("truncated"), full.alias("full_length"), X.preview(t).alias("preview"), X.slug(t).alias("slug"),
        X.content_hash(t).alias("content_hash"),
    )


@query
def prj7_titles(s, d):
    made = F.concat(F.lit("Chapter "), F.col("p_partkey") % 40, F.lit(": "), "p_name", F.lit("  ... "), F.col("p_partkey") % 300)
    return V.read(s, d, "part").select("p_partkey", X.chapter_title(made).alias("title"))


@query
def prj12_tiers(s, d):
    names = F.array(*map(F.lit, ("Class 9", "Senior Secondary", "University", "secondary", "Grade 12", "PhD", "kindergarten", "", "Middle school")))
    t = V.read(s, d, "events").select("event_id", F.get(names, (F.col("event_id") % 9).cast("int")).alias("t"))
    return t.select("event_id", X.academic_tier(F.col("t")).alias("tier"))


@query
def prj13_guardrails(s, d):
    x = V.read(s, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, ("Class 9", "Grade 12", "college"))), (F.col("doc_id") % 3).cast("int")).alias("grade"))
    return P.with_guardrails(x, "grade").select("doc_id", "tier_key", "label", "audience", "tone", "math_ceiling", F.array_join("prohibitions", "; ").alias("prohibitions"), F.array_join("requirements", "; ").alias("requirements"))


@query
def prj14_subjects(s, d):
    extra = F.when(F.col("doc_id") % 7 == 0, " velocity force energy momentum wave").when(F.col("doc_id") % 7 == 1, " enzyme protein cell cell dna").otherwise("")
    x = V.read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 13 == 0, "Organic matters").otherwise("Notes").alias("title"), F.concat(extra, F.lit(" "), "text").alias("text"))
    return x.select("doc_id", X.subject(F.col("title"), F.col("text")).alias("subject"))


@query
def flt_line_predicates(s, d):
    t = F.col("line")
    x = V.book_lines(s, d).select("book_id", "line_no", P.valid_heading(t).alias("heading"), P.non_theory(t).alias("non_theory"), P.educational(t).alias("educational"), P.noise_line(t).alias("noise"))
    return x.groupBy("book_id").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("heading", "non_theory", "educational", "noise")])


@query
def flt11_safe_hints(s, d):
    b = V.read(s, d, "benchmark").select("item_id", F.substring_index("text", " ", 2).alias("answer"), F.col("text").alias("rest"))
    hint = F.concat(F.lit("Look again. The final answer is '"), "answer", F.lit("'. So x = "), "answer", F.lit(" and "), "rest")
    return b.select("item_id", P.without_answer(hint, F.col("answer")).alias("hint"))


@query
def str2_running_headers(s, d):
    return L.running_headers(V.book_lines(s, d))


@query
def str2_headers_by_page(s, d):
    """Headers count once per page (a chapter's document)."""
    return L.running_headers(V.book_lines(s, d), "part")


@query
def str26_weak_chapters(s, d):
    """Chapters of the styled books with one section at most."""
    lines = settled(V.styled_lines(s, d))
    short = U.briefs(lines)
    chapters = U.chapters(short)
    return U.weak_chapters(SK.sections_by_kind(lines, chapters, settled(SK.section_kinds(short, chapters))))


@query
def str3_body_lines(s, d):
    lines = V.book_lines(s, d)
    return L.without_noise(lines, L.running_headers(lines)).groupBy("book_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("pos").alias("pos_sum"))


@query
def str7_heading_candidates(s, d):
    return U.heading_candidates(V.book_lines(s, d)).select("book_id", "kind", "pos", "number", "title")


@query
def str7_styled_headings(s, d):
    """Every family of headings occurs."""
    return U.heading_candidates(V.styled_lines(s, d)).select("book_id", "kind", "pos", "number", "title")


@query
def str14_styled_scores(s, d):
    """Scores of all families of the styled books."""
    lines = U.briefs(V.styled_lines(s, d))
    lengths = U.book_lengths(lines)
    headings = settled(U.without_listing(settled(U.heading_candidates(lines))))
    return U.candidate_scores(headings, lengths).select("book_id", "kind", "n", "score")


@query
def str10_grouped_headings(s, d):
    return FM.grouped_headings(U.briefs(V.styled_lines(s, d))).select("book_id", "number", "pos", "title")


@query
def str19_contents_plan(s, d):
    p = N.contents_plan(U.briefs(V.styled_lines(s, d)))
    return p.select("book_id", "chapter", "title", "page", F.array_join(F.transform("sections", lambda x: F.concat_ws(" ", x["section"], x["title"])), "; ").alias("sections"))


@query
def str20_anchored_chapters(s, d):
    """Every third chapter of a contents book has a heading; the others are found by the label of their first section."""
    lines = U.briefs(V.styled_lines(s, d))
    return N.anchored_chapters(lines, settled(N.contents_plan(lines))).select("book_id", "chapter_id", "chapter_index", "title", "start", "end", "by_label")


@query
def str16_styled_ladder(s, d):
    """All four ways to divide a book."""
    lines = U.briefs(V.styled_lines(s, d))
    own = V.outlines(s, d).filter("book_id like '%1-%'")
    return O.ladder(lines.select("book_id").distinct(), O.outline_chapters(own), N.divided_by_contents(lines)[0], U.chapters(lines))


@query
def str20_styled_chapters(s, d):
    """Chapters by headings of all families."""
    return U.with_units(U.chapters(V.styled_lines(s, d))).select("book_id", "kind", "chapter_id", "chapter_index", "start", "end", "unit_index")


@query
def str21_section_kinds(s, d):
    lines = U.briefs(V.styled_lines(s, d))
    return SK.section_kinds(lines, U.chapters(lines)).select("book_id", "kind", "score", "level")


@query
def str22_styled_sections(s, d):
    """Numbered, lettered and hashed sections, introductions and a chapter's glossary."""
    lines = settled(V.styled_lines(s, d))
    short = U.briefs(lines)
    chapters = U.chapters(short)
    return SK.sections_by_kind(lines, chapters, settled(SK.section_kinds(short, chapters))).select("book_id", "chapter_id", "label", "title", "lines", F.md5("content").alias("content"))


@query
def str27_simple_chapters(s, d):
    """Numbered sections, headings of any kind, folded parts."""
    c = SC.simple_chapters(V.styled_lines(s, d))
    return c.select("book_id", "chapter_index", "title", F.md5("content").alias("content"), F.array_join(F.transform("subsections", lambda x: F.concat_ws(" ", x["label"], x["title"])), "; ").alias("subsections"))


@query
def str14_family_scores(s, d):
    lines = U.briefs(V.book_lines(s, d))
    lengths = U.book_lengths(lines)
    headings = settled(U.without_listing(settled(U.heading_candidates(lines))))
    return U.best_family(U.candidate_scores(headings, lengths)).select("book_id", "kind", "n", "score")


@query
def str20_chapters(s, d):
    return U.with_units(U.chapters(V.book_lines(s, d))).select("book_id", "chapter_id", "chapter_index", "start", "end", "unit_index")


@query
def str23_sections(s, d):
    lines = settled(V.book_lines(s, d))
    short = U.briefs(lines)
    return U.sections(lines, U.chapters(short), U.printed_contents(short)).select("book_id", "chapter_id", "label", "title", "lines", F.md5("content").alias("content"))


@query
def str16_ladder(s, d):
    """Books of some sources have an embedded outline; all have headings."""
    lines = U.briefs(V.book_lines(s, d))
    own = V.outlines(s, d).filter("book_id like '%1-%'")
    return O.ladder(lines.select("book_id").distinct(), O.outline_chapters(own), U.printed_contents(lines), U.chapters(lines))


@query
def str17_outline_plan(s, d):
    pages = V.book_lines(s, d).select("book_id", F.col("part").alias("page_index"), F.col("line").alias("text"))
    return O.section_words(O.outline_plan(V.outlines(s, d)), pages).select("book_id", "chapter", "chapter_title", "label", "title", "first_page", "stop_page", "words")


def _outline(s, d):
    """Pages of a source's documents; a chapter every five pages, a section on every page."""
    p = V.numbered(V.read(s, d, "documents")).select(F.col("source").alias("book_id"), F.col("n").alias("page_index"), "text")
    top = p.filter("page_index % 5 = 1").select("book_id", (F.col("page_index") * 2 - 1).alias("seq"), F.lit(1).alias("level"), F.concat(F.lit("Chapter "), F.col("page_index")).alias("title"), F.col("page_index").alias("page"))
    sub = p.select("book_id", (F.col("page_index") * 2).alias("seq"), F.lit(2).alias("level"), F.concat(F.lit("Part "), F.col("page_index")).alias("title"), F.col("page_index").alias("page"))
    return top.unionByName(sub), p


@query
def str18_outline_sections(s, d):
    return U.outline_sections(*_outline(s, d)).select("book_id", "chapter", "label", "first_page", "words")


@query
def chk1_paragraphs(s, d):
    x = V.read(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return K.paragraph_chunks(x).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query
def chk2_packed_chunks(s, d):
    x = V.read(s, d, "documents").select("doc_id", K.packed(F.col("text")).alias("c"))
    return x.select("doc_id", F.posexplode("c").alias("chunk_index", "chunk"))


def _paragraphs(s, d):
    return V.read(s, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query
def chk3_balanced_chunks(s, d):
    """Paragraphs gathered to 600 characters, ten chunks at most; the last takes the rest."""
    x = _paragraphs(s, d).select("doc_id", F.posexplode(K.packed(F.col("text"), "paragraphs", 600, most=10)).alias("chunk_index", "chunk"))
    return x.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


@query
def chk4_titled_sections(s, d):
    """Sections of about 5,000 characters with titles."""
    return K.titled_sections(_paragraphs(s, d)).withColumn("content", F.md5("content"))


@query
def chk5_deduplicated_chunks(s, d):
    return K.deduplicated_chunks(V.chunks(s, d)).select("course_id", "chapter_id", "content_hash", "copies", "chunk_key")


@query
def flt9_verified_chunks(s, d):
    return R.verified(V.chunks(s, d), course="src1", chapter="ch_2").select("chunk_id", "chapter_id")


@query
def ret1_bm25_top(s, d):
    q = V.read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scores = R.bm25(V.read(s, d, "documents").select("doc_id", "text"), q).withColumn("score", rounded(F.col("score"), 6))
    return R.top(scores, "query_id", 5, F.desc("score"), "doc_id")


def _vectors(s, d):
    v = V.read(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v, v.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


@query
def ret3_dense_top(s, d):
    return R.dense_top(*_vectors(s, d), 8)


@query
def ret3c_dense_all_pairs(s, d):
    """Every vector asks."""
    v = _vectors(s, d)[0]
    return R.dense_top(v, v.withColumnRenamed("doc_id", "query_id"), 3)


@query
def ret3b_dense_same_label(s, d):
    return R.dense_top(*_vectors(s, d), 8, "cosine", "label")


@query
def ret4_chapter_else_course(s, d):
    """Queries see their chapter's verified chunks, those of the course where the chapter has none."""
    c = V.chunks(s, d).withColumn("chapter_id", F.when(F.col("chunk_id") % 3 > 0, F.col("chapter_id")).otherwise("ch_1"))
    q = V.read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("course_id"), F.concat(F.lit("ch_"), F.col("item_id") % 9).alias("chapter_id"))
    return R.chapter_else_course(q, c).groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chunk_id").alias("ids"))


@query
def ret5_hybrid(s, d):
    docs = V.read(s, d, "documents").select("doc_id", "text")
    dense = R.dense_top(*_vectors(s, d), 8).select("query_id", "doc_id", "rank")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    c = R.candidate_bm25(dense.join(docs, "doc_id").join(asked, "query_id")).withColumn("bm25", rounded(F.col("bm25"), 9))
    return R.fused(c, 4)


@query
def ret6_prompt_contexts(s, d):
    docs = V.read(s, d, "documents").select("doc_id", F.col("text").alias("document"))
    ranked = R.dense_top(*_vectors(s, d), 3).join(docs, "doc_id", "left")
    return R.grounded_prompts(ranked).select("query_id", "excerpts", F.md5("context").alias("context"))


@query
def ret7_cards(s, d):
    c = V.chunks(s, d).select(F.concat_ws("/", "course_id", "chapter_id").alias("query_id"), F.col("chunk_id").alias("rank"), "document")
    return E.retrieval_cards(c).select("query_id", "topic", F.md5("answer").alias("answer"))


def _chapters(s, d):
    """Documents as chapters with a few facts put in front."""
    i = F.col("doc_id")
    facts = F.concat(F.lit("Momentum is defined as the product of the mass and the velocity. Here F"), i % 5, F.lit(" = m * a, and the Speed equals "), i % 90, F.lit(" m/s. Example "), i % 9, F.lit(" A cart rolls down a slope and stops after a while on level ground.\n"))
    return V.read(s, d, "documents").select(F.concat(F.lit("c"), i).alias("chapter_id"), F.concat(F.lit("Chapter "), i).alias("title"), F.concat(facts, "text").alias("text"), F.col("source").alias("course_id"), i.alias("n"))


@query
def ext1_chapter_theory(s, d):
    t = E.chapter_theory(_chapters(s, d))
    return t.select("chapter_id", F.size("facts").alias("facts"), F.size("terms").alias("terms"), F.size("examples").alias("examples"), "summary", F.size("cards").alias("cards"), "quiz.type", "quiz.expected_answer", F.array_join("quiz.options", " | ").alias("options"))


def _rows(c, *fields):
    return F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(x[f] for f in fields))), ";")


@query
def ext8_grounded_merge(s, d):
    """Chapters' facts merged with a model's rows: whole, in part, empty, or none."""
    m = E.grounded_merge(V.theory_rows(s, d), V.blueprints(s, d))
    return m.select(
        "chapter_id", F.md5("summary").alias("summary"), F.array_join("objectives", ";").alias("objectives"),
        F.md5(_rows("principles", "title", "content", "tag")).alias("principles"), _rows("formulations", "title", "formula", "derivation", "variables").alias("formulations"),
        F.md5(_rows("worked_examples", "title", "content")).alias("worked_examples"), _rows("mental_models", "concept", "analogy", "takeaway").alias("mental_models"),
        _rows("misconceptions", "trap", "correction").alias("misconceptions"), "theory_source",
    )


@query
def win2_collapsed_turns(s, d):
    return T.collapsed_turns(V.dialogues(s, d)).select("conv_id", "turn", "role")


@query
def trn4_tutor_examples(s, d):
    x = T.tutor_examples(V.dialogues(s, d))
    return x.select("conv_id", "topic", F.size("messages").alias("messages"), F.md5(T.chat_text(F.col("messages"))).alias("text"))


@query
def trn5_topic_lessons(s, d):
    return T.topic_lessons(V.dialogues(s, d)).select("topic", F.size("messages").alias("messages"))


@query
def trn8_combined(s, d):
    t = E.chapter_theory(_chapters(s, d)).join(_chapters(s, d).select("chapter_id", "text"), "chapter_id")
    out = T.combined(T.curriculum_examples(t), T.notes_examples(t), T.tutor_examples(V.dialogues(s, d)), T.topic_lessons(V.dialogues(s, d)))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("examples"), F.sum(F.size("messages")).alias("messages"))


def _courses(s, d):
    i = F.col("doc_id")
    x = V.read(s, d, "documents")
    return x.select(F.concat(F.lit("c"), i).alias("course_id"), F.concat(F.lit("Course "), F.when(i % 2 == 0, " ").otherwise(""), F.floor(i / 3)).alias("title"), F.col("lang").alias("subject"), F.col("source").alias("academic_tier"), (i * 7919 % 1000).alias("mtime"))


@query
def cat2_catalogue(s, d):
    c = _courses(s, d)
    own = c.filter("course_id not like 'c%0'")
    return C.catalogue(c.filter("course_id like 'c%0'"), own).select("course_id", "title", "is_builtin")


@query
def cat3_superseded(s, d):
    return C.superseded(_courses(s, d)).select("course_id", "mtime")


@query
def cat5_search(s, d):
    return C.search(_courses(s, d), "RSE 1", "en").select("course_id", "title")


def _course_chapters(s, d):
    x = V.numbered(V.read(s, d, "documents"))
    n, i = F.col("n"), F.col("doc_id")
    return x.select(F.col("source").alias("course_id"), n.alias("chapter_index"), F.concat(F.lit("c"), i).alias("chapter_id"), (F.floor((n - 1) / 7) + 1).cast("int").alias("unit_index"), (1 + i % 6).cast("int").alias("sections"), (i % 4).cast("int").alias("cards"), F.when(i % 3 == 0, "model").alias("theory_source"), F.when(i % 11 == 0, "Own unit").alias("unit_title"))


def _specs(s, d):
    """What is asked of each course: all, the first three, a range, a list, numbers beyond it, nonsense."""
    x = V.read(s, d, "documents").select(F.col("source").alias("course_id")).distinct()
    k = F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(course_id, '[0-9]+', 0) as int)"), F.lit(0)), F.lit(7))
    return x.select("course_id", F.get(F.array(*map(F.lit, ("ALL", " 3 ", "2-4", "1, 3,5 - 8,x", "90000-99999", "4-2,?", "7"))), k).alias("spec")).filter("spec <> '7'")


@query
def flt10_selected_chapters(s, d):
    c = _course_chapters(s, d)
    return C.selection_labels(C.selected_chapters(c, _specs(s, d)), c)


@query
def flt8_length_gates(s, d):
    """Lines long enough for each use, per source."""
    kinds = ("chunk", "body", "section", "intro", "review", "training", "training_book", "training_append")
    return V.chunks(s, d).groupBy("course_id").agg(*(F.count_if(P.long_enough(F.col("document"), k)).alias(k) for k in kinds))


@query
def prj9_prj10_ids(s, d):
    """Subjects out of file names, and ids of chunks, sections and cards."""
    n, name = F.col("p_partkey"), F.col("p_name")
    path = F.concat(F.lit("/books/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("_textbook.txt"))
    return V.read(s, d, "part").select(
        "p_partkey", X.subject_from_file(path).alias("subject"), X.builtin_chunk_id(name, F.lit("standard"), n % 20_000).alias("builtin"),
        X.section_id(n % 9, F.concat(n % 9, F.lit("."), n % 5)).alias("section"), X.card_id(name, F.lit("standard"), F.col("p_type")).alias("card"),
    )


@query
def jon3_quizzes_with_cards(s, d):
    """Quizzes find the first card of their concept, else the one at their place."""
    c = _course_chapters(s, d).select("course_id", (F.col("chapter_index") - 1).alias("at"), F.concat(F.lit("topic "), F.col("chapter_index") % 9).alias("topic"), F.col("chapter_id").alias("card_id"))
    q = c.select("course_id", "at", F.when(F.col("at") % 4 == 0, "unknown").otherwise(F.concat(F.lit("topic "), F.col("at") % 11)).alias("concept"))
    return C.quizzes_with_cards(q, c).select("course_id", "at", "concept", "card_id")


@query
def jon10_chapter_lookup(s, d):
    """Chapters asked for by id, by index, or in vain."""
    c = _course_chapters(s, d).withColumn("title", F.concat(F.lit("T "), "chapter_id"))
    i = F.col("chapter_index")
    asked = c.select("course_id", F.when(i % 3 == 0, F.col("chapter_id")).when(i % 3 == 1, i.cast("string")).otherwise("none").alias("ref"))
    return C.chapter_lookup(asked.distinct(), c)


@query
def jon2_enriched(s, d):
    """Chapters with title and text of the canonical chapter of their index, where it has them."""
    c = _course_chapters(s, d).select("course_id", "chapter_index", F.concat(F.lit("T "), "chapter_id").alias("title"), F.lit("own").alias("full_text"))
    i = F.col("chapter_index")
    k = c.filter("chapter_index % 2 = 0").select("course_id", i, F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Canonical "), i)).alias("title"), F.when(i % 6 > 0, "canonical").alias("full_text"))
    return C.enriched(c, k)


@query
def cat1_bank_courses(s, d):
    """Card banks nested by subject and tier as courses of cards."""
    b = V.read(s, d, "benchmark")
    card = F.struct(F.concat(F.lit("Topic "), "item_id").alias("topic"), F.col("text").alias("question"), F.lit("a").alias("answer"))
    cards = F.array(card, F.struct(F.lit("More").alias("topic"), F.lit("q").alias("question"), F.lit("b").alias("answer")))
    tiers = F.create_map(F.concat(F.lit("Class "), F.col("item_id") % 3 + 9), F.struct(cards.alias("cards")))
    repo = F.create_map(F.concat(F.lit("Subject "), "item_id"), tiers)
    return C.bank_courses(b.select(repo.alias("repo"))).withColumn("question", F.md5("question"))


@query
def trn6_section_prompts(s, d):
    """Sections of all classes as training texts."""
    i = F.col("doc_id")
    titles = F.array(*map(F.lit, ("Waves", "Appendix B", "Preface", "References", "Answers to odd problems", "Contents of the sea")))
    x = V.read(s, d, "documents").select(i.alias("section_id"), F.get(titles, (i % 6).cast("int")).alias("title"), F.col("text").alias("content"), F.concat(F.lit("About "), i).alias("output"))
    return T.section_prompts(x).select("section_id", "section_class", F.md5("text").alias("text"))


@query
def trn2_assessments(s, d):
    """Courses with quizzes or an exam, two of each."""
    i = F.col("item_id")
    many = lambda name, n: F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(k <= n, F.concat(F.lit(name), k.cast("string")))), lambda x: x.isNotNull())
    x = V.read(s, d, "benchmark").select(i.cast("string").alias("course_id"), F.concat(F.lit("Course "), i).alias("title"), many("quiz ", i % 4).alias("quizzes"), many("exam ", i % 3).alias("finalExam"))
    return T.assessment_examples(x).select("course_id", T.chat_text(F.col("messages")).alias("text"))


@query
def top5_newest_courses(s, d):
    return C.newest_courses(_courses(s, d)).select("course_id", "mtime")


@query
def agg5_course_rollups(s, d):
    return C.rollups(_course_chapters(s, d))


@query
def agg6_coverage(s, d):
    return C.coverage(_course_chapters(s, d))


@query
def cat4_pending_chapters(s, d):
    c = _course_chapters(s, d)
    return C.pending(c, c.filter("theory_source is not null")).select("course_id", "chapter_id")


@query
def cat6_chapters_by_unit(s, d):
    c = _course_chapters(s, d)
    units = c.filter("unit_index % 2 = 0").select("course_id", "unit_index").distinct().withColumn("unit_title", F.concat(F.lit("Declared "), "unit_index"))
    return C.chapters_by_unit(c, units).select("course_id", "unit", "chapters")


@query
def snk4_upsert(s, d):
    c = K.deduplicated_chunks(V.chunks(s, d)).select("chunk_key", "copies", F.lit("old").alias("version"))
    new = c.filter("copies > 1").withColumn("version", F.lit("new"))
    return K.upserted(c, new, "chunk_key")


@query
def snk5_without_course(s, d):
    return K.without_course(V.chunks(s, d), "src3").groupBy("course_id").agg(F.count(F.lit(1)).alias("chunks"))


@query
def agg10_document_sizes(s, d):
    return V.read(s, d, "documents").groupBy("source").agg(F.sum(F.size(X.words(F.col("text")))).alias("words"), F.sum(F.length("text")).alias("chars"))
