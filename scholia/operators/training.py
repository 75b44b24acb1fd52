"""Chat-format training data from dialogues, chapters and courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import context_sample, strip

PER_TOPIC = 5
TUTOR = "You are a patient tutor who teaches by questions."
CURRICULUM = "You write summaries, objectives and recall cards for a chapter. Answer with JSON."
ASSESSMENT = "You write quizzes and exam questions for a course. Answer with JSON."
NOTES = "You are a master academic teacher and summarizer. Produce clear, high-retention pedagogical summaries for students."


def message(role, content) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def topics(dialogues: DataFrame) -> DataFrame:
    return dialogues.select(strip(F.col("topic")).alias("topic")).filter("topic <> ''").distinct()


def collapsed_turns(dialogues: DataFrame, first: int = 6) -> DataFrame:
    """The first turns of each dialogue without empty ones and without a turn of the same role as the one before.

    The opening question of the user counts as the turn before the first.
    """
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = dialogues.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).withColumn("_k", F.row_number().over(by))
    t = t.filter((F.col("_n") >= 4) & (F.col("_k") <= first)).withColumn("text", strip(F.col("text"))).filter("text <> ''")
    t = t.withColumn("role", F.when(F.col("role") == "Teacher", "assistant").otherwise("user"))
    t = t.withColumn("_before", F.lag("role", 1, "user").over(by))
    return t.filter(F.col("_before") != F.col("role")).select("conv_id", "topic", "turn", "role", "text")


def tutor_examples(dialogues: DataFrame, per_topic: int = PER_TOPIC) -> DataFrame:
    """(conv_id, topic, messages): dialogues that end with the tutor and have three messages, at most five of a topic.

    Texts stay out of the window over topics: the cap is found on ids, and Spark limits each group before the shuffle.
    """
    turns = collapsed_turns(dialogues)
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    turns = turns.withColumn("_last", F.row_number().over(last)).filter("not (_last = 1 and role = 'user')")
    sizes = turns.groupBy("conv_id", "topic").agg(F.count(F.lit(1)).alias("n")).filter("n >= 1")
    kept = sizes.withColumn("_rn", F.row_number().over(Window.partitionBy("topic").orderBy("conv_id"))).filter(F.col("_rn") <= per_topic).select("conv_id")
    turns = turns.join(kept, "conv_id", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: message(x["role"], x["text"]))
    g = turns.groupBy("conv_id", "topic").agg(ordered.alias("_turns"))
    head = F.array(
        message("system", F.concat(F.lit(f"{TUTOR}\nTopic: "), "topic")), message("user", F.concat(F.lit("Can you teach me about "), "topic", F.lit("?")))
    )
    return g.select("conv_id", "topic", F.concat(head, "_turns").alias("messages"))


def topic_lessons(dialogues: DataFrame) -> DataFrame:
    """One lesson per distinct topic from a template."""
    t = F.col("topic")
    text = F.concat(
        F.lit("## Lesson: "), t, F.lit("\n\n### 1. A mental model\nThink of "), t, F.lit(" as a system that keeps its balance: when one factor moves, others answer."),
        F.lit("\n\n### 2. Core mechanics\nIn "), t, F.lit(" a baseline sets the state, a mechanism links the parts, and limits bound the outcome."),
        F.lit("\n\n### 3. A common mistake\nLooking at symptoms of "), t, F.lit(" and not at their cause."),
        F.lit("\n\n### 4. Check\nIf the main condition in "), t, F.lit(" were reversed, what would you see first?"),
    )
    ask = F.concat(F.lit("I'm struggling to understand "), t, F.lit(". Can you teach it to me from first principles?"))
    return topics(dialogues).select("topic", F.array(message("system", TUTOR), message("user", ask), message("assistant", text)).alias("messages"))


def curriculum_examples(chapters: DataFrame, variant: str = "course") -> DataFrame:
    """Chapters (chapter_id, title, text, summary, objectives, cards) to examples whose answer is JSON.

    course: 120 characters or more, with a summary and cards; book: 250; append: 200. Missing parts have defaults.
    """
    least = {"course": 120, "book": 250, "append": 200}[variant]
    c = chapters.filter(F.length("text") >= least)
    if variant == "course":
        c = c.filter((F.coalesce("summary", F.lit("")) != "") & (F.size("cards") > 0))
    own = F.when(F.size("objectives") > 0, F.slice("objectives", 1, 3)).otherwise(F.array(F.concat(F.lit("Understand "), "title")))
    answer = F.to_json(F.struct("summary", own.alias("objectives"), F.slice("cards", 1, 3).alias("cards")))
    ask = F.concat(F.lit("Chapter: "), "title", F.lit("\n\nChapter Content:\n"), context_sample(F.col("text")))
    return c.select("chapter_id", F.array(message("system", CURRICULUM), message("user", ask), message("assistant", answer)).alias("messages"))


def notes_examples(chapters: DataFrame) -> DataFrame:
    """Chapters to study notes with numbered card points."""
    points = F.array_join(F.transform(F.slice("cards", 1, 3), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". **"), c["question"], F.lit("**: "), c["answer"])), "\n")
    ask = F.concat(F.lit("Can you summarize '"), "title", F.lit("' for my revision notes?\n\nSection Content:\n"), F.substring("text", 1, 2000))
    answer = F.concat(F.lit("### Core Concept: "), "title", F.lit("\n"), "summary", F.lit("\n\n### Key Conceptual Takeaways\n"), points)
    return chapters.filter(F.length("text") >= 250).select("chapter_id", F.array(message("system", NOTES), message("user", ask), message("assistant", answer)).alias("messages"))


def assessment_examples(courses: DataFrame) -> DataFrame:
    """Courses (course_id, title, quizzes, finalExam) with any question to one example of the first two of each."""
    answer = F.to_json(F.struct(F.slice("quizzes", 1, 2).alias("quizzes"), F.slice("finalExam", 1, 2).alias("finalExam")))
    ask = F.concat(F.lit("Generate summative assessment questions for course module: '"), "title", F.lit("'."))
    some = courses.filter((F.size("quizzes") > 0) | (F.size("finalExam") > 0))
    return some.select("course_id", F.array(message("system", ASSESSMENT), message("user", ask), message("assistant", answer)).alias("messages"))


#: Classes of sections, and the titles that show each; all others are theory.
SECTION_CLASSES = (
    ("APPENDIX", r"(?i)^\s*appendi(?:x|ces)\b"),
    ("FRONT_MATTER", r"(?i)^\s*(?:table\s+of\s+contents|contents|toc|preface|foreword|dedication|acknowledge?ments|copyright|publisher|about\s+the\s+authors?)\b"),
    ("BIBLIOGRAPHY", r"(?i)^\s*(?:bibliography|references|works\s+cited)\b"),
    ("EXERCISE_SOLUTIONS", r"(?i)^\s*(?:solutions\s+(?:to|for)|answers\s+to|answer\s+key)\b"),
)
THEORY, PROMPT_CHARS = "CORE_THEORY", 3500
SECTION_TASK = "Say which class the section belongs to: {}. For all but the last say that it is no theory, and why. For theory write two sentences of overview, three objectives and three cards."


def section_class(title: Column) -> Column:
    out = F.lit(THEORY)
    for name, pattern in reversed(SECTION_CLASSES):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


def section_prompts(sections: DataFrame) -> DataFrame:
    """sections (section_id, title, content, output) to (section_id, section_class, text): task, section and answer as one text.

    Theory is answered by output, everything else by a JSON object that says why it is none. Contents show 3,500 characters,
    as the prompts that the reader was made for do.
    """
    kind = section_class(F.col("title"))
    task = SECTION_TASK.format(", ".join(name for name, _ in (*SECTION_CLASSES, (THEORY, ""))))
    reason = F.to_json(F.struct(F.lit(False).alias("is_theory"), F.concat(F.lit("Section class "), kind).alias("reason")))
    answer = F.when(kind == THEORY, F.col("output")).otherwise(reason)
    ask = F.concat(F.lit("Title: "), "title", F.lit("\nContent:\n"), F.substring("content", 1, PROMPT_CHARS))
    return sections.select("section_id", kind.alias("section_class"), chat_text(F.array(message("system", task), message("user", ask), message("assistant", answer))).alias("text"))


def chat_text(messages: Column) -> Column:
    """Messages as one text with role marks."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"), m["content"], F.lit("<|eot_id|>"))), "")


def combined(*sources: DataFrame) -> DataFrame:
    """All examples as one dataset with their source's number."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i).alias("source"), "messages")
        out = part if out is None else out.unionByName(part)
    return out
