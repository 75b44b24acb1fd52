"""Keyword, vector and hybrid retrieval for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.num import rounded
from scholia.functions.predicates import with_guardrails
from scholia.functions.text import words
from scholia.sources.tables import settled

K1, B = 1.5, 0.75
#: Fixed value: what stands for missing excerpts.
PLACEHOLDER = "No specific textbook excerpt retrieved."
FUSION = 60.0
#: Rows of a block, of vectors and of queries, while there are fewer than FEW blocks of a side, and the most there may be: what a
#: task holds (64 dimensions of 8 bytes each: 8 MB a side). Larger blocks are copied to fewer others.
VECTORS, QUERIES = 4096, 4096
FEW, LARGEST = 8, 16384
#: Queries of a block scored in one matrix product.
ROWS = 256


def blocks(rows: int, least: int) -> int:
    """How many blocks a side of so many rows is dealt into."""
    return max(1, min(-(-rows // least), FEW), -(-rows // max(least, LARGEST)) if rows > least * FEW else 1)


def nearest(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the n least finite distances of each row, rounded to six digits; ties go to the first column.

    A partial sort finds the n-th distance; only what isn't farther (up to rounding) is rounded and sorted.
    """
    if d.shape[1] > n:
        last = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
        rows, columns = np.nonzero((d <= last + 2e-6 + np.abs(last) * 1e-12) & np.isfinite(d))
    else:
        rows, columns = np.nonzero(np.isfinite(d))
    near = np.rint(d[rows, columns] * 1e6) / 1e6 + 0.0  # no negative zero
    order = np.lexsort((columns, near, rows))
    rows, columns, near = rows[order], columns[order], near[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
    return rows[kept], columns[kept], near[kept]


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(words(F.lower(F.col(text)))).alias("term"))


def term_table(docs: DataFrame, doc: str = "doc_id", text: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """(doc, length, term, tf, first): the postings of all documents from one scan, written once; reuse it for many sets of queries.

    One row of a document is its first; it says that the document exists and, with a null term, that it has no words. With asked
    (term), only postings of these terms are kept, and a first row of another term has a null one. Texts are dealt by document,
    so that all postings of one lie together.
    """
    tokens = words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    # the length is a column before rows are made of the words, else it would be counted for each of them
    rows = docs.select(doc, text).repartition(doc).select(doc, tokens.alias("_words")).withColumn("length", F.size("_words")).select(doc, "length", F.posexplode_outer("_words").alias("_at", "term"))
    first = F.coalesce(F.col("_at") == 0, F.lit(True))
    if asked is not None:
        rows = rows.join(asked.select("term", F.lit(True).alias("_asked")), "term", "left").filter(F.col("_asked") | first)
        rows = rows.withColumn("term", F.when(F.col("_asked"), F.col("term")))
    return settled(rows.groupBy(doc, "length", "term").agg(F.count("term").alias("tf"), F.bool_or(first).alias("first")))


def bm25(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, doc, score) of all pairs with a common term; other pairs score 0. Words that a query repeats count as often."""
    asked = settled(_tokens(queries, query, text).select("term").distinct())
    return bm25_of(term_table(docs, doc, text, asked), queries, doc, query, text)


def bm25_of(postings: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """bm25 of a term_table. Postings stay where they lie while the queries' terms are few: a document's are summed up before a shuffle.

    No side is broadcast by hint: the queries' terms and their weights are written, so that Spark knows their size, broadcasts what is
    below its limit and divides the partitions of frequent terms. Only the one row of corpus statistics is sent to every task.
    """
    asked = settled(_tokens(queries, query, text).groupBy(query, "term").agg(F.count(F.lit(1)).alias("times")))
    whole = postings.filter("first").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    own = postings.join(asked.select("term").distinct(), "term", "left_semi").select(doc, "length", "term", "tf")
    weights = own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(whole))
    weights = settled(weights.select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"), "mean"))
    norm = 1.0 - B + B * (F.col("length") / F.greatest(F.col("mean"), F.lit(1e-4)))
    one = F.col("idf") * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * norm)
    rows = own.join(weights, "term").withColumn("one", one).select(doc, "term", "one")
    return rows.join(asked, "term").groupBy(query, doc).agg(F.sum(F.col("one") * F.col("times")).alias("score"))


def with_zeros(pairs: DataFrame, scores: DataFrame, doc: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Chosen pairs (query, doc) with their score, 0 where they have no common term."""
    return pairs.join(scores, [query, doc], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top(df: DataFrame, by: str, n: int, *order) -> DataFrame:
    """The first n rows of each key with their rank; Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= n)


def candidate_bm25(candidates: DataFrame, query: str = "query_id", doc: str = "doc_id", text: str = "text", asked: str = "query_text") -> DataFrame:
    """Candidates (query, doc, text, query_text) with a score whose statistics come from the query's own candidates."""
    q = candidates.select(query, asked).distinct()
    terms = q.select(query, F.explode(words(F.lower(F.col(asked)))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("times"))
    size = candidates.select(query, doc, F.size(words(F.lower(F.col(text)))).alias("length"))
    own = size.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    tf = candidates.select(query, doc, F.explode(words(F.lower(F.col(text)))).alias("term")).join(terms, [query, "term"]).groupBy(query, doc, "term", "times").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(query, "term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, [query, "term"]).join(size, [query, doc]).join(own, query)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = 1.0 - B + B * (F.col("length") / F.greatest(F.col("mean"), F.lit(1e-4)))
    scores = rows.groupBy(query, doc).agg(F.sum(F.col("times") * idf * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * norm)).alias("bm25"))
    return candidates.join(scores, [query, doc], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def dense_top(vectors: DataFrame, queries: DataFrame, n: int, metric: str = "l2", same: str | None = None) -> DataFrame:
    """(query_id, doc_id, distance, rank): the nearest vectors of each query, exactly, for any number of queries.

    Both sides are dealt into `blocks` of bounded size by a hash; every pair of blocks meets in one group (an
    equi-join on the pair's numbers), is scored by matrix products and keeps n per query, so that only n rows per query and
    block are shuffled on. Nothing passes the driver but the two counts. `same` names a column that must be equal. Null
    embeddings match nothing; ties go to the smaller doc_id; repeated vectors are each a result.
    """
    vectors, queries = (df.filter("embedding is not null") for df in (vectors, queries))
    parts, sets = (blocks(df.count(), least) for df, least in ((vectors, VECTORS), (queries, QUERIES)))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, times: int) -> DataFrame:
        df = df.select(key, F.col("embedding").cast("array<double>").alias("embedding"), *([F.col(same).alias("_same")] if same else []))
        df = df.withColumn(own, F.pmod(F.xxhash64(key, "embedding"), F.lit(blocks)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    v = dealt(vectors, "doc_id", "_part", parts, "_set", sets)
    q = dealt(queries, "query_id", "_set", sets, "_part", parts)

    def score(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left = left.sort_values("doc_id", kind="stable")
            x, docs = np.vstack(left["embedding"].to_numpy()), left["doc_id"].to_numpy()
            own, norms = left["_same"].to_numpy() if same else None, (x**2).sum(1)
            for at in range(0, len(right), ROWS):
                part = right.iloc[at : at + ROWS]
                m, ids = np.vstack(part["embedding"].to_numpy()), part["query_id"].to_numpy()
                if metric == "cosine":
                    d = 1.0 - (m @ x.T) / np.outer(np.linalg.norm(m, axis=1), np.sqrt(norms)).clip(1e-12)
                else:
                    d = np.add.outer((m**2).sum(1), norms)
                    d -= 2 * m @ x.T
                    np.maximum(d, 0, out=d)
                if same:
                    d = np.where(part["_same"].to_numpy()[:, None] == own[None, :], d, np.inf)
                row, k, near = nearest(d, n)
                found.append(pd.DataFrame({"query_id": ids[row], "doc_id": docs[k], "distance": near}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})

    rows = v.groupBy("_part", "_set").cogroup(q.groupBy("_part", "_set")).applyInPandas(score, "query_id long, doc_id long, distance double")
    return top(rows, "query_id", n, "distance", "doc_id")


def fused(candidates: DataFrame, n: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of candidates (query, doc, rank, bm25): rank is the dense one; ties keep the dense order."""
    by = Window.partitionBy(query)
    keyword = F.row_number().over(by.orderBy(F.desc("bm25"), "rank"))
    c = candidates.withColumn("bm25_rank", keyword)
    c = c.withColumn("rrf", 1.0 / (FUSION + F.col("rank")) + 1.0 / (FUSION + F.col("bm25_rank")))
    c = c.withColumn("fused_rank", F.row_number().over(by.orderBy(F.desc(rounded(F.col("rrf"), 12)), "rank")))
    return c.filter(F.col("fused_rank") <= n).select(query, doc, F.col("rank").alias("dense_rank"), "bm25_rank", "fused_rank")


def verified(chunks: DataFrame, course: str | None = None, chapter: str | None = None, subject: str | None = None, tier: str | None = None) -> DataFrame:
    """The metadata filter of a search: verified chunks of a course (else of a subject and tier), and of a chapter."""
    out = chunks.filter(F.col("status") == "verified")
    for name, value in ((("course_id", course),) if course else (("subject", subject), ("academic_tier", tier))):
        out = out.filter(F.col(name) == value) if value else out
    return out.filter(F.col("chapter_id") == chapter) if chapter else out


def chapter_else_course(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): verified chunks of the query's chapter; of its course, where the chapter has none."""
    c = chunks.filter(F.col("status") == "verified").select("chunk_id", "course_id", F.col("chapter_id").alias("_chapter"))
    pairs = queries.select("query_id", "course_id", "chapter_id").join(c, "course_id")
    own = F.col("chapter_id") == F.col("_chapter")
    has = pairs.groupBy("query_id").agg(F.max(own.cast("int")).alias("_has"))
    return pairs.join(has, "query_id").filter(own | (F.col("_has") == 0)).select("query_id", "chunk_id")


def grounded_prompts(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """ranked (query, rank, document) to one context per query, excerpts in rank order; a placeholder where there is none."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("document").isNotNull(), F.struct("rank", "document")))), lambda x: x["document"])
    text = F.array_join(ordered, "\n---\n")
    return ranked.groupBy(query).agg(F.when(text == "", PLACEHOLDER).otherwise(text).alias("context"), F.count("document").alias("excerpts"))


#: What every grounded prompt asks for.
GROUNDING = ("Explain and prove from the excerpts only", "Add no facts and no theories of another level", "Write formulas in plain text, such as F = m * a")


def grounded_system_prompts(ranked: DataFrame, about: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, tier_key, excerpts, prompt): grounded_prompts set between a course's data and the guardrails of its tier.

    about: (query, role, subject, course_title, chapter_title, tier, question); a null question adds nothing. Queries without
    excerpts get the placeholder.
    """
    context = grounded_prompts(ranked, query)
    rows = with_guardrails(about, "tier").join(context, query, "left")
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    parts = (
        text("You are the ", F.col("role"), " for ", F.col("subject"), ".\nCourse: ", F.col("course_title"), "\nChapter: ", F.col("chapter_title"), "\nLearners: ", F.col("label"), " (", F.col("audience"), ")"),
        text("# Excerpts of the course\n", F.coalesce("context", F.lit(PLACEHOLDER))),
        text("# Style\n", F.col("tone"), "\nMathematics: ", F.col("math_ceiling")),
        text("# Not allowed\n", bullets(F.col("prohibitions"))),
        text("# Required\n", bullets(F.col("requirements"))),
        text("# Grounding\n", "\n".join(f"- {x}" for x in GROUNDING)),
        F.when(F.col("question").isNotNull(), text("# Question\n", F.col("question"))),
    )
    return rows.select(query, "tier_key", F.coalesce("excerpts", F.lit(0)).cast("long").alias("excerpts"), F.concat_ws("\n\n", *parts).alias("prompt"))
