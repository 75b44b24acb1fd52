"""A corpus pipeline: quality, exact copies, near copies, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before has kept; all but the last return the columns
of `documents`. The driver writes each result as Parquet and rereads it as the next stage's docs; run() does the same in the
shared folder.
"""

from __future__ import annotations

from scholia.llm import decontam, exact_dedup, ngram_join, pieces, quality
from scholia.llm.common import cut, read


def drop_low_quality(spark, docs, sf_dir):
    """Documents that the classifier, trained on the labels of this corpus, doesn't reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    """Of texts that are equal but for white space, the row with the smallest id."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of texts linked by 5-word shingles at a Jaccard similarity of 0.75 or more, the row with the smallest id."""
    return ngram_join.keep_one_of_each(docs)


def drop_benchmark_passages(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """doc_id, ids, n_ids, round_trip of what is left."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("SentencePiece encoding and decoding", encode),
]

#: Trained scores and Viterbi ids have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
