"""Language mixtures of documents by expectation-maximisation over character n-grams.

Training counts byte trigrams of every labelled, not held-out document per language; counts are summed in each task and then
by Spark, and the table of (languages x BUCKETS) is what the driver sees. A document's trigrams are taken as drawn from a
mixture of the languages: expectation-maximisation estimates the proportions, and the set of languages is the one with the
best likelihood after a penalty for every language beyond the first.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import body, held_out

BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
#: Each trigram overlaps its neighbours, so a document's likelihood counts a third.
OVERLAP = 3.0
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BREAKS = re.compile(r"[\W\d_]+")
_MIX = np.uint32(2654435761)


def buckets(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text, every run of other characters than letters as one space."""
    raw = np.frombuffer(f" {_BREAKS.sub(' ', text.lower()).strip()} ".encode(), np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return (code * _MIX) >> np.uint32(16)


def count_by_language(batches):
    """One row per language and bucket that a task has seen."""
    seen: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            if _LETTER.search(text):
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] += np.bincount(buckets(text), minlength=BUCKETS)
    for lang, counts in seen.items():
        at = counts.nonzero()[0]
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at]})


class Mixture:
    """Languages and, per bucket, their probabilities over the largest of them."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        n = np.zeros((len(self.langs), BUCKETS))
        n[counts["lang"].map({x: i for i, x in enumerate(self.langs)}), counts["bucket"]] = counts["n"]
        p = (n + SMOOTHING) / (n.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        self.ratio = (p / p.max(0, keepdims=True)).astype(np.float32) if self.langs else p

    @staticmethod
    def maximise(ratio: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of the languages whose rows are given."""
        share, total = np.full(len(ratio), 1 / len(ratio), np.float32), counts.sum()
        if len(ratio) > 1:
            for _ in range(rounds):
                share = share * (ratio @ (counts / (share @ ratio))) / total
        return share, float(counts @ np.log(share @ ratio))

    def infer(self, text: str) -> list[tuple[str, float]]:
        """Languages of the text with their proportions, largest first; nothing for a text without a letter."""
        if not self.langs or not text or not _LETTER.search(text):
            return []
        counts = np.bincount(buckets(text), minlength=BUCKETS)
        at = counts.nonzero()[0]
        counts, ratio = counts[at].astype(np.float32), self.ratio[:, at]
        share, _ = self.maximise(ratio, counts)
        order = np.argsort(-share, kind="stable")
        penalty = 0.5 * np.log(max(2.0, float(counts.sum())))
        best, kept = -np.inf, None
        for k in range(1, len(order) + 1):
            own, fit = self.maximise(ratio[order[:k]], counts)
            value = fit / OVERLAP - penalty * (k - 1)
            if value <= best:
                break
            best, kept = value, own
        named = [(self.langs[i], float(s)) for i, s in zip(order, kept, strict=False)]
        return sorted(named, key=lambda x: (-x[1], x[0]))


def fit(documents: DataFrame) -> Mixture:
    """Learn from text and non-null lang of the documents that are not held out."""
    rows = documents.filter(F.col("lang").isNotNull() & ~held_out()).select("lang", body("text").alias("text"))
    counts = rows.mapInPandas(count_by_language, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Mixture(counts.toPandas())


def predict(documents: DataFrame, model: Mixture) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(batches):
        for pdf in batches:
            found = [shared.value.infer(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "held_out": pdf["held_out"],
                    "lang_pred": [x[0][0] if x else UNDETERMINED for x in found],
                    "score": [min(1.0, x[0][1]) if x else 0.0 for x in found],
                    "languages": [[name for name, _ in x] for x in found],
                    "proportions": [[part for _, part in x] for x in found],
                }
            )

    rows = documents.select("doc_id", held_out().alias("held_out"), body("text").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")


def identify(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages, proportions.

    Null texts and texts without a letter are `und` with score 0 and no languages; so is every text when no labelled row is
    left to learn from. Equal proportions go by name. Repeated rows are predicted one by one, an empty table gives no rows,
    other columns are ignored.
    """
    return predict(documents, fit(documents))
