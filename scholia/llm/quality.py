"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

A document becomes a short vector of statistics of its whole text. Cosines of random projections of the standardised vector
approximate a Gaussian kernel; ridge scores come from normal equations that every partition sums over its labelled rows and
Spark adds up cell by cell. A monotone map, fitted by pooling adjacent violators over `BINS` score bins, turns raw scores
into probabilities. What reaches the driver is bounded: means of the statistics, a (FEATURES + 2)^2 / 2 matrix, BINS counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import body, cut, held_out

FEATURES = 128
WIDTH = 2.0
RIDGE = 1e-3
BINS = 512
PARTS = 32
SEED = 7
THRESHOLD = 0.3
#: Score of every row when there is nothing to learn from (no labelled row outside the held-out ones).
UNKNOWN = 0.5

STATS = 17
_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".?!", b",;:'\"()-")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[128:] = 8


def statistics(text: str) -> list[float]:
    """Statistics of one whole text, zeros for an empty one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * STATS
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    kinds = len(set(words))
    odd = sum(not w.isalnum() for w in words) / n
    return [
        *share.tolist(),
        float(np.log1p(len(raw))),
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        len(raw) / n,
        kinds / n,
        float(np.log1p(kinds)),
        len(set(lines)) / len(lines),
        odd,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(text: pd.Series) -> pd.Series:
    return text.map(statistics)


class Model:
    """Plain numbers that score a batch of statistics."""

    def __init__(self, mean, std, seed=SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.asarray(mean), np.maximum(np.asarray(std), 1e-9)
        self.w = rng.normal(size=(STATS, FEATURES)) / (WIDTH * np.sqrt(STATS))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = self.at = self.value = None

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.value is None:
            return np.full(len(stats), UNKNOWN)
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def pool_adjacent_violators(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value under weight."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: doc_id, stats. labels: doc_id, quality; several labels of one document count as their mean."""
    marks = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = stats.select("doc_id", "stats").join(marks, "doc_id").select("stats", "y").repartition(PARTS)
    rows = cut(rows, "labelled")
    each = [F.get("stats", i) for i in range(STATS)]
    first = rows.select(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each)]).first()
    model = Model([first[f"m{i}"] or 0.0 for i in range(STATS)], [first[f"s{i}"] or 0.0 for i in range(STATS)])
    if first["m0"] is None:
        return model

    def sums(batches):
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for pdf in batches:
            z = np.hstack([model.lift(np.vstack(pdf["stats"])), pdf[["y"]].to_numpy()])
            total += z.T @ z
        i, j = np.triu_indices(FEATURES + 2)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = rows.mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram = np.zeros((FEATURES + 2, FEATURES + 2))
    gram[cells["i"], cells["j"]] = gram[cells["j"], cells["i"]] = cells["v"]
    n, d = gram[-2, -2], FEATURES + 1
    model.beta = np.linalg.solve(gram[:d, :d] + RIDGE * n / d * np.eye(d), gram[:d, -1])

    def binned(batches):
        for pdf in batches:
            raw = model.raw(np.vstack(pdf["stats"]))
            yield pd.DataFrame({"bin": np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(int), "raw": raw, "y": pdf["y"]})

    bins = (
        rows.mapInPandas(binned, "bin int, raw double, y double")
        .groupBy("bin")
        .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
        .toPandas()
        .sort_values("bin")
    )
    model.at, model.value = bins["raw"].to_numpy(), pool_adjacent_violators(bins["y"].to_numpy(), bins["n"].to_numpy(float))
    return model


def document_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return documents.select(F.col(id_col).alias("doc_id"), statistics_udf(body(text_col)).alias("stats"))


def score_column(model: Model):
    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(stats)) if len(stats) else [], dtype=float)

    return score


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty; an empty text has the score of all-zero statistics. Rows of one id are scored one by one.
    Labels without a document, null labels and labels of held-out ids teach nothing; with no label left, every score is
    UNKNOWN. An empty table gives no rows; other columns are ignored.
    """
    stats = cut(document_statistics(documents), "statistics")
    model = fit(stats, labels)
    scored = stats.select("doc_id", held_out().alias("held_out"), score_column(model)("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those predicted bad; the score is a function of the text, so rows stay where they are."""
    model = fit(document_statistics(documents), labels)
    return documents.filter(score_column(model)(statistics_udf(body("text"))) >= THRESHOLD)


