import random
import re
from collections import Counter

import numpy as np
import pytest

from scholia.llm import collocations

SCHEMA = "doc_id long, lang string, text string, suffix string, c int"
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least=10, top=2000):
    out = []
    for lang in {x or "und" if x is None else x for x, _ in rows}:
        f, n = Counter(), 0
        for text in (t or "" for x, t in rows if ("und" if x is None else x) == lang):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for size in (1, 2, 3):
                    f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and c >= least and p in (q[:2], q[1:]) and 100 * c >= 50 * a for q, c in f.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def documents(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "\x01x", "\x1f", "under_score", "new york", "it's", *"bcdefg"]
    rows = [(r.choice(["en", "de", None, "x\ty z", "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ".", "\n", ", "]) for _ in range(r.randint(0, 60)))) for _ in range(150)]
    return [*rows, *rows[:30], ("en", None), ("en", ""), (None, " .;"), ("en", "hot word " * 3000), ("en", "hot word again. " * 500)]


@pytest.mark.parametrize(("seed", "ranges"), [(1, 4), (2, 60)])
def test_against_brute_force(spark, seed, ranges):
    rows = documents(seed)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(i, x, t, "x", 1) for i, (x, t) in enumerate(rows)], SCHEMA).repartition(5)
        assert sorted(map(tuple, collocations.collocations(table).collect())) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_of_words(monkeypatch):
    """Suffixes across the chunks of a long text."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [b"a b c d. " * 50]})
    totals = []
    for words in (7, 1 << 20):
        monkeypatch.setattr(collocations, "WORDS", words)
        c = Counter()
        for b in collocations.combined_suffixes([batch]):
            for s, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                c[s] += n
        totals.append(c)
    assert totals[0] == totals[1] == {b"en\ta b c ": 50, b"en\tb c d ": 50, b"en\tc d ": 50, b"en\td ": 50}


def test_three_way():
    r = np.random.default_rng(3)
    keys = [r.zipf(1.5, 5000).clip(max=40).astype(np.int32) for _ in range(3)]
    weight = r.integers(1, 4, 5000)
    alive = np.ones(5000, bool)
    for depth, (first, total) in enumerate(collocations.three_way(keys, weight, 12), 1):
        groups = Counter()
        for *k, w in zip(*keys[:depth], weight, strict=True):
            groups[tuple(map(int, k))] += int(w)
        assert alive.all()
        assert {tuple(int(k[i]) for k in keys[:depth]): int(t) for i, t in zip(first, total, strict=True)} == {k: v for k, v in groups.items() if v >= 12}
