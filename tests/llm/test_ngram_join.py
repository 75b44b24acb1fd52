import random

import pytest

from scholia.llm import ngram_join as J
from scholia.llm.components import connected_components


def brute(texts):
    """Component of each index, and set sizes."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = [*words]
        for k in rng.sample(range(len(w)), rng.randint(0, edits)):
            w[k] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def made(rng):
    vocabulary = [f"w{i}" for i in range(4000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = [fresh(k) for k in (12, 30, 60)]
    texts = [None, "", " \t ", "one", "one", "a b c d", "A B\nC D", "a b c e", "long " * 30_000]
    for words, n, edits in ((fresh(200), 60, 6), (fresh(120), 25, 4), (fresh(40), 12, 2), (fresh(9), 8, 1)):
        texts += family(rng, words, n, edits)
    for c in common:  # shared passages in texts of their own
        texts += [" ".join(fresh(rng.randint(0, 120)) + c + fresh(rng.randint(0, 120))) for _ in range(30)]
    chain = fresh(100)
    for _ in range(12):  # each links with the next, the ends don't
        texts.append(" ".join(chain))
        chain = chain[5:] + fresh(5)
    texts += [" ".join(c) for c in common] + [" ".join(common[1] + common[2])] * 2 + [" ".join(common[2] + common[0])]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot,rows", [(50, 200_000), (6, 200_000), (3, 20)])
def test_against_brute_force(spark, monkeypatch, hot, rows):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "HOT_ROWS", rows)
    texts = made(random.Random(hot))
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, _set int, _n string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_edges(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(empty).count() == 0
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (7, None), (3, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect())
    assert got == [("3", 1, 3), ("5", 2, 5), ("5", 2, 5), ("7", 0, 7), ("None", 2, 5)]
    kept = J.keep_one_of_each(docs.filter("doc_id is not null"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 7] and kept.columns == ["doc_id", "text"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(500, k) for k in range(501, 700)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
            if x is not y:
                x |= y
                for k in y:
                    root[k] = x
    assert got == {k: min(v) for k, v in root.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
