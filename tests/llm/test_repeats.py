import hashlib
import random
from collections import Counter

import numpy as np

from scholia.llm import bwt_dedup as B


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + B.LENGTH] for r in raw for p in range(len(r) - B.LENGTH + 1))
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - B.LENGTH + 1):
            if seen[r[p : p + B.LENGTH]] > 1:
                gone[p : p + B.LENGTH] = b"\1" * B.LENGTH
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        yield len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()


def check(spark, texts, parts=3):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _tid string").repartition(parts)
    got = {r["doc_id"]: tuple(r)[1:] for r in B.remove_repeats(docs).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want


def prose(rng, n):
    return "".join(rng.choices("abcdefg é", k=n))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 1000)
    rng = random.Random(1)
    common, base = prose(rng, 450), prose(rng, 3000)
    texts = [None, "", "short", prose(rng, 395), prose(rng, 5000)]
    for n in (300, 398, 399, 400, 401, 420, 440, 441, 600, 1500):
        piece = prose(rng, n)
        texts += [prose(rng, rng.randint(0, 500)) + piece + prose(rng, 300), piece + prose(rng, 90), prose(rng, 70) + piece]
    texts += [prose(rng, rng.randint(0, 300)) + common + prose(rng, rng.randint(0, 300)) for _ in range(25)]
    for _ in range(20):  # near copies
        t = list(base)
        for k in rng.sample(range(3000), 5):
            t[k] = "#"
        texts.append("".join(t))
    texts += [base, base, "a" * 399, "a" * 400, "a" * 401, "xy" * 700, "abc" * 500 + prose(rng, 500), prose(rng, 500) * 2, "x" * 900]
    check(spark, texts)


def test_lone_self_repeat_and_empty(spark):
    rng = random.Random(2)
    check(spark, ["z" * 500, prose(rng, 700)])
    check(spark, [None])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.remove_repeats(docs).count() == 0
    twice = spark.createDataFrame([(1, "q" * 20 + prose(rng, 600))] * 2, "doc_id long, text string")
    assert [r["n_removed"] == r["n_bytes"] for r in B.remove_repeats(twice, with_text=True).collect()] == [True, True]


def test_copies_count_once(spark, monkeypatch):
    tables, cut = {}, B.cut
    monkeypatch.setattr(B, "cut", lambda df, name: tables.setdefault(name, cut(df, name)))
    rng = random.Random(4)
    hot = prose(rng, 2000)
    check(spark, [hot] * 50 + [prose(rng, 300) + hot[500:1500] + prose(rng, 300), prose(rng, 900)])
    rows = tables["transforms"]
    assert 0 < rows.count() == rows.select("_tid", "_q").distinct().count()
    assert tables["spans"].filter("_whole").count() == 1 == tables["spans"].filter("_whole and _windows is null").count()


def test_refine():
    rng = np.random.default_rng(3)
    runs = [x[np.lexsort(x.T[::-1])] for x in (rng.integers(0, 3, (rng.integers(0, 40), 4)) for _ in range(5))]
    rows = np.vstack(runs)
    order, lcp = B.refine(rows)
    got = rows[order]
    assert [*map(tuple, got)] == sorted(map(tuple, rows))
    for i in range(1, len(got)):
        same = 0
        while same < 4 and got[i][same] == got[i - 1][same]:
            same += 1
        assert lcp[i] == same
    assert B.refine(rows[:0])[0].size == 0


def test_frequent_keys_are_not_gathered(spark, monkeypatch):
    """Copies, seeds, cores, windows and contexts that many texts share: exact, and no join shuffles the rows of one."""
    monkeypatch.setattr(B, "HOT_ROWS", 20, raising=False)
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    shuffled, sent, frame = [], set(), type(spark.range(1))
    join = frame.join

    def watched(left, right, on=None, how=None):
        keys = [on] if isinstance(on, str) else on
        if "strategy=broadcast" in right._jdf.queryExecution().analyzed().toString().split("\n")[0]:
            sent.add(tuple(keys))
        elif "_q" not in left.columns or keys != ["_tid"]:  # rows within one text meet in any case
            shuffled.append((left, keys))
        return join(left, right, on, how)

    monkeypatch.setattr(frame, "join", watched)
    rng = random.Random(5)
    hot, exact, copied = prose(rng, 900), prose(rng, 400), prose(rng, 700)
    near = lambda: prose(rng, rng.randint(90, 200))
    texts = [near() + hot + near() for _ in range(60)] + [near() + exact + near() for _ in range(60)]
    check(spark, texts + [copied] * 60 + [prose(rng, 500), hot[100:600], "ab" * 400, copied[:500] + near()])
    for left, keys in shuffled:
        assert (left.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0) <= 20, keys
    assert sent == {("_tid",), ("_seed",), ("_core",), ("_window",), ("_core", "_kind")}
