import hashlib
import zlib
from itertools import combinations, product

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

from scholia.llm import decontam, exact_dedup, hilbert

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _keep string, _i int"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang"), more.get("source", "s"), None, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_curve_steps_by_one(spark):
    cube = spark.createDataFrame([*product(range(16), repeat=3)], "_x0 int, _x1 int, _x2 int")
    rows = sorted(hilbert.with_hilbert_index(cube).collect(), key=lambda r: r["_curve"])
    assert [r["_curve"] for r in rows] == list(range(4096))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[c] - b[c]) for c in hilbert.DIMS) == 1


def test_shards(spark):
    texts = [None, "", "a", "a", "é" * 50, "long " * 2000] + [f"text {i}" * (i % 50) for i in range(500)]
    rows = hilbert.hilbert_shards(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert hilbert.hilbert_shards(docs(spark, texts).limit(0)).count() == 0
    few = hilbert.hilbert_shards(docs(spark, ["a", "b", "b"]).union(docs(spark, ["a"]))).collect()
    assert len({(r["shard"], r["slot"]) for r in few}) == 4


def test_exact(spark):
    texts = ["a b", "a  b", "a\t\nb", None, "", " ", "a b ", "c", "x" * 100_000, "x" * 100_000]
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["keep_id"] for i in range(10)] == [0, 0, 0, 3, 3, 5, 6, 7, 8, 8]
    assert [got[i]["kept"] for i in range(10)] == [1, 0, 0, 1, 0, 1, 1, 1, 1, 0]
    assert got[1]["text_sha256"] == hashlib.sha256(b"a b").hexdigest() and got[1]["group_size"] == 3
    assert exact_dedup.exact_duplicates(docs(spark, texts).limit(0)).count() == 0
    twice = docs(spark, texts).union(docs(spark, texts))
    assert exact_dedup.exact_duplicates(twice).filter("kept").count() == 12
    left = exact_dedup.keep_first_copies(docs(spark, texts))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 3, 5, 6, 7, 8] and left.columns[-1] == "_i"


def test_spaced_seeds(spark):
    item = [f"w{i}" for i in range(40)]
    changed = [*item]
    changed[5] = changed[17] = changed[29] = "other"
    clean = [f"c{i}" for i in range(300)]
    texts = [" ".join(clean + item + clean), " ".join(clean[:90] + changed), " ".join(clean + item[:6] + clean), None, "", "w1 w2", ("q " * 60_000) + " ".join(item).upper()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "w1 w2"), (4, " ".join(item))], "item_id long, text string")
    got = decontam.overlaps(docs(spark, texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, i) for d in (0, 1, 6) for i in (1, 4)}
    assert got.filter("doc_id = 0 and item_id = 1").first().asDict() == {"doc_id": 0, "item_id": 1, "n_hits": 30, "overlap": 1.0, "first_token": 300, "last_token": 339}
    assert decontam.overlaps(docs(spark, texts).limit(0), bench).count() == 0
    assert decontam.overlaps(docs(spark, texts), bench.limit(0)).count() == 0
    left = decontam.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5]


def test_seeds_cover_all_differences(spark):
    items, texts = {}, {}
    for n, most in ((13, 3), (12, 3), (11, 2)):
        items[n] = [f"v{n}x{k}" for k in range(n)]
        for at in (c for d in range(most + 2) for c in combinations(range(n), d)):
            texts[(n, at)] = "a b " + " ".join("other" if k in at else w for k, w in enumerate(items[n])) + " c"
    items[40] = [f"u{k}" for k in range(40)]
    texts[(40, ())] = " ".join("other" if k % 4 == 0 else w for k, w in enumerate(items[40]))
    for lengths in ((11, 12, 13, 40), (13, 40)):  # with and without masks for short items
        bench = spark.createDataFrame([(n, " ".join(items[n])) for n in lengths], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs(spark, texts.values()), bench).collect()}
        want = {(i, n) for i, (n, at) in enumerate(texts) if n in lengths and len(at) <= {11: 2}.get(n, 3)}
        assert got == want


def test_shuffle_join_agrees(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = docs(spark, ["x y z " + item, "none"])
    want = decontam.overlaps(d, bench).collect()
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert decontam.overlaps(d, bench).collect() == want and len(want) == 1


def test_documents_full_of_hits(spark, monkeypatch):
    """Memory may grow neither with the hits of a document nor with copies of an item."""
    item, times = [f"w{i}" for i in range(40)], 600
    texts = [" ".join(item * times), "q " * 3_000, "none of it"]
    bench = [(k, " ".join(item)) for k in range(20)] + [(20, "q " * 15)]
    doc, one = np.pad(np.tile(np.arange(40), times), (13, 24), constant_values=-1), np.pad(np.arange(40), (13, 24), constant_values=-2)
    seen = np.array([[c == "1" for c in mask] for mask in decontam.MASKS])
    hits, at = 0, []
    for j in range(30):
        same = sliding_window_view(doc, 37)[: 40 * times - 10] == one[j : j + 37]
        near = (same[:, None, 13:24] | ~seen).all(2).any(1) & (sliding_window_view(same, 13, 1).sum(2).max(1) >= 0.75 * 13)
        hits, at = hits + near.sum(), [*at, *near.nonzero()[0]]
    want = {(0, k, hits, 1.0, min(at), max(at) + 10) for k in range(20)} | {(1, 20, 2_990 * 5, 1.0, 0, 2_999)}
    for limit in (decontam.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
        got = decontam.overlaps(docs(spark, texts), spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert {tuple(r) for r in got} == want and len(got) == 21


def test_held_out(spark):
    from scholia.llm.common import held_out

    got = spark.range(200).withColumn("h", held_out("id")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_rows_and_short_items(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, "five short words in here"), (None, item), (2, "too few words")], "item_id long, text string")
    texts = [item, "so five SHORT words in here, then", "five short words are here", "too few words"]
    d = docs(spark, texts).union(docs(spark, texts[:1]))
    got = [(r["doc_id"], r["item_id"], r["first_token"], r["last_token"], r["overlap"]) for r in decontam.overlaps(d, bench).collect()]
    assert sorted(got, key=str) == sorted([(0, 1, 0, 19, 1.0)] * 2 + [(0, None, 0, 19, 1.0)] * 2 + [(1, 1, 1, 5, 1.0)], key=str)
