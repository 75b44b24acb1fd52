"""The pipeline, each stage on its own input against a plain version."""

import re

import corpus_pipeline
from scholia.llm import decontam, exact_dedup, ngram_join, pieces, quality
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    """Whether 11 tokens equal at one mask's places lie in a stretch of 13 that agrees in three quarters."""
    tok = lambda s: [w for w in re.split(r"[\W_]+", (s or "").lower()) if w]
    w = tok(text)
    for item in items:
        b = tok(item)
        stretch = min(decontam.STRETCH, len(b))
        for d in range(-len(b), len(w)):  # diagonals
            same = [0 <= d + j < len(w) and w[d + j] == b[j] for j in range(len(b))]
            if sum(same) < 7:
                continue
            for j in range(len(b) - decontam.SPAN + 1):
                if 0 <= d + j <= len(w) - decontam.SPAN and any(all(same[j + k] for k, c in enumerate(m) if c == "1") for m in decontam.MASKS):
                    lo, hi = j - decontam.STRETCH, j + decontam.SPAN + decontam.STRETCH
                    around = [0 <= k < len(b) and same[k] for k in range(lo, hi)]
                    if max(sum(around[s : s + stretch]) for s in range(len(around) - stretch + 1)) / stretch >= decontam.AGREE:
                        return True
    return False


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    done = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        done.append({r["doc_id"] for r in docs.collect()})
    scores = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert done[0] == {r["doc_id"] for r in scores.filter("predicted = 1").collect()} and len(done[0]) > 0.6 * len(rows)
    first = {}
    for i in sorted(done[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    assert done[1] == set(first.values())
    order = sorted(done[1])
    assert done[2] == {order[k] for k, (_, c) in enumerate(brute([rows[i] for i in order])) if c == k}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert done[3] == {i for i in done[2] if not contaminated(rows[i], items)}
    assert done[4] == done[3] and docs.filter("not round_trip").count() == 0
    v = pieces.Vocabulary.load(pieces.MODEL)
    assert all(v.decode(r["ids"]) == rows[r["doc_id"]] and len(r["ids"]) == r["n_ids"] for r in docs.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_rows_without_own_ids(spark):
    clean, other, near = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    close = near.replace("c59", "x")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    rows = [(1, clean), (2, clean), (2, other), (None, clean), (7, near), (7, near), (None, "n"), (None, "n")]
    assert left(exact_dedup.keep_first_copies(table(rows))) == sorted([(1, clean), (2, other), (7, near), (None, "n")], key=str)
    rows = [(1, near), (2, close), (2, other), (None, close), (5, clean), (5, clean), (6, ""), (6, "")]
    assert left(ngram_join.keep_one_of_each(table(rows))) == sorted([(1, near), (2, other), (5, clean), (6, ""), (6, "")], key=str)
    bench = spark.createDataFrame([(1, near)], "item_id long, text string")
    rows = [(1, near), (1, clean), (None, near), (None, other)]
    assert left(decontam.drop_contaminated(table(rows), bench)) == sorted([(1, clean), (None, other)], key=str)


CLASHING = ("_few", "_few_", "_few_kept", "_bad", "__sha", "_sha", "_SHA", "_th", "__row", "_own_row", "_own_row_bad", "kept", "_n", "node", "component", "n_shingles", "_row", "_h", "_key", "_features", "score", "predicted")


def test_columns_of_any_name_stay(spark):
    clean, near = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, clean), (2, clean), (3, near), (4, near.replace("b59", "x")), (None, None), (6, ""), (7, clean)]
    table = spark.createDataFrame([(i, t, *(f"{c}:{i}" for c in CLASHING)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    spark.conf.set("spark.sql.caseSensitive", "true")  # names that differ in case only
    try:
        bench = spark.createDataFrame([(1, near)], "item_id long, text string")
        labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
        stages = {
            "exact": exact_dedup.keep_first_copies,
            "near": ngram_join.keep_one_of_each,
            "clean": lambda d: decontam.drop_contaminated(d, bench),
            "good": lambda d: quality.keep_good(d, labels),
        }
        left = {}
        for name, stage in stages.items():
            for df in (table, table.limit(0)):
                out = stage(df)
                assert out.columns == table.columns
                found = out.collect()
                assert all(r[c] == f"{c}:{r['doc_id']}" for r in found for c in CLASHING)
                if df is table:
                    left[name] = sorted((r["doc_id"] for r in found), key=str)
                else:
                    assert not found
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert left["exact"] == [1, 3, 4, 6] and left["near"] == [1, 3, 6, None] and left["clean"] == [1, 2, 6, 7, None]
