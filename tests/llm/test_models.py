import random
import string

import numpy as np
import pytest

from scholia.llm import chat, langid, pieces, quality

DOCS = "doc_id long, text string, lang string, source string, _text string, stats int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", 1) for i, t, lang in rows], DOCS)


def words(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, "abcdef" if i % 2 else "uvwxyz", 60), "aa" if i % 2 else "zz") for i in range(300)]
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "12 !!", "zz"), (1003, words(rng, "abcdef", 20_000), None), (1003, "uvw xyz wvu", None)]
    extra += [(1004, words(rng, "abcdef", 300) + " " + words(rng, "uvwxyz", 100), None)]
    got = langid.identify(docs(spark, rows + extra)).collect()
    assert len(got) == 306
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "zz") for r in got if r["doc_id"] < 300)
    late = [(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] >= 1000]
    assert sorted(late) == [(1000, "und"), (1001, "und"), (1002, "und"), (1003, "aa"), (1003, "zz"), (1004, "aa")]
    mixed = next(r for r in got if r["doc_id"] == 1004)
    assert mixed["languages"] == ["aa", "zz"] and abs(mixed["score"] - 0.75) < 0.05
    assert langid.identify(docs(spark, rows).limit(0)).count() == 0
    unlabelled = langid.identify(docs(spark, [(1, "abc", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)]


def test_mixture_against_plain_em():
    rng = np.random.default_rng(0)
    ratio, counts = rng.random((3, 50)).astype(np.float32), rng.integers(1, 9, 50).astype(np.float32)
    share = np.full(3, 1 / 3)
    for _ in range(langid.ROUNDS):
        new = np.zeros(3)
        for b in range(50):
            p = share * ratio[:, b]
            new += counts[b] * p / p.sum()
        share = new / counts.sum()
    got, fit = langid.Mixture.maximise(ratio, counts)
    assert np.allclose(got, share, atol=1e-4)
    assert fit == pytest.approx(sum(counts[b] * np.log(share @ ratio[:, b]) for b in range(50)), rel=1e-4)


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, "abcdef", 80) if i % 3 else " ".join(rng.choices("%&#$!", k=80)), None) for i in range(400)]
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    extra = [(1000, None, None), (1001, "", None), (1002, "abc " * 30_000, None), (3, "abc fed", None)]
    got = quality.quality_scores(docs(spark, rows + extra), marks).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    right = [r["predicted"] == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] < 400 and r["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.95
    blank = quality.quality_scores(docs(spark, extra), marks.limit(0)).collect()
    assert {r["score"] for r in blank} == {quality.UNKNOWN}
    assert quality.quality_scores(docs(spark, rows).limit(0), marks).count() == 0
    left = quality.keep_good(docs(spark, rows), marks)
    assert left.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert 240 <= left.count() <= 280


def test_pooling():
    rng = np.random.default_rng(3)
    y, w = rng.random(40), rng.integers(1, 5, 40).astype(float)
    got = quality.pool_adjacent_violators(y, w)
    assert (np.diff(got) >= -1e-12).all() and got @ w == pytest.approx(y @ w)
    want = [max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(got, want)


def brute(v, text):
    """Best score over all segmentations."""
    best = [0.0] + [-1e18] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - v.longest), j):
            p = text[i:j]
            s = v.pieces[p][1] if p in v.pieces else v.unknown if j - i == 1 else None
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def random_text(rng, n):
    return "".join(rng.choices(string.ascii_letters + "   \n\t.,éß中😀▁0", k=n))


def test_viterbi_is_best_and_reversible():
    v, rng = pieces.Vocabulary.load(pieces.MODEL), random.Random(4)
    score = dict(v.pieces.values())
    for n in [0, 1, 2, 5, 30, 200, 3000]:
        text = random_text(rng, n)
        ids = v.encode(text)
        assert v.decode(ids) == text
        if text:
            assert v.encode(text) == v.search(" " + text) == [*np.frombuffer(v.encode_raw(text), np.int32)]
            total, k = 0.0, 0
            while k < len(ids):
                if ids[k] in score:
                    total, k = total + score[ids[k]], k + 1
                else:  # byte pieces of one character
                    lead = v.table[ids[k]][0]
                    total, k = total + v.unknown, k + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            assert total == pytest.approx(brute(v, " " + text))
    assert v.apart and all(v.decode(v.encode(t)) == t for t in (" ", "  a  ", "x" * 5000, "▁", "\x00"))


def test_crossing_pieces_commit_where_paths_meet():
    made = {"a": -3.0, "b": -3.0, "ab": -4.0, "ba": -4.0, "aba": -5.5, "bab": -5.0, " ": -1.0, "b a": -2.0}
    v = pieces.Vocabulary({p: (i, s) for i, (p, s) in enumerate(made.items())}, list(range(100, 356)), [p.encode() for p in made])
    rng = random.Random(5)
    assert not v.apart
    for n in (1, 10, 500):
        text = "".join(rng.choices("aab b", k=n))
        ids = v.encode(text)
        assert "".join(list(made)[i] for i in ids) == " " + text
        assert sum(list(made.values())[i] for i in ids) == pytest.approx(brute(v, " " + text))


def test_ids_equal_the_public_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    proto = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, searched by Viterbi
    public, v, rng = SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.Vocabulary.load(pieces.MODEL), random.Random(6)
    agree = 0
    for _ in range(100):
        text = random_text(rng, 60).replace("▁", "")
        ours, theirs = v.encode(text), public.encode(text)
        assert public.decode(theirs) == v.decode(ours)
        agree += ours == theirs
    assert agree >= 95  # equal scores may be broken differently


def test_encode_documents(spark):
    rows = [(1, "Hello wörld", None), (2, None, None), (3, "", None), (4, "long text " * 20_000, None), (4, "twice", None)]
    got = pieces.encode_documents(docs(spark, rows))
    assert got.filter("not round_trip").count() == 0 and got.count() == 5
    assert got.filter("doc_id in (2, 3) and n_ids = 0 and size(ids) = 0").count() == 2
    back = {(r["doc_id"], r["text"]) for r in pieces.decode_documents(got).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert pieces.encode_documents(docs(spark, rows).limit(0)).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "cy", "yo"), (1, 3, "cy", "yo"), (1, 70, "ann", "late")]
    rows += [(2, 0, "system", "alone"), (None, None, None, "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["participant"], r["block"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, p, b) for p in ("ann", "bob", "cy") for b in (0, 1)} | {(None, "unknown", None)}
    ann = got[1, "ann", 0]
    assert ann["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n" + "<|im_start|>user name=cy\nyo<|im_end|>\n" * 2
    for r in got.values():
        spans = [tuple(map(int, s.split(":"))) for s in r["mask_spans"].split(",") if s]
        assert sum(b - a for a, b in spans) == r["masked_chars"]
        assert all(r["text"][:a].endswith("assistant\n") and r["text"][b:].startswith("<|im_end|>\n") for a, b in spans)
    assert got[1, "bob", 0]["mask_spans"] and not got[1, "bob", 1]["mask_spans"] and ann["n_turns"] == 5
    assert [r["view_start"] for r in (ann, got[1, "ann", 1])] == [0, len(ann["text"])]
    forged = spark.createDataFrame([(1, 0, "bob\nevil", "x"), (1, 1, "al", "y")], "conv_id long, turn long, role string, text string")
    assert all("bob evil\n" in r["text"] or r["participant"] == "bob\nevil" for r in chat.rotate(forged).collect())
    assert chat.rotate(turns.limit(0)).count() == 0
