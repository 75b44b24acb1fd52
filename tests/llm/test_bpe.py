import hashlib
import random

from tokenizers import Tokenizer

from scholia.llm import bpe

SCHEMA = "doc_id long, text string, ids string, n_tokens int"


def texts():
    r = random.Random(7)
    letters = "aaaabcdefthe nding'sstTΣσς 12.!?\n\tééİ  日本語한<|՘\u1c89"
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(400)]
    fixed = [None, "", " ", "a" * 3000, "the" * 2000, "<|endoftext|>a<|startoftext|><|endoftext|>", "x<|endoftext|", "IT'S they'Re", "é İ Σ", "\x00\x1c\u0085"]
    return fixed + made + [" ".join(made) * 3, "".join(r.choice("abcdefghij") for _ in range(4000))] + made[:20]


def test_against_the_public_library(spark):
    rows = list(enumerate(texts()))
    public = Tokenizer.from_file(bpe.MODEL)
    public.no_truncation()
    public.no_padding()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in bpe.digests(bpe.decode_documents(bpe.encode_documents(table))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = public.encode(t or "", add_special_tokens=False).ids
        decoded = public.decode(ids, skip_special_tokens=False)
        want = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)))
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, t


def test_every_code_point_of_two_planes():
    ours, public = bpe.Merges.load(bpe.MODEL), Tokenizer.from_file(bpe.MODEL)
    marks = [f"a{chr(c)}b 1{chr(c)}2" for c in range(0, 0x20000, 5) if not 0xD800 <= c < 0xE000]
    for t, e in zip(marks, public.encode_batch(marks, add_special_tokens=False), strict=True):
        assert ours.encode(t) == e.ids, t


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(bpe.decode_documents(bpe.encode_documents(empty))).count() == 0
    null = spark.createDataFrame([(1, None, 0)], "doc_id long, ids array<int>, n_tokens long")
    assert bpe.decode_documents(null).first()["text"] == ""
