"""Byte-pair encoding and decoding with a given vocabulary, in batched merge rounds.

The symbols of all new words of a batch lie in one flat array. A round looks up every adjacent pair by binary search over the
sorted pair keys, takes the lowest rank of each word and merges that pair everywhere in the word, left to right; words without
a known pair leave. Merging a pair everywhere at once equals merging it one by one if no pair with a merged symbol has a lower
rank than the one that made the symbol; the vocabulary is checked for that when it is loaded. After a round only the pairs
beside merged symbols are looked up again, so a very long word costs lookups in proportion to its merges.

Text is prepared as the vocabulary file asks: NFC, white space to one space, lower case, then the pieces that the file's
pattern finds. The names of special tokens inside a text are these tokens. Vocabularies are never trained here; the file is
a parameter.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from scholia.llm.common import body

MODEL = public_tokenizers.path("word_bpe_49k.json")
#: Words that a task remembers; beyond it forgets all.
REMEMBER = 200_000
#: Longer words aren't remembered.
LONGEST_KEPT = 200
#: Texts handled at a time.
ROWS = 200
NO_PAIR = np.iinfo(np.int32).max
#: White space as the vocabulary's own pattern language has it.
WHITE = r"[\x09-\x0D\x20\x85\xA0  -     　]"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def newer_characters() -> tuple[str, dict[int, str]]:
    """Where the Unicode versions of Python's libraries and of the public encoder differ.

    As ranges of a character class: letters and numbers that the encoder doesn't know as such yet. As a table: lower case of
    letters that only the encoder knows.
    """
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))) if unicodedata.category(c) == "Cn"]
    split = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]+"), "removed", invert=True)
    theirs = {c for word, _ in split.pre_tokenize_str("".join(new)) for c in word}
    runs: list[list[int]] = []
    for c in map(ord, new):
        if chr(c) in theirs:
            continue
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    lower = {ord(c): low for c in new if (low := normalizers.Lowercase().normalize_str(c)) != c}
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs), lower


class Merges:
    """A vocabulary: symbols of bytes, sorted pair keys with their ranks and results, the texts of ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*vocab.values(), *self.specials.values())
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]), strict=True))
        born = np.full(self.size, -1)  # the rank that makes a symbol
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("a pair must rank after the pairs that make its parts")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        names = {i: t for t, i in chain(vocab.items(), self.specials.items())}
        self.names = [names.get(i, "") for i in range(self.size)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        white, (newer, self.lower) = WHITE[1:-1], newer_characters()
        self.plain = regex.compile(split.replace(r"\s", white))
        careful = split.replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{newer}]]")
        self.careful = regex.compile(careful.replace(r"[^\s\p{L}\p{N}]", rf"[[^{white}\p{{L}}\p{{N}}]||[{newer}]]"), regex.V1)
        self.white = regex.compile(WHITE + "+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_PAIR if none) and result of each pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in order, and how many each word has. No word is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol, owner = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[raw[ends]]
        rank, result = np.full(len(symbol), NO_PAIR, np.int32), np.zeros(len(symbol), np.int64)
        look = np.flatnonzero(owner[:-1] == owner[1:])
        done = []
        while len(symbol):
            rank[look], result[look] = self.look_up(symbol[look], symbol[look + 1])
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(symbol)))
            best_here = np.repeat(best, length)
            over = best_here == NO_PAIR
            if over.any():
                done.append((owner[over], symbol[over]))
                symbol, owner, rank, result, best_here = (x[~over] for x in (symbol, owner, rank, result, best_here))
            hit = np.flatnonzero(rank == best_here)
            # a run of overlapping hits is one symbol repeated: every second one merges, from the left
            fresh = np.concatenate(([True], np.diff(hit) != 1)) if len(hit) else np.zeros(0, bool)
            runs = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - runs) % 2 == 0]
            symbol[hit] = result[hit]
            stays = np.ones(len(symbol), bool)
            stays[hit + 1] = False
            touched = np.zeros(len(symbol), bool)
            touched[hit] = True
            touched[hit[hit > 0] - 1] = True
            before = hit[hit > 1] - 2  # the neighbour on the left if the symbol between went into it
            touched[before[~stays[before + 1]]] = True
            symbol, owner, rank, result, touched = (x[stays] for x in (symbol, owner, rank, result, touched))
            rank[touched] = NO_PAIR
            look = np.flatnonzero(touched[:-1] & (owner[:-1] == owner[1:]))
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        try:
            text.encode("latin-1")
            return self.plain.findall(text.lower())
        except UnicodeEncodeError:  # a final sigma has no form of its own here
            return self.careful.findall(text.replace("Σ", "σ").translate(self.lower).lower())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of int32."""
        parts = [[x if i % 2 else self.words(x) for i, x in enumerate(self.special.split(t))] for t in texts]
        known = self.known
        new = list({w for p in parts for x in p[::2] for w in x if w not in known})
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = list({w for p in parts for x in p[::2] for w in x})
        if new:
            symbols, sizes = self.merge([w.encode() for w in new])
            raw, ends = symbols.tobytes(), (np.cumsum(sizes) * 4).tolist()
            known.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        out = []
        for p in parts:
            pieces = (np.int32(self.specials[x]).tobytes() if i % 2 else b"".join(map(known.__getitem__, x)) for i, x in enumerate(p))
            out.append(b"".join(pieces))
        if len(known) > REMEMBER:
            known.clear()
        for w in new:
            if len(w) > LONGEST_KEPT:
                known.pop(w, None)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The symbols' names joined by spaces, which is what a vocabulary without a decoder gives; unknown ids are skipped."""
        names, size = self.names, self.size
        return " ".join([names[i] for i in ids if 0 <= i < size and names[i]])


def encode_documents(documents: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_tokens.

    Null texts count as empty and have no ids. Repeated rows are encoded one by one, an empty table gives no rows, other
    columns are ignored. A task holds ROWS texts and their ids at a time.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    vocabulary = documents.sparkSession.sparkContext.broadcast(Merges.load(model))

    def run(batches):
        v = vocabulary.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            raw = v.encode_all(batch.column(1).to_pylist())
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(sizes)], names=["doc_id", "ids", "n_tokens"])
        v.known.clear()  # workers live on

    rows = documents.select(F.col(id_col).alias("doc_id"), body(text_col).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (doc_id, ids, n_tokens) with a column text, decoded from ids; null ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Merges.load(model))

    def run(batches):
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids = batch.column(1)
            texts = [vocabulary.value.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "n_tokens", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
