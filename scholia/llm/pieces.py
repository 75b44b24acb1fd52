"""SentencePiece ids by streaming Viterbi over a given vocabulary, and back.

The best segmentation of a text is the path of pieces with the largest sum of scores. The search walks the text once, with an
automaton that names all pieces ending at a boundary. A piece spans `longest` characters at most, so only paths through the
last `longest` boundaries survive. Scores and back pointers lie in a window of four times that; whenever it is full, the ids up
to the boundary where the back pointers of all surviving paths meet are committed and the window moves there (it grows only
while they don't meet). Memory is bounded by the window and the distance to the last commit, not by the text.

Where the vocabulary has no piece with a space after another character and none with a line feed (checked), every beginning
of a run of spaces is a boundary of all paths, so stretches between them are searched alone, all by the same search; the ids of
stretches are remembered in a table of bounded size, since words repeat.

Characters without a piece become byte pieces; a literal U+2581, which the vocabulary uses for the space, does too, so that
decoding gives back every text. The model's file is read on the driver (its path is a parameter) and sent to the tasks.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import body

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character costs below the worst piece, as in the public library.
UNKNOWN_PENALTY = 10.0
#: Stretches whose ids a worker remembers, and the longest of them; neither changes a result.
REMEMBER, LONGEST_KEPT = 400_000, 48
#: Rows whose ids a task holds at once.
ROWS = 500
_STRETCH = re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], table: list[bytes]):
        self.pieces, self.byte_ids, self.table = pieces, byte_ids, table
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.apart = not any(" " in p.lstrip(" ") or "\n" in p for p in pieces)
        self.singles = frozenset(p for p in pieces if len(p) == 1)
        self.known: dict[str, bytes] = {}
        self.__setstate__({})

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("ends", "known")} | {"known": {}}

    def __setstate__(self, state: dict) -> None:
        """The automaton of the pieces is built where it is used."""
        vars(self).update(state)
        self.ends = ahocorasick.Automaton()
        for p, (i, score) in self.pieces.items():
            self.ends.add_word(p, (len(p), i, score))
        self.ends.make_automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        pieces, byte_ids, table = {}, [0] * 256, []
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                table.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                table.append(b"")
            else:
                p = p.replace(SPACE, " ")
                pieces[p] = (i, sp.get_score(i))
                table.append(p.encode())
        return cls(pieces, byte_ids, table)

    def search(self, text: str) -> list[int]:
        """Ids of the best path through text; of equal paths, the one whose last piece starts first."""
        n, longest, base, ids = len(text), self.longest, 0, []
        room = min(n, 4 * longest)
        # by boundary after base: score of the best path there, length and id (-1: unknown) of its last piece
        best, back = [0.0] + [-np.inf] * room, [(0, 0)] * (room + 1)
        unknown = [] if self.singles.issuperset(text) else [j for j in range(n, 0, -1) if text[j - 1] not in self.singles]

        def pass_unknown(end: int) -> None:
            """Boundaries before end have met all their pieces: a character without a piece may be passed as bytes."""
            while unknown and unknown[-1] < end:
                end_here = unknown.pop()
                if end_here - base > room:
                    slide(end_here)
                j = end_here - base
                if best[j - 1] + self.unknown > best[j]:
                    best[j], back[j] = best[j - 1] + self.unknown, (1, -1)

        def commit(end: int) -> None:
            """Ids of the path from base to end, then forget it."""
            path, j = [], end - base
            while j > 0:
                k, i = back[j]
                path.append((i,) if i >= 0 else [self.byte_ids[x] for x in text[base + j - 1].encode()])
                j -= k
            ids.extend(chain.from_iterable(reversed(path)))

        def slide(end: int) -> None:
            """Make room for end: commit up to where all paths through the window's last boundaries meet."""
            nonlocal base, room, best, back
            open_at = {j for j in range(max(0, end - longest - base), end - base) if best[j] > -np.inf}
            while len(open_at) > 1:
                j = max(open_at)
                open_at.remove(j)
                open_at.add(j - back[j][0])
            (meet,) = open_at
            if meet:
                commit(base + meet)
                best = [x - best[meet] for x in best[meet:]]
                back, base = back[meet:], base + meet
            room = max(room, 2 * (end - base))
            best += [-np.inf] * (room + 1 - len(best))
            back += [(0, 0)] * (room + 1 - len(back))

        for last, (k, i, score) in self.ends.iter(text):
            end = last + 1
            if unknown:
                pass_unknown(end)
            if end - base > room:
                slide(end)
            j = end - base
            value = best[j - k] + score
            if value > best[j]:
                best[j], back[j] = value, (k, i)
        pass_unknown(n + 1)
        commit(n)
        return ids

    def stretch(self, text: str) -> bytes:
        return np.array(self.search(text), np.int32).tobytes()

    def encode_raw(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers; a space goes before it, as the public library puts one."""
        if not text:
            return b""
        text = f" {text}"
        if not self.apart:
            return np.array(self.search(text), np.int32).tobytes()
        known, parts = self.known, _STRETCH.findall(text)
        new = set(parts).difference(known)
        if len(known) + len(new) > REMEMBER:
            known.clear()
            new = set(parts)
        if len(new) > REMEMBER // 2:  # a very long text of many words keeps nothing
            return b"".join(map(self.stretch, parts))
        for p in new:
            known[p] = self.stretch(p)
        out = b"".join(map(known.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST_KEPT:
                del known[p]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ids; ids without a text (control pieces) are skipped, broken bytes become U+FFFD."""
        table = self.table
        raw = b"".join([table[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_documents(documents: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_ids, round_trip (whether decoding gives back the text).

    Null texts count as empty and have no ids. Equal scores go to the path whose last piece starts first. Repeated rows
    are encoded one by one, an empty table gives no rows, other columns are ignored.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    vocabulary = documents.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        v = vocabulary.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            raw = [v.encode_raw(t) for t in texts]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            offsets = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            flat = np.frombuffer(b"".join(raw), np.int32)
            same = [v.decode(np.frombuffer(i, np.int32).tolist()) == t for i, t in zip(raw, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_ids", "round_trip"],
            )
        v.known.clear()  # workers live on

    rows = documents.select(F.col(id_col).alias("doc_id"), body(text_col).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (doc_id, ids) back to doc_id, text; null ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        for batch in batches:
            texts = [vocabulary.value.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
