"""Conversation structure repair: cheapest edits of a dialogue by Hirschberg's divide and conquer over four states.

A repaired dialogue is empty, or an optional system turn and then user and assistant turns in pairs. Its automaton has four
states: nothing yet, after the system turn, after a user, after an assistant. Edits: Keep 0, Rerole to user or assistant 3,
Delete 4 (blank and repeated turns have to go), Insert an empty user or assistant turn 3; a truncated turn that stays costs 3.

The cost vector of a position has one entry for each state right after the turn before it. Forward and backward vectors meet
in the middle of a segment; the crossing is the state with the least sum, among equals the one whose edits so far come first
in byte order (the forward vector carries that order: edits up to the same turn are never prefixes of each other, so it is
strict). Then both halves are solved alone. Nothing but two vectors is ever kept, in n log n steps.

Conversations of any length: turns are range-partitioned and sorted, so a conversation may lie in many partitions, and cut into
blocks of BLOCK turns. A conversation that lies in one block inside a partition is solved where it is. For the others, each block
gives the vectors of all four entry states, the same divide and conquer over blocks gives every block its crossing states,
and blocks are solved alone again. Only that chain of block vectors (128 bytes for BLOCK turns) is seen by one task.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import cut
from scholia.llm.hilbert import _STEP

#: Turns and bytes of text of a block, at most (a longer text is a block of its own).
BLOCK, BYTES = 4096, 8 << 20
BLANK, DUPLICATE = 8, 9
#: Kinds below 8: the role's first letter (system, user, assistant, other), plus 4 if truncated.
INITIALS = ("s", "u", "a")
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Cost and edits that end a dialogue in each state.
CLOSE = ((0, ""), (6, "II"), (3, "I"), (0, ""))
SPACES = " \t\n\x0b\x0c\r"


def inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def steps(kind: int) -> list[dict[int, tuple[int, str]]]:
    """From each state to each state over a turn of this kind: least cost, and the least edits (inserts, then the turn's own)."""
    found: list[dict[int, tuple[int, str]]] = []
    for state in range(4):
        ways: dict[int, tuple[int, str]] = {}

        def way(to, cost, edits, ways=ways):
            ways[to] = min(ways.get(to, (NEVER, "")), (cost, edits))

        at = state
        for n in range(3):
            way(at, 3 * n + 4, "I" * n + "D")
            if kind < BLANK:
                initial, extra = kind % 4, 3 * n + 3 * (kind // 4)
                if initial == 0 and at == START:
                    way(SYSTEM, extra, "I" * n + "K")
                if initial == 1 and at != USER:
                    way(USER, extra, "I" * n + "K")
                if initial == 2 and at == USER:
                    way(ASSISTANT, extra, "I" * n + "K")
                way(inserted(at), extra + 3, "I" * n + "R")
            at = inserted(at)
        found.append(ways)
    return found


STEPS = [steps(k) for k in range(10)]
#: The same as (from, to, cost, edits).
MOVES = [[(p, q, cost, edits) for p, ways in enumerate(s) for q, (cost, edits) in ways.items()] for s in STEPS]


def ranked(best: list[tuple | None]) -> list[tuple[int, int]]:
    """(cost, rank) for each state out of (cost, rank before, edits); states that can't be reached come last."""
    order = sorted((b[1:], q) for q, b in enumerate(best) if b)
    rank = {q: i for i, (_, q) in enumerate(order)}
    return [(b[0], rank[q]) if b else (NEVER, 4) for q, b in enumerate(best)]


def forward(kinds: bytes, vector: list[tuple[int, int]]) -> list[tuple[int, int]]:
    for kind in kinds:
        best: list[tuple | None] = [None] * 4
        for p, q, cost, edits in MOVES[kind]:
            before, rank = vector[p]
            if before < NEVER:
                way = (before + cost, rank, edits)
                if best[q] is None or way < best[q]:
                    best[q] = way
        vector = ranked(best)
    return vector


def backward(kinds: bytes, costs: list[int]) -> list[int]:
    for kind in reversed(kinds):
        now = [NEVER] * 4
        for p, q, cost, _ in MOVES[kind]:
            now[p] = min(now[p], cost + costs[q])
        costs = now
    return costs


def only(state: int) -> list[tuple[int, int]]:
    return [(0, 0) if q == state else (NEVER, 4) for q in range(4)]


def to(state: int) -> list[int]:
    """Costs from each state to one; -1: to the end of the dialogue."""
    return [cost for cost, _ in CLOSE] if state < 0 else [0 if q == state else NEVER for q in range(4)]


def crossing(vector: list[tuple[int, int]], costs: list[int]) -> int:
    """The state with the least sum, of equals the one whose edits come first."""
    return min((f + costs[q], rank, q) for q, (f, rank) in enumerate(vector))[2]


def edits_between(kinds: bytes, entry: int, leave: int) -> str:
    """Least edits of the cheapest way from the state before a segment to the one after its last turn."""
    if len(kinds) <= 1:
        return STEPS[kinds[0]][entry][leave][1] if kinds else ""
    half = len(kinds) // 2
    left, right = kinds[:half], kinds[half:]
    middle = crossing(forward(left, only(entry)), backward(right, to(leave)))
    return edits_between(left, entry, middle) + edits_between(right, middle, leave)


def audit_of(kinds: bytes) -> str:
    """The edits of a whole dialogue."""
    last = crossing(forward(kinds, only(START)), to(-1)) if kinds else START
    return edits_between(kinds, START, last) + CLOSE[last][1]


remembered = lru_cache(maxsize=50_000)(audit_of)


def compose(vector: list[tuple[int, int]], block: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """forward() over a block whose vectors are known for each entry state."""
    best: list[tuple | None] = [None] * 4
    for p, (before, rank) in enumerate(vector):
        for q, (cost, inner) in enumerate(block[p]):
            if before < NEVER and cost < NEVER:
                way = (before + cost, rank, inner)
                if best[q] is None or way < best[q]:
                    best[q] = way
    return ranked(best)


def crossings(blocks: list, entry: int, leave: int) -> list[int]:
    """The states after each block on the least cheapest way: the same meeting in the middle, over blocks."""
    if len(blocks) == 1:
        return [leave]
    half = len(blocks) // 2
    vector, costs = only(entry), to(leave)
    for b in blocks[:half]:
        vector = compose(vector, b)
    for b in reversed(blocks[half:]):
        costs = [min(b[p][q][0] + costs[q] for q in range(4)) for p in range(4)]
    middle = crossing(vector, costs)
    return crossings(blocks[:half], entry, middle) + crossings(blocks[half:], middle, leave)


def replay(audit: str, entry: int, roles: list[str], texts: list[str], kinds: bytes) -> tuple[list[str], list[str], int]:
    """Repaired roles and texts, and the cost."""
    state, at, cost, out_roles, out_texts = entry, 0, 0, [], []
    for edit in audit:
        if edit == "I":
            state, cost = inserted(state), cost + 3
            out_roles.append(ROLE_OF[state])
            out_texts.append("")
            continue
        kind, role, text = kinds[at], roles[at], texts[at]
        at += 1
        if edit == "D":
            cost += 4
            continue
        if edit == "R":
            state, cost = inserted(state), cost + 3
            role = ROLE_OF[state]
        else:
            state = kind % 4 + 1
        cost += 3 * (kind // 4)
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts, cost


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns damaged by the checksum of `conv_id:turn` modulo 20.

    0: dropped (one row stays, gone, that names the conversation), 1: emptied, 2: without [.!?], 3: twice, 4: said by the user.
    Nulls of role and text, and in the checked name, are one space.
    """
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(name.cast("binary")) % 20).alias("case"))
    case = F.col("case")
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case.isin(0, 1), "").when(case == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (case == 0).alias("gone"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data.astype(np.uint8)))])


def cut_blocks(batches, most: int = BLOCK):
    """A sorted partition of turns to blocks; conversations that may go on elsewhere are open.

    Blocks: conv_id, part, seq (the blocks' own order), open, turns, kinds and initials (a byte each), roles, texts, digests
    (none if closed: there, repeated turns are known already).
    """
    part, seq, first, held, full = TaskContext.get().partitionId(), 0, True, None, False

    def out(rows: pa.RecordBatch, cuts: np.ndarray, is_open: np.ndarray):
        nonlocal seq
        stay = pc.invert(rows.column("gone")).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(stay)))[cuts]
        turns = rows.filter(pa.array(stay))
        kinds = turns.column("kind").to_numpy().astype(np.uint8).copy()
        digests = turns.column("digest")
        values = digests.to_pylist()
        for a, b, away in zip(offsets[:-1].tolist(), offsets[1:].tolist(), is_open.tolist(), strict=True):
            if away or len(set(values[a:b])) == b - a:
                continue
            seen = set()
            for i in range(a, b):
                if values[i] in seen and kinds[i] != BLANK:
                    kinds[i] = DUPLICATE
                seen.add(values[i])
        at = pa.array(offsets.astype(np.int32))
        listed = [pa.ListArray.from_arrays(at, turns.column(c)) for c in ("turn", "role", "text")]
        sizes = np.diff(offsets)
        far = np.concatenate(([0], np.cumsum(sizes * is_open))).astype(np.int32)
        digests = digests.filter(pa.array(np.repeat(is_open, sizes)))
        n = len(cuts) - 1
        columns = [
            rows.column("conv_id").take(pa.array(cuts[:-1])),
            pa.array(np.full(n, part, np.int32)),
            pa.array(np.arange(seq, seq + n, dtype=np.int64)),
            pa.array(is_open),
            listed[0],
            _binaries(offsets, kinds),
            _binaries(offsets, turns.column("initial").to_numpy()),
            *listed[1:],
            pa.ListArray.from_arrays(pa.array(far), digests),
        ]
        seq += n
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "open", "turns", "kinds", "initials", "roles", "texts", "digests"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        n = rows.num_rows
        runs = np.concatenate(([0], pc.run_end_encode(rows.column("conv_id")).run_ends.to_numpy()))
        begin = np.repeat(runs[:-1], np.diff(runs))
        size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy().astype(np.int64))))
        block, weight = (np.arange(n) - begin) // most, (size[:-1] - size[begin]) // BYTES
        change = (begin[1:] != begin[:-1]) | (block[1:] != block[:-1]) | (weight[1:] != weight[:-1])
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1))
        conv = np.searchsorted(runs, cuts, side="right") - 1
        if len(cuts) > 1:
            # closed: the conversation's only block, neither the partition's first conversation nor going on from a block before
            alone = np.bincount(conv)[conv] == 1
            is_open = ~alone
            if first or full:
                is_open[conv == 0] = True
            yield out(rows.slice(0, cuts[-1]), cuts, is_open[:-1])
            full = bool(conv[-1] == conv[-2])
            first = first and bool(conv[-1] == 0)
        held = rows.slice(cuts[-1])
    if held is not None:
        yield out(held, np.array([0, held.num_rows]), np.array([True]))


def with_duplicates(kinds: bytes, later) -> bytes:
    changed = bytearray(kinds)
    for i in later or ():
        if changed[i] != BLANK:
            changed[i] = DUPLICATE
    return bytes(changed)


def block_vectors(batches):
    """(conv_id, part, seq, kinds, later) to the kinds with repeated turns, and (cost, rank) from each to each state."""
    for batch in batches:
        kinds = [with_duplicates(k, x) for k, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        vectors = [[forward(k, only(p)) for p in range(4)] for k in kinds]
        flat = [[x for row in v for pair in row for x in pair] for v in vectors]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kinds, pa.binary()), pa.array(flat, pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "kinds", "vectors"])


def chained(batches):
    """Block vectors sorted by conversation and block to the states before and after each block, and whether it's the last."""
    def solve(chain: list):
        blocks = [[[(v[8 * p + 2 * q], v[8 * p + 2 * q + 1]) for q in range(4)] for p in range(4)] for *_, v in chain]
        vector = only(START)
        for b in blocks:
            vector = compose(vector, b)
        after = crossings(blocks, START, crossing(vector, to(-1)))
        parts, seqs = zip(*((p, s) for p, s, _ in chain), strict=True)
        last = [False] * (len(chain) - 1) + [True]
        columns = [pa.array(parts, pa.int32()), pa.array(seqs, pa.int64()), pa.array([START, *after[:-1]], pa.int32()), pa.array(after, pa.int32()), pa.array(last)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "entry", "leave", "last"])

    chain, now = [], None
    for batch in batches:
        for conv, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chain and conv != now:
                yield solve(chain)
                chain = []
            now = conv
            chain.append(block)
    if chain:
        yield solve(chain)


def solved(batches):
    """Blocks with their states to repaired pieces."""
    for batch in batches:
        rows = batch.to_pydict()
        out: dict[str, list] = {k: [] for k in ("audit", "cost", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "first", "last_one", "low", "high", "distinct")}
        for i in range(batch.num_rows):
            kinds, initials, turns = rows["kinds"][i], rows["initials"][i], [t for t in rows["turns"][i] if t is not None]
            entry, leave = rows["entry"][i], rows["leave"][i]
            if leave < 0:  # a whole conversation
                audit = remembered(kinds) if len(kinds) <= 64 else audit_of(kinds)
            else:
                audit = edits_between(kinds, entry, leave) + (CLOSE[leave][1] if rows["last"][i] else "")
            roles, texts, cost = replay(audit, entry, rows["roles"][i], rows["texts"][i], kinds)
            values = (
                audit, cost, roles, texts, kinds.count(BLANK), kinds.count(DUPLICATE), sum(4 <= k < BLANK for k in kinds),
                sum(pair not in LEGAL for pair in zip(initials, initials[1:])),
                initials[0] if initials else None, initials[-1] if initials else None, min(turns, default=None), max(turns, default=None), len(set(turns)),
            )
            for k, v in zip(out, values, strict=True):
                out[k].append(v)
        ints = [pa.array(out[k], pa.int64()) for k in list(out)[4:]]
        columns = [*(batch.column(c) for c in ("conv_id", "part", "seq", "open")), pa.array(out["audit"], pa.string()), pa.array(out["cost"], pa.int64()), *(pa.array(out[k], pa.list_(pa.string())) for k in ("roles", "texts")), *ints]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "open", *out])


def pieces_of(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """repair() in two tables: conversations in one piece, and pieces of the others."""
    conv = turns.schema["conv_id"].dataType.simpleString()
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), gone.alias("gone"))
    # the last key lets a range end between equal rows
    rows = rows.withColumn("_own", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "role", "text", "_own"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    trimmed = F.rtrim("text", F.lit(SPACES))
    initial = F.array_position(F.array(*map(F.lit, INITIALS)), F.substring("role", 1, 1))
    initial = F.when(initial == 0, 3).otherwise(initial - 1).cast("int")
    kind = F.when(trimmed == "", BLANK).otherwise(initial + F.when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(4))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.select("conv_id", "turn", "role", "text", "gone", initial.alias("initial"), kind.cast("int").alias("kind"), digest.alias("digest"))
    schema = f"conv_id {conv}, part int, seq long, open boolean, turns array<long>, kinds binary, initials binary, roles array<string>, texts array<string>, digests array<binary>"
    blocks = cut(rows.mapInArrow(lambda batches: cut_blocks(batches, block), schema), "blocks")

    far = blocks.filter("open")
    seen = far.select("conv_id", "part", "seq", F.posexplode("digests").alias("i", "digest"))
    firsts = seen.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq", "i")).alias("f")).select("f.*")
    later = seen.join(firsts, ["part", "seq", "i"], "left_anti").groupBy("part", "seq").agg(F.collect_list("i").alias("later"))
    light = far.select("conv_id", "part", "seq", "kinds").join(later, ["part", "seq"], "left").select("conv_id", "part", "seq", "kinds", "later")
    vectors = cut(light.mapInArrow(block_vectors, f"conv_id {conv}, part int, seq long, kinds binary, vectors array<long>"), "vectors")
    chain = vectors.select("conv_id", "part", "seq", "vectors").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    states = chain.mapInArrow(chained, "part int, seq long, entry int, leave int, last boolean").join(vectors.select("part", "seq", "kinds"), ["part", "seq"])
    names = ["conv_id", "part", "seq", "open", "turns", "kinds", "initials", "roles", "texts", "entry", "leave", "last"]
    far = far.drop("kinds").join(states, ["part", "seq"]).select(*names)
    near = blocks.filter("not open").withColumns({"entry": F.lit(START), "leave": F.lit(-1), "last": F.lit(True)}).select(*names)
    piece = f"conv_id {conv}, part int, seq long, open boolean, audit string, cost long, roles array<string>, texts array<string>, "
    piece += ", ".join(f"{c} long" for c in ("blank", "duplicate", "truncated", "illegal", "first", "last_one", "low", "high", "distinct"))
    return near.mapInArrow(solved, piece), far.mapInArrow(solved, piece)


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Repaired pieces of conversations: conv_id, part, seq (their order), open, audit, cost, roles and texts (the repaired
    turns), and per piece what summaries() adds up.

    turns: conv_id, turn, role, text; rows with a true `gone` only name their conversation, which then has a piece without turns.
    Turns go by turn number (nulls first), then role, then text; a null conv_id is a conversation, null roles and texts are one
    space, repeated rows are repeated turns, other columns are ignored, an empty table gives no rows.
    """
    near, far = pieces_of(turns, block)
    return near.unionByName(far)


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, part, seq, at, role, text: the repaired turns, in order of part, seq, at."""
    return pieces.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "t")).select("conv_id", "part", "seq", "at", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def summed(batches):
    """Pieces in order to one row per conversation; texts are hashed piece by piece, never joined."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    now, total, audits, sha, begun, low, high, last, distinct = None, None, [], None, False, None, None, None, 0

    def row():
        gaps = 0 if low is None else high - low + 1 - distinct
        return (now, gaps, *total, "".join(audits), sha.hexdigest())

    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for p in batch.to_pylist():
            if total is None or p["conv_id"] != now:
                if total is not None:
                    done.append(row())
                now, total, audits, sha, begun, low, high, last, distinct = p["conv_id"], [0] * 5, [], hashlib.sha256(), False, None, None, None, 0
            crossed = last is not None and p["first"] is not None and (last, p["first"]) not in LEGAL
            for i, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                total[i] += p[c]
            total[3] += crossed
            last = last if p["last_one"] is None else p["last_one"]
            if p["low"] is not None:
                distinct += p["distinct"] - (high is not None and high == p["low"])
                low, high = p["low"] if low is None else low, p["high"]
            audits.append(p["audit"])
            for role, text in zip(p["roles"], p["texts"], strict=True):
                sha.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
        if done:
            yield _rows(done, names, kind)
    if total is not None:
        yield _rows([row()], names, kind)


def _rows(done: list, names: list[str], kind) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)


def summaries(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """repair(), summed up: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation."""
    conv = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    near, far = pieces_of(turns, block)
    far = far.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return near.mapInArrow(summed, schema).unionByName(far.mapInArrow(summed, schema))


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _after(state: str, edit: str, cost: str, said: str | None = None, when: str = "true") -> str:
    """SQL: what is known in a state (cost, audit, repaired), one edit later; null where the state can't be reached."""
    text = f"CASE WHEN {state}.o = '' THEN '' ELSE {state}.o || chr(10) END || {said}" if said else f"{state}.o"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', o := {text}) END"


def _spoken(state: str, role: str) -> str:
    """SQL: the turn kept or rerolled to a role."""
    keep = _after(state, "K", "3 * late", "role || ':' || text", f"NOT bad AND left(role, 1) = '{role[0]}'")
    return f"{keep}, {_after(state, 'R', '3 + 3 * late', f"'{role}:' || text", 'NOT bad')}"


_INSERTED = f"""(SELECT *, {_least("u1", "s3", _after("u1", "I", "3", "'assistant:'"))} AS a1 FROM
  (SELECT *, {_least("s2", *(_after(s, "I", "3", "'user:'") for s in ("s0", "s1", "s3")))} AS u1 FROM way))""".replace("list_min([u1, s3", "list_min([s3")
#: A plain forward table of least (cost, audit, repaired) per state, turn by turn.
SQL = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
k AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: {_STEP})) % 20 AS k FROM h),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM p),
f AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND nth > 1 AS again, trimmed <> '' AND nth = 1 AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut_off,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS two FROM o),
g AS (SELECT conv_id, pos, role, text, blank OR again AS bad, CAST(cut_off AS BIGINT) AS late FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
  count(*) FILTER (WHERE cut_off) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
way AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, struct_pack(c := 0::BIGINT, a := '', o := '') AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR) AS s3 FROM conversations
UNION ALL
SELECT w.conv_id, w.pos + 1, {_after("s0", "D", "4")}, {_least(_after("s1", "D", "4"), _after("s0", "K", "3 * late", "role || ':' || text", "NOT bad AND left(role, 1) = 's'"))},
  {_least(_after("u1", "D", "4"), *(_spoken(s, "user") for s in ("s0", "s1", "a1")))}, {_least(_after("a1", "D", "4"), _spoken("u1", "assistant"))}
FROM {_INSERTED} w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.pos = w.pos + 1),
e AS (SELECT conv_id, {_least("s0", "a1")} AS best FROM {_INSERTED} w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(best.o) AS repaired_sha256 FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""
