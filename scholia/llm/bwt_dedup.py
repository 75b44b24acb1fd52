"""Removal of long repeats with merged shard Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere in the corpus.

1. Seeds. Among the SEED-byte substrings of a window of LENGTH bytes, the one with the smallest hash (leftmost of equals)
   depends on the window alone, so equal windows have equal seeds at equal offsets. Windows whose seed occurs once in the
   corpus repeat nowhere and leave the job.
2. Shards. The windows of one seed fall into groups of GROUP neighbouring starts; a group's windows share a core of
   LENGTH - GROUP + 1 bytes. Each task takes the cores of its texts as suffixes of DEPTH symbols (hashes of SYMBOL bytes),
   sorts them, and has its shard's transform: rows in suffix order, each with the bytes before it (its Burrows-Wheeler
   context) and after it. Equal rows of a shard are one row with a count.
3. Merge. Rows go to ranges of suffix order. A task holds, for its range, the sorted runs of all shards and refines their
   interleave symbol by symbol: after round t, rows that share t symbols form one block; a block is split by the next symbol
   with a stable count, blocks of one row are left alone, and the common prefix of neighbours is the round in which they
   parted. No suffix is compared or sorted again. Blocks left at full depth are the repeated intervals.
4. Windows. In a repeated interval all members share the core, so a window of LENGTH bytes repeats if its few bytes before
   and after the core do; Spark counts those contexts per interval.

Every step groups or joins by content with partial aggregation; no group is gathered into a task, as rows of frequent keys are
joined where they lie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import body, cut

LENGTH = 400
SEED = 64
GROUP = 41
SYMBOL = 120
DEPTH = (LENGTH - GROUP + 1) // SYMBOL
SYMBOLS = [f"_s{i}" for i in range(DEPTH)]
#: Rows of a shard; a task makes as many shards as it needs.
SHARD_ROWS = 30_000
#: Tables of text ids are broadcast up to this many rows (counted first) and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Keys of more rows than this, and of more than one in HOT_KEYS of all rows, are joined by broadcast: fewer than HOT_KEYS keys.
HOT_ROWS, HOT_KEYS = 1_000, 20_000
#: Bytes that a task works on at once.
PIECE = 1 << 18
_BITS = 22  # positions in a piece, with its overlap, stay below 2**22
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [
            np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, b % (1 << 64), np.uint64))])
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers[0], _powers[1]


class Hashed:
    """Hashes of all substrings of some bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _tables(max(len(raw), PIECE + LENGTH) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        h = (self.sums[at + n] - self.sums[at]) * self.down[at]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    rows = y.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def seeds_of(raw: np.ndarray, owner_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window start, seed position and seed hash of each run of windows with one seed.

    raw: bytes; owner_end: for every byte, where its text ends. Windows don't cross that end.
    """
    none = np.zeros(0, np.int64)
    n = len(raw)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    hashed = Hashed(raw)
    own = hashed.of(np.arange(n - SEED + 1), SEED)
    mask = np.uint64((1 << _BITS) - 1)
    packed = (own & ~mask) | np.arange(len(own), dtype=np.uint64)
    at = (sliding_min(packed, LENGTH - SEED + 1) & mask).astype(np.int64)
    starts = np.arange(len(at))
    at[starts + LENGTH > owner_end[: len(at)]] = -1
    cuts = np.flatnonzero(np.diff(at)) + 1
    a, b = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]) - 1
    keep = at[a] >= 0
    a, b = a[keep], b[keep]
    x = at[a]
    return a, b, x, own[x]


def pieces(texts: list[bytes]):
    """Bytes of several texts as one array of some PIECE bytes; for every byte its text, its offset there and the text's end."""
    todo, size = [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[start : start + PIECE + LENGTH - 1]
            todo.append((i, start, part))
            size += len(part)
            if size >= PIECE:
                yield todo
                todo, size = [], 0
    if todo:
        yield todo


def seed_rows(batches):
    for pdf in batches:
        texts = [t.encode() for t in pdf["_text"]]
        tid = pdf["_tid"].to_numpy()
        for todo in pieces(texts):
            lens = np.array([len(p) for _, _, p in todo])
            first = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(len(todo)), lens)
            a, b, x, seed = seeds_of(np.frombuffer(b"".join(p for _, _, p in todo), np.uint8), np.repeat(first + lens, lens))
            if not len(a):
                continue
            o = owner[a]
            shift = np.array([s for _, s, _ in todo])[o] - first[o]
            yield pd.DataFrame(
                {
                    "_tid": tid[np.array([i for i, _, _ in todo])[o]],
                    "_x": x + shift,
                    "_a": a + shift,
                    "_b": b + shift,
                    "_seed": seed.view(np.int64),
                }
            )


def refine(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of sorted runs by their symbols: the order of the rows and the common prefix of each with the row before."""
    n, depth = symbols.shape
    order, lcp = np.arange(n), np.full(n, depth)
    block = np.zeros(n, np.int64)
    if n:
        lcp[0] = 0
    for t in range(depth):
        _, first, size = np.unique(block, return_index=True, return_counts=True)
        if not (size > 1).any():
            break
        live = np.flatnonzero(np.repeat(size > 1, size))
        own = symbols[order[live], t]
        moved = np.lexsort((own, block[live]))  # stable: rows of one block and symbol keep the order of the runs
        order[live] = order[live][moved]
        own = own[moved]
        parted = live[1:][(block[live][1:] == block[live][:-1]) & (own[1:] != own[:-1])]
        lcp[parted] = t
        block = np.cumsum(np.isin(np.arange(n), np.concatenate([first, parted]), assume_unique=False)) - 1
    # where blocks were apart from the start of a round, an earlier round has set lcp
    return order, lcp


def shard_rows(batches):
    """Rows of a shard's transform: symbols in suffix order, contexts before and after, text and position."""
    out: list[pd.DataFrame] = []

    def transform() -> pd.DataFrame:
        rows = pd.concat(out, ignore_index=True)
        out.clear()
        order, _ = refine(rows[SYMBOLS].to_numpy())
        return rows.iloc[order]

    for pdf in batches:
        for tid, text, found in zip(pdf["_tid"], pdf["_text"], pdf["_found"], strict=True):
            raw = text.encode()
            x, a, b = np.asarray(found, np.int64).reshape(-1, 3).T
            low, high = (x - b) // GROUP, (x - a) // GROUP
            n = high - low + 1
            group = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q = np.unique(np.repeat(x, n) - GROUP * group)
            for base in range(0, len(raw), PIECE):
                at = q[(q >= base) & (q < base + PIECE)]
                if not len(at):
                    continue
                hashed = Hashed(np.frombuffer(raw[base : base + PIECE + LENGTH], np.uint8))
                rows = pd.DataFrame({s: hashed.of(at - base + i * SYMBOL, SYMBOL).view(np.int64) for i, s in enumerate(SYMBOLS)})
                rows["_q"], rows["_tid"] = at, [tid] * len(at)
                end = DEPTH * SYMBOL
                rows["_before"] = [raw[max(0, p - GROUP + 1) : p] for p in at]
                rows["_after"] = [raw[p + end : p + end + GROUP - 1] for p in at]
                out.append(rows)
                if sum(map(len, out)) >= SHARD_ROWS:
                    yield transform()
    if out:
        yield transform()


def frequent(counts: DataFrame, *keys: str) -> DataFrame | None:
    """Keys of so many rows (_n, one row a key) that no task should get them all; None if there are none."""
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)).select(*keys)
    return None if hot.isEmpty() else F.broadcast(hot)


def spread(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "left_semi", within: DataFrame | None = None) -> DataFrame:
    """Join (left_semi or inner) with a table of distinct keys; rows of hot keys aren't shuffled.

    within: a part of the table that has all its hot keys, if that is easier to find than the table.
    """
    if hot is None:
        return rows.join(table, keys, how)
    rest = rows.join(hot, keys, "left_anti").join(table, keys, how)
    few = (table if within is None else within).join(hot, keys, "left_semi")
    return rest.unionByName(rows.join(F.broadcast(few), keys, how))


def repeated_intervals(rows: DataFrame) -> DataFrame:
    """Symbols of the suffixes that occur more than once, over all shards, and how often (_n)."""
    runs = rows.groupBy("_shard", *SYMBOLS).agg(F.count(F.lit(1)).alias("_n"))
    runs = runs.repartitionByRange(*SYMBOLS).sortWithinPartitions("_shard", *SYMBOLS)

    def merge(batches):
        held = [pdf for pdf in batches if len(pdf)]
        if held:
            pdf = pd.concat(held, ignore_index=True)
            symbols = pdf[SYMBOLS].to_numpy()
            order, lcp = refine(symbols)
            first = np.flatnonzero(lcp < DEPTH)
            total = np.add.reduceat(pdf["_n"].to_numpy()[order], first)
            hit = first[total > 1]
            yield pd.DataFrame(dict(zip(SYMBOLS, symbols[order[hit]].T, strict=True)) | {"_n": total[total > 1]})

    return runs.mapInPandas(merge, ", ".join(f"{s} long" for s in [*SYMBOLS, "_n"]))


def repeated_windows(rows: DataFrame) -> DataFrame:
    """_tid, _q, _low, _high, _es: starts of repeated windows, as offsets before the core: _es, or all from _low to _high if null."""
    core = F.xxhash64(*SYMBOLS)
    intervals = cut(repeated_intervals(rows).select(core.alias("_core"), "_n"), "intervals")
    hot = frequent(intervals, "_core")
    kinds = spread(rows.select("_core", "_kind"), intervals.select("_core"), ["_core"], hot)
    kinds = cut(kinds.groupBy("_core", "_kind").agg(F.count(F.lit(1)).alias("_n")), "kinds")
    # windows are compared only where a context stands alone: those of a context met twice all repeat
    alone = kinds.filter("_n = 1").select("_core").distinct()
    context = spread(rows.select("_core", "_kind", "_before", "_after"), alone, ["_core"], hot)
    context = context.groupBy("_core", "_kind").agg(F.min("_before").alias("_before"), F.min("_after").alias("_after"), F.count(F.lit(1)).alias("_n"))
    # a start e bytes before the core has e bytes of the context before it and GROUP - 1 - e of the one after it
    each = context.filter(F.length("_before") + F.length("_after") >= GROUP - 1).select(
        "*", F.explode(F.sequence(F.greatest(F.lit(0), F.lit(GROUP - 1) - F.length("_after")), F.length("_before"))).alias("_e")
    )
    sides = [F.expr("substring(_before, length(_before) - _e + 1, _e)"), F.expr(f"substring(_after, 1, {GROUP - 1} - _e)")]
    each = cut(each.select("_core", "_kind", "_n", "_e", F.xxhash64("_core", "_e", *sides).alias("_window")), "windows")
    counts = each.groupBy("_window").agg(F.sum(F.least("_n", F.lit(2))).alias("_k"), F.count_if(F.col("_n") == 1).alias("_n"))
    counts = cut(counts.filter("_k > 1 and _n > 0").select("_window", "_n"), "repeated-windows")
    some = spread(each.filter("_n = 1"), counts.select("_window"), ["_window"], frequent(counts, "_window"))
    some = some.groupBy("_core", "_kind").agg(F.collect_set("_e").alias("_es"))
    twice = kinds.filter("_n > 1").select("_core", "_kind", F.lit(None).cast("array<int>").alias("_es"))
    own = rows.select("_core", "_kind", "_tid", "_q", F.greatest(F.lit(0), F.lit(GROUP - 1) - F.length("_after")).alias("_low"), F.length("_before").alias("_high"))
    key = ["_core", "_kind"]  # frequent ones were met twice
    own = spread(own.filter("_low <= _high"), some.unionByName(twice), key, frequent(kinds, *key), "inner", twice)
    return own.select("_tid", "_q", "_low", "_high", "_es")


def merge_spans(flat) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows, given as first and last starts of runs of windows, one after the other."""
    runs = np.asarray(flat, np.int64).reshape(-1, 2)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    if not len(runs):
        return []
    reach = np.maximum.accumulate(runs[:, 1]) + LENGTH
    new = np.flatnonzero(runs[1:, 0] > reach[:-1]) + 1  # a window that starts where another ends touches it
    firsts, lasts = np.concatenate([[0], new]), np.concatenate([new, [len(runs)]]) - 1
    return [(int(a), int(b)) for a, b in zip(runs[firsts, 0], reach[lasts], strict=True)]


def narrow(df: DataFrame, keys: DataFrame, how: str, hot: DataFrame | None = None) -> DataFrame:
    """Join with a table of text ids, by broadcast if its counted size allows; else hot ones, all in the table, aren't shuffled."""
    if keys.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), "_tid", how)
    if how == "left_semi":
        return spread(df, keys, ["_tid"], hot)
    return (df if hot is None else df.join(hot, "_tid", "left_anti")).join(keys, "_tid", how)


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, on demand).

    Texts count as UTF-8 bytes, null as empty. Repeats are judged on the input: of a repeated string, no copy stays. Equal
    texts of LENGTH bytes or more go whole, also under one doc_id. Texts shorter than LENGTH stay. An empty table gives no
    rows; other columns are ignored.
    """
    texts = documents.select(F.col("doc_id"), body("text").alias("_text"))
    texts = texts.withColumn("_tid", F.unhex(F.md5(F.col("_text").cast("binary"))))
    long = texts.filter(F.octet_length("_text") >= LENGTH)
    copies = cut(long.groupBy("_tid").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "copies")
    hot, copies = frequent(copies, "_tid"), copies.select("_tid")
    # of equal texts one is enough: what another text shares with them repeats, and they go whole
    long = long.select("_tid", "_text")
    one = cut(narrow(long, copies, "left_semi", hot).groupBy("_tid").agg(F.first("_text").alias("_text")), "one-of-copies")
    long = narrow(long, copies, "left_anti", hot).unionByName(one)

    found = cut(long.select("_tid", "_text").mapInPandas(seed_rows, "_tid binary, _x long, _a long, _b long, _seed long"), "seeds")
    place = F.xxhash64("_tid", "_x")
    shared = found.groupBy("_seed").agg(F.min(place).alias("l"), F.max(place).alias("h"), F.count(F.lit(1)).alias("_n"))
    shared = cut(shared.filter("l <> h").select("_seed", "_n"), "shared-seeds")
    by_text = spread(found, shared.select("_seed"), ["_seed"], frequent(shared, "_seed"))
    by_text = by_text.groupBy("_tid").agg(F.collect_set(F.array("_x", "_a", "_b")).alias("_found"))
    by_text = cut(by_text.select("_tid", F.flatten("_found").alias("_found")), "candidates")

    kind = f"{', '.join(f'{s} long' for s in SYMBOLS)}, _q long, _tid binary, _before binary, _after binary"
    rows = narrow(long.select("_tid", "_text"), by_text.select("_tid"), "left_semi").join(by_text, "_tid")
    rows = rows.select("_tid", "_text", "_found").mapInPandas(shard_rows, kind)
    keys = [F.xxhash64(*SYMBOLS).alias("_core"), F.xxhash64("_before", "_after").alias("_kind"), F.spark_partition_id().alias("_shard")]
    rows = cut(rows.select("*", *keys), "transforms")
    every = F.array(F.col("_q") - F.col("_high"), F.col("_q") - F.col("_low"))
    some = F.flatten(F.transform("_es", lambda e: F.array(F.col("_q") - e, F.col("_q") - e)))
    spans = narrow(repeated_windows(rows), copies, "left_anti").select("_tid", F.coalesce(some, every).alias("_runs"))
    spans = spans.groupBy("_tid").agg(F.flatten(F.collect_list("_runs")).alias("_windows"))
    spans = cut(spans.join(copies.withColumn("_whole", F.lit(True)), "_tid", "full"), "spans")

    def finish(batches):
        for pdf in batches:
            out = []
            for text, windows, all_of in zip(pdf["_text"], pdf["_windows"], pdf["_whole"], strict=True):
                raw = text.encode()
                gone = [(0, len(raw))] if all_of is True or all_of == 1 else merge_spans(windows)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [()] * 5
            made = {"doc_id": pdf["doc_id"], "n_bytes": cols[0], "n_removed": cols[1], "n_spans": cols[2], "kept_sha256": cols[3]}
            yield pd.DataFrame(made | ({"kept": cols[4]} if with_text else {}))

    kind = documents.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    ids, raw = spans.select("_tid"), F.col("_text").cast("binary")
    touched = spread(narrow(texts, ids, "left_semi", hot), spans, ["_tid"], hot, "inner")
    touched = touched.select("doc_id", "_text", "_windows", "_whole").mapInPandas(finish, kind)
    zero = F.lit(0).cast("long")
    same = narrow(texts, ids, "left_anti", hot).select(
        "doc_id",
        F.octet_length("_text").cast("long").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"),
        *([raw.alias("kept")] if with_text else []),
    )
    return touched.unionByName(same)
