"""Phrase collocations: counts of one to three words by multikey three-way quicksort of suffix pointers, scored by their weakest cut.

1. Tasks cut texts into pieces and words and combine equal suffixes (the words of a piece from each position, three at most),
   so that a phrase repeated in thousands of documents is one row of a task.
2. Suffixes are routed by language and leading words into ranges. A range ends wherever the load asks for
   it, also inside the suffixes of one word or two, so a very common word is spread over many tasks.
3. A task sorts pointers to its suffixes by multikey three-way quicksort down to the third word, all open partitions of a round
   at once in numpy. An equal partition is a phrase and the sum of its suffixes is its count; a partition whose sum can't reach
   the least count is abandoned, whether it's equal, less or greater. Only the first and last word and word pair of a range may
   go on in the neighbouring ranges: their counts are summed up afterwards, whatever they are.
4. Counts are joined to candidates, scored in exact decimals and ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.common import body, cut

LEAST, LONGEST, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
#: Words whose suffixes a task combines at a time; their numbers fit into 21 bits.
WORDS = 1 << 19
#: Ranges of suffixes for each shuffle partition: a task holds a whole range.
RANGES = 6
#: Bytes of text a task cuts into words at a time (a longer text is taken alone).
BYTES = 4 << 20
SPACE, BREAK = 0x20, 0x0A
#: Parts of a language that are ranked apart before they are ranked together.
SALTS = 16

#: What each byte counts as: A-Z lower case, a tab a space, [.,;:!?\x0A-\x0D] the end of a piece.
_BYTES = bytearray(range(256))
for _b in range(ord("A"), ord("Z") + 1):
    _BYTES[_b] = _b + 32
_BYTES[0x09] = SPACE
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_b] = BREAK
_BYTES = bytes(_BYTES)

WORD_COLUMNS = ["w1", "w2", "w3"]
#: A suffix: the language, a tab, and each word with a space after it, so that suffixes that begin with the same words are neighbours in
#: byte order. Words hold neither tabs nor spaces.
SUFFIXES = "suffix binary, c long"
COUNTS = "lang string, w1 string, w2 string, w3 string, depth int, c long"


def strings(raw: np.ndarray, chosen: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The chosen bytes as an Arrow array of binaries of these sizes."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[chosen])])


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of prepared bytes, and which piece each word is in."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], (raw != SPACE) & (raw != BREAK), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return strings(raw, inside[1:-1], ends - starts), np.searchsorted(np.flatnonzero(raw == BREAK), starts)


def combined_suffixes(batches):
    """Batches of (lang, text) to SUFFIXES: the different suffixes of up to WORDS words of one language, with counts."""
    waiting: dict[str, list] = {}
    held = 0

    def combine(lang: str, texts: list[bytes]):
        words, piece = words_of(b"\n".join(texts))
        for a in range(0, len(words), WORDS):
            b = min(a + WORDS, len(words))
            z = min(b + LONGEST - 1, len(words))  # the words after it complete the last suffixes
            coded = words[a:z].dictionary_encode()
            number = np.concatenate((coded.indices.to_numpy().astype(np.int64) + 1, np.zeros(LONGEST - 1, np.int64)))
            at = np.concatenate((piece[a:z], np.full(LONGEST - 1, -1)))
            n = b - a
            second = np.where(at[1 : n + 1] == at[:n], number[1 : n + 1], 0)
            third = np.where(at[2 : n + 2] == at[:n], number[2 : n + 2], 0)
            key, count = np.unique((number[:n] << 42) | (second << 21) | third, return_counts=True)
            names = pc.binary_join_element_wise(coded.dictionary, b"", b" ")
            names = pa.concat_arrays([pa.array([b""], names.type), names])
            parts = (names.take(pa.array((key >> shift) & ((1 << 21) - 1))) for shift in (42, 21, 0))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang.encode() + b"\t", *parts, b""), pa.array(count)], names=["suffix", "c"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text.translate(_BYTES))
            held += len(text)
            if held >= BYTES:
                for k, texts in waiting.items():
                    yield from combine(k, texts)
                waiting, held = {}, 0
                pa.default_memory_pool().release_unused()
    for k, texts in waiting.items():
        yield from combine(k, texts)


def parsed(suffixes: pa.Array) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """Suffixes as numbers (language, three words; 0: the suffix has ended), and what the numbers stand for."""
    n = len(suffixes)
    offsets = np.frombuffer(suffixes.buffers()[1], np.int32)[suffixes.offset : suffixes.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(suffixes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    tabs = np.flatnonzero(raw == 0x09)
    ahead = tabs[np.searchsorted(tabs, offsets[1:]) - 1] + 1 - offsets[:-1]  # to the last tab of the row; a language may hold others
    language = np.repeat(np.tile([True, False], n), np.stack([ahead, np.diff(offsets) - ahead], 1).ravel())
    spaces = np.flatnonzero((raw == SPACE) & ~language)
    begins = np.searchsorted(spaces, offsets)
    count = np.diff(begins)
    row = np.repeat(np.arange(n, dtype=np.int32), count)
    nth = np.arange(len(row)) - np.repeat(begins[:-1], count)
    before = np.concatenate(([0], spaces[:-1] + 1))
    sizes = spaces - np.where(nth == 0, np.repeat(offsets[:-1] + ahead, count), before)
    words = strings(raw, ~language & (raw != SPACE), sizes).dictionary_encode()
    langs = strings(raw, language, ahead).dictionary_encode()
    keys = [langs.indices.to_numpy() + 1, *(np.zeros(n, np.int32) for _ in range(LONGEST))]
    numbers = words.indices.to_numpy() + 1
    for i in range(LONGEST):
        keys[1 + i][row[nth == i]] = numbers[nth == i]
    return keys, [[b"", *(x[:-1] for x in langs.dictionary.to_pylist())], *[[b"", *words.dictionary.to_pylist()]] * LONGEST]


def three_way(keys: list[np.ndarray], weight: np.ndarray, least: int):
    """Multikey three-way quicksort of pointers by keys[0], keys[1], ...: for each depth, a pointer and the sum of each equal partition.

    Keys are whole numbers, 0 ends a suffix. Partitions whose weight is below `least` are abandoned. The open partitions of a
    depth lie one after the other; a round divides all of them by the median of their first, middle and last key.
    """
    pointer, size = np.arange(len(weight), dtype=np.int32), np.array([len(weight)])[: len(weight)]
    for key in keys:
        first, total, deeper, deeper_sizes = [], [], [], []
        k, w = key[pointer], weight[pointer]
        while len(size):
            begin = np.cumsum(size) - size
            a, b, c = k[begin], k[begin + size // 2], k[begin + size - 1]
            pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
            owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
            wanted = np.repeat(pivot, size)
            rest = []
            for side in (k == wanted, k < wanted, k > wanted):
                mine = owner[side]
                sums = np.bincount(mine, w[side], len(size)).astype(np.int64)
                alive = sums >= least
                if not rest:
                    alive &= pivot > 0  # suffixes that end here go no deeper
                sizes = np.bincount(mine, minlength=len(size))[alive]
                at = np.flatnonzero(side)[alive[mine]]
                rest.append((at, sizes))
                if len(rest) == 1:
                    deeper.append(pointer[at])
                    deeper_sizes.append(sizes)
                    first.append(deeper[-1][np.cumsum(sizes) - sizes])
                    total.append(sums[alive])
            at = np.concatenate([rest[1][0], rest[2][0]])
            pointer, k, w, size = pointer[at], k[at], w[at], np.concatenate([rest[1][1], rest[2][1]])
        first, total, pointer, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, total, deeper, deeper_sizes))
        yield first, total


def range_counts(batches, least: int = LEAST):
    """A range of suffixes (SUFFIXES) to its COUNTS. Depth 0 sums a language; counts of the range's edges may be partial."""
    schema = pa.schema([("lang", pa.string()), *((w, pa.string()) for w in WORD_COLUMNS), ("depth", pa.int32()), ("c", pa.int64())])
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    weight = table.column("c").to_numpy()
    keys, names = parsed(table.column("suffix").combine_chunks())
    n = len(weight)
    del table, batches

    def rows(pointers: np.ndarray, totals: np.ndarray, depth: int):
        columns = [pa.array([names[i][j] for j in keys[i][pointers].tolist()], pa.binary()).cast(pa.string()) if i <= depth else pa.nulls(len(pointers), pa.string()) for i in range(LONGEST + 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(pointers), depth, np.int32)), pa.array(totals.astype(np.int64))], schema=schema)

    # the first and last suffix of the range in the order of the routing, and the words and pairs they begin with
    edges: list[set] = [set() for _ in range(LONGEST)]
    for choose in (min, max):
        here = np.arange(n)
        for depth in range(LONGEST):
            found = np.unique(keys[depth][here])
            best = choose(found.tolist(), key=lambda j, d=depth: names[d][j] + bool(d and j) * b" ")
            if not best:
                break
            here = here[keys[depth][here] == best]
            edges[depth].add((int(here[0]), int(weight[here].sum())))
    for depth in range(1, LONGEST):
        for pointer, total in edges[depth]:
            yield rows(np.array([pointer]), np.array([total]), depth)
    for depth, (pointers, totals) in enumerate(three_way(keys, weight, least if least > 1 else 1)):
        if depth and depth < LONGEST:
            edge = np.zeros(len(pointers), bool)
            for pointer, _ in edges[depth]:
                edge |= np.logical_and.reduce([keys[i][pointers] == keys[i][pointer] for i in range(depth + 1)])
            pointers, totals = pointers[~edge], totals[~edge]
        if depth:
            yield rows(pointers, totals, depth)
    sums = np.bincount(keys[0], weight).astype(np.int64)
    for lang in np.flatnonzero(sums):
        yield rows(np.flatnonzero(keys[0] == lang)[:1], sums[lang : lang + 1], 0)
    del keys, names, weight
    pa.default_memory_pool().release_unused()  # workers live on


def phrase_counts(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, w1, w2, w3, depth, c: every phrase of one to three words that occurs `least` times in a language; depth 0: its words in all.

    Null texts count as empty, null languages as `und`, repeated rows count each, an empty table gives no rows, other columns
    are ignored. A text may be of any length; a task holds BYTES of texts, or one text, and a range of suffixes.
    """
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), body(text_col).cast("binary").alias("text"))
    ranges = RANGES * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.mapInArrow(combined_suffixes, SUFFIXES).repartitionByRange(ranges, "suffix")
    counts = ranges.mapInArrow(lambda batches: range_counts(batches, least), COUNTS)
    return counts.groupBy("lang", *WORD_COLUMNS, "depth").agg(F.sum("c").alias("c")).filter((F.col("depth") == 0) | (F.col("c") >= least))


def ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in exact decimals, for counts below 10^15."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language.

    A phrase of 2 or 3 words that occurs a >= least times scores by its weakest cut (l and r: counts of both sides); it goes if
    a longer phrase around it occurs inside_percent of its times. Ties go to the more frequent, then to the bytewise smaller
    phrase. Nulls, repeated rows, empty tables and other columns: see phrase_counts.
    """
    counts = cut(phrase_counts(documents, text_col, lang_col, least), "phrases")
    sizes = counts.filter("depth = 0").select("lang", F.col("c").alias("n"))
    ones = counts.filter("depth = 1").select("lang", F.col("w1").alias("w"), F.col("c").alias("f"))
    pairs = counts.filter("depth = 2").select("lang", "w1", "w2", F.col("c").alias("a"))
    triples = counts.filter("depth = 3").select("lang", "w1", "w2", "w3", F.col("c").alias("a"))

    def one(w: str, name: str) -> DataFrame:
        return ones.select("lang", F.col("w").alias(w), F.col("f").alias(name))

    around = triples.select("lang", "w1", "w2", "a").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    around = around.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    two = pairs.join(around, ["lang", "w1", "w2"], "left").filter(F.expr(f"longer is null or 100 * longer < {inside_percent} * a"))
    two = two.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    left_pairs = pairs.select("lang", "w1", "w2", F.col("a").alias("l2"))
    right_pairs = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
    three = triples.join(left_pairs, ["lang", "w1", "w2"]).join(right_pairs, ["lang", "w2", "w3"]).join(one("w1", "l1"), ["lang", "w1"]).join(one("w3", "r2"), ["lang", "w3"])
    three = three.withColumn("s1", ratio(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", ratio(F.col("a"), F.col("l2"), F.col("r2")))
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    # the first of SALTS parts of a language each, so that the last ranking reads so many times `top` rows at most
    order = (F.desc("score"), F.desc("a"), "phrase")
    every = two.unionByName(three).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (["lang", "_salt"], ["lang"]):
        every = every.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    best = every.drop("_salt")
    return best.join(F.broadcast(sizes) if top else sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS k FROM w),
t AS (SELECT lang, ws[k] AS w1, ws[k + 1] AS w2, ws[k + 2] AS w3 FROM i),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, a, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.a >= {INSIDE_PERCENT} * f2.a)
  AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.a >= {INSIDE_PERCENT} * f2.a)),
s3 AS (SELECT f3.*, x.f AS l1, v.a AS r1, u.a AS l2, y.f AS r2, 1000000::HUGEINT * f3.a * f3.a // (x.f::HUGEINT * v.a) AS s1, 1000000::HUGEINT * f3.a * f3.a // (u.a::HUGEINT * y.f) AS s2
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
  JOIN f2 u ON u.lang = f3.lang AND u.w1 = f3.w1 AND u.w2 = f3.w2 JOIN f2 v ON v.lang = f3.lang AND v.w1 = f3.w2 AND v.w2 = f3.w3),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM s3)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM c JOIN n USING (lang)
QUALIFY rank <= {TOP}
"""
