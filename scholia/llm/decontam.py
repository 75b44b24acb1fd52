"""Benchmark decontamination with spaced seeds.

A seed mask looks at some token positions of a window and ignores the others, so two windows that differ only at ignored
positions hash alike. The masks cover all places that a stretch may differ in. Every window of every document is hashed under each mask and joined with the hashes of the benchmark's
windows; a hit is verified on the tokens around it, where substitutions are allowed: some stretch of `STRETCH` aligned tokens
must agree in at least `AGREE` of its places.

Only DataFrame functions. Benchmark items of equal tokens are one text until the end. Windows, seeds, the join's probe, the
verification and the first sums per document and text are one generated loop, so a document's token hashes lie beside its
windows and no row is made of a hit, however many a document has: what a task holds doesn't grow with them. The seed table is broadcast up to `BROADCAST_ROWS` rows
(counted first). Beyond, seeds are first asked of a bit table of fixed size, and what passes is joined by shuffle, with the tokens around it only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import body, cut, free_name

#: 1 looks, 0 ignores. Span 11, weight 6: wherever up to 3 of 13 aligned tokens differ, some mask sees none of them.
MASKS = ("11010011001", "10001101011", "10111000101", "10010111100", "11010000111", "11011100001", "01101010110")
#: The same for 3 of 12 and 2 of 11 tokens; used where the benchmark has items of fewer than STRETCH tokens.
SHORT_MASKS = (
    "10101011010", "10101100101", "11010010011", "00110101011", "11001101100", "01100011101",
    "10011000111", "10110110001", "00001111110", "00111110100", "11110100100", "11001010101",
)
#: The masks of SQL, which thereby finds a part of what overlaps() does.
SQL_MASKS = ("11101001101", "11001011011")
SPAN = 11
STRETCH = 13
#: Items of fewer than SPAN tokens have to be found whole; items of fewer than this say too little to be found.
LEAST = 5
AGREE = 0.75
BROADCAST_ROWS = 500_000
#: Tokens that are compared around a hit: STRETCH before the window to STRETCH after it.
AROUND = SPAN + 2 * STRETCH
#: The bit table has TABLES parts of 2 ** BITS bits, each for other bits of a seed.
BITS, TABLES = 24, 3


def token_hashes(text: Column) -> Column:
    """A hash of each token: lower-cased runs of letters and digits, in text order."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(tokens, lambda w: F.xxhash64(w))


def windows(df: DataFrame, h: str, masks: list[str], where: list[Column] | None = None) -> DataFrame:
    """One row per window and mask: df's columns, _i (start), _m (number of the mask), _seed (null: past the end, or not where)."""
    least = min(map(len, masks))
    # explode_outer: an inner generator would make the optimiser derive a filter that computes the hashes once more
    at = df.select("*", F.explode_outer(F.when(F.size(h) >= least, F.sequence(F.lit(0), F.size(h) - least))).alias("_i"))
    seeds = []
    for m, mask in enumerate(masks):
        seed = F.xxhash64(F.lit(int("1" + mask, 2)), *[F.get(h, F.col("_i") + k) for k, c in enumerate(mask) if c == "1"])
        only = [F.col("_i") <= F.size(h) - len(mask)] if len(mask) > least else []
        only += [where[m]] if where else []
        seeds.append(F.when(reduce(lambda a, b: a & b, only), seed) if only else seed)
    return at.filter(F.col("_i").isNotNull()).select("*", F.posexplode_outer(F.array(*seeds)).alias("_m", "_seed"))


def agreeing(hits: DataFrame, name: str, places: range) -> DataFrame:
    """hits with a bit for each of the places around the window at which document and item agree.

    Generated, so that filters don't compute it again, and few places at once, as the JVM leaves long methods uncompiled. Items
    are padded, so that not both are null.
    """
    same = [
        F.shiftleft(F.equal_null(F.get("_h", F.col("_k") + k), F.get("_ih", F.col("_j") + (k + STRETCH))).cast("long"), k - places.start)
        for k in places
    ]
    return hits.select("*", F.explode_outer(F.array(reduce(Column.bitwiseOR, same))).alias(name))


def bit_places(seed: Column) -> list[tuple[Column, Column]]:
    """Word and bit of a seed in each part of the bit table."""
    parts = [F.shiftrightunsigned(seed, t * (64 - BITS) // (TABLES - 1)).bitwiseAND(F.lit((1 << BITS) - 1)) for t in range(TABLES)]
    return [((F.shiftright(p, 6) + t * (1 << BITS - 6)).cast("int"), p.bitwiseAND(F.lit(63)).cast("int")) for t, p in enumerate(parts)]


def bit_table(seeds: DataFrame) -> DataFrame:
    """One row: _bits, longs whose bits are set at the places of all seeds."""
    places = F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in bit_places(F.col("_seed"))])
    words = seeds.select(F.explode(places).alias("_p")).groupBy(F.col("_p.w").cast("long").alias("id"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, _p.b)")).alias("_w"))
    dense = seeds.sparkSession.range(TABLES << BITS - 6).join(words, "id", "left")
    dense = dense.select("id", F.coalesce("_w", F.lit(0).cast("long")).alias("_w"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "_w"))), lambda x: x["_w"]).alias("_bits"))


def item_texts(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that can be found (item_id, _ih: token hashes), and their distinct texts (_ih, _len, _text: number)."""
    items = benchmark.select("item_id", token_hashes(body("text")).alias("_ih"))
    items = cut(items.filter(F.size("_ih") >= LEAST), "items")
    texts = items.select("_ih").distinct().select("_ih", F.size("_ih").alias("_len"), F.monotonically_increasing_id().alias("_text"))
    return items, cut(texts, "items")


def passages(documents: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per contaminated document and text of item_texts: doc_id, _text, n_hits, overlap, first_token, last_token."""
    docs = documents.select(F.col(id_col).alias("doc_id"), token_hashes(body(text_col)).alias("_h")).withColumn("_row", F.monotonically_increasing_id())
    size = F.col("_len")
    few, short, lengths, stretch = texts.select(
        F.sum("_len"), F.count_if(size.between(SPAN, STRETCH - 1)), F.collect_set(F.when(size < SPAN, size)), F.least(F.min("_len"), F.lit(STRETCH))
    ).first()
    spaced = [*MASKS, *SHORT_MASKS] if short else [*MASKS]
    where = [size >= SPAN] * len(MASKS) + [size.between(SPAN, STRETCH - 1)] * (len(spaced) - len(MASKS))
    masks = spaced + ["1" * n for n in sorted(lengths)]  # ten lengths at most
    where += [size == n for n in sorted(lengths)]
    pad = F.array_repeat(F.lit(0).cast("long"), SPAN + STRETCH)
    texts = texts.withColumn("_padded", F.concat(F.slice(pad, 1, STRETCH), "_ih", pad))
    keys = windows(texts, "_ih", masks, where).filter(F.col("_seed").isNotNull()).withColumnRenamed("_i", "_j")
    found = windows(docs, "_h", masks).drop("_m")
    if (few or 0) * len(spaced) <= BROADCAST_ROWS:
        hits = found.withColumn("_k", F.col("_i")).join(F.broadcast(keys.select("_seed", "_text", "_j", "_m")), "_seed")
        hits = hits.join(F.broadcast(texts.select("_text", "_len", F.col("_padded").alias("_ih"))), "_text")
    else:
        around = F.slice("_padded", F.col("_j") + 1, F.lit(AROUND))
        keys = cut(keys.select("_seed", "_text", "_len", "_m", around.alias("_ih"), F.lit(0).alias("_j")), "seeds")
        here = [F.getbit(F.get("_bits", w), b) == 1 for w, b in bit_places(F.col("_seed"))]
        found = found.join(F.broadcast(bit_table(keys)), reduce(lambda a, b: a & b, here))
        start = F.greatest(F.col("_i") - STRETCH, F.lit(0))
        found = found.select("doc_id", "_row", "_i", "_seed", F.slice("_h", start + 1, F.lit(AROUND)).alias("_h"), (F.col("_i") - start).alias("_k"))
        hits = found.join(keys, "_seed")
    hits = agreeing(hits, "_window", range(SPAN))
    # a window may hit by several masks; it counts by the first of them
    looks = [sum(1 << k for k, c in enumerate(mask) if c == "1") for mask in spaced]
    first = F.coalesce(*[F.when(F.col("_window").bitwiseAND(F.lit(look)) == look, F.lit(m)) for m, look in enumerate(looks)])
    hits = hits.filter((size < SPAN) | (first == F.col("_m")))
    hits = agreeing(agreeing(hits, "_before", range(-STRETCH, 0)), "_after", range(SPAN, SPAN + STRETCH))
    same = F.col("_before").bitwiseOR(F.shiftleft("_window", STRETCH)).bitwiseOR(F.shiftleft("_after", SPAN + STRETCH))
    hits = hits.select("doc_id", "_row", "_text", "_i", "_len", F.explode_outer(F.array(same)).alias("_same"))
    own = F.least(size, F.lit(STRETCH))
    ones = F.expr(f"shiftleft(1L, least(_len, {STRETCH})) - 1")
    best = F.greatest(*[F.bit_count(F.shiftright("_same", s).bitwiseAND(ones)) for s in range(AROUND - (stretch or STRETCH) + 1)])
    hits = hits.withColumn("_best", best / own).filter(F.col("_best") >= AGREE)
    return hits.groupBy("_row", "_text", "doc_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.max("_best").alias("overlap"),
        F.min("_i").cast("long").alias("first_token"),
        (F.max(F.col("_i") + F.least(F.lit(SPAN), size)) - 1).cast("long").alias("last_token"),
    ).drop("_row")


def overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per contaminated document and benchmark item: doc_id, item_id, n_hits, overlap, first_token, last_token.

    n_hits counts verified windows, overlap is the best share of agreeing places in a stretch of 13 tokens (in the item's
    length, where that is shorter), first_token and last_token bound the windows in the document. Items of 5 to 10 tokens have
    to occur whole and unchanged; shorter items, null and empty texts match nothing. Rows are told apart by themselves, not
    by their ids: repeated documents and repeated items each get their rows, null ids as well. Other columns are ignored.
    """
    items, texts = item_texts(benchmark)
    return (
        passages(documents, texts, id_col, text_col)
        .join(items.join(texts, "_ih").select("item_id", "_text"), "_text")
        .select("doc_id", "item_id", "n_hits", "overlap", "first_token", "last_token")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the rows that hold a benchmark passage.

    All columns stay, whatever their names. Null ids and texts, repeated rows and empty tables: see overlaps; of equal ids only
    the rows with a passage go.
    """
    name = free_name(documents, "_own_row")
    rows = documents.withColumn(name, F.struct("doc_id", F.unhex(F.md5(body("text").cast("binary"))).alias("text")))
    bad = passages(rows, item_texts(benchmark)[1], name, "text").select(F.col("doc_id").alias(f"{name}_bad")).distinct()
    return rows.join(bad, rows[name] == bad[f"{name}_bad"], "left_anti").drop(name)


def _sql_seeds() -> str:
    looks = [[k for k, c in enumerate(mask) if c == "1"] for mask in SQL_MASKS]
    return " UNION ALL ".join(
        f"SELECT *, '{m}' || '|' || concat_ws('|', {', '.join(f'w[i + {k + 1}]' for k in look)}) AS seed FROM {{0}}"
        for m, look in enumerate(looks)
    )


SQL = f"""
WITH d0 AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b0 AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
d1 AS (SELECT *, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM d0),
b1 AS (SELECT *, unnest(range(0, len(w) - {SPAN - 1})) AS i FROM b0),
d2 AS ({_sql_seeds().format('d1')}),
b2 AS ({_sql_seeds().format('b1')}),
hit AS (SELECT DISTINCT d2.doc_id, b2.item_id, d2.i AS i, b2.i AS j FROM d2 JOIN b2 USING (seed)),
al AS (SELECT hit.*, least({STRETCH}, len(b0.w)) AS n, list_transform(range(-{STRETCH}, {SPAN + STRETCH}),
  lambda k: CASE WHEN i + k >= 0 AND j + k >= 0 AND i + k < len(d0.w) AND j + k < len(b0.w) AND d0.w[i + k + 1] = b0.w[j + k + 1] THEN 1 ELSE 0 END) AS same
  FROM hit JOIN d0 USING (doc_id) JOIN b0 USING (item_id)),
best AS (SELECT doc_id, item_id, i, list_max(list_transform(range(1, {SPAN + 2 * STRETCH} - n + 2), lambda s: list_sum(same[s:s + n - 1]))) / n AS o FROM al)
SELECT doc_id, item_id, count(*) AS n_hits, max(o) AS overlap, min(i) AS first_token, max(i) + {SPAN - 1} AS last_token
FROM best WHERE o >= {AGREE} GROUP BY doc_id, item_id
"""
