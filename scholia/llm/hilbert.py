"""Shards cut from a Hilbert curve over the metadata.

Size, source and language are each quantised to 16 levels; a row's cell is its point in the 16 x 16 x 16 cube, and cells are
ordered by their Hilbert index, so a shard covers a compact box of all three dimensions and readers can skip shards by any of
them. Inside a cell, rows go by a salt of the id and then by id: a cell that holds a third of all rows is numbered by `SALTS`
independent windows. Starts come from counts per (cell, salt); only the table of 4,096 cells is ever in one partition.

Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.common import body

SHARDS = 16
SALTS = 1024
BITS = 4
DIMS = ["_x0", "_x1", "_x2"]


def level(name: Column) -> Column:
    """One of 16 levels for a name; null has the level of the empty name."""
    return F.conv(F.substring(F.md5(F.coalesce(name, F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % (1 << BITS)


def size_level(size: Column) -> Column:
    """Level of a size: its power of two, 16 bytes or less as 0, half a megabyte or more as 15."""
    return F.least(F.lit(15), F.greatest(F.lit(0), F.length(F.bin(size)) - 5))


def salt(id_: Column) -> Column:
    """One of 1,024 parts of a cell, by the id's digest; null has the part of the empty id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int") % SALTS


def with_hilbert_index(cells: DataFrame, dims: list[str] = DIMS, bits: int = BITS, out: str = "_curve") -> DataFrame:
    """Add the Hilbert index of integer coordinates below 2**bits (gray-code walk, highest bit first)."""
    own = [f"_h{i}" for i in range(len(dims))]
    df = cells.withColumns({h: F.col(d).cast("long") for h, d in zip(own, dims, strict=True)})
    bit = lambda c, q: F.shiftright(F.col(c), q).bitwiseAND(F.lit(1))
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for i, h in enumerate(own):
            swap = F.col(own[0]).bitwiseXOR(F.col(h)).bitwiseAND(F.lit(low))
            flip = bit(h, q) == 1
            df = df.withColumns(
                {own[0]: F.when(flip, F.col(own[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(own[0]).bitwiseXOR(swap))}
                | ({h: F.when(flip, F.col(h)).otherwise(F.col(h).bitwiseXOR(swap))} if i else {})
            )
    for i in range(1, len(own)):
        df = df.withColumn(own[i], F.col(own[i]).bitwiseXOR(F.col(own[i - 1])))
    turn = F.lit(0).cast("long")
    for q in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(bit(own[-1], q) == 1, F.lit((1 << q) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_turn", turn)
    df = df.withColumns({h: F.col(h).bitwiseXOR(F.col("_turn")) for h in own})
    index = sum(
        (F.shiftleft(bit(h, q), q * len(own) + len(own) - 1 - i) for q in range(bits) for i, h in enumerate(own)),
        F.lit(0).cast("long"),
    )
    return df.withColumn(out, index).drop("_turn", *own)


def hilbert_shards(
    documents: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    name_cols: tuple[str, str] = ("source", "lang"),
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: runs of equal row counts along the curve.

    The law is `rows`: counts of two shards differ by one at most. A null text has size 1 and the checksum of the empty
    text, null names count as empty names, repeated rows each get a slot of their own. With fewer rows than shards, some
    shards stay empty; an empty table gives no rows.
    """
    text = F.col(text_col)
    rows = documents.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_n"),
        F.crc32(body(text_col).cast("binary")).alias("text_crc32"),
        level(F.col(name_cols[0])).alias("_x1"),
        level(F.col(name_cols[1])).alias("_x2"),
        salt(F.col(id_col)).alias("_salt"),
    ).withColumn("size", F.col("_n") + 1)
    rows = rows.withColumn("_x0", size_level(F.col("size"))).drop("_n")

    counts = rows.groupBy(*DIMS, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    cells = with_hilbert_index(counts.groupBy(*DIMS).agg(F.sum("_rows").alias("_cell_rows")))
    along = Window.partitionBy().orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 cells
    cells = cells.select(
        *DIMS,
        F.coalesce(F.sum("_cell_rows").over(along), F.lit(0)).alias("_cell_start"),
        F.sum("_cell_rows").over(Window.partitionBy()).alias("_all"),
    )
    within = Window.partitionBy(*DIMS).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_salt_start", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    starts = starts.join(F.broadcast(cells), DIMS).select(
        *DIMS, "_salt", (F.col("_cell_start") + F.col("_salt_start")).alias("_start"), "_all"
    )
    own = Window.partitionBy(*DIMS, "_salt").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_in", F.row_number().over(own) - 1).join(starts, [*DIMS, "_salt"])
    placed = placed.withColumn("_at", F.col("_start") + F.col("_in"))
    return placed.withColumn("shard", F.expr(f"(_at * {shards}) div _all").cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        # the first position of a shard is its number times all rows, divided by shards, rounded up
        (F.col("_at") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _walk() -> str:
    """The curve index as SQL steps over (x0, x1, x2), the same walk one bit at a time."""
    steps, at = ["c0 AS (SELECT *, x0 AS a0, x1 AS a1, x2 AS a2 FROM dims)"], 0
    for q in range(BITS - 1, 0, -1):
        low = (1 << q) - 1
        for i in range(3):
            swap, flip = f"(xor(a0, a{i}) & {low})", f"(a{i} >> {q}) & 1 = 1"
            put = [f"CASE WHEN {flip} THEN xor(a0, {low}) ELSE xor(a0, {swap}) END AS a0"]
            put += [f"CASE WHEN {flip} THEN a{i} ELSE xor(a{i}, {swap}) END AS a{i}"] if i else []
            steps.append(f"c{at + 1} AS (SELECT * REPLACE ({', '.join(put)}) FROM c{at})")
            at += 1
    turn = "0"
    for q in range(BITS - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN (g2 >> {q}) & 1 = 1 THEN {(1 << q) - 1} ELSE 0 END)"
    steps.append(f"gray AS (SELECT *, a0 AS g0, xor(a1, a0) AS g1, xor(a2, xor(a1, a0)) AS g2 FROM c{at}), turned AS (SELECT *, {turn} AS turn FROM gray)")
    index = " + ".join(f"(((xor(g{i}, turn) >> {q}) & 1) << {3 * q + 2 - i})" for q in range(BITS) for i in range(3))
    return ", ".join(steps) + f", curve AS (SELECT *, {index} AS curve FROM turned)"


_LEVEL = "instr('0123456789abcdef', substr(md5(coalesce({c}, '')), 4, 1)) - 1"


def _nibble(i: int) -> int:
    """The checksum's share of four bits (reversed polynomial)."""
    for _ in range(4):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


_TABLE = f"([{', '.join(str(_nibble(i)) for i in range(16))}]::BIGINT[])"
_LOW = f"{_TABLE}[1 + (xor(a, b) & 15)]"
_STEP = f"xor(xor(a, b) >> 8, xor({_LOW} >> 4, {_TABLE}[1 + (xor(xor(a, b) >> 4, {_LOW}) & 15)]))"
#: The checksum is folded over the bytes, four bits at a time.
SQL = f"""WITH docs AS (SELECT doc_id, source, lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (SELECT doc_id, source, lang, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: {_STEP})) AS text_crc32 FROM docs),
dims AS (SELECT *, CAST(least(15, greatest(0, length(bin(size)) - 5)) AS BIGINT) AS x0, {_LEVEL.format(c="source")} AS x1, {_LEVEL.format(c="lang")} AS x2,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INT) % {SALTS} AS salt FROM summed),
{_walk()}, placed AS (SELECT *, row_number() OVER (ORDER BY curve, salt, doc_id NULLS FIRST, text_crc32, size) - 1 AS at_, count(*) OVER () AS n FROM curve)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(at_ * {SHARDS} // n AS INT) AS shard, CAST(at_ - ((at_ * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM placed"""
