"""Jaccard join of documents on word shingles by adaptive multi-match prefixes.

A document's shingles are ordered by hash. If two sets are linked, each holds 75 % of the other, and their first P + l - 1
shingles (P = n - ceil(0.75 n) + 1) have l in common. Shingles in more than HOT texts are costly candidates, so a document's
prefix is lengthened until, with h costly shingles in it, l - h reaches MATCH: only the others are joined. A pair needs MATCH of
them in common and, more sharply, as many as its overlap lacks when all that its prefixes don't show is taken as common. A
document whose room for longer prefixes ends (many costly shingles) takes its whole set as its prefix; the rest are texts
that consist of costly shingles for three quarters: families of near copies. With costly shingles last in their order, what a
family's pairs must share lies in the few first costly ones: a set with c of them gives the first c - ceil(0.75 n) + 1.

Links are wanted for their components, so pairs inside a component are not all made: first each document is verified against
the pivot it shares most with (pairs linear in rows), then only pairs whose components still differ. Of a family, the pivots are
the documents with the largest share of costly shingles, and pairs that too few of these rule out aren't made. Texts with equal sets (128-bit hash) are one node throughout. Tables are written once and deleted
when their reader is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import body, cut, forget, free_name, keep_rows
from scholia.llm.components import connected_components
from scholia.llm.shingles import lists, shingle_sets

#: A shingle in more texts than this is costly; the table of costly ones that tasks get is bounded, exactness doesn't hang on it.
HOT = 50
HOT_ROWS = 200_000
MATCH = 3
PIVOTS = 3
#: Key tables are broadcast up to this many rows (counted first) and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: So are the sets of candidates up to this many shingles.
BROADCAST_SHINGLES = 2_000_000


def need(n):
    """Shingles of a set of n that a linked set must hold."""
    return (3 * n + 3) // 4


def wanted(n):
    """Common shingles asked for, costly ones apart."""
    return np.minimum(MATCH, need(n))


def base_size(n):
    """Length of the prefix of a set of n without costly shingles."""
    return np.where(n > 0, n - need(n) + wanted(n), 0)


def _prefix_rows(batches):
    """doc_id, _th, _s (hash of the set), _n, _prefix of rows doc_id, _th, _text."""
    for batch in batches:
        for lo, hi, s, at in shingle_sets(batch.column(2)):
            n = np.diff(at)
            names = [xxhash.xxh3_128_digest(s[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(names, pa.binary()), pa.array(n), lists(s, at[:-1], base_size(n))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_th", "_s", "_n", "_prefix"])


def _set_rows(batches):
    """_th, _all of rows _th, _text."""
    for batch in batches:
        for lo, hi, s, at in shingle_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists(s, at[:-1], np.diff(at))], names=["_th", "_all"])


def _costly(flat: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of flat are in the sorted array hot."""
    if not len(hot):
        return np.zeros(len(flat), bool)
    return hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat


def _light_rows(hot, flagged: bool):
    """Rows (node, n, prefix) whose prefix has no costly shingle, or keys (node) of the others."""

    def run(batches):
        for batch in batches:
            prefix = batch.column(2)
            touched = np.array([bool(_costly(np.asarray(x), hot.value).any()) for x in (y.values for y in prefix)], bool)
            if flagged:
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(touched))], names=["_node"])
            else:
                yield batch.filter(pa.array(~touched))

    return run


def _longer_rows(hot):
    """Rows (_th, _text) of documents with costly shingles to _th, _n, _light, _rest, _last, _tokens, _family.

    Light: the shingles of the lengthened prefix but the costly ones; _rest: how many of the set those are not; _last: the
    prefix's last hash. Others: all shingles but the costly ones, and the costly ones that a family's prefix has.
    """

    def run(batches):
        for batch in batches:
            for lo, hi, s, at in shingle_sets(batch.column(1)):
                costly = _costly(s.view(np.int64), hot.value)
                out = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = b - a
                    p, own = n - need(n) + 1, s[a:b]
                    room = min(n * 85 // 1000 + 6, need(n) - 1)
                    matches = np.arange(1, room + 2) - np.cumsum(costly[a:b])[p - 1 : p + room] if n else np.zeros(0)
                    k = int(np.argmax(matches >= wanted(n))) if n and (matches >= wanted(n)).any() else -1
                    end = p + k if k >= 0 else n
                    tokens = own[:end][~costly[a : a + end]]
                    family = own[costly[a:b]] if k < 0 else own[:0]
                    family = family[: max(0, len(family) - need(n) + 1)]
                    ends = own[end - 1 : end] if k >= 0 else family[-1:]
                    out.append((n, k >= 0, n - len(tokens), int(ends[0]) >> 1 if len(ends) else 0, tokens, family))
                n, light, rest, last, tokens, family = zip(*out, strict=True)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(light), pa.array(rest, pa.int64()), pa.array(last, pa.int64())]
                columns += [pa.array([x.view(np.int64) for x in c], pa.list_(pa.int64())) for c in (tokens, family)]
                yield pa.RecordBatch.from_arrays(columns, names=["_th", "_n", "_light", "_rest", "_last", "_tokens", "_family"])

    return run


def narrow(df: DataFrame, keys: DataFrame, on, how: str = "left_semi") -> DataFrame:
    """Join with a written table of keys, by broadcast if its counted size allows."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def _most_common(counts: DataFrame) -> np.ndarray:
    """Sorted shingles in more than HOT texts, the HOT_ROWS most frequent at most."""
    rows = counts.filter(F.col("_df") > HOT).orderBy(F.desc("_df"), "_token").limit(HOT_ROWS).select("_token")
    return np.sort(np.array([r["_token"] for r in rows.collect()], np.int64))


def needed(n: Column) -> Column:
    return F.floor((n * 3 + 3) / 4)


class Join:
    def __init__(self, documents: DataFrame):
        self.texts = documents.select(F.xxhash64("doc_id", body("text")).alias("_th"), body("text").alias("_text"))
        kind = documents.schema["doc_id"].dataType.simpleString()
        rows = documents.select("doc_id", F.xxhash64("doc_id", body("text")).alias("_th"), body("text").alias("_text"))
        rows = rows.mapInArrow(_prefix_rows, f"doc_id {kind}, _th long, _s binary, _n long, _prefix array<long>")
        self.prefixes = cut(rows.withColumn("_uid", F.monotonically_increasing_id()), "prefixes")
        rows = self.prefixes.drop("_prefix")
        first = cut(rows.groupBy("_s").agg(F.min("_uid").alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c"), "equal-sets")
        rows = narrow(rows, first, "_s", "left").withColumn("node", F.coalesce("_first", "_uid"))
        self.docs = cut(rows.select("doc_id", "_th", "_uid", "node", "_n"), "nodes")
        forget(first)
        self.nodes = self.docs.filter("_uid = node and _n > 0").select("node", "_th", "_n")

    def tokens(self) -> tuple[DataFrame, DataFrame]:
        """Rows (_token, node, _r, _light, _rest, _last, _df) of the lengthened prefixes; rows (_token, node, _rest, _last) of families."""
        spark = self.docs.sparkSession
        copies = cut(self.docs.filter("_uid <> node").select("_uid"), "copies")
        base = narrow(self.prefixes.filter("_n > 0"), copies, "_uid", "left_anti").select(F.col("_uid").alias("_node"), "_n", "_prefix")
        counts = base.select(F.explode("_prefix").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_df"))
        hot, flagged, longer = self.lengthened(base, _most_common(counts))
        # costly shingles that only longer prefixes and whole sets show
        late = _most_common(longer.select(F.explode("_tokens").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_df")))
        if len(late):
            forget(flagged, longer)
            hot, flagged, longer = self.lengthened(base, np.union1d(hot.value, late))

        n, least = F.col("_n"), F.least(F.lit(MATCH), needed(F.col("_n"))).cast("int")
        last = F.shiftrightunsigned(F.element_at("_prefix", -1), 1)
        light = base.mapInArrow(_light_rows(hot, False), "_node long, _n long, _prefix array<long>")
        light = light.select(F.explode("_prefix").alias("_token"), F.col("_node").alias("node"), F.lit(True).alias("_light"))
        light = light.unionByName(longer.select(F.explode("_tokens").alias("_token"), "node", "_light"))
        dfs = light.groupBy("_token").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
        rows = cut(light.join(dfs, "_token"), "shared")

        # costly shingles of the whole sets, with those that only the whole sets have made costly
        seen = rows.filter(~F.col("_light")).groupBy("node").agg(F.count_if(F.col("_df") > HOT).alias("_late"))
        heavy = longer.filter("not _light").join(seen, "node", "left").withColumn("_rest", F.col("_rest") + F.coalesce("_late", F.lit(0)))
        slack = (needed(n) - F.col("_rest")).cast("int")
        info = longer.filter("_light").select("node", "_n", least.alias("_r"), "_rest", "_last")
        info = info.unionByName(heavy.select("node", "_n", F.least(F.lit(MATCH), F.greatest(F.lit(1), slack)).alias("_r"), "_rest", F.lit((1 << 63) - 1).alias("_last")))
        plain = narrow(base, cut(longer.select(F.col("node").alias("_node")), "longer-nodes"), "_node", "left_anti")
        info = info.unionByName(plain.select(F.col("_node").alias("node"), "_n", least.alias("_r"), (n - F.size("_prefix")).alias("_rest"), last.alias("_last")))
        full = heavy.filter(slack <= 0)
        common = F.col("_rest")  # pairs that have other shingles in common as well are met by those
        size = F.size("_family") + F.coalesce("_late", F.lit(0))
        full = full.select("node", "_n", F.lit(1).alias("_r"), (common - size).alias("_rest"), "_last", common.alias("_common"), "_family")
        late = rows.filter(~F.col("_light") & (F.col("_df") > HOT)).select("_token", "node")
        family = full.select(F.explode("_family").alias("_token"), *[c for c in full.columns if c != "_family"]).unionByName(late.join(full.drop("_family"), "node"))
        rows_of = rows.join(info, "node").withColumn("_common", n)
        out = cut(rows_of, "rows"), cut(family, "family")
        forget(copies, flagged, longer, rows, self.prefixes)
        return out

    def lengthened(self, base: DataFrame, costly: np.ndarray):
        """Broadcast costly shingles; _th, node of the nodes with one in their prefix; what _longer_rows() makes of them."""
        hot = base.sparkSession.sparkContext.broadcast(costly)
        flagged = base.mapInArrow(_light_rows(hot, True), "_node long")
        flagged = cut(flagged.join(self.nodes.select(F.col("node").alias("_node"), "_th"), "_node"), "costly")
        keys = cut(flagged.select("_th"), "costly-texts")
        longer = narrow(self.texts, keys, "_th").mapInArrow(_longer_rows(hot), "_th long, _n long, _light boolean, _rest long, _last long, _tokens array<long>, _family array<long>")
        longer = cut(longer.dropDuplicates(["_th"]).join(flagged.select("_th", F.col("_node").alias("node")), "_th"), "longer")
        forget(keys)
        return hot, flagged, longer

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are linked."""
        na, nb = (self.nodes.select(F.col("node").alias(k), F.col("_n").alias(f"n{k}"), F.col("_th").alias(f"th{k}")) for k in "ab")
        near = (F.col("na") * 4 >= F.col("nb") * 3) & (F.col("nb") * 4 >= F.col("na") * 3)
        pairs = cut(pairs.join(na, "a").join(nb, "b").filter(near).select("a", "b", "na", "nb", "tha", "thb"), "pairs")
        keys = cut(pairs.select(F.col("tha").alias("_th")).union(pairs.select("thb")).distinct(), "texts")
        sets = narrow(self.texts, keys, "_th").mapInArrow(_set_rows, "_th long, _all array<long>")
        sets = cut(sets.dropDuplicates(["_th"]), "sets")
        few = (sets.agg(F.sum(F.size("_all"))).first()[0] or 0) <= BROADCAST_SHINGLES
        x, y = (sets.select(F.col("_th").alias(f"th{k}"), F.col("_all").alias(f"all{k}")) for k in "ab")
        x, y = (F.broadcast(x), F.broadcast(y)) if few else (x, y)
        checked = pairs.join(x, "tha").join(y, "thb").withColumn("_i", F.size(F.array_intersect("alla", "allb")))
        links = cut(checked.filter(F.col("_i") * 100 >= (F.col("na") + F.col("nb") - F.col("_i")) * 75).select("a", "b"), "links")
        forget(pairs, keys, sets)
        return links


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    """Each node with the pivot that it shares most shingles with; pivots of a shingle: the nodes with the largest share of
    common shingles, equal shares by salted hashes."""
    share = F.col("_common") / F.col("_n")
    pivots = rows.groupBy("_token").agg(*[F.max_by("node", F.struct(share, F.xxhash64("node", F.lit(i)))).alias(f"p{i}") for i in range(PIVOTS)])
    near = rows.join(pivots, "_token").select("node", "_r", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("_pivot"))
    near = near.filter("node <> _pivot").groupBy("node", "_pivot").agg(F.count(F.lit(1)).alias("_m"), F.min("_r").alias("_r")).filter("_m >= _r")
    near = near.groupBy("node").agg(F.max_by("_pivot", F.struct("_m", F.xxhash64("_pivot"))).alias("_pivot"))
    return near.select(F.least("node", "_pivot").alias("a"), F.greatest("node", "_pivot").alias("b")).distinct()


def _crossing_pairs(rows: DataFrame, component: DataFrame, first: Column) -> DataFrame:
    """Pairs of nodes of different components with enough common shingles; `first` says which rows pair with all others."""
    rows = rows.join(component.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("_token").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.mode("component", True).alias("_most")).filter("l <> h")
    rows = rows.join(mixed.select("_token", "_most"), "_token")
    side = lambda k: [F.col("node").alias(k), F.col("component").alias(f"c{k}"), F.struct("_last", "_rest").alias(f"s{k}"), F.col("_r").alias(f"r{k}"), F.col("_n").alias(f"n{k}"), F.col("_common").alias(f"m{k}")]
    x = rows.filter(first).select("_token", *side("x"))
    y = rows.select("_token", *side("y"), first.alias("fy"))
    # if both are first, the pair is met twice and counted from the smaller node
    possible = F.least("mx", "my") * 175 >= (F.col("nx") + F.col("ny")) * 75
    pairs = x.join(y, "_token").filter(possible & (F.col("cx") != F.col("cy")) & (~F.col("fy") | (F.col("x") < F.col("y"))))
    # what the prefix that ends first doesn't show; if ends are equal, the larger rest
    low = F.when(F.col("sx._last") == F.col("sy._last"), F.greatest("sx._rest", "sy._rest")).otherwise(F.least("sx", "sy")["_rest"])
    pairs = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("_m"), F.min(F.least("rx", "ry")).alias("_r"), F.min(low).alias("_rest"), F.min(F.col("nx") + F.col("ny")).alias("_size"))
    # all common shingles outside of the rest were counted
    return pairs.filter((F.col("_m") >= F.col("_r")) & ((F.col("_m") + F.col("_rest")) * 175 >= F.col("_size") * 75)).select("a", "b")


def _components(documents: DataFrame) -> DataFrame:
    """doc_id, _th, n_shingles, component of each row."""
    join = Join(documents)
    rows, family = join.tokens()
    links = join.verified(_pivot_pairs(rows).unionByName(_pivot_pairs(family)).distinct())
    component = connected_components(links)
    light, common = F.col("_light"), F.col("_df") > HOT
    # of a shingle that only whole sets have made costly, pairs of whole sets aren't needed
    crossing = _crossing_pairs(rows, component, light | ~common)
    # of a family, what the pivots have joined meets only what they have not
    crossing = crossing.unionByName(_crossing_pairs(family, component, F.col("component") != F.col("_most"))).distinct()
    more = join.verified(crossing)
    forget(component, rows, family)
    component = connected_components(links.unionByName(more))
    forget(links, more)

    docs = join.docs.select("doc_id", "_th", "node", F.col("_n").alias("n_shingles"))
    return docs.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def jaccard_components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null text counts as empty; a document without words is linked with nothing. Documents with equal sets are linked. Rows of
    one doc_id are documents of their own that share their id; a null id is larger than any other. An empty table gives no
    rows; other columns are ignored.
    """
    docs = _components(documents)
    least = docs.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("_least"))
    docs = docs.join(least, "component", "left")
    return docs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """documents with one row of each component: one with the smallest id. Documents without words all stay.

    All columns stay, whatever their names. Null texts have no words, null ids give way to others, repeated rows are one
    component, an empty table gives no rows.
    """
    name = free_name(documents, "_th")
    docs = _components(documents).filter("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "_th")  # null ids last
    docs = docs.join(docs.groupBy("component").agg(F.min(row).alias("_least")), "component")
    kept = F.col("doc_id").eqNullSafe(F.col("_least.doc_id")) & (F.col("_th") == F.col("_least._th"))
    rows = documents.withColumn(name, F.xxhash64("doc_id", body("text")))
    return keep_rows(rows, docs.select("doc_id", F.col("_th").alias(name), kept.alias("kept")), ["doc_id", name]).drop(name)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""
