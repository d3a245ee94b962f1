"""Mixing sources to target weights, with an exact quota of blocks for each source in every output shard.

Targets: the sources, in order, weigh WEIGHTS, repeating, and share SHARE of all words; a target stops at MOST times its source's words,
and the excess is shared by weight among the others until none is above. A source gives its documents in an order that a digest of each
fixes: whole passes, then a beginning, then one document from behind it. The beginning ends where the longest one that fits does, or up to
CUTS documents before, whichever leaves what some document fills best (none, if nothing beats the longest beginning alone).
So a document is taken MOST times at most, and a target is missed by little even where a source has a few documents.

A source's takings, in that order, are cut into blocks of BLOCK documents, its quota. A tree splits the quotas among the shards: at
each node the left half's blocks are a multivariate hypergeometric draw from the node's, so shards and sources come out exact (numpy draws
from up to 1e9 blocks, 16e9 documents; beyond that BLOCK must grow).
Sources are bundled by hash: the tree is drawn for the bundles first (BUNDLES numbers), then for the sources of each bundle in a
task of its own with what the bundle has in every shard, which together is the same distribution. A source's blocks are put in another
order (multiplied by a prime modulo their number), and each shard takes as many as it drew from where the shard before it ended, so
no block is drawn twice. In a shard the documents are ordered by a digest.

No source meets in a task: documents are ranked in cells, the first digits of their digest, whose sums are added up. The driver sees
three sums over the sources and one for each bundle. All draws depend on SEED alone, so reruns agree, on any cluster.

Defined cases: the null source is the last one; null and empty texts have size 0 and are never taken; documents of a source with equal
id and text are alike (which of them is taken more often is not defined); no words at all, or an empty table, give targets of 0;
columns are only carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, materialize, prepare, read_table
from .ordering import numbered

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 13
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a block, blocks of a shard as long as there are at most SHARDS of them, and bundles of sources.
BLOCK, SHARD_BLOCKS, SHARDS, BUNDLES = 16, 1024, 4096, 256
#: Documents that a beginning may be shorter than the longest one that fits.
CUTS = 16
#: Parts that a source's sizes are dealt into, one for so many documents, at most.
SALTS, SALT_ROWS = 4096, 512
#: Digits of the digest that make a cell: a source is ranked in up to 4,096 tasks.
CELL = 3
#: Primes above any number of blocks, to put blocks in another order.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _k (the source, never null), _size (words) and _key (a digest that orders the documents)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    k = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    return docs.withColumns({"_k": k, "_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_key": key})


def targets(sources: DataFrame) -> DataFrame:
    """sources (_k, _words, _n) with _target; the driver sees three sums a round."""
    last = sources.withColumns({"_all": F.lit(""), "_null": F.col("_k") == ""})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    ranked = numbered(last, "_all", ["_null", "_k"], "sources").select("_k", "_words", "_n", weight.cast("double").alias("_weight"))
    whole = ranked.agg(F.sum("_words"), F.sum("_weight")).first()
    total, rest, weights, full = SHARE * (whole[0] or 0), SHARE * (whole[0] or 0), whole[1] or 1.0, 0
    while True:
        share, cap = F.col("_weight") * F.lit(rest) / F.lit(weights), F.lit(float(MOST)) * F.col("_words")
        row = ranked.agg(F.sum(F.when(share > cap, cap)), F.sum(F.when(share <= cap, F.col("_weight"))), F.count(F.when(share > cap, 1))).first()
        if row[2] <= full:
            return ranked.withColumn("_target", F.when(share > cap, cap).otherwise(share)).drop("_weight")
        rest, weights, full = total - row[0], row[1] or 1.0, row[2]


def split(quota: np.ndarray, room: np.ndarray, seed: list[int], first: int = 0):
    """Yields (shard, sources, blocks): how many of each source's quota every shard gets. room: the blocks of each shard, quota.sum() in
    all. The draw of a tree node depends on the seed and the node alone."""
    if len(room) == 1:
        has = np.flatnonzero(quota)
        yield first, has, quota[has]
        return
    half = len(room) // 2
    random = np.random.default_rng([*seed, first, len(room)])
    left = random.multivariate_hypergeometric(quota, int(room[:half].sum()), method="marginals")
    yield from split(left, room[:half], seed, first)
    yield from split(quota - left, room[half:], seed, first + half)


def rooms(blocks: int, shards: int) -> np.ndarray:
    """Blocks of each shard, as even as can be."""
    return np.diff(blocks * np.arange(shards + 1, dtype=np.int64) // shards)


def shares(quotas: DataFrame, shards: int | None = None) -> DataFrame:
    """_k, shard, start, blocks: which of a source's blocks, in their new order, each shard takes. quotas: _k, _blocks."""
    bundled = quotas.select("_k", "_blocks", F.pmod(F.xxhash64("_k"), F.lit(BUNDLES)).cast("int").alias("_bundle"))
    sums = np.zeros(BUNDLES, np.int64)
    for r in bundled.groupBy("_bundle").agg(F.sum("_blocks").alias("n")).collect():
        sums[r["_bundle"]] = r["n"]
    total = int(sums.sum())
    shards = shards or min(SHARDS, -(-total // SHARD_BLOCKS)) or 1

    def run(key, rows):
        room = np.zeros(shards, np.int64)
        for shard, bundles, blocks in split(sums, rooms(total, shards), [SEED]):
            room[shard] = blocks[bundles == key[0]].sum()
        rows = rows.sort_values("_k")
        parts = [pd.DataFrame({"_k": rows["_k"].to_numpy()[has], "shard": shard, "blocks": blocks}) for shard, has, blocks in split(rows["_blocks"].to_numpy(), room, [SEED, key[0]])]
        out = pd.concat(parts)  # by shard
        out["start"] = out.groupby("_k")["blocks"].cumsum() - out["blocks"]
        return out[["_k", "shard", "start", "blocks"]]

    return bundled.groupBy("_bundle").applyInPandas(run, "_k string, shard int, start long, blocks long")


def reordered(block: Column, blocks: Column, k: Column) -> Column:
    """A block's place when a source's blocks are put in another order."""
    mixed = F.xxhash64(k, F.lit(SEED))
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(mixed, F.lit(len(PRIMES))) + 1).cast("int"))
    return (block * prime.cast("long") + F.pmod(mixed, blocks)) % blocks


def ranked(docs: DataFrame) -> DataFrame:
    """The documents of sized(), written, with _words, _n (documents with words) and _target of their source and, where they have words,
    _rank and _before (documents and words ahead in the source)."""
    docs = docs.withColumn("_cell", F.left("_key", F.lit(CELL)))
    cells = materialize(docs.groupBy("_k", "_cell").agg(F.sum("_size").alias("_w"), F.count(F.when(F.col("_size") > 0, 1)).alias("_d")), "cells")
    by = Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(by), F.lit(0))
    sources = targets(materialize(cells.groupBy("_k").agg(F.sum("_w").alias("_words"), F.sum("_d").alias("_n")), "sources"))
    cells = cells.select("_k", "_cell", ahead("_w").alias("_w0"), ahead("_d").alias("_d0")).join(sources, "_k")
    full = F.col("_size") > 0
    inside = Window.partitionBy("_k", "_cell").orderBy((~full).cast("int"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    here = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    out = docs.join(cells, ["_k", "_cell"]).withColumns({"_rank": F.when(full, F.col("_d0") + here(full.cast("long"))), "_before": F.when(full, F.col("_w0") + here("_size"))})
    return materialize(out.drop("_cell", "_w0", "_d0"), "ranked")


def takings(ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of ranked(), a row for each time they are taken, with _copy and _at, the place among all that the source
    gives; _k, _taken: how many a source gives)."""
    passes = F.when(F.col("_words") > 0, sum((F.col("_target") >= i * F.col("_words")).cast("int") for i in range(1, MOST + 1))).otherwise(0)
    rows = ranks.where("_rank IS NOT NULL").withColumn("_passes", passes).withColumn("_rest", F.col("_target") - F.col("_passes") * F.col("_words"))
    fits = F.col("_before") + F.col("_size") <= F.col("_rest")
    sources = rows.groupBy("_k", "_passes", "_n", "_rest").agg(F.count(F.when(fits, 1)).alias("_m"), F.coalesce(F.sum(F.when(fits, F.col("_size"))), F.lit(0)).alias("_w"))
    sources = materialize(sources, "beginnings")
    total = sources.agg(F.sum("_n")).first()[0] or 0
    # Where the beginning may end, and what is then left; a document of any size that stands behind that end may fill it.
    # A source of many documents is dealt to several tasks, by size, each with all its cuts.
    salts = F.least(F.lit(SALTS), F.expr(f"1 + _n div {SALT_ROWS}"))
    near = lookup(rows.where(fits), sources.select("_k", "_n", "_m"), ["_k"], "_n", total, F.col("_key")).where(F.col("_rank") >= F.col("_m") - CUTS).select("_k", F.col("_rank").alias("_cut"), (F.col("_rest") - F.col("_before")).alias("_left"))
    cuts = near.unionByName(sources.select("_k", F.col("_m").alias("_cut"), (F.col("_rest") - F.col("_w")).alias("_left")))
    cuts = cuts.join(sources.select("_k", "_n"), "_k").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_n")
    sizes = rows.groupBy("_k", "_n", "_size").agg(F.max("_rank").alias("_rank")).withColumn("_salt", F.col("_size") % salts)
    sizes = sizes.join(cuts, ["_k", "_salt"]).where(F.col("_rank") >= F.col("_cut"))
    best = sizes.groupBy("_k", "_salt").agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_left")).alias("off"), (-F.col("_cut")).alias("cut"), "_rank")).alias("x"))
    best = best.groupBy("_k").agg(F.min("x").alias("x"))
    ends = sources.join(best, "_k", "left").withColumn("_fill", F.coalesce(F.col("x.off") < F.col("_rest") - F.col("_w"), F.lit(False)))
    ends = ends.select("_k", F.when(F.col("_fill"), -F.col("x.cut")).otherwise(F.col("_m")).alias("_cut"), F.when(F.col("_fill"), F.col("x._rank")).alias("_rank"), (F.col("_passes") * F.col("_n")).alias("_first"), "_n")
    ends = materialize(ends, "ends")
    last = ends.where("_rank IS NOT NULL").select("_k", "_rank", (F.col("_first") + F.col("_cut")).alias("_last"))
    none = F.array().cast("array<long>")
    whole = F.when(F.col("_passes") > 0, F.transform(F.sequence(F.lit(0), F.col("_passes") - 1), lambda p: p * F.col("_n") + F.col("_rank"))).otherwise(none)
    more = F.when(F.col("_rank") < F.col("_cut"), F.array(F.col("_passes") * F.col("_n") + F.col("_rank"))).when(F.col("_last").isNotNull(), F.array("_last")).otherwise(none)
    out = lookup(rows, ends.select("_k", "_n", "_cut"), ["_k"], "_n", total, F.col("_key")).join(last, ["_k", "_rank"], "left").select("*", F.posexplode(F.concat(whole, more)).alias("_copy", "_at")).drop("_passes", "_rest", "_last", "_cut")
    given = ends.select("_k", (F.col("_first") + F.col("_cut") + F.col("_rank").isNotNull().cast("long")).alias("_taken"))
    return out, given


def mix(ranks: DataFrame, shards: int | None = None) -> DataFrame:
    """What ranked() has, a row for each time a document is taken: shard, position (from 0 in the shard), _copy."""
    rows, given = takings(ranks)
    given = materialize(given.where("_taken > 0").withColumn("_blocks", F.ceil(F.col("_taken") / BLOCK)), "quotas")
    drawn = shares(given, shards).select("_k", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("blocks") - 1)).alias("_place"))
    blocks = given.select("_k", "_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    placed = blocks.withColumn("_place", reordered(F.col("_block"), F.col("_blocks"), F.col("_k"))).join(drawn, ["_k", "_place"]).select("_k", "_block", "shard")
    out = rows.withColumn("_block", F.expr(f"_at div {BLOCK}")).join(placed, ["_k", "_block"])
    order = Window.partitionBy("shard").orderBy(F.md5(F.concat("_key", F.lit(":"), F.col("_copy").cast("string"))), "_key", "_copy")
    return out.withColumn("position", (F.row_number().over(order) - 1).cast("long")).drop("_block", "_at")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None) -> DataFrame:
    """docs, each row as often as the mix takes it, with shard and position; texts are written once to the shared folder."""
    prepare(docs.sparkSession)
    return mix(ranked(sized(docs, id_col, text_col, source_col)), shards).select(*docs.columns, "shard", "position")


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "text", "source")
    ranks = ranked(materialize(docs.select("doc_id", "_k", "_size", "_key"), "sizes"))
    taken = mix(ranks).groupBy("_k", "_rank").agg(F.sum("_size").alias("taken"))
    both = ranks.join(taken, ["_k", "_rank"], "left")
    return both.select("doc_id", F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, '') AS k, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS MATERIALIZED (SELECT k, sum(size)::BIGINT AS words, count(*) FILTER (size > 0) AS n, (ARRAY{list(map(float, WEIGHTS))})[(row_number() OVER (ORDER BY k = '', k) - 1) % {len(WEIGHTS)} + 1] AS weight FROM d GROUP BY k),
x AS (SELECT 0 AS i, {SHARE} * sum(words)::DOUBLE AS rest, sum(weight) AS w, 0 AS full FROM s
      UNION ALL SELECT * FROM (SELECT x.i + 1, (SELECT {SHARE} * sum(words)::DOUBLE FROM s) - sum(CASE WHEN weight * rest / w > {MOST}.0::DOUBLE * words THEN {MOST}.0::DOUBLE * words ELSE 0 END), sum(CASE WHEN weight * rest / w > {MOST}.0::DOUBLE * words THEN 0 ELSE weight END), count(*) FILTER (weight * rest / w > {MOST}.0::DOUBLE * words) AS now FROM x, s GROUP BY x.i, x.full HAVING count(*) FILTER (weight * rest / w > {MOST}.0::DOUBLE * words) > x.full)),
t AS (SELECT k, words, n, least(weight * rest / w, {MOST}.0::DOUBLE * words) AS target FROM s, (SELECT * FROM x ORDER BY i DESC LIMIT 1)),
p AS (SELECT *, CASE WHEN words > 0 THEN {' + '.join(f'(target >= {i} * words)::INT' for i in range(1, MOST + 1))} ELSE 0 END AS passes FROM t),
r AS (SELECT d.*, words, target, passes, target - passes * words AS rest, CASE WHEN size > 0 THEN row_number() OVER (PARTITION BY k ORDER BY size = 0, key) - 1 END AS place,
      coalesce(sum(size) OVER (PARTITION BY k ORDER BY size = 0, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN p USING (k)),
f AS (SELECT *, size > 0 AND before + size <= rest AS fits FROM r),
w AS (SELECT k, count(*) FILTER (fits) AS m, any_value(rest) - sum(CASE WHEN fits THEN size ELSE 0 END) AS missing FROM f WHERE size > 0 GROUP BY k),
c AS (SELECT f.k, place AS cut, rest - before AS missing FROM f JOIN w USING (k) WHERE fits AND place >= m - {CUTS} UNION ALL SELECT k, m, missing FROM w),
z AS (SELECT k, size, max(place) AS place FROM f WHERE size > 0 GROUP BY ALL),
e AS (SELECT z.k, z.place, cut FROM z JOIN c ON c.k = z.k AND z.place >= cut JOIN w ON w.k = z.k WHERE abs(size - c.missing) < w.missing QUALIFY row_number() OVER (PARTITION BY z.k ORDER BY abs(size - c.missing), cut DESC, z.place) = 1)
SELECT doc_id, size, words AS source_size, target, (size * (CASE WHEN size > 0 THEN passes ELSE 0 END + CASE WHEN size > 0 AND (place < coalesce(e.cut, w.m) OR place = e.place_) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM f LEFT JOIN w ON w.k = f.k LEFT JOIN (SELECT k, place AS place_, cut FROM e) e ON e.k = f.k
"""
QUERIES = {"op13_mix": op13_mix}
ORACLE_SQL = {"op13_mix": SQL}
