"""Connected components of an edge table by alternating large-star and small-star, on DataFrames alone.

Both joins are on the complement of the node, by which neither side is dealt yet: so both sides are plain shuffles, and
adaptive execution may split the partition of a node of very many edges. Each round's edges are written, and those of the
round before deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _met(e: DataFrame, least: DataFrame) -> DataFrame:
    w = F.bitwise_not("u").alias("w")
    return e.select("u", "v", w).join(least.select(w, "m"), "w")


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u gets an edge to the smallest of u and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _met(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours all get an edge to the smallest of them. Edges come with u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = _met(e, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, component (the smallest node it reaches), for nodes with an edge to another node.

    Loops, repeated edges and edges in both directions are allowed; without edges the result is empty. Null ends are dropped."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(ordered, "edges")
    state = _state(now)
    while state[0]:
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
