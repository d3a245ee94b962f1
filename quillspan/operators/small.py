"""Small operators: visits along routes, batch numbers, checked search parameters, merges of translation batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import upsert


def visits(routes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """How often each place is an end of a route."""
    return routes.select(F.explode(F.array(a, b)).alias("place")).groupBy("place").agg(F.count("*").alias("n"))


def next_number(names: DataFrame, name: str = "name", pattern: str = r"(\d+)") -> int:
    """One more than the largest number in the names, 1 without any."""
    found = names.select(F.max(F.when(F.col(name).rlike(pattern), F.regexp_extract(name, pattern, 1).cast("long"))).alias("m")).first()["m"]
    return (found or 0) + 1


def checked_params(df: DataFrame, volumes: int = 37) -> DataFrame:
    """Search parameters with what is not allowed set to null: a volume of 1..volumes, an id of letters, digits, _ and -."""
    volume = F.expr("try_cast(vol AS INT)")
    return df.withColumns({"vol": F.when(volume.between(1, volumes), volume), "id": F.when(F.col("id").rlike("^[A-Za-z0-9_-]{1,64}$"), F.col("id"))})


def narrow(hits: DataFrame, vol: int | None = None, cat: str | None = None, quoted: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Hits of one volume, one category, and (given the ids of records that quote) of those alone."""
    if vol is not None:
        hits = hits.where(F.col("v") == vol)
    if cat is not None:
        hits = hits.where(F.col("cat") == cat)
    return hits if quoted is None else hits.join(quoted.select(key), key, "left_semi")


def largest_category(df: DataFrame, cat: str, order: str) -> DataFrame:
    """The category of most rows, if more than one row has it; of equal ones the first seen."""
    counted = df.where(F.coalesce(cat, F.lit("")) != "").groupBy(cat).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(1).where("n > 1").drop("_first")


def applicable(df: DataFrame, flag, name: str = "n") -> DataFrame:
    """How many rows have the flag, and whether that tells them apart: some, but not all."""
    return df.agg(F.count_if(flag).alias(name), F.count("*").alias("total")).withColumn("applies", (F.col(name) > 0) & (F.col(name) < F.col("total")))


def filled_groups(groups: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Groups that have rows, with their number."""
    return groups.select(key).distinct().join(df.groupBy(key).agg(F.count("*").alias("n")), key).where("n > 0")


def endpoints(routes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All places that any route names, once each."""
    return routes.select(F.explode(F.array(a, b)).alias("place")).where("place IS NOT NULL").distinct()


def by_width(ranges: DataFrame, group: str, low: str, high: str, order: str) -> DataFrame:
    """Ranges with their place in their group, the narrowest first (ties by order)."""
    w = Window.partitionBy(group).orderBy(F.col(high) - F.col(low), order)
    return ranges.withColumn("place", F.row_number().over(w) - 1)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A place for each row in an order that depends on key and seed alone, so that it can be repeated."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)


def one_of_each_kind(df: DataFrame, key: list[str], kind: str, order: list[str]) -> DataFrame:
    """The first row of every kind for each key."""
    w = Window.partitionBy(*key, kind).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_translations(done: DataFrame, batch: DataFrame, known: DataFrame, key: str = "id", answer: str = "answer_en") -> tuple[DataFrame, DataFrame]:
    """(merged table, counts of inserted, replaced and unknown): unknown ids and empty answers are left out."""
    valid = batch.where(F.coalesce(F.trim(answer), F.lit("")) != "").join(known.select(key), key, "left_semi")
    merged = upsert(done, valid, key)
    unknown = batch.join(known.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown").alias("op"), "n")
    counts = merged.where("op <> 'kept'").groupBy("op").agg(F.count("*").alias("n")).unionByName(unknown)
    return merged.drop("op"), counts


def volumes_of(hits: DataFrame, volume: str) -> DataFrame:
    """One row: how many volumes the hits are from, and how many hits there are."""
    return hits.agg(F.count_distinct(volume).alias("volumes"), F.count("*").alias("hits"))


def listed(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """place, from 1: the order in which a volume's or a category's rows are listed; equal ones by key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order, key)).cast("long"))


def appended(*lists: DataFrame) -> DataFrame:
    """All rows of lists with the same columns, in whatever order those stand; repeated rows stay."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out
