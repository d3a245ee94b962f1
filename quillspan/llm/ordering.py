"""Deals rows into ranges of ascending identifiers, each sorted, without a global sort of the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_or_sentinel, materialize, partitions

#: Ranges for each partition: enough that hashing ranges to partitions comes out even.
RANGES = 3


def _range_of(key, borders: list[int]):
    """How many borders are at most key, by binary search in a literal array."""
    if not borders:
        return F.lit(0)
    table, steps = F.lit(borders), len(borders).bit_length() + 1
    # (lo, hi): the first lo borders are at most key, the ones from hi on are above it
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = F.get(table, mid) <= key
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~low, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]


def ranged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """(doc_id, text, range) rows and the borders: a row's range is the number of borders that are at most its doc_id.

    A null doc_id becomes NULL_ID. The number of borders follows spark.sql.shuffle.partitions, not the rows."""
    rows = docs.select(id_or_sentinel(F.col(id_col).cast("long")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = partitions(docs.sparkSession) * RANGES
    share = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", F.lit(share), F.lit(max(10_000, 20 * n))).alias("b")).first()["b"] if share else []
    borders = sorted(set(found or []))
    return rows.withColumn("range", _range_of(F.col("doc_id"), borders)), borders


def real_id(col):
    return F.when(F.col(col) != NULL_ID, F.col(col))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with idx, their places from 0 among the rows of their group by order (nulls first), and n, how many those are.

    group has no nulls. The rows are dealt to ordered ranges of (group, *order) and written once, so no group meets in a task; a row's
    place is that in its range, corrected by the sizes of the group's earlier ranges and of the range's earlier groups."""
    ranges = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = materialize(ranges.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), name)
    cells = kept.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = before(Window.partitionBy(group).orderBy("_p")) - before(Window.partitionBy("_p").orderBy(group))
    cells = cells.select(group, "_p", shift.alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    place = F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_shift")
    return kept.join(cells, [group, "_p"]).withColumn("idx", place).drop("_p", "_m", "_shift")
