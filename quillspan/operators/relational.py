"""Joins, merges, windows and samples that the analytics need beyond the plain ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written


def narrowest_range(facts: DataFrame, ranges: DataFrame, on: list[str], value: str, key: list[str], low: str = "lo", high: str = "hi", title: str = "title", order: str = "ord") -> DataFrame:
    """Each fact with the title of the narrowest range that holds its value (ties by order), "" without one.

    The ranges meet the facts on `on` first, and the best is kept by an aggregate, not a sort."""
    meet = F.col(value).between(F.col(low), F.col(high))
    best = facts.select(*key, *on, value).join(ranges, on).where(meet).groupBy(*key).agg(F.min_by(title, F.struct(F.col(high) - F.col(low), F.col(order))).alias(title))
    return facts.join(best, key, "left").withColumn(title, F.coalesce(title, F.lit("")))


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, keep: list[str]) -> DataFrame:
    """Each left row with the columns `keep` of the last right row of its key that is not later. One sort of both sides
    together, so no left row meets more than one right row."""
    r = right.select(*on, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*keep).alias("_r"))
    names = [c for c in left.columns if c not in on]
    le = left.select(*on, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_l"))
    w = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(le, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*on, "_l.*", "_r.*")


def contains_in_text(needles: DataFrame, needle: str, haystack: str) -> DataFrame:
    """Where each needle first occurs in one text (0-based, null where nowhere): a literal, so no join."""
    at = F.position(F.col(needle), F.lit(haystack))
    return needles.withColumn("at", F.when((F.length(needle) > 0) & (at > 0), at - 1))


def shingle_join(left: DataFrame, right: DataFrame, n: int, left_words: str, right_words: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, left_pos, right_pos) of every common n-word shingle, by an equi-join."""
    def grams(df, words, key, prefix):
        x = df.where(F.size(words) >= n).select(F.col(key).alias(f"{prefix}_id"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).alias(f"{prefix}_pos", "gram"))
        return x

    return grams(left, left_words, left_id, "left").join(grams(right, right_words, right_id, "right"), "gram").drop("gram")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows by key, new values over old ones, with op: kept, replaced or inserted."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("_o"))
    n = new.select(key, F.struct(*cols).alias("_n"))
    op = F.when(F.col("_n").isNull(), "kept").when(F.col("_o").isNull(), "inserted").otherwise("replaced")
    return o.join(n, key, "full_outer").select(key, *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in cols], op.alias("op"))


def require_complete(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join, if every left key has a partner; otherwise an error, before anything is written."""
    if missing := left.join(right, on, "left_anti").select(*on).limit(5).collect():
        raise ValueError(f"no partner for {missing}")
    return left.join(right, on)


def neighbours(df: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.select(group, key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("following"))


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an order-preserving distinct."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def round_robin(df: DataFrame, group: str, order: list[str], least: int) -> DataFrame:
    """Whole rounds of one row of each group, up to the first round with which `least` rows are reached."""
    ranked = df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    sizes = ranked.groupBy("round").agg(F.count("*").alias("n")).select("round", F.sum("n").over(Window.orderBy("round")).alias("total"))
    last = sizes.agg(F.min(F.when(F.col("total") >= least, F.col("round"))).alias("last"))
    return ranked.crossJoin(F.broadcast(last)).where("last IS NULL OR round <= last").drop("last")


def stratified(df: DataFrame, flag: Column, total: int, order: list[str], share: float = 0.4) -> DataFrame:
    """Up to share of total rows with the flag, the rest without, each by order."""
    quota = int(total * share)
    return df.where(flag).orderBy(*order).limit(quota).unionByName(df.where(~flag).orderBy(*order).limit(total - quota))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def running_starts(df: DataFrame, group: list[str], order: str, length: Column) -> DataFrame:
    """Where each row's text begins if a group's texts stand one after another."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))


#: Points that a line or a set of places may have: they go into the plan as literals.
POINTS = 10_000


def _sorted_points(points: DataFrame, x: str, value: str) -> tuple[list, list]:
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(value).alias("v")).orderBy("x").limit(POINTS + 1).collect()
    if len(rows) > POINTS:
        raise ValueError(f"more than {POINTS} points")
    return [r["x"] for r in rows], [r["v"] for r in rows]


def rank_in(ascending: list[float], x: Column) -> Column:
    """How many of the numbers are at most x, by binary search in a literal array."""
    if not ascending:
        return F.lit(0)
    table = F.lit(ascending)

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = F.get(table, mid) <= x
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & under, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~under, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ascending)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ascending).bit_length() + 1)), start, step)["lo"]


def interpolate(points: DataFrame, queries: DataFrame, x: str, y: str) -> DataFrame:
    """y at the queries' x on the polygon through points (POINTS at most); constant beyond its ends, null without any."""
    xs, ys = _sorted_points(points, x, y)
    if not xs:
        return queries.withColumn(y, F.lit(None).cast("double"))
    at = F.least(F.greatest(F.col("_r"), F.lit(1)), F.lit(max(1, len(xs) - 1))) - 1
    of = lambda values, i: F.get(F.lit([float(v) for v in values]), i)
    ranked = queries.withColumn("_r", rank_in(xs, F.col(x))).withColumn("_i", at)
    a, b = F.col("_i"), F.least(F.col("_i") + 1, F.lit(len(xs) - 1))
    inside = F.least(F.greatest(F.col(x), of(xs, a)), of(xs, b))
    slope = F.coalesce((of(ys, b) - of(ys, a)) / F.nullif(of(xs, b) - of(xs, a), F.lit(0.0)), F.lit(0.0))
    return ranked.withColumn(y, of(ys, a) + slope * (inside - of(xs, a))).drop("_r", "_i")


def nearest_point(points: DataFrame, queries: DataFrame, x: str, name: str, key: list[str]) -> DataFrame:
    """For each query the name of the point (of POINTS at most) whose x is nearest; of equal ones the first by x."""
    xs, names = _sorted_points(points, x, name)
    if not xs:
        return queries.select(*key, F.lit(None).cast("string").alias(name))
    first = {v: i for i, v in reversed(list(enumerate(xs)))}
    xs, names = list(first)[::-1], [names[i] for i in list(first.values())[::-1]]  # one of equal places
    r = queries.withColumn("_r", rank_in(xs, F.col(x)))
    low, high = F.greatest(F.col("_r") - 1, F.lit(0)), F.least(F.col("_r"), F.lit(len(xs) - 1))
    off = lambda i: F.abs(F.col(x) - F.get(F.lit(xs), i))
    return r.select(*key, F.get(F.lit(names), F.when(off(low) <= off(high), low).otherwise(high)).alias(name))


def page(df: DataFrame, order: list, number: int, size: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def ordered_totals(df: DataFrame, order: list[str], sizes: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of a size over all earlier rows by order. The rows are dealt to ordered ranges and written once, so no
    task has them all; a range adds the sums of those before it, one row for each."""
    ranges = df.withColumns({f"_z_{k}": v.cast("long") for k, v in sizes.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(ranges.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "ordered")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.groupBy("_p").agg(*[F.sum(f"_z_{k}").alias(f"_y_{k}") for k in sizes])
    sums = sums.select("_p", *[before(Window.orderBy("_p"), f"_y_{k}").alias(f"_x_{k}") for k in sizes])  # a row for each range
    own = parts.withColumns({f"_w_{k}": before(Window.partitionBy("_p").orderBy("_m"), f"_z_{k}") for k in sizes}).join(F.broadcast(sums), "_p")
    return own.select(*df.columns, *[(F.col(f"_w_{k}") + F.col(f"_x_{k}")).alias(k) for k in sizes])


#: Words of the shingles that find candidates, and items without a whole word inside that may be sought in every text.
SHINGLE, TINY_ITEMS = 6, 10_000


def contained(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text: str = "text") -> DataFrame:
    """(text_id, item_id) of every item that a text has as a substring.

    An item's first and last word may be parts of words; what is between them stands in the text word by word, so its first words, SHINGLE
    at most, find the candidates by an equal join, for each number of words that items have. Items of two words or fewer
    have no such words; they are sought in every text, and more than TINY_ITEMS of them are refused."""
    spaced = lambda df: df.withColumn("_w", F.split(F.trim(text), r"\s+"))
    cut = spaced(items.where(F.col(text).isNotNull())).withColumn("_w", F.slice("_w", 2, F.greatest(F.lit(0), F.size("_w") - 2)))
    cut = cut.select(item_id, F.col(text).alias("_item"), "_w", F.least(F.size("_w"), F.lit(SHINGLE)).alias("_k"))
    sizes = sorted(r["_k"] for r in cut.select("_k").distinct().collect())
    tiny = cut.where("_k = 0").select(item_id, "_item")
    found = texts.select(text_id, F.col(text).alias("_x")).join(F.broadcast(_few(tiny, TINY_ITEMS)), F.contains("_x", F.col("_item"))).select(text_id, item_id) if 0 in sizes else None
    for k in [k for k in sizes if k]:
        grams = spaced(texts).where(F.size("_w") >= k).select(text_id, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.array_join(F.slice("_w", i, F.lit(k)), " ")))).alias("_gram"))
        pairs = grams.join(cut.where(F.col("_k") == k).select(item_id, F.array_join(F.slice("_w", 1, k), " ").alias("_gram"), "_item"), "_gram").select(text_id, item_id, "_item").distinct()
        here = pairs.join(texts.select(text_id, F.col(text).alias("_x")), text_id).where(F.contains("_x", F.col("_item"))).select(text_id, item_id)
        found = here if found is None else found.unionByName(here)
    return found if found is not None else texts.select(text_id).withColumn(item_id, F.lit(None).cast(items.schema[item_id].dataType)).where("false")


def _few(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to broadcast")
    return df
