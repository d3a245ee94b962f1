"""Derived tables for publication: core and rest, statistics, pages, a sitemap."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def split_core_rest(df: DataFrame, key: str, limits: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """core: every row with its texts' first characters and more (1 if any is longer); rest: the remainders of long rows."""
    over = lambda c: F.length(F.coalesce(c, F.lit(""))) > limits[c]
    longer = F.greatest(*[over(c).cast("int") for c in limits]) if len(limits) > 1 else over(next(iter(limits))).cast("int")
    core = df.select(*[F.left(F.coalesce(c, F.lit("")), F.lit(limits[c])).alias(c) if c in limits else F.col(c) for c in df.columns], longer.alias("more"))
    rest = df.where(longer == 1).select(key, *[F.substring(F.coalesce(c, F.lit("")), n + 1, 1 << 30).alias(c) for c, n in limits.items()])
    return core, rest


def join_core_rest(core: DataFrame, rest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    r = rest.select(key, F.struct(*columns).alias("_rest"))
    return core.join(r, key, "left").select(*[F.concat(c, F.coalesce(f"_rest.{c}", F.lit(""))).alias(c) if c in columns else F.col(c) for c in core.columns if c != "more"])


def trim_tooltip(x, n: int = 130) -> Column:
    v = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    return F.when(F.length(v) > n, F.concat(F.regexp_replace(F.left(v, F.lit(n)), r"\s+$", ""), F.lit("…"))).otherwise(v)


def bundle(df: DataFrame, rename: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in rename.items()])


def bundle_with_meta(df: DataFrame, rename: dict[str, str], translated: Column, **about: str) -> tuple[DataFrame, DataFrame]:
    """The bundle's rows, and its header of one row: what it is about, how many records it has and how many are translated."""
    meta = df.agg(F.count("*").alias("count"), F.count_if(translated).alias("translated"))
    return bundle(df, rename), meta.select(*[F.lit(v).alias(k) for k, v in about.items()], "count", "translated")


def totals(df: DataFrame, group: str, translated: Column) -> DataFrame:
    """statistics() of every group, and in the row whose group is null of all rows together."""
    n, done = F.count("*"), F.count_if(translated)
    return df.rollup(group).agg(n.alias("n"), done.alias("translated"), F.round(done / F.greatest(F.lit(1), n), 6).alias("share"), F.countDistinct(group).alias("groups"), F.grouping(group).cast("int").alias("total"))


def sizes(df: DataFrame, text: str) -> DataFrame:
    """files, bytes and mean_bytes of a column of texts as they would be written."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return df.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.round(F.avg(size), 3).alias("mean_bytes"))


def statistics(df: DataFrame, group: str, translated: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(translated).alias("translated"), F.round(F.count_if(translated) / F.greatest(F.lit(1), F.count("*")), 6).alias("share"))


def queue(df: DataFrame, done: DataFrame, key: str, length: Column, n: int = 2) -> DataFrame:
    """The n shortest rows that are not done."""
    return df.join(done, key, "left_anti").orderBy(length, key).limit(n)


def sitemap_entries(df: DataFrame, site: str, key: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"<url><loc>{site}/"), F.replace(F.url_encode(F.col(key).cast("string")), F.lit("+"), F.lit("%20")), F.lit("</loc></url>")).alias("value"))


def sitemap(df: DataFrame, site: str, key: str) -> DataFrame:
    """The lines of a sitemap file, in order of `line`: envelope, one entry for each key, envelope."""
    entries = df.select(F.lit(1).alias("line"), F.col(key).cast("string").alias("key")).select("line", "key", F.concat(F.lit(f"<url><loc>{site}/"), F.replace(F.url_encode("key"), F.lit("+"), F.lit("%20")), F.lit("</loc></url>")).alias("value"))
    opening = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    ends = df.sparkSession.createDataFrame([(0, "", opening), (2, "", "</urlset>")], "line int, key string, value string")
    return ends.unionByName(entries)


def robots(site: str) -> str:
    return f"User-agent: *\nAllow: /\nSitemap: {site}/sitemap.xml\n"


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def json_array(df: DataFrame, order: list[str]) -> DataFrame:
    """One value: all rows as a JSON array in order. For published tables that fit one file; larger ones go to json_lines."""
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    return df.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["j"]), ","), F.lit("]")).alias("value"))


def json_object(df: DataFrame, key: str) -> DataFrame:
    """One value: a JSON object from each key to its row, in order of keys. As json_array, for tables that fit one file."""
    rest = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    name = F.expr(f"substring(to_json(array(cast(`{key}` as string))), 2, length(to_json(array(cast(`{key}` as string)))) - 2)")
    pair = F.struct(F.col(key).alias("k"), F.concat(name, F.lit(":"), rest).alias("j"))
    return df.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda r: r["j"]), ","), F.lit("}")).alias("value"))


def _files(spark, path: str):
    """The store that a path names, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def publish(df: DataFrame, path: str, expected: DataFrame | None = None, on: list[str] | None = None, unique: bool = False) -> None:
    """Puts df at path as Parquet, as a whole or not at all.

    It is written aside, the written rows are checked (every key of expected must be there; none twice, if unique), and only then does
    the folder take its place; what stood there is moved away first and comes back if that fails. Readers of path see the old
    table, for a moment none, or the new one."""
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    fs, staged = _files(spark, aside)
    try:
        df.write.parquet(aside)
        if expected is not None:
            rows = spark.read.schema(df.schema).parquet(aside).select(*on)
            missing = expected.select(*on).join(rows, on, "left_anti").limit(5).collect()
            twice = rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect() if unique else []
            if missing or twice:
                raise ValueError(f"not published: without {missing}, twice {twice}")
        _, final = _files(spark, path)
        _, old = _files(spark, f"{aside}.old")
        had = fs.exists(final)
        if had and not fs.rename(final, old):
            raise OSError(f"{path} cannot be replaced")
        if not fs.rename(staged, final):
            if had:
                fs.rename(old, final)
            raise OSError(f"{path} cannot be written")
        fs.delete(old, True)
    finally:
        fs.delete(staged, True)


def write_complete(left: DataFrame, right: DataFrame, on: list[str], path: str) -> None:
    """Publishes the join of both, or nothing at all where a left key lacks a partner."""
    publish(left.join(right, on), path, left.select(*on).distinct(), on)


def write_vectors(vectors: DataFrame, path: str, key: str, vector: str = "embedding", unit: float = 1e-3) -> None:
    """Publishes a vector table: every row has as many numbers as the others, all finite, of length 1 within `unit` (or all 0)."""
    v = F.transform(vector, lambda z: z.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, z: a + z * z))
    checked = vectors.withColumn("_bad", F.coalesce(F.isnan(norm) | ((norm > 0) & (F.abs(norm - 1) > unit)), F.lit(True)))
    seen = checked.agg(F.count_distinct(F.size(vector)).alias("sizes"), F.max("_bad").alias("bad")).first()
    if seen["sizes"] > 1 or seen["bad"]:
        raise ValueError("vectors of different sizes, or without a norm of 1")
    publish(vectors, path, vectors.select(key), [key], unique=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pages(df: DataFrame, path: str, key: str, html: str) -> None:
    """One folder for each key with its page as text; replaces what was there."""
    df.select(key, F.col(html).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_volumes(df: DataFrame, path: str, key: str, text: str) -> str:
    """Every row as a text in files of many, one for each partition: its name (key), a line end, the text, and behind each text a
    boundary that no text has, which is returned. As a file for each text costs the driver and the store the same for a line as for a book."""
    boundary = f"\n--{uuid.uuid4().hex}\n"
    df.select(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))).alias("value")).write.text(path, lineSep=boundary)
    return boundary


def plain_record(fields: list[str]) -> Column:
    return F.concat_ws("\n\n", *[F.when(t.strip(c) != "", F.col(c)) for c in fields])
