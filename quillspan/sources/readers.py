"""Readers: marked-up text, JSON lines, whole and tolerant JSON, verse files, vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import ship

HEADER_END = "#META#Header#End#"
VERSES = "array<struct<id:int,name:string,transliteration:string,verses:array<struct<id:int,text:string,translation:string>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _bodies(whole: DataFrame, keep: list[str], header_end: str) -> DataFrame:
    """keep, seq, value: the lines of each value behind its first header end, or all lines without one."""
    at = F.locate(header_end, F.col("value"))
    body = F.when(at > 0, F.expr(f"substring(value, locate('{header_end}', value) + {len(header_end)})")).otherwise(F.col("value"))
    return whole.select(*keep, F.posexplode(F.split(body, "\r?\n")).alias("seq", "value"))


def marked_text(spark: SparkSession, path: str, header_end: str = HEADER_END) -> DataFrame:
    """(file, path, seq, value): the lines behind the first header end, or all lines without one."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value")
    return _bodies(whole, ["file", "path"], header_end)


def marked_volumes(spark: SparkSession, path: str, boundary: str, header_end: str = HEADER_END) -> DataFrame:
    """(name, seq, value): marked_text() for files of many texts each (publish.write_volumes), by the name of the text (empty: null). A file may be
    of any size: it is read in splits, of which each row is one text."""
    texts = spark.read.text(path, lineSep=boundary)
    at = F.locate("\n", F.col("value"))
    named = texts.select(F.nullif(F.left("value", at - 1), F.lit("")).alias("name"), F.expr("substring(value, locate('\n', value) + 1)").alias("value"))
    return _bodies(named, ["name"], header_end)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object for each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON value of any type, as the column value."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("value"))


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """whole_json that gives no rows where a file is missing or broken."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"value {schema}")
    rows = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True)
    return rows.select(F.from_json("value", schema).alias("value")).where("value IS NOT NULL")


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, value, broken): every file of a folder as one JSON value; a broken one has a null value and counts as such. An empty file has no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"path string, value {schema}, broken boolean")
    rows = spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").isNull().alias("broken"), "value")
    return rows.select("path", F.when(~F.col("broken"), F.from_json("value", schema)).alias("value"), "broken")


def verses(spark: SparkSession, path: str) -> DataFrame:
    """chapter, name, transliteration, verse, text, translation."""
    chapters = whole_json(spark, path, VERSES).select(F.explode("value").alias("c"))
    return chapters.select(F.col("c.id").alias("chapter"), "c.name", "c.transliteration", F.explode("c.verses").alias("v")).select("chapter", "name", "transliteration", F.col("v.id").alias("verse"), "v.text", "v.translation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table up to this size is dealt out anew after reading: it may be one file with one row group.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores; larger tables stay as they are read. The size is the plan's own estimate, so no file is listed."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
