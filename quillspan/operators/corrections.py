"""Declarative corrections: validated first, as rows of errors, then applied as a fold inside each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.readers import exists
from . import quotes

FIELDS = ("qe", "ae", "qa", "aa", "topic", "cat")
SCHEMA = "map<string,struct<by:string,why:string,replace:array<struct<field:string,find:string,with:string>>,set:map<string,string>,quotations:array<struct<quote:string,is:string,why:string>>>>"
#: What a quotation may be said to be.
REFERENCE, NARRATION = r"^\d{1,3}:\d{1,3}(-\d{1,3})?$", "narration"


def load(spark, folder: str, files: str = "*.json") -> DataFrame:
    """(file, id, entry) of all files of a folder that have such names; none where the folder is missing. Broken JSON and an id in two files are errors."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"file string, id string, entry {SCHEMA.removeprefix('map<string,').removesuffix('>')}")
    rows = spark.read.option("pathGlobFilter", files).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    entry = F.from_json("raw", SCHEMA.removeprefix("map<string,").removesuffix(">"), {"mode": "FAILFAST"})
    entries = rows.select("file", F.explode("m").alias("id", "raw")).select("file", "id", "raw", entry.alias("entry"))
    entries = entries.select("file", "id", F.col("entry").withField("set", _strings(F.col("raw"), F.col("entry.set"))).alias("entry"))
    if twice := entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect():
        raise ValueError(f"corrected in more than one file: {[r['id'] for r in twice]}")
    return entries


def _strings(raw, given):
    """The fields that an entry sets; those whose value is no JSON string are null."""
    own = F.try_parse_json(raw)
    kinds = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.coalesce(F.schema_of_variant(F.try_variant_get(own, f"$.set.{f}", "variant")), F.lit("VOID")))])
    return F.transform_values(given, lambda f, v: F.when(~f.isin(*FIELDS) | (F.element_at(kinds, f) == "STRING"), v))


def problems(records: DataFrame, entries: DataFrame, key: str = "id", verses: DataFrame | None = None) -> DataFrame:
    """(id, error) for everything that forbids the corrections; empty where they may be applied. With verses (chapter, verse,
    text) a reference must name some."""
    fields = [c for c in FIELDS if c in records.columns]
    text = F.create_map(*[x for c in fields for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))])
    joined = entries.select(F.col("id").alias("_id"), "entry").join(records.select(F.col(key).alias("_key"), text.alias("_m")), F.col("_id") == F.col("_key"), "left")
    unknown = joined.where("_key IS NULL").select(F.col("_id").alias("id"), F.lit("unknown id").alias("error"))
    known = joined.where("_key IS NOT NULL")

    def step(a, r):
        bad = F.when(r["field"].isNull() | ~r["field"].isin(fields), F.lit("field not allowed")).when((F.coalesce(r["find"], F.lit("")) == "") | r["with"].isNull(), F.lit("find or with is missing")).when(t.occurrences(a["m"][r["field"]], r["find"]) != 1, F.lit("find does not occur exactly once"))
        new = F.when(bad.isNull(), F.transform_values(a["m"], lambda k, v: F.when(k == r["field"], F.replace(v, r["find"], r["with"])).otherwise(v))).otherwise(a["m"])
        return F.struct(new.alias("m"), F.when(bad.isNotNull(), F.concat(a["e"], F.array(bad))).otherwise(a["e"]).alias("e"))

    state = F.struct(F.col("_m").alias("m"), F.array().cast("array<string>").alias("e"))
    replaces = F.coalesce(F.col("entry.replace"), F.array().cast("array<struct<field:string,find:string,with:string>>"))
    folded = known.select(F.col("_id").alias("id"), "entry", "_m", F.aggregate(replaces, state, step).alias("s"))
    a = folded.select("id", F.explode("s.e").alias("error"))
    wrong = F.when(~F.col("f").isin(fields), "set: field not allowed").when(F.col("v").isNull(), "set: not a string")
    b = folded.select("id", F.explode("entry.set").alias("f", "v")).select("id", wrong.alias("error")).where("error IS NOT NULL")
    now = F.when(F.col("entry.set").isNull(), F.col("s.m")).otherwise(F.transform_values("s.m", lambda k, v: F.coalesce(F.try_element_at("entry.set", k), v)))
    q = folded.withColumn("_now", now).select("id", F.explode("entry.quotations").alias("q"), t.norm_ws(F.concat_ws(" ", F.try_element_at("_now", F.lit("qa")), F.try_element_at("_now", F.lit("aa")))).alias("x"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    said = F.col("q.is") == NARRATION
    c = q.select("id", F.when(blank("q.quote") | blank("q.is"), "quotation: quote or is is missing").when(~said & ~F.col("q.is").rlike(REFERENCE), "quotation: bad reference").when(~F.contains("x", t.norm_ws("q.quote")), "quotation is not in the text").alias("error")).where("error IS NOT NULL")
    found = unknown.unionByName(a).unionByName(b).unionByName(c)
    if verses is None:
        return found
    named = q.where(~said & F.col("q.is").rlike(REFERENCE)).select("id", F.col("q.is").alias("spec"))
    return found.unionByName(quotes.asserted(named, verses).where("said IS NULL").select("id", F.lit("quotation: no such verse").alias("error")))


def apply(records: DataFrame, entries: DataFrame, key: str = "id", verses: DataFrame | None = None) -> DataFrame:
    """records with replaces (each sees the one before) and then sets applied. Raises if there is any problem."""
    if bad := problems(records, entries, key, verses).limit(10).collect():
        raise ValueError("corrections cannot be applied: " + "; ".join(f"{r['id']}: {r['error']}" for r in bad))
    joined = records.join(entries.select(F.col("id").alias("_id"), "entry"), F.col(key) == F.col("_id"), "left")

    def fixed(c: str):
        own = F.filter(F.coalesce(F.col("entry.replace"), F.array().cast("array<struct<field:string,find:string,with:string>>")), lambda r: r["field"] == c)
        text = F.aggregate(own, F.col(c), lambda x, r: F.replace(x, r["find"], r["with"]))
        return F.coalesce(F.try_element_at("entry.set", F.lit(c)), text).alias(c)

    return joined.select(*[fixed(c) if c in FIELDS else F.col(c) for c in records.columns])


def overrides(entries: DataFrame) -> DataFrame:
    """(id, quote, is): quotations that a correction identifies, by white-space-normalised text."""
    return entries.select("id", F.explode("entry.quotations").alias("q")).select("id", t.norm_ws("q.quote").alias("quote"), F.col("q.is").alias("is"))
