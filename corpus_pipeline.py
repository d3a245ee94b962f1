"""A corpus pipeline over `documents`: toxicity, near duplicates, benchmark passages, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and run() writes each
stage's rows as Parquet into the shared folder before the next reads them. The first four keep the columns of `documents`:
rejected documents go, one document of each near-duplicate group stays, contaminated documents go, and secrets are replaced
in the text. The last returns the packed pieces. What nulls, empty texts, repeated rows and empty tables give is in the
docstrings of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import decontaminate, neardup, packing, secrets, toxicity
from quillspan.llm.common import materialize, prepare, read_table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neardup.keep_one(docs, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), mode="drop")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secrets.redact(docs, secrets.train(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers, the near-duplicate search and the packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
