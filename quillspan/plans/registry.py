"""Where queries register: name, function and, where SQL can express it, the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread, table

#: White space as Unicode has it, in a character class of DuckDB's regular expressions.
WHITE = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))
