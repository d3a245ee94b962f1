"""Makes this package importable on the executors, and writes scratch tables where all of them can read."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspan_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillspan-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quillspan.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), os.path.dirname(top)))
    sc.addPyFile(path)
    sc._quillspan_shipped = True


_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; without that setting (local runs only) a temporary one."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it twice sees the same rows, and a lost executor costs no recomputing."""
    path = f"{shared_dir(df.sparkSession)}/quillspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
