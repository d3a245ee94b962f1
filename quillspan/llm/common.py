"""Scratch tables in the cluster's shared folder, batch slicing and file access."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir, ship

#: Bytes of text that one numpy pass handles at once (a longer text is handled whole).
CHUNK_BYTES = 1 << 20
#: Stands for a null identifier where an operator needs a number.
NULL_ID = -(1 << 63)
#: Keys that a join may treat as heavy, at most, and the parts that rows without a partner by shuffle are dealt into.
HEAVY, SALTS = 1000, 1 << 20
#: Bits of a bit set of hashed keys, 8 MB however many keys there are.
SET_BITS = 26
#: Rows of an Arrow batch, and bytes after which it ends sooner, because single texts may have megabytes.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspan/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later steps survive a lost executor without recomputing it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The Arrow file system of a shared folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def discard(*frames: DataFrame) -> None:
    """Deletes the scratch tables that frames were read from, when nothing will read them any more."""
    for df in frames:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bit_set(df: DataFrame, hashed) -> np.ndarray:
    """A bit set of SET_BITS bits that has those of all rows' hashed keys (a long column): a filter that lets no key of df go.

    Its size is fixed; the more keys, the more others pass too, so what passes must meet the keys themselves afterwards."""
    at = hashed.bitwiseAND(F.lit((1 << SET_BITS) - 1))
    rows = df.select(at.alias("h")).groupBy(F.shiftright("h", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(1 << (SET_BITS - 3), np.uint8)
    for r in rows:
        out[r["part"] * 4096 : r["part"] * 4096 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_set(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed & ((1 << SET_BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread, how: str = "inner") -> DataFrame:
    """rows joined ("inner" or "left") with groups, which has one row for each key and in `size` how many of the total rows have it.

    Keys of more than total / HEAVY rows are HEAVY at most, so broadcasting them has a fixed bound, and no such key meets in one
    task. Rows of other keys are shuffled by key; heavy ones and those with a null key are dealt by the hash of `spread`. rows is
    read once, groups twice. The two sides have no column in common but the keys."""
    values = [c for c in groups.columns if c not in keys and c != size]
    heavy = F.col(size) > total // HEAVY + 1
    own = F.struct(*values) if values else F.struct(F.lit(1).alias("_1"))
    hot = F.broadcast(groups.where(heavy).select(*keys, own.alias("_hot")))
    marked = rows.join(hot, keys, "left")
    shuffled = F.col("_hot").isNull()
    for k in keys:
        shuffled &= F.col(k).isNotNull()
    marked = marked.withColumn("_salt", F.when(shuffled, -1).otherwise(F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")))
    rest = groups.where(~heavy).select(*keys, own.alias("_own"), F.lit(-1).alias("_salt"))
    both = marked.join(rest, [*keys, "_salt"], "left").withColumn("_own", F.coalesce("_hot", "_own"))
    if how == "inner":
        both = both.where("_own IS NOT NULL")
    return both.select(*rows.columns, *[F.col(f"_own.{v}").alias(v) for v in values])


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES):
    """Splits a batch into runs of rows with at most about `limit` bytes of text."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(length)
    at = 0
    while at < n:
        before = run[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(run, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another and where each begins (one more at the end). Null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def id_or_sentinel(col):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID).cast("long"))


class _Crc32:
    """crc32 as DuckDB SQL: crc32_sql(text) needs the one-row table t of `table`, and text of ASCII characters."""

    table = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"

    def __call__(self, text: str) -> str:
        return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


crc32_sql = _Crc32()
