"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by every document's token windows.

Words are the runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. A window is n consecutive
words of an item; an item of fewer words, but not none, is one window. Hits found by hash are verified word by word.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; items that repeat an
item_id count once; a null item_id counts as an item whose id prints as nothing; every input row yields one output row, so
repeated rows repeat; an empty benchmark leaves every document clean; other columns of either table are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, lookup, materialize, read_table, slices
from .words import ALNUM, Words, windows, words

N = 10
#: (window, item) pairs in one broadcast block (about 100 MB).
BLOCK_WINDOWS = 500_000
_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
_HITS = [T.StructField("hits", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


def item_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, size, words, item) for each distinct window of each item."""

    def scan(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words(column(batch, "text"), ALNUM)
                ids = column(batch, "item").to_pylist()
                out = ([], [], [], [])
                for t, count in enumerate(w.count.tolist()):
                    size, a = min(n, count), int(w.first[t])
                    if not count:
                        continue
                    hashes = windows(w.hash[a : a + count], size)
                    for j, h in enumerate(hashes.astype(np.int64).tolist()):
                        for o, x in zip(out, (h, size, w.lowered(a + j, a + j + size), ids[t])):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], ["h", "size", "words", "item"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "h long, size int, words binary, item string").distinct()


class Index:
    """One block of windows as flat arrays: for each window length the sorted hashes, and the words and items behind them."""

    def __init__(self, table: pa.Table):
        t = table.combine_chunks().sort_by([("size", "ascending"), ("h", "ascending")])
        flat = lambda c: t.column(c).combine_chunks().cast(pa.large_binary())
        size = t.column("size").to_numpy()
        h = t.column("h").to_numpy()
        self.words, self.items = flat("words"), flat("item")
        lengths, at = np.unique(size, return_index=True)
        self.by = {int(n): (int(a), h[a:b]) for n, a, b in zip(lengths, at, np.append(at[1:], len(h)))}

    def hits(self, w: Words) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """For each text the (first word, word behind the last) of its verified occurrences, and the items they are of."""
        spans: list[list] = [[] for _ in w.count]
        items: list[set] = [set() for _ in w.count]
        for size, (base, known) in self.by.items():
            h = windows(w.hash, size).view(np.int64)
            if not len(h):
                continue
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
            text = np.searchsorted(w.first, at, side="right") - 1
            whole = at + size <= w.first[text + 1]
            at, text = at[whole], text[whole]
            low, high = (np.searchsorted(known, h[at], side=s) for s in ("left", "right"))
            for a, t, i, j in zip(at.tolist(), text.tolist(), low.tolist(), high.tolist()):
                seen = w.lowered(a, a + size)
                own = [base + x for x in range(i, j) if self.words[base + x].as_py() == seen]
                if own:
                    first = int(w.first[t])
                    spans[t].append((a - first, a - first + size))
                    items[t].update(self.items[x].as_py().decode() for x in own)
        return spans, items


def blocks(windows_df: DataFrame, block: int = BLOCK_WINDOWS):
    """The benchmark's windows as broadcast blocks of a bounded size, one after another: each is released before the next is read."""
    rows = materialize(windows_df, "windows")
    spark, parts = rows.sparkSession, max(1, -(-rows.count() // block))
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("h", "item"), F.lit(parts)) == p)
        yield parts, spark.sparkContext.broadcast(Index(part.toArrow()))


def _joined(hits: list) -> tuple[int, list[tuple[int, int]]]:
    runs: list[list[int]] = []
    for s, e in sorted(hits):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return sum(e - s for s, e in runs), [tuple(r) for r in runs]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", keep: list[str] | None = None, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each document: the columns named in keep, n_words, n_hit, n_items, items_sha256, contaminated, and spans (character runs with hits).

    A benchmark of one block is scanned in one pass. Of a larger one each block's hits are written, by the digest of the text
    that has them, before the next block is broadcast; a last pass joins them to the documents."""
    keep = keep or ["doc_id"]
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("k"), F.col(text_col).cast("string").alias("text"))
    key_type = rows.schema["k"].dataType
    result = T.StructType([T.StructField("k", key_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    found, parts = [], 1
    for parts, part in blocks(item_windows(benchmark, n), block):
        if parts == 1:
            rows = rows.mapInArrow(_closing(part), result)
            break
        hits = rows.select(digest, "text").mapInArrow(_opening(part), T.StructType([T.StructField("digest", T.StringType()), *_HITS]))
        found.append(materialize(hits, "hits"))
        part.destroy()
    if parts > 1:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        sums = every.dropDuplicates(["digest", "hits", "items"]).groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        counted = materialize(rows.select(digest).groupBy("digest").agg(F.count("*").alias("n")).join(sums, "digest"), "hits")
        rows = lookup(rows.select("k", "text", digest), counted, ["digest"], "n", rows.count(), F.to_json("k"), "left").drop("digest").mapInArrow(_closing(None), result)
    return rows.select("k.*", *[f for f in result.names if f != "k"])


def _opening(part):
    hit_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                spans, items = part.value.hits(words(column(batch, "text"), ALNUM))
                own = [t for t, h in enumerate(spans) if h]
                said = [[{"s": s, "e": e} for s, e in spans[t]] for t in own]
                yield pa.RecordBatch.from_arrays([column(batch, "digest").take(pa.array(own, pa.int64())), pa.array(said, hit_type), pa.array([sorted(items[t]) for t in own], pa.list_(pa.string()))], ["digest", "hits", "items"])

    return run


def _closing(part):
    """part: the only block, or None where each row brings its hits and items."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words(column(batch, "text"), ALNUM)
                if part is not None:
                    hits, named = part.value.hits(w)
                else:
                    hits = [[(x["s"], x["e"]) for x in h or []] for h in column(batch, "hits").to_pylist()]
                    named = [i or [] for i in column(batch, "items").to_pylist()]
                n_hit, digest, spans = [], [], []
                for t, h in enumerate(hits):
                    total, runs = _joined(h)
                    n_hit.append(total)
                    digest.append(hashlib.sha256(",".join(sorted(named[t])).encode()).hexdigest())
                    spans.append(_characters(w, t, runs))
                n_items = pa.array(list(map(len, named)), pa.int64())
                yield pa.RecordBatch.from_arrays([column(batch, "k"), pa.array(w.count, pa.int64()), pa.array(n_hit, pa.int64()), n_items, pa.array(digest), pc.greater(pa.array(n_hit, pa.int64()), 0), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["k", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return run


def _characters(w: Words, t: int, runs) -> list[list[int]]:
    """Word runs of text t as code point ranges."""
    base, first, out = int(w.text_at[t]), int(w.first[t]), []
    for s, e in runs:
        a, b = int(w.start[first + s]), int(w.end[first + e - 1])
        before = int(((w.data[base:a] & 0xC0) != 0x80).sum())
        out.append([before, before + int(((w.data[a:b] & 0xC0) != 0x80).sum())])
    return out


def cut_spans(text, spans):
    """The text without its spans (ascending, disjoint code point ranges), as a column."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x[1]))
    starts = F.concat(F.transform(spans, lambda x: x[0]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, mode: str = "drop") -> DataFrame:
    """docs without contaminated documents (mode "drop") or without the passages themselves ("cut"); the columns stay."""
    names = docs.columns
    packed = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text")), benchmark, n, keep=["row"])
    if mode == "drop":
        return packed.where(~F.col("contaminated")).select("row.*")
    text = cut_spans(F.col("row.text"), F.col("spans"))
    return packed.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in names])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {N}) AS size, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (size, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE_SQL = {"op9_decontaminate": SQL}
