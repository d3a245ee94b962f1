"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

A text's five-word shingles are hashed once; the upper bits choose one of BINS bins, of which each keeps its minimum. An
empty bin takes over a full bin's minimum, chosen by the bin's own random order of all bins (the same for every text), which
makes the densification unbiased. Of every minimum, hashed with its bin, only BITS low-order bits are stored; likeness takes off the matches that chance
adds: (m - 2**-BITS) / (1 - 2**-BITS), not below 0.

Defined cases: null counts as empty; a text without words has the empty fingerprint, which is like itself alone; equal doc_ids
are ordered by text; a null doc_id comes last in descending order; one document alone is its own next; an empty table gives
no rows; other columns are not looked at. A worker holds the bins of ROWS rows at most, however short their texts are.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, column, partitions, read_table
from .ordering import ranged, real_id
from .words import mix, shingles, words

BINS, BITS, WORDS = 512, 4, 5
#: Rows whose bins are held at once (about 10 kB each with all that is computed from them).
ROWS = 512
#: Full bins up to which a text's empty ones are filled one text at a time; with more, a few rounds over all texts do.
FEW = 48


@functools.cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it asks the bins for a minimum, and at which place it asks each."""
    rng = np.random.default_rng(2017)
    order = np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int64)
    return order, np.argsort(order, axis=1).astype(np.int16)


def bins(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low-order bits of every bin's minimum, a row for each text, and which texts have words."""
    value, at = shingles(words(arr), WORDS)
    n = np.diff(at)
    low = np.zeros((len(n), BINS), np.uint8)
    if not len(value):
        return low, n > 0
    slot = np.repeat(np.arange(len(n)), n) * BINS + (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))  # sets are sorted, so bins follow one another
    least = np.zeros(len(n) * BINS, np.uint64)
    full = np.zeros(len(n) * BINS, bool)
    least[slot[first]] = np.minimum.reduceat(mix(value), first)
    full[slot[first]] = True
    full, least = full.reshape(-1, BINS), least.reshape(-1, BINS)
    order, place = _orders()
    count = full.sum(axis=1)
    for i in np.flatnonzero((count > 0) & (count <= FEW)).tolist():
        donors, empty = np.flatnonzero(full[i]), np.flatnonzero(~full[i])
        least[i, empty] = least[i, donors[place[np.ix_(empty, donors)].argmin(axis=1)]]
    doc, empty = np.nonzero(~full & (count > FEW)[:, None])
    for turn in range(BINS):
        if not len(doc):
            break
        donor = order[empty, turn]
        ok = full[doc, donor]
        least[doc[ok], empty[ok]] = least[doc[ok], donor[ok]]
        doc, empty = doc[~ok], empty[~ok]
    # A minimum that fills many bins must not meet another by chance in all of them at once: the bits depend on the bin too.
    low = (mix(least + mix(np.arange(BINS, dtype=np.uint64))) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    low[n == 0] = 0
    return low, n > 0


def packed(low: np.ndarray, has: np.ndarray) -> list[str]:
    """Fingerprints as lower-case hex: BITS bits for each bin, in order."""
    bits = ((low[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(low), -1)
    return [row.tobytes().hex() if h else "" for row, h in zip(np.packbits(bits, axis=1), has)]


def unpacked(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    has = np.array([bool(p) for p in prints])
    raw = np.frombuffer(b"".join(bytes.fromhex(p or "00" * (BINS * BITS // 8)) for p in prints), np.uint8)
    bits = np.unpackbits(raw).reshape(len(prints), BINS, BITS)
    return (bits << np.arange(BITS - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8), has


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The estimated share of common shingles of each pair of rows."""
    chance = 2.0**-BITS
    match = np.clip(((one[0] == two[0]).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(one[1] & two[1], match, (one[1] == two[1]).astype(float))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first characters of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt by range in descending doc_id; each range's last row is the first of the range that follows (look = 1)."""
    rows, borders = ranged(docs, id_col, text_col)
    heads = sorted(((r["range"], r["m"]) for r in rows.groupBy("range").agg(F.max("doc_id").alias("m")).collect()), reverse=True)  # a row for each range
    own = F.struct(F.col("range").cast("int").alias("range"), F.lit(0).alias("look"))
    if not heads:
        return rows.select(F.col("range").cast("int").alias("range"), F.lit(0).alias("look"), "doc_id", "text")
    to = dict(zip([r for r, _ in heads[1:]] + [heads[0][0]], [r for r, _ in heads]))  # a range's head also closes the range before it
    head, target = [None] * (len(borders) + 1), [0] * (len(borders) + 1)
    for r, m in heads:
        head[r], target[r] = m, to[r]
    head = F.array(*[F.lit(h).cast("long") for h in head])
    ahead = F.when(F.col("doc_id") == F.get(head, F.col("range")), F.struct(F.get(F.lit(target), F.col("range")).cast("int").alias("range"), F.lit(1).alias("look")))
    dealt = rows.select(F.explode(F.array_compact(F.array(own, ahead))).alias("at"), "doc_id", "text").select("at.range", "at.look", "doc_id", "text")
    return dealt.repartition(partitions(docs.sparkSession), "range").sortWithinPartitions("range", "look", F.desc("doc_id"), F.desc("text"))


def _flush(rows):
    """Yields the rows that are followed by another of their range; the last row is left for the next call."""
    texts = [r[3] for r in rows]
    mine = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    if not mine:
        return None
    own = bins(pa.array(texts, pa.large_string()))
    new = [edited(texts[i], texts[i + 1]) for i in mine]
    other = bins(pa.array(new, pa.large_string()))
    take = lambda x, i: (x[0][i], x[1][i])
    here, after = take(own, np.array(mine)), take(own, np.array(mine) + 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in mine], pa.int64()),
            pa.array([len(texts[i]) for i in mine], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
            pa.array(packed(*here)),
            pa.array(packed(*other)),
            pa.array(likeness(here, other)),
            pa.array(likeness(here, after)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def prints_of(batches):
    """Arrow batches of fingerprints() from batches of (range, look, doc_id, text), in order."""
    rows, size = [], 0
    for b in batches:
        for row in zip(*[column(b, c).to_pylist() for c in ("range", "look", "doc_id", "text")]):
            if row[1] and rows and rows[-1][1] and rows[-1][0] == row[0]:
                continue  # further rows with the head's doc_id
            rows.append((*row[:3], row[3] or ""))
            size += len(rows[-1][3])
            if size >= CHUNK_BYTES or len(rows) > ROWS:
                if (out := _flush(rows)) is not None:
                    yield out
                rows, size = rows[-1:], 0
    if (out := _flush(rows)) is not None:
        yield out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness and the next document's (descending doc_id)."""
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs, id_col, text_col).mapInArrow(prints_of, kind).withColumn("doc_id", real_id("doc_id"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLE_SQL: dict[str, str] = {}
