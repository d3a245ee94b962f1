"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Pieces of equal length are alike to a packing, so the plan is made from the number of pieces of each length alone: at most
`size` numbers, however large the corpus. Reduction fixes sets that provably dominate every other set with their largest
piece (an exact fit of two, a lone piece, the largest partner where only one more piece fits, and the corresponding triples);
best-fit decreasing packs the rest. Pieces then take the plan's places by their rank among pieces of their length.

A document longer than `size` is cut into pieces of `size` ids, its first piece being the shorter one. Every document ends
with the end id.

Defined cases: null and empty texts are the end id alone; every row is a document of its own, repeated rows and ids too;
an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, materialize, prepare, read_table, slices
from .tokens import encoder, vocabulary

SIZE, END = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are encoded together (a longer text alone); the more, the fewer pieces are met again.
TOGETHER = 4 << 20


def reduce(count: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of count (pieces by length) and returns them as (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(*lengths: int) -> None:
        need = np.bincount(lengths, minlength=len(count))
        times = int(min(count[x] // need[x] for x in set(lengths)))
        count[:] -= need * times
        fixed.append((lengths, times))

    changed = True
    while changed:
        changed = False
        for w in range(size, 0, -1):
            while count[w]:
                count[w] -= 1
                here = np.flatnonzero(count)
                few = np.repeat(here[:3], np.minimum(count[here[:3]], 3))[:3].tolist()
                room, fit = size - w, here[here <= size - w]
                chosen = None
                if not len(fit):
                    chosen = (w,)
                elif fit[-1] == room or len(few) < 2 or few[0] + few[1] > room:
                    chosen = (w, int(fit[-1]))
                elif len(few) < 3 or sum(few) > room:
                    k, pair = int(fit[-1]), _largest_pair(count, fit, room)
                    if pair is None or k >= sum(pair):
                        chosen = (w, k)
                    else:
                        count[k] -= 1
                        second = fit[(fit <= room - k) & (count[fit] > 0)]
                        count[k] += 1
                        half = fit[fit <= room // 2]
                        if len(second) and len(half) and second[-1] >= half[-1]:
                            chosen = (w, k, int(second[-1]))
                count[w] += 1
                if chosen is None:
                    break
                fix(*chosen)
                changed = True
    return fixed


def _largest_pair(count: np.ndarray, fit: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two pieces (one length twice where there are two of it) of the largest sum that fits."""
    best, i, j = None, 0, len(fit) - 1
    while i <= j:
        a, b = int(fit[i]), int(fit[j])
        if a + b > room or (i == j and count[a] < 2):
            j -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        i += 1
    return best


def best_fit(count: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of the pieces in count, by whole groups of equal sequences."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]  # by room left

    def put(lengths: tuple[int, ...], times: int, room: int) -> None:
        if times:
            open_[room][lengths] = open_[room].get(lengths, 0) + times

    for w in range(size, 0, -1):
        left = int(count[w])
        for room in range(w, size + 1):
            if not left:
                break
            each = room // w  # once a piece is in, the same sequence stays the tightest fit
            for lengths in list(open_[room]):
                if not left:
                    break
                times = open_[room].pop(lengths)
                full = min(times, left // each)
                put(lengths + (w,) * each, full, room - each * w)
                left -= full * each
                if full < times and left:
                    put(lengths + (w,) * left, 1, room - left * w)
                    full, left = full + 1, 0
                put(lengths, times - full, room)
        each = size // w
        put((w,) * each, left // each, size - each * w)
        if left % each:
            put((w,) * (left % each), 1, size - left % each * w)
    return [(k, v) for group in open_ for k, v in group.items()]


def plan(count: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of all sequences for count[x] pieces of each length x."""
    left = np.array(count, np.int64)
    return reduce(left, size) + best_fit(left, size)


class Places:
    """For each length: from which rank on a plan's entry holds, its first sequence, pieces in each, and offset."""

    def __init__(self, sequences: list[tuple[tuple[int, ...], int]], size: int):
        used, first, rows = np.zeros(size + 1, np.int64), 0, {}
        for lengths, times in sequences:
            at = 0
            for w in sorted(set(lengths), reverse=True):
                each = lengths.count(w)
                rows.setdefault(w, []).append((used[w], first, each, at))
                used[w] += each * times
                at += each * w
            first += times
        self.by = {w: np.array(r, np.int64) for w, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for w in np.unique(length).tolist():
            own, table = np.flatnonzero(length == w), self.by[w]
            e = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
            k = rank[own] - e[:, 0]
            sequence[own], offset[own] = e[:, 1] + k // e[:, 2], e[:, 3] + k % e[:, 2] * w
        return sequence, offset


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number among those of its length in its partition."""
    path = path or vocabulary(VOCABULARY)
    last = int(end).to_bytes(4, "little")

    def run(batches):
        many, part = encoder(path).many, TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", TOGETHER):
                row, number, start, length, crc = [], [], [], [], []
                for t, ids in enumerate(many([text or "" for text in column(batch, "text").to_pylist()])):
                    own = ids + last
                    n = len(own) // 4
                    at = 0
                    while at < n:
                        take = (n - at) % size or size
                        row.append(t)
                        number.append(0 if at == 0 else number[-1] + 1)
                        start.append(at)
                        length.append(take)
                        crc.append(zlib.crc32(own[4 * at : 4 * (at + take)]))
                        at += take
                long = np.array(length, np.int64)
                order = np.argsort(long, kind="stable")
                sorted_ = long[order]
                nth = np.empty(len(long), np.int64)
                nth[order] = np.arange(len(long)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(long, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(row, pa.int32())), *[pa.array(x, kind) for x, kind in ((number, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))], pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(docs.sparkSession)
    cut = materialize(pieces(docs, size, path, end), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).select("part", "length", "before")
    total = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        total[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(total, size), size))

    def run(batches):
        for b in batches:
            sequence, offset = places.value.find(column(b, "length").to_numpy(), column(b, "rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
