"""Token files with fixed-width bit packing: every id takes as many bits as the largest id of the vocabulary needs.

A file holds a range of ascending doc_ids. Layout, all little-endian: MAGIC, u8 bits, u32 ids in a block; blocks of packed
ids (least significant bit first, each padded to whole bytes); i64 doc_ids; u64 first id of each document, one more at the
end; u64 byte offset of each block, one more at the end; u64 documents, u64 blocks, MAGIC. Blocks and documents can be
read alone.

Writers name their files anew in every attempt and hand the names on through a manifest table, so a lost executor or a second
attempt leaves at most an unused file.

Defined cases: null and empty texts are the end id alone; equal doc_ids are ordered by text; a null doc_id comes first; an empty
table gives no files and no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, filesystem, materialize, partitions, prepare, read_table, scratch_path
from .ordering import ranged, real_id
from .tokens import encoder, vocabulary

MAGIC = b"QSIDS\x01"
BLOCK = 1 << 16
VOCABULARY, END = "word_bpe_49k.json", 2


def bits_for(size: int) -> int:
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = ((ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """n ids from number first on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (first + np.arange(n, dtype=np.int64)) * bits
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[(at >> 3) + k] << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = stream, bits, block
        self.buffer, self.waiting, self.total, self.at = [], 0, 0, 0
        self.docs, self.first, self.blocks = [], [], []
        self._put(MAGIC + bytes([bits]) + block.to_bytes(4, "little"))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.first.append(self.total)
        self.buffer.append(ids)
        self.total += len(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            joined = np.concatenate(self.buffer)
            whole = len(joined) // self.block * self.block
            for a in range(0, whole, self.block):
                self.blocks.append(self.at)
                self._put(pack_bits(joined[a : a + self.block], self.bits))
            self.buffer, self.waiting = [joined[whole:]], len(joined) - whole

    def close(self) -> None:
        if self.waiting:
            self.blocks.append(self.at)
            self._put(pack_bits(np.concatenate(self.buffer), self.bits))
        end = self.at
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.first + [self.total], "<u8").tobytes() + np.array(self.blocks + [end], "<u8").tobytes())
        self._put(np.array([len(self.docs), len(self.blocks)], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Random access to a file's documents and ids. source: a seekable Arrow file."""

    def __init__(self, source):
        self.file, size = source, source.size()
        tail = source.read_at(16 + len(MAGIC), size - 16 - len(MAGIC))
        head = source.read_at(len(MAGIC) + 5, 0)
        if tail[16:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block = head[len(MAGIC)], int.from_bytes(head[len(MAGIC) + 1 :], "little")
        docs, blocks = np.frombuffer(tail, "<u8", 2).astype(int)
        length = 8 * (docs + docs + 1 + blocks + 1)
        index = source.read_at(length, size - 16 - len(MAGIC) - length)
        self.docs = np.frombuffer(index, "<i8", docs)
        self.first = np.frombuffer(index, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.blocks = np.frombuffer(index, "<u8", blocks + 1, 8 * (2 * docs + 1)).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids number a to b (b excluded) of the file."""
        out = []
        while a < b:
            k, inside = divmod(a, self.block)
            take = min(b - a, self.block - inside)
            data = self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k]))
            out.append(unpack_bits(data, self.bits, take, inside))
            a += take
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))

    def documents(self, run: int = 16):
        """(doc_id, ids) of all documents in order, reading `run` blocks at once."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + run * self.block, side="right")) - 1)
            ids, base = self.ids(int(self.first[i]), int(self.first[j])), int(self.first[i])
            for k in range(i, j):
                yield int(self.docs[k]), ids[int(self.first[k]) - base : int(self.first[k + 1]) - base]
            i = j


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Writes docs as token files into folder. Returns the manifest: range (ascending doc_ids), file, docs, ids."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or vocabulary(VOCABULARY)
    rows, _ = ranged(docs, "doc_id", "text")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    last = int(end).to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        bits = bits_for(max(enc.size, end + 1))
        out, folder_fs = None, None

        def done():
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((current, pa.int32()), (name, pa.string()), (len(writer.docs), pa.int64()), (writer.total, pa.int64()))], ["range", "file", "docs", "ids"])

        current = name = writer = None
        for b in batches:
            for r, doc_id, text in zip(*[column(b, c).to_pylist() for c in ("range", "doc_id", "text")]):
                if r != current:
                    if writer:
                        yield done()
                    current, name = r, f"{folder}/ids-{r:06d}-{uuid.uuid4().hex}.qsids"
                    folder_fs, out = filesystem(name)
                    writer = Writer(folder_fs.open_output_stream(out), bits)
                writer.add(doc_id, np.frombuffer(enc.ids(text or "") + last, "<u4"))
        if writer:
            yield done()

    dealt = rows.select(F.col("range").cast("int").alias("range"), "doc_id", "text").repartition(partitions(spark), "range").sortWithinPartitions("range", "doc_id", "text")
    return materialize(dealt.mapInArrow(run, "range int, file string, docs long, ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files themselves."""

    def run(batches):
        for b in batches:
            for name, start in zip(*[column(b, c).to_pylist() for c in ("file", "start")]):
                fs, path = filesystem(name)
                reader = Reader(fs.open_input_file(path))
                out = ([], [], [], [])
                for (doc_id, ids), first in zip(reader.documents(), reader.first.tolist()):
                    for o, x in zip(out, (doc_id, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # The window sees one row for each file, of which there are as many as ranges.
    start = F.coalesce(F.sum("ids").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", start.alias("start")).repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", real_id("doc_id"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return read(write(docs, scratch_path(spark, "token-files")))


QUERIES = {"op3_token_files": op3_token_files}
ORACLE_SQL: dict[str, str] = {}
