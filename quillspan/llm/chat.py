"""Chat formatting on token level: segments are encoded one by one, reserved ids are spliced between them, and the loss
mask comes from prefix sums over the segments.

A turn is TURN, role, TEXT, text, END; the three marks are ids above the vocabulary, which no text can produce. Written out,
the marks are strings; where one of the CONTROL strings occurs in a role or text, it is broken up by an escape
(ESC k behind its first character, and ESC e for ESC itself), which reading undoes. The loss mask covers the texts of
assistant turns.

Conversations are streamed turn by turn in order, so a conversation of any length needs the memory of one batch.

Defined cases: null text and role are empty; equal turns are ordered by role and text; a null turn comes first; a null conv_id is a
conversation of its own; repeated rows are repeated turns; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, id_or_sentinel, partitions, prepare, read_table, slices
from .ordering import real_id
from .tokens import encoder, vocabulary

VOCABULARY = "byte_bpe_50k.json"
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Strings that must not stand unbroken in content: the template's own marks and those of templates in wide use.
CONTROL = (*MARKS, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESC = "\x1b"
TRAINED = "assistant"
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}{ESC}k{m[0][1:]}", text.replace(ESC, ESC + "e"))


def unescape(text: str) -> str:
    return text.replace(ESC + "k", "").replace(ESC + "e", ESC)


def _bytes_of_ids(path: str) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    tok = encoder(path).tokenizer
    return [bytes(chars[c] for c in t) if (t := tok.id_to_token(i)) and all(c in chars for c in t) else (t or "").encode() for i in range(encoder(path).size)]


def format_turns(roles: list[str], texts: list[str], path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, loss mask) of each turn."""
    enc = encoder(path)
    turn, text, end = (np.array([enc.size + i], np.uint32) for i in range(3))
    out = []
    for role, said in zip(roles, texts):
        parts = [turn, np.frombuffer(enc.ids(escape(role)), np.uint32), text, np.frombuffer(enc.ids(escape(said)), np.uint32), end]
        at = np.cumsum([len(p) for p in parts])
        change = np.zeros(at[-1] + 1, np.int32)
        if role == TRAINED:
            change[at[2]] += 1
            change[at[3]] -= 1
        out.append((np.concatenate(parts), np.cumsum(change[:-1]).astype(bool)))
    return out


class Digest:
    """What is read back from a conversation's ids and masks, turn by turn."""

    def __init__(self):
        self.turns, self.sha, self.loss, self.loss_chars, self.chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, ids: np.ndarray, mask: np.ndarray, known: list[bytes]) -> None:
        size = len(known)
        marks = np.flatnonzero(ids >= size)
        if len(marks) != 3 or (ids[marks] != size + np.arange(3)).any() or marks[0] != 0 or marks[2] != len(ids) - 1:
            raise ValueError("not a formatted turn")
        said = lambda x: b"".join([known[i] for i in x.tolist()]).decode()
        raw_role, raw_text = said(ids[1 : marks[1]]), said(ids[marks[1] + 1 : marks[2]])
        role, text = unescape(raw_role), unescape(raw_text)
        self.turns += 1
        self.sha.update(f"{role}\n{text}\n".encode())
        self.chars += len(raw_role) + len(raw_text) + sum(map(len, MARKS))
        trained = unescape(said(ids[mask]))
        self.loss.update(trained.encode())
        self.loss_chars += len(trained)

    def row(self) -> tuple:
        return self.turns, self.sha.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def formatted(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, ids, mask for each turn; the rows of a conversation are in one partition and in order."""
    spark = conversations.sparkSession
    prepare(spark)
    path = path or vocabulary(VOCABULARY)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                made = format_turns(column(b, "role").to_pylist(), column(b, "text").to_pylist(), path)
                lengths = np.cumsum([0] + [len(i) for i, _ in made])
                flat = lambda k, kind: pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([m[k] for m in made]) if made else [], kind))
                yield pa.RecordBatch.from_arrays([column(b, "conv_id"), column(b, "turn"), flat(0, pa.int32()), flat(1, pa.bool_())], ["conv_id", "turn", "ids", "mask"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(id_or_sentinel(F.col("conv_id").cast("long")).alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    dealt = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, turn long, ids array<int>, mask array<boolean>")


def read_back(turns: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each conversation of formatted(), in whose order the rows must still be."""
    path = path or vocabulary(VOCABULARY)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        known, current, digest, rows = _bytes_of_ids(path), None, None, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for b in batches:
            ids, mask = column(b, "ids"), column(b, "mask")
            at = ids.offsets.to_numpy()
            flat, flat_mask = ids.values.to_numpy().astype(np.uint32), mask.values.to_numpy(zero_copy_only=False).astype(bool)
            for conv, a, z in zip(column(b, "conv_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if conv != current:
                    if digest:
                        rows.append((current, *digest.row()))
                    current, digest = conv, Digest()
                digest.add(flat[a:z], flat_mask[a:z], known)
            if len(rows) >= 1000:
                yield out()
                rows = []
        if digest:
            rows.append((current, *digest.row()))
        if rows:
            yield out()

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return turns.mapInArrow(run, kind).withColumn("conv_id", real_id("conv_id"))


_PROBE = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"))
    return read_back(formatted(table.unionByName(probe)))


def _sql_length(col: str) -> str:
    out = f"length({col}) + length({col}) - length(replace({col}, chr(27), ''))"
    for c in CONTROL:
        out += f" + 2 * ((length({col}) - length(replace({col}, '{c}', ''))) // {len(c)})"
    return out


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = '{TRAINED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({sum(map(len, MARKS))} + {_sql_length("role")} + {_sql_length("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
QUERIES = {"op10_chat": op10_chat}
ORACLE_SQL = {"op10_chat": SQL}
