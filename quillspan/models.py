"""Model calls behind small interfaces: an encoder, a chat model, a translator. The defaults are deterministic stand-ins."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import written
from .config import SETTINGS
from .functions import text as t

DIMENSIONS = 64
NO_SOURCES = "No source answers this question."


def hash_encoder(texts: list[str], n: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors from word hashes."""
    out = np.zeros((len(texts), n), np.float32)
    for i, x in enumerate(texts):
        for w in x.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % n] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray] = hash_encoder, batch: int = SETTINGS.batch) -> DataFrame:
    """key, embedding: texts cleaned, encoded batch by batch on the executors."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key], "embedding": list(np.asarray(encode(list(part["x"])), np.float32))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, t.clean_for_embedding(text).alias("x")).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


class StubModel:
    """Answers with a digest of what it was asked."""

    name = "stub"

    def complete(self, system: str, user: str, max_tokens: int | None = None) -> str:
        return f"[{self.name}] {hashlib.sha256((system + user).encode()).hexdigest()[:16]}"


PROVIDERS: dict[str, Callable[[], object]] = {"stub": StubModel}


def get_model(provider: str = SETTINGS.provider):
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    return PROVIDERS[provider]()


def first_key(*names: str) -> str | None:
    """The first of the environment variables that is set."""
    return next((os.environ[n] for n in names if os.environ.get(n)), None)


def context(hits: DataFrame, order: str, cite, text: str) -> DataFrame:
    """One row: numbered source blocks in order. hits is a top-k."""
    w = Window.orderBy(order)
    rows = hits.select(F.row_number().over(w).alias("n"), cite.alias("c"), F.col(text).alias("x"))
    block = F.concat(F.lit("[S"), F.col("n").cast("string"), F.lit("] ("), "c", F.lit(")\n"), "x")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda z: z["b"]), "\n\n").alias("context"))


def answer(question: str, hits: DataFrame, order: str, cite, text: str, dense_score: str = "dense_score", model=None) -> dict:
    """question, answer, confidence; without hits a fixed text and 0."""
    best = hits.agg(F.max(dense_score).alias("m"), F.count("*").alias("n")).select("n", t.confidence(F.col("m")).alias("c")).first()
    if not best["n"]:
        return {"question": question, "answer": NO_SOURCES, "confidence": 0.0}
    sources = context(hits, order, cite, text).first()["context"]
    said = (model or get_model()).complete("Answer from the sources alone.", f"{sources}\n\n{question}")
    return {"question": question, "answer": said, "confidence": best["c"]}


def with_pairs(text: str, pairs: list[tuple[str, str]]) -> str:
    """A request to translate text, with the fixed translations of the verses in it."""
    fixed = "\n".join(f"{a} => {b}" for a, b in pairs)
    return f"{fixed}\n\n{text}" if fixed else text


def translate(df: DataFrame, cache: DataFrame, key: str, text: str, provider: str = SETTINGS.provider, model=None, pairs: str | None = None, fallback=None) -> tuple[DataFrame, DataFrame]:
    """(rows with translation and engine, new cache): only texts that the cache (key, en, engine) lacks reach the model, each once.

    pairs: a column array<struct<quote:string,en:string>> of verses whose translation is given. A model that fails gives way to
    fallback, whose name is then the engine; without one the error stands. What is new is written before it is used twice."""
    model = model or get_model(provider)
    keyed = df.withColumn("_k", t.cache_key(provider, text))
    given = F.col(pairs) if pairs else F.array().cast("array<struct<quote:string,en:string>>")
    missing = keyed.select("_k", F.col(text).alias("x"), given.alias("p")).dropDuplicates(["_k"]).join(cache.select(F.col("key").alias("_k")), "_k", "left_anti")

    def one(x, fixed):
        request = with_pairs(x, [(r["quote"], r["en"]) for r in fixed])
        try:
            return model.complete("Translate.", request), model.name
        except Exception:
            if fallback is None:
                raise
            return fallback.complete("Translate.", request), fallback.name

    def run(batches):
        for b in batches:
            done = [one(x, p) for x, p in zip(b["x"], b["p"])]
            yield pd.DataFrame({"key": b["_k"], "en": [d[0] for d in done], "engine": [d[1] for d in done]})

    fresh = written(missing.mapInPandas(run, "key string, en string, engine string"), "translations")
    full = cache.select("key", "en", "engine").unionByName(fresh)
    return keyed.join(full.withColumnRenamed("key", "_k"), "_k", "left").drop("_k"), full


def upper_batch(sentences: list[str]) -> list[str]:
    """A stand-in for a local model that translates batches."""
    return [s.upper() for s in sentences]


def translate_sentences(df: DataFrame, key: str, text: str, batch_model: Callable[[list[str]], list[str]] = upper_batch, size: int = 8) -> DataFrame:
    """key, en: sentences (cut behind stops and at line ends) in batches of `size`, joined by spaces."""

    def run(batches):
        for b in batches:
            done = [" ".join(y for a in range(0, len(s), size) for y in batch_model(list(s[a : a + size]))) for s in b["s"]]
            yield pd.DataFrame({key: b[key], "en": done})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, t.line_sentences(text).alias("s")).mapInPandas(run, f"`{key}` {kind}, en string")


def engine_label(configured: str | None = None) -> str:
    """Which engine will translate, for people to read."""
    return configured or "local model (offline)"
