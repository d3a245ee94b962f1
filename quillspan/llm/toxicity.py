"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (label 1) and unlabelled texts train a linear scorer with the class-prior-corrected, non-negative
risk of Kiryo et al.: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). The unlabelled texts are training rows as they come, labelled
or not, toxic or not, so that the prior holds for them; no label of a clean row reaches a weight. Which features there are comes
before, from a test of how much more often toxic texts have them than all training rows; their weights come from the risk.

Two uses of the clean labels remain, neither in the order of the scores: the prior is the share of toxic rows among the labelled ones, and a
bounded sample of both kinds sets two numbers, scale and offset, so that 0.5 separates the classes. Inputs of a score are a
text's distinct words and word beginnings alone.

The class prior and the features' document frequencies come from all rows that are not held out. The samples for the
gradient steps and the scale are bounded (SAMPLE documents each of toxic, labelled and any rows, those with the smallest hash of doc_id) and never
held-out rows; scores are given to every document from its whole text.

Defined cases: null and empty texts get the score of a text without features; without labelled toxic rows every score is 0;
several labels for one doc_id count as toxic if one is; rows with a null label are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_set, column, discard, in_set, materialize, prepare, read_table, slices
from .words import ALNUM, _powers, mix, words
from .words import _BYTE as BYTE_CODE

#: Documents of each kind (toxic, labelled, any) that training reads, at most.
SAMPLE = 4000
#: Features that the scorer keeps, at most; a feature must be in this many toxic texts.
FEATURES, LEAST_TEXTS = 6000, 4
#: ... and exceed its share of the unlabelled texts by so many standard deviations.
LEAST_CHANCE = 5
BITS = 20
PREFIXES = (4, 5, 6)
FOLDS = 5


def held_out(col):
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, with repeats, and the text that each comes from."""
    w = words(arr, ALNUM)
    doc = np.repeat(np.arange(len(w.count), dtype=np.int64), w.count)
    length = w.end - w.start
    shift = np.uint64(64 - BITS)
    out, of = [(w.hash >> shift).astype(np.int32)], [doc]
    if len(w.data):
        power, inverse = _powers(len(w.data) + 1)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[w.data] * power[: len(w.data)], dtype=np.uint64)))
        for n in PREFIXES:
            long = length > n
            s = w.start[long]
            out.append((mix((run[s + n] - run[s]) * inverse[s] + np.uint64(n)) >> shift).astype(np.int32))
            of.append(doc[long])
    return np.concatenate(out), np.concatenate(of)


@dataclass
class Model:
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    scale: float = 1.0
    offset: float = -50.0

    def score(self, arr: pa.Array) -> np.ndarray:
        which, doc = features(arr)
        hit = self.weight[which] != 0
        pair = np.unique((doc[hit] << BITS) | which[hit])
        z = np.bincount(pair >> BITS, weights=self.weight[pair & ((1 << BITS) - 1)], minlength=len(arr))
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, place: np.ndarray) -> list:
    """(kind, y, features) rows, one for each document of a kind; kind 0: labelled at random, 1: toxic, 2: any, labelled or not.

    Only the numbers of the features that the scorer keeps come along: 3 * SAMPLE rows of 2 * FEATURES bytes at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    first = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    own = known.join(ids, "doc_id", "left_semi")
    picked = first(own).select("doc_id", "y", F.lit(0).alias("kind")).unionByName(first(own.where("y = 1")).select("doc_id", "y", F.lit(1).alias("kind"))).unionByName(first(ids).select("doc_id", F.lit(-1).alias("y"), F.lit(2).alias("kind")))
    kept = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                which, doc = features(column(batch, "text"))
                at = kept.value[which]
                pair = np.unique((doc[at >= 0] << BITS) | at[at >= 0])
                cut = np.searchsorted(pair >> BITS, np.arange(batch.num_rows + 1))
                low = (pair & ((1 << BITS) - 1)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "kind"), column(batch, "y"), pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["doc_id", "kind", "y", "f"])

    # At most 3 * SAMPLE rows of three numbers, so broadcasting them has a fixed bound. Of rows that repeat a doc_id one stays.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), "kind", "y", "text")
    return rows.mapInArrow(run, "doc_id string, kind int, y int, f binary").groupBy("doc_id", "kind", "y").agg(F.min("f").alias("f")).collect()


def _marked(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """y and text of the rows of docs that judged (doc_id, y) names. A bit set of a fixed size keeps most others from being shuffled."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(judged, key))

    def run(batches):
        for x in batches:
            yield x.filter(pa.array(in_set(bits.value, column(x, "h").to_numpy()))).select(["id", "text"])

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), key.alias("h")).mapInArrow(run, "id string, text string")
    return materialize(rows.join(judged.select(F.col("doc_id").cast("string").alias("id"), "y"), "id").select("y", "text"), "marked")


def _frequencies(docs: DataFrame, wanted: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """In how many texts each feature is (of those wanted, if given), and the number of texts."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                which, doc = features(column(batch, "text"))
                if known.value is not None:
                    hit = known.value[which]
                    which, doc = which[hit], doc[hit]
                pair = np.unique((doc << BITS) | which)
                total += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
                n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["f", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    # At most 2^BITS + 1 rows; what is in fewer toxic texts than LEAST_TEXTS is not wanted.
    rows = counts.where((F.col("f") < 0) | (F.col("n") >= (LEAST_TEXTS if wanted is None else 1))).toArrow()
    f, n = rows["f"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(1 << BITS, np.int64)
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


def _sparse(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and columns of the ones in a matrix of a row for each text, and the number of rows."""
    return np.repeat(np.arange(len(group)), [len(x) for x in group]), np.concatenate(group).astype(np.int64), len(group)


def _margin(x: tuple, w: np.ndarray) -> np.ndarray:
    return np.bincount(x[0], weights=w[x[1]], minlength=x[2])


def fit(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk of positive and unlabelled texts (their feature numbers), by Adam.

    Where the negative part of the risk falls below 0, the step goes up that part's gradient instead."""
    p, u = _sparse(pos), _sparse(unl)
    w, bias = np.zeros(width), 0.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    back = lambda x, dz: np.append(np.bincount(x[1], weights=dz[x[0]], minlength=width), dz.sum())
    for step in range(1, steps + 1):
        zp, zu = _margin(p, w) + bias, _margin(u, w) + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = back(u, sig(zu) / u[2]) - prior * back(p, sig(zp) / p[2])
        grad = prior * back(p, (sig(zp) - 1) / p[2]) + grad_negative if negative >= 0 else -grad_negative
        grad[:-1] += 1e-5 * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, steps: int = 300) -> Model:
    """The scorer for these documents and labels (doc_id, toxic)."""
    size = 1 << BITS
    open_ = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    own = docs.where(open_).select("doc_id", "text")
    judged = labels.where(open_).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    prior = judged.where("y IS NOT NULL").join(own.select("doc_id"), "doc_id", "left_semi").agg(F.avg("y")).first()[0]
    if not prior:
        return Model()
    prior = float(np.clip(prior, 0.01, 0.9))
    marked = _marked(own, judged.where("y = 1"))
    df_p, n_p = _frequencies(marked)
    df_u, n_u = _frequencies(own, df_p > 0)
    discard(marked)
    if not n_p or not n_u:
        return Model()
    rate_p, rate_u = df_p / n_p, (df_u + 0.5) / n_u
    chance = (df_p - n_p * rate_u) / np.sqrt(n_p * rate_u)  # standard deviations above what unlabelled texts show
    gain = np.where((df_p >= LEAST_TEXTS) & (rate_p > 2 * rate_u) & (chance > LEAST_CHANCE), np.sqrt(df_p) * np.log((rate_p + 1e-9) / rate_u), 0)
    keep = np.argsort(-gain, kind="stable")[:FEATURES]
    keep = np.sort(keep[gain[keep] > 0])
    if not len(keep):
        return Model()
    place = np.full(size, -1, np.int32)
    place[keep] = np.arange(len(keep))

    rows = sorted(_sample(docs, labels, place), key=lambda r: (r["kind"], r["y"], bytes(r["f"])))
    sets = {k: [np.frombuffer(r["f"], np.uint16) for r in rows if r["kind"] == k] for k in (0, 1, 2)}
    truth = np.array([r["y"] for r in rows if r["kind"] == 0])
    pos, unl = sets[1], sets[2]
    if not pos or not unl:
        return Model()

    w = fit(pos, unl, len(keep), prior, steps)[0]
    model = Model()
    model.weight[keep] = w
    z = _margin(_sparse(sets[0]), w)
    a, b = 1.0, float(-np.median(z))
    for _ in range(500):  # scale and offset by Newton's method on the labelled sample, with a weak prior
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, h = q - truth, q * (1 - q) + 1e-6
        g = np.array([(r * z).sum() + 0.01 * a, r.sum() + 0.01 * b])
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        d = np.linalg.solve(hess, g)
        d *= min(1, 2 / (np.abs(d).max() + 1e-12))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    model.scale, model.offset = float(a), float(b)
    return model


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (a struct k and a string text) with a column score; the struct alone goes along."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([column(batch, "k"), pa.array(known.value.score(column(batch, "text")), pa.float64())], ["k", "score"])

    return docs.select("k", "text").mapInArrow(run, T.StructType([T.StructField("k", docs.schema["k"].dataType), T.StructField("score", T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels)
    rows = _scored(docs.select(F.struct("doc_id").alias("k"), F.col("text").cast("string").alias("text")), model)
    return rows.select("k.doc_id", F.coalesce(held_out(F.col("k.doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; the columns stay."""
    prepare(docs.sparkSession)
    model = train(docs, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _scored(docs.select(row.alias("k"), F.col("text").cast("string").alias("text")), model).where("score < 0.5").select("k.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
