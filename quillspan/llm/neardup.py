"""MinHash near-duplicates: many universal hash minima, banding, signature check, exact check, connected components.

A text is lower-cased (A-Z) and split into words at \\x20 and \\x09-\\x0D; its set holds its distinct five-word shingles
(fewer words: the whole sequence; none: empty, linked with nothing). Two documents are linked where
100 * intersection >= threshold * union. Equal sets share one representative, so thousands of copies add no pairs.

Candidates are found in rounds. First each bucket's members meet the bucket's smallest document; the links that hold
give components. A bucket whose members are then in one component can add nothing and is done. In the others every two
members meet block by block, as matrices of whole sets, and only links that join components come out. So no group is
expanded into pairs of rows, and no link between components is left out.

Defined cases: null text counts as empty; rows with the same doc_id are one document when components are formed (a null doc_id
too), each row keeping its own n_shingles; a document without shingles is its own component; an empty table gives no rows.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, bit_set, column, discard, id_or_sentinel, in_set, lookup, materialize, partitions, read_table, slices
from .components import components
from .words import constants, shingles, words

HASHES = 280
WORDS = 5
#: Chance that banding misses a pair exactly at the threshold, at most.
MISS = 1e-6
#: Documents and shingles in one block of a unit of open buckets, and documents in a unit before its buckets stand alone.
BLOCK_DOCS, BLOCK_SHINGLES, UNIT_DOCS = 1024, 500_000, 16_384
#: Pairs of one leader that one task gets its text for.
PAIRS = 256
#: Standard errors by which a signature's estimate may fall short before a pair is dropped unseen.
MARGIN = 6


def bands_for(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands that still miss a pair at the threshold with a chance of `miss` at most."""
    fit = [r for r in range(1, hashes + 1) if (1 - threshold**r) ** (hashes // r) <= miss]
    rows = max(fit, default=1)
    return hashes // rows, rows


def minima(values: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each set (none may be empty) the minimum of every universal hash a * x + b modulo 2**64, of which the upper half counts."""
    out = np.empty((len(at) - 1, len(a)), np.uint32)
    buffer = np.empty_like(values)
    for k in range(len(a)):
        np.multiply(values, a[k], out=buffer)
        buffer += b[k]
        out[:, k] = np.minimum.reduceat(buffer, at[:-1]) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, threshold: float, hashes: int = HASHES, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, set_key (equal for equal sets), bands (one bucket key each) and low (the minima's low bytes)."""
    n_bands, rows = bands_for(threshold, hashes)

    def run(batches):
        a, b, c = constants(hashes, 101), constants(hashes, 102), constants(rows, 103)
        salt = constants(n_bands, 104)
        for whole in batches:
            for batch in slices(whole, "text"):
                values, at = shingles(words(column(batch, "text")), k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                low, bands = [None] * len(n), [None] * len(n)
                key = [None] * len(n)
                if len(full):
                    m = minima(values, np.append(at[:-1][full], at[-1]), a, b)
                    grouped = m[:, : n_bands * rows].reshape(len(full), n_bands, rows).astype(np.uint64)
                    buckets = ((grouped * c).sum(axis=2) + salt) * np.uint64(0x9E3779B97F4A7C15)
                    buckets ^= buckets >> np.uint64(29)
                    buckets = buckets.view(np.int64)
                    small = m.astype(np.uint8)
                    for i, t in enumerate(full.tolist()):
                        low[t], bands[t] = small[i].tobytes(), buckets[i]
                        key[t] = hashlib.blake2b(values[at[t] : at[t + 1]].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["doc_id", "n", "set_key", "bands", "low"])

    rows_in = docs.select(id_or_sentinel(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows_in.mapInArrow(run, "doc_id long, n long, set_key binary, bands array<long>, low binary")


def _likely(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes allow a link and whose signatures do not rule it out. known: doc_id, n, low."""

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(column(x, c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("low_u", "low_v"))
            match = (one == two).mean(axis=1)
            estimate = (match - 1 / 256) / (1 - 1 / 256)
            least = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / one.shape[1])
            yield x.filter(pa.array(estimate >= least)).select(["u", "v"])

    side = lambda c: known.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("low").alias(f"low_{c}"))
    leading = materialize(pairs.groupBy("u").agg(F.count("*").alias("links")).join(side("u"), "u"), "leading")
    one = lookup(pairs, leading, ["u"], "links", pairs.count(), "v")
    sized = one.join(side("v"), "v").where(F.least("n_u", "n_v") >= F.lit(threshold) * F.greatest("n_u", "n_v"))
    return sized.select("u", "v", "low_u", "low_v").mapInArrow(run, "u long, v long")


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text of the documents whose doc_id is in ids (distinct). A bit set of a fixed size keeps most other texts from being shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_set(ids, F.xxhash64("doc_id")))

    def run(batches):
        for x in batches:
            yield x.filter(pa.array(in_set(bits.value, column(x, "h").to_numpy()))).select(["doc_id", "text"])

    rows = docs.select(id_or_sentinel(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs of which the whole sets are alike enough.

    A leader's pairs are dealt into parts of about PAIRS; each part's rows come sorted, the leader first, and stream through one task."""

    def run(batches):
        key, leaders = None, []
        for whole in batches:
            for x in slices(whole, "text"):
                value, at = shingles(words(column(x, "text")), k)
                u, part, v = (column(x, c).to_pylist() for c in ("u", "part", "v"))
                ok = []
                for i in range(x.num_rows):
                    own = value[at[i] : at[i + 1]]
                    if (u[i], part[i]) != key:
                        key, leaders = (u[i], part[i]), []
                    if v[i] is None:
                        leaders.append(own.copy())
                    elif any(_alike(p, own, percent) for p in leaders):
                        ok.append(i)
                yield x.take(pa.array(ok, pa.int64())).select(["u", "v"])

    parts = materialize(pairs.groupBy("u").agg(F.count("*").alias("links")).withColumn("parts", F.ceil(F.col("links") / PAIRS)), "parts")
    dealt = lookup(pairs, parts, ["u"], "links", pairs.count(), "v").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v")
    named = lambda c: texts.select(F.col("doc_id").alias(c), "text")
    first = parts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(named("u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    rows = first.unionByName(dealt.join(named("v"), "v").select("u", "part", "v", "text"))
    sorted_ = rows.repartition(partitions(pairs.sparkSession), "u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return sorted_.mapInArrow(run, "u long, v long").distinct()


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    if not len(p) or not len(q):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _cross_links(rest: DataFrame, known: DataFrame, docs: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Links between documents of one open bucket that are in different components so far.

    rest: bucket, doc_id, c (component so far), u (the bucket's leader). Documents that open buckets tie together form a
    unit (a very large unit is left as its buckets). A unit's documents are dealt into blocks of a bounded size: a component
    that fills a block has blocks of its own, all others share theirs. Every two blocks meet in one task, as matrices, but
    for those of one component, whose documents need no link. No row is made for a pair, and only links that join
    components come out; so a large component costs its size times the blocks of what is not in it."""
    unit = components(rest.where("doc_id <> u").select("u", F.col("doc_id").alias("v")))
    named = materialize(rest.join(unit.select(F.col("node").alias("doc_id"), F.col("component").alias("unit")), "doc_id").select("bucket", "unit", "doc_id", "c"), "named")
    each = named.groupBy("unit", "doc_id").agg(F.count("*").alias("times"))
    sized = materialize(each.groupBy("unit").agg(F.count("*").alias("members"), F.sum("times").alias("size")), "sized")
    placed = lookup(named, sized, ["unit"], "size", named.count(), "doc_id")
    large = F.col("members") > UNIT_DOCS
    of = placed.select(large.cast("byte").alias("kind"), F.when(large, F.col("bucket")).otherwise(F.col("unit")).alias("unit"), "doc_id", "c").distinct()
    rows = materialize(of.join(known.select("doc_id", "n").dropDuplicates(["doc_id"]), "doc_id"), "units")
    need = F.greatest(F.ceil(F.sum("docs") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    by_c = rows.groupBy("kind", "unit", "c").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).withColumn("own", (F.col("docs") >= BLOCK_DOCS) | (F.col("n") >= BLOCK_SHINGLES))
    groups_ = by_c.groupBy("kind", "unit", "own", F.when(F.col("own"), F.col("c")).alias("g")).agg(need.alias("blocks"), F.sum("docs").alias("docs"))
    per = groups_.groupBy("kind", "unit").agg(F.array_sort(F.collect_list(F.struct("own", "g", "blocks"))).alias("groups"), F.sum("docs").alias("size"))
    dealt = lookup(rows, materialize(per, "blocks"), ["kind", "unit"], "size", rows.count(), "doc_id")
    before = lambda g: F.aggregate(F.filter("groups", lambda x: x < g), F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
    numbered = F.transform("groups", lambda g: F.struct(g["own"].alias("own"), g["g"].alias("g"), g["blocks"].alias("blocks"), before(g).alias("first")))
    dealt = dealt.withColumn("groups", numbered)
    mine = F.coalesce(F.try_element_at(F.filter("groups", lambda g: g["own"] & (g["g"] == F.col("c"))), F.lit(1)), F.try_element_at(F.filter("groups", lambda g: ~g["own"]), F.lit(1)))
    dealt = dealt.withColumn("mine", mine).withColumn("at", F.col("mine.first") + F.pmod(F.xxhash64("doc_id"), "mine.blocks"))
    meets = F.filter("groups", lambda g: ~(g["own"] & F.col("mine.own") & (g["g"] == F.col("mine.g"))))
    other = F.flatten(F.transform(meets, lambda g: F.sequence(g["first"], g["first"] + g["blocks"] - 1)))
    tiles = dealt.select("kind", "unit", "doc_id", "c", "at", F.explode(other).alias("other")).select("kind", "unit", "doc_id", "c", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    texts = materialize(_texts(docs, rows.select("doc_id").distinct(), id_col, text_col), "texts")
    found = tiles.join(texts, "doc_id").groupBy("kind", "unit", "i", "j").applyInArrow(_tile(percent, k), "u long, v long")
    found = materialize(found, "links")
    discard(named, sized, rows, texts)
    return found


def _tile(percent: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        ids, comp, own = (column(table, c).to_numpy() for c in ("doc_id", "c", "at"))
        i, j = column(table, "i")[0].as_py(), column(table, "j")[0].as_py()
        sets = [shingles(words(x), k) for x in column(table, "text").chunks]
        size = np.concatenate([np.diff(at) for _, at in sets])
        value = np.concatenate([v for v, _ in sets])
        member = np.repeat(np.arange(len(size)), size)
        _, col, times = np.unique(value, return_inverse=True, return_counts=True)
        shared = times[col] > 1
        member, col = member[shared], np.unique(col[shared], return_inverse=True)[1]
        order = np.argsort(col, kind="stable")
        member, col = member[order], col[order]
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        both = np.zeros((len(one), len(two)), np.float32)
        for low in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            a, b = np.searchsorted(col, [low, low + 4096])
            x = np.zeros((len(size), min(4096, int(col[-1]) + 1 - low)), np.float32)
            x[member[a:b], col[a:b] - low] = 1
            both += x[one] @ x[two].T
        both = both.astype(np.int64)
        link = (both > 0) & (100 * both >= percent * (size[one][:, None] + size[two][None, :] - both))
        link &= comp[one][:, None] != comp[two][None, :]
        p, q = np.nonzero(link)
        root: dict[int, int] = {}

        def find(z):
            while root.setdefault(z, z) != z:
                root[z] = z = root[root[z]]
            return z

        u, v = [], []
        for s, t in zip(one[p].tolist(), two[q].tolist()):
            a, b = find(int(comp[s])), find(int(comp[t]))
            if a != b:
                root[a] = b
                u.append(ids[s])
                v.append(ids[t])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _shared(reps: DataFrame, leaders: DataFrame) -> DataFrame:
    """doc_id, bucket of the buckets of several documents, and by chance a few others; most of the rest is not shuffled again."""
    bits = reps.sparkSession.sparkContext.broadcast(bit_set(leaders, F.col("bucket")))

    def run(batches):
        for x in batches:
            bands = column(x, "bands")
            flat = bands.flatten().to_numpy()
            doc = np.repeat(column(x, "doc_id").to_numpy(), np.diff(bands.offsets.to_numpy()))
            ok = in_set(bits.value, flat)
            yield pa.RecordBatch.from_arrays([pa.array(doc[ok]), pa.array(flat[ok])], ["doc_id", "bucket"])

    return reps.select("doc_id", "bands").mapInArrow(run, "doc_id long, bucket long")


def groups(docs: DataFrame, percent: int = 80, hashes: int = HASHES, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    threshold = percent / 100
    signed = materialize(signatures(docs, threshold, hashes, k, id_col, text_col), "signatures")
    total = signed.count()
    sets = materialize(signed.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets")
    # A document that has rows with different texts ties their sets together.
    members = materialize(lookup(signed.where("n > 0").select("doc_id", "set_key"), sets, ["set_key"], "copies", total, "doc_id").select("doc_id", "rep").distinct(), "members")
    all_rows = materialize(signed.select("doc_id", "n"), "sizes")
    reps = materialize(signed.join(sets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set_key"]).select("doc_id", "n", "bands", "low"), "reps")
    discard(signed, sets)

    bucket = F.explode("bands").alias("bucket")
    leaders = materialize(reps.select("doc_id", bucket).groupBy("bucket").agg(F.min("doc_id").alias("u"), F.count("*").alias("size")).where("size > 1"), "leaders")
    led = lookup(_shared(reps, leaders), leaders, ["bucket"], "size", max(1, leaders.agg(F.sum("size")).first()[0] or 0), "doc_id").select("bucket", "doc_id", "u")
    led = materialize(led, "led")
    discard(leaders)
    known = materialize(reps.join(led.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", "low"), "known")
    discard(reps)
    pairs = materialize(led.where("doc_id <> u").select("u", F.col("doc_id").alias("v")).distinct(), "pairs")
    likely = materialize(_likely(pairs, known, threshold), "likely")
    texts = materialize(_texts(docs, likely.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), id_col, text_col), "texts")
    links = materialize(_verified(likely, texts, percent, k), "links")
    discard(pairs, likely, texts)
    label = components(links)

    named = led.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("bucket", "doc_id", "u", F.coalesce("component", "doc_id").alias("c"))
    named = materialize(named, "named")
    discard(led)
    open_ = materialize(named.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("bucket", "size", F.lit(1).alias("open")), "open")
    rest = materialize(lookup(named, open_, ["bucket"], "size", named.count(), "doc_id").select("bucket", "doc_id", "c", "u"), "rest")
    found = _cross_links(rest, known, docs, percent, k, id_col, text_col)
    discard(named, open_, rest, known)
    more = members.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    ties = members.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    label = components(links.unionByName(found).unionByName(more).unionByName(ties.join(more.where("u <> v").select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi")))

    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    placed = materialize(copies.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "copies", F.coalesce("component", "rep").alias("c")), "placed")
    of = lookup(members, placed, ["rep"], "copies", total, "doc_id").groupBy("doc_id").agg(F.min("c").alias("c"))
    out = all_rows.join(of, "doc_id", "left").select("doc_id", "n", F.coalesce("c", "doc_id").alias("c"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("c").alias("component_id"), (F.col("doc_id") == F.col("c")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The document with the smallest doc_id of each group; rows that repeat both its doc_id and text are kept once.

    Rows with one doc_id (null too) but different texts all stay where their doc_id does. The columns stay."""
    own = f"kept_{uuid.uuid4().hex}"
    kept = groups(docs, percent).where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(own)).distinct()
    # The rows of a doc_id are together behind the join, so the last step deals nothing anew.
    return docs.withColumn(own, id_or_sentinel("doc_id").cast("long")).join(kept, own, "left_semi").dropDuplicates([own, "text"]).drop(own)


def op7_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents"), 85)


QUERIES = {"op7_minhash_groups": op7_minhash_groups}
ORACLE_SQL: dict[str, str] = {}
