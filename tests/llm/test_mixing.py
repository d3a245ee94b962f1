import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import mixing
from quillspan.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = np.random.default_rng(4)
    out = []
    for s, n in (("a", 300), ("b", 80), ("B", 40), ("é", 9), ("c", 1), (None, 60), ("zero", 3)):
        for i in range(n):
            words = 0 if s == "zero" else int(r.lognormal(3, 1)) + (5000 if i == 7 else 0)
            out.append((len(out), " \n".join(["word"] * words) or None, "en", s, words))
    return out + [(0, out[0][1], "en", "a", 1), (None, "no id but words", "en", "a", 1), (None, "\x0b \x85 \xa0", "en", "b", 1)]


def brute(given):
    of = {}
    for i, r in enumerate(given):
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        key = hashlib.md5(f"13:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        of.setdefault(r[3], []).append((key, size, i))
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    words = {s: sum(x[1] for x in of[s]) for s in names}
    capped, total = set(), 1.5 * sum(words.values())
    while True:
        rest, w = total - sum(2.0 * words[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        now = {s for s in names if s in capped or weight[s] * rest / w > 2 * words[s]}
        if now == capped:
            break
        capped = now
    out = []
    for s in names:
        target = 2.0 * words[s] if s in capped else weight[s] * rest / w
        passes = (target >= words[s]) + (target >= 2 * words[s]) if words[s] else 0
        left, full = target - passes * words[s], sorted(x for x in of[s] if x[1])
        taken, starts = {x[2]: passes for x in of[s]}, [sum(x[1] for x in full[:i]) for i in range(len(full) + 1)]
        m = max(i for i in range(len(full) + 1) if starts[i] <= left) if full else 0
        cuts = range(max(0, m - mixing.CUTS), m + 1)
        largest = {x[1]: i for i, x in enumerate(full)}
        near = min(((abs(size - (left - starts[j])), -j, i) for j in cuts for size, i in largest.items() if i >= j), default=None)
        cut, extra = (-near[1], [near[2]]) if near and near[0] < left - starts[m] else (m, [])
        for i in [*range(cut), *extra]:
            taken[full[i][2]] += 1
        out += [(given[x[2]][0], x[1], words[s], round(target, 6), x[1] * taken[x[2]]) for x in of[s]]
    return out


def test_mix_against_brute_force(spark, tmp_path):
    given = rows()
    spark.createDataFrame(given, DOCS).withColumns({c: F.lit(1) for c in ("size", "taken", "shard", "n", "idx")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op13_mix(spark, str(tmp_path)).collect()
    plain = lambda x: sorted(repr((a, b, c, round(d, 6), e)) for a, b, c, d, e in x)
    assert plain(map(tuple, got)) == plain(brute(given))
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sum(abs(sum(v) - target) <= max(0.005 * target, 1) for (_, target), v in by.items()) >= len(by) - 1  # the source of one document has no choice


def test_empty_and_wordless(spark, tmp_path):
    for name, given in (("none", []), ("blank", [(1, None, "en", "a", 0), (2, " ", "en", None, 1)])):
        spark.createDataFrame(given, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert sorted(map(tuple, mixing.op13_mix(spark, f"{tmp_path}/{name}").collect())) == [(r[0], 0, 0, 0.0, 0) for r in given]


def test_shards_hold_exact_quotas(spark):
    prepare(spark)
    docs = spark.createDataFrame(rows(), DOCS).withColumn("shard_", F.lit("clash"))
    got = mixing.mixed(docs, shards=5).collect()
    of = {}
    for r in got:
        of.setdefault(r["shard"], []).append(r)
    assert sorted(of) == [0, 1, 2, 3, 4]
    for own in of.values():
        assert sorted(r["position"] for r in own) == list(range(len(own)))
    # A source's last block may be short, all others are full; shards have equally many blocks.
    assert max(map(len, of.values())) - min(map(len, of.values())) <= mixing.BLOCK * 8
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = mixing.mixed(docs.repartition(11), shards=5).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    taken = sum(r[4] for r in brute(rows()))
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got) == taken


def test_splitting_tree_is_exact_and_hypergeometric():
    quota, seen = np.array([50, 0, 7, 300, 1]), []
    for seed in range(300):
        room = mixing.rooms(358, 7)
        table = np.zeros((5, 7), int)
        for shard, has, blocks in mixing.split(quota, room, [seed]):
            table[has, shard] = blocks
        assert (table.sum(1) == quota).all() and (table.sum(0) == room).all()
        seen.append(table)
    share = np.mean(seen, 0) / np.maximum(1, quota)[:, None]
    assert np.abs(share[[0, 3]] - mixing.rooms(358, 7) / 358).max() < 0.02
    # The variance of a hypergeometric draw: n K/N (1 - K/N) (N - n) / (N - 1).
    n, k, size = room[2], 50, 358
    want = n * k / size * (1 - k / size) * (size - n) / (size - 1)
    assert abs(np.var([t[0, 2] for t in seen]) - want) < 0.35 * want


def test_new_order_is_a_permutation(spark):
    for n in (1, 2, 5, 16, 1000):
        x = spark.range(n).select(mixing.reordered(F.col("id"), F.lit(n).cast("long"), F.lit("s")).alias("p")).collect()
        assert sorted(r["p"] for r in x) == list(range(n))
