import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillspan.llm import manifest
from quillspan.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = [(i * 7 % 50, f"text {i}\nline\n", "en", f"s{i % 3}", i) for i in range(50)]
    out += [(100, "alone", None, "lone", 5), (1, "é\n日本", "x", "S", None), (None, "no id\n", "en", "s0", 1), (None, None, None, "s0", None), (7, "", "en", None, 0), (8, "\n", "en", None, 1)]
    out += [(9, "twice\n", "en", "s1", 3)] * 2 + [(9, "other", "en", "s1", 3), (3, "long " * 20_000 + "\n", "en", "s2", 1)]
    return out


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])])


def climb(nodes):
    """Root, and the proof of each node as (place, siblings) of each level, by following every node on its own."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 3 * 3 : a // 3 * 3 + 3]
            proofs[i].append((a % 3, [x for j, x in enumerate(run) if j != a % 3]))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [a // 3 for a in at]
    return nodes[0], proofs


def brute(given):
    of = {}
    for r in given:
        of.setdefault(r[3], []).append(r)
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    made, out = {}, []
    for s in sources:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = climb([leaf(r) for r in of[s]])
    root, tops = climb([made[s][0] for s in sources])
    for s, top in zip(sources, tops):
        for r, proof in zip(of[s], made[s][1]):
            d = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[1] is None else (r[0], r[1].replace("\n", ""), *r[2:])
            x = leaf(d)
            for place, near in proof + top:
                x = h(*near[:place], x, *near[place:])
            out.append((r[0], leaf(r), made[s][0], root, h(*[y for _, near in proof + top for y in near]), x, x == root))
    return out


def result(spark, docs, levels):
    other = manifest.tampered(F.col("text"), F.col("doc_id"))
    fields = [F.col(c) for c in manifest.FIELDS]
    leaves = docs.select("doc_id", "source", manifest.leaf(fields).alias("digest"), F.when(other != F.col("text"), manifest.leaf(fields[:-1] + [other])).alias("changed"))
    made = manifest.manifest(leaves, ["doc_id"], levels)
    made = made.withColumn("folded", manifest.fold(F.coalesce("changed", "digest"), F.col("path"), F.col("siblings")))
    return made.select("doc_id", "digest", "subroot", "root", F.sha2("siblings", 256), "folded", (F.col("folded") == F.col("root")))


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_against_brute_force(spark, levels):
    prepare(spark)
    docs = spark.createDataFrame(rows(), DOCS)
    got = result(spark, docs, levels).collect()
    want = brute(rows())
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {x[6] for x in got} == {True, False}


def test_manifest_query(spark, tmp_path):
    for name, given in (("some", rows()), ("one", [(5, "a\nb", "en", "s", 3)]), ("none", [])):
        spark.createDataFrame(given, DOCS).withColumns({c: F.lit(1) for c in ("idx", "n", "tree", "digest", "path", "bucket", "root")}).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = manifest.op11_manifest(spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(given) if given else []))


def test_proofs_hold_for_their_leaf_alone():
    leaves = [h(str(i)) for i in range(100)]
    root = manifest.collapse(leaves, manifest.depth(100))[-1]
    assert len(root) == 1
    for x, (path, near) in zip(leaves, manifest.lower_proofs(leaves, manifest.depth(100), "", "")):
        assert manifest.folded(x, path, near) == root[0] and manifest.folded(h("other"), path, near) != root[0]
