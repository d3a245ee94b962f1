"""A Merkle manifest of a dataset: a tree of the rows of each source, and a tree of the sources' roots.

A leaf is the digest of its row's fields. Every FANOUT consecutive nodes (the last run may be shorter, even one) become the
digest of their hexadecimal digests one after another, until one node is left; a lone leaf is its own root.

The tree is built by superblocks: nodes are bucketed by index // FANOUT ** LEVELS, a bucket collapses its LEVELS levels in one
applyInPandas group (6,561 digests at most, however large a source is), and the buckets' roots are the nodes of the next round.
Proofs come down again: a bucket's own proof (its upper part) meets its nodes in a cogroup, where the lower part is made and put
before it. So only digests are shuffled, never texts or proofs.

A proof is two strings, both from the leaf to the root: `path`, two digits a level (the node's place in its run and how many
siblings the run has), and `siblings`, their digests, left to right. fold() gives the root that a leaf and a proof lead to.

Defined cases: a null field is "-" in the leaf; rows of one source and doc_id are ordered by leaf, a null doc_id comes first;
every row is a leaf, repeated rows too; the null source is a source of its own, the first; an empty table gives no rows;
columns other than FIELDS (and those asked for in `keep`) are not looked at. A null doc_id is not tampered with.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, materialize, read_table
from .ordering import numbered

FANOUT, LEVELS = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def field(x: Column) -> Column:
    """A value as its length in bytes and itself, so that no two rows of fields read alike."""
    said = x.cast("string")
    return F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(x) for x in fields]), 256)


def digest(hexadecimal: str) -> str:
    return hashlib.sha256(hexadecimal.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def collapse(digests: list[str], levels: int) -> list[list[str]]:
    """The digests and those of each of the levels above them."""
    out = [digests]
    for _ in range(levels):
        d = out[-1]
        out.append([digest("".join(d[i : i + FANOUT])) for i in range(0, len(d), FANOUT)])
    return out


def lower_proofs(digests: list[str], levels: int, path: str, siblings: str) -> list[tuple[str, str]]:
    """(path, siblings) of each digest, ending in those of the root of them all."""
    upper = [(path, siblings)]
    for d in reversed(collapse(digests, levels)[:-1]):
        here = []
        for run in range(0, len(d), FANOUT):
            own, above = d[run : run + FANOUT], upper[run // FANOUT]
            for place in range(len(own)):
                here.append((f"{place}{len(own) - 1}{above[0]}", "".join(own[:place] + own[place + 1 :]) + above[1]))
        upper = here
    return upper


def folded(leaf: str, path: str, siblings: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for i in range(0, len(path), 2):
        place, more = int(path[i]) * HEX, int(path[i + 1]) * HEX
        near = siblings[at : at + more]
        leaf, at = digest(near[:place] + leaf + near[place:]), at + more
    return leaf


def fold(leaf: Column, path: Column, siblings: Column) -> Column:
    @F.pandas_udf("string")
    def run(leaves: pd.Series, paths: pd.Series, near: pd.Series) -> pd.Series:
        return pd.Series([folded(*x) for x in zip(leaves, paths, near)], dtype=object)

    return run(leaf, path, siblings)


_NODE = "tree string, idx long, n long, digest string"


def _bucketed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"idx div {FANOUT**levels}"))


def _round(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the buckets, as nodes of the next round."""

    def run(key, rows):
        rows, n = rows.sort_values("idx"), int(rows["n"].iloc[0])
        up = min(levels, depth(n))
        root = collapse(rows["digest"].tolist(), up)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // FANOUT**up)], "digest": [root]})

    return _bucketed(nodes.select("tree", "idx", "n", "digest"), levels).groupBy("tree", "bucket").applyInPandas(run, _NODE)


def build(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """nodes (tree, idx, n, digest) and the nodes that are left after each round; of the last there is one for each tree."""
    rounds = [nodes]
    while True:
        rounds.append(materialize(_round(rounds[-1], levels), "nodes"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return rounds


def prove(rounds: list[DataFrame], roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The first round's rows with path, siblings and the other columns of roots, which has (tree, path, siblings) of each root."""
    more = [f for f in roots.schema if f.name not in ("tree", "path", "siblings")]
    given = ["path", "siblings", *[f.name for f in more]]
    upper = roots.select("tree", F.lit(0).cast("long").alias("bucket"), *given)
    for nodes in reversed(rounds[:-1]):
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*nodes.schema, *more]) + ", path string, siblings string"

        def run(rows, above):
            rows, (path, siblings, *other) = rows.sort_values("idx").drop(columns="bucket"), above[given].iloc[0]
            made = lower_proofs(rows["digest"].tolist(), min(levels, depth(int(rows["n"].iloc[0]))), path, siblings)
            return rows.assign(path=[p for p, _ in made], siblings=[x for _, x in made], **dict(zip(given[2:], other)))

        made = _bucketed(nodes, levels).groupBy("tree", "bucket").cogroup(upper.groupBy("tree", "bucket")).applyInPandas(run, kind)
        upper = made.withColumnRenamed("idx", "bucket")
    return upper.withColumnRenamed("bucket", "idx")


def manifest(leaves: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """leaves (source, digest and other columns) with idx (from 0 in the source, by order and then digest), n, subroot, root,
    path and siblings."""
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))
    own = build(numbered(leaves.withColumn("tree", tree), "tree", [*order, "digest"], "leaves"), levels)
    subroots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    whole = build(numbered(subroots, "tree", ["of"], "subroots"), levels)
    root = whole[-1].select("tree", F.lit("").alias("path"), F.lit("").alias("siblings"), F.col("digest").alias("root"))
    top = prove(whole, root, levels).select(F.col("of").alias("tree"), "path", "siblings", F.col("digest").alias("subroot"), "root")
    return prove(own, top, levels).drop("tree")


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without line feeds in rows whose id has an even checksum."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    other = tampered(F.col("text").cast("string"), F.col("doc_id"))
    changed = F.when(other != F.col("text"), leaf([F.col(c) for c in FIELDS[:-1]] + [other]))
    leaves = materialize(docs.select("doc_id", "source", leaf([F.col(c) for c in FIELDS]).alias("digest"), changed.alias("changed")), "digests")
    made = manifest(leaves, ["doc_id"]).withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("path"), F.col("siblings")))
    return made.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 14, above: int = 8) -> str:
    """The same level by level, for sources of up to FANOUT ** levels rows and FANOUT ** above sources."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text))
    other = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    sql = [
        "t AS MATERIALIZED (" + crc32_sql.table + ")",
        f"d AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN {crc32_sql('doc_id::VARCHAR')} END AS crc FROM documents, t)",
        f"e AS (SELECT row_number() OVER () AS row, doc_id, coalesce('s' || source, '') AS k, sha256({fields('text')}) AS leaf, sha256({fields(f'({other})')}) AS f FROM d)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM e)",
        "a0 AS (SELECT k, i, n, leaf AS d FROM l)",
        "p0 AS (SELECT row, k, i, '' AS sib, f FROM l)",
    ]

    def climb(nodes: str, proofs: str, levels: int) -> None:
        for j in range(levels):
            run = f"OVER (PARTITION BY k, i // {FANOUT} ORDER BY i ROWS BETWEEN"
            sql.append(f"{nodes}x{j} AS (SELECT k, i, n, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM {nodes}{j})")
            sql.append(f"{nodes}{j + 1} AS (SELECT k, i // {FANOUT} AS i, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d FROM {nodes}{j} GROUP BY k, i // {FANOUT})")
            sql.append(f"{proofs}{j + 1} AS (SELECT row, k, i // {FANOUT} AS i, sib || b || e AS sib, CASE WHEN n > 1 THEN sha256(b || f || e) ELSE f END AS f FROM {proofs}{j} JOIN {nodes}x{j} USING (k, i))")

    climb("a", "p", levels)
    sql.append(f"s AS (SELECT k AS own, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, d FROM a{levels})")
    sql.append("r0 AS (SELECT 0 AS k, i, n, d FROM s)")
    sql.append(f"q0 AS (SELECT row, 0 AS k, s.i, sib, f FROM p{levels} p JOIN s ON s.own = p.k)")
    climb("r", "q", above)
    return f"WITH {', '.join(sql)} SELECT l.doc_id, leaf, s.d AS subroot, r.d AS root, sha256(q.sib) AS proof_sha256, q.f AS folded_root, q.f = r.d AS verified FROM l JOIN q{above} q USING (row) JOIN s ON s.own = l.k, r{above} r"


QUERIES = {"op11_manifest": op11_manifest}
ORACLE_SQL = {"op11_manifest": _sql()}
