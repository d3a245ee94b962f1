"""Queries of quotation spans: alignment of braces, runs with an authority, originals with overrides, and paragraphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import text as t
from ..operators import quotes, relational, seeds, spans
from ..sources.readers import table
from .catalog import _FOLDED, _GRAMS, _NO_VOWELS, _cascade_sql, _longest_sql
from .flows import _BRACES, _marked_docs
from .registry import WHITE, docs, query

# --- alignment


# Quotations (doc_id, k, words) take marks (doc_id, pos, ref, words), both numbered from 1 in their document. A row of the table
# holds the best sums for one more quotation; the mark that it takes is where its running maximum is first reached.
def _aligned_sql(quoted: str, marks: str) -> str:
    return f"""al_m AS MATERIALIZED (SELECT doc_id, list(ref ORDER BY pos) AS refs, list(words ORDER BY pos) AS bags FROM ({marks}) GROUP BY doc_id),
al_q AS MATERIALIZED (SELECT doc_id, k, list_transform(range(1, coalesce(len(refs), 0) + 1), lambda j: CASE WHEN refs[j] = -1 THEN {quotes.NARRATION_SHARE}::DOUBLE WHEN len(words) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(words, bags[j]))::DOUBLE / len(words) END) AS sim, coalesce(refs, []) AS refs, count(*) OVER (PARTITION BY doc_id) AS n
      FROM ({quoted}) LEFT JOIN al_m USING (doc_id)),
al_r AS (SELECT doc_id, 0::BIGINT AS k, list_transform(range(0, any_value(len(sim)) + 1), lambda j: 0.0::DOUBLE) AS best, []::BIGINT[] AS won, list(sim ORDER BY k) AS sims FROM al_q WHERE n <= len(refs) GROUP BY doc_id
      UNION ALL SELECT doc_id, k, list_prepend('-inf'::DOUBLE, top), list_transform(top, lambda x: list_position(sums, x)::BIGINT), sims FROM (
        SELECT doc_id, k, sims, sums, list_transform(range(1, len(sums) + 1), lambda j: list_max(sums[1:j])) AS top FROM (
          SELECT doc_id, k + 1 AS k, list_transform(sims[k + 1], lambda z, j: best[j] + z) AS sums, sims FROM al_r WHERE k < len(sims)))),
al_w AS (SELECT doc_id, list(won ORDER BY k) AS wons, any_value(len(best)) - 1 AS m FROM al_r WHERE k > 0 GROUP BY doc_id),
al_t AS (SELECT doc_id, len(wons)::BIGINT AS k, m::BIGINT AS j, 0::BIGINT AS took, wons FROM al_w
      UNION ALL SELECT doc_id, k - 1, wons[k][j] - 1, wons[k][j], wons[1:k - 1] FROM al_t WHERE k > 0),
al AS (SELECT al_q.doc_id, al_q.k, coalesce(al_q.refs[al_t.took], -1)::INT AS ref FROM al_q LEFT JOIN al_t ON al_t.doc_id = al_q.doc_id AND al_t.k = al_q.k - 1)"""


_BAG = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_QUOTED = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, {_BAG.format('b')} AS words FROM b WHERE i % 5 <> 0"
_AUTHORITY = "CASE i % 3 WHEN 1 THEN q WHEN 2 THEN q || ' ' || coalesce(next, '') ELSE substring_index(q, ' ', 2) END"
_MARKS = f"""SELECT doc_id, i AS pos, CASE WHEN i % 4 = 0 THEN -1 ELSE i END AS ref, {_BAG.format("CASE i % 3 WHEN 1 THEN b WHEN 2 THEN b || ' ' || coalesce(next, '') ELSE array_to_string(string_split(b, ' ')[1:2], ' ') END")} AS words
FROM (SELECT doc_id, i, b, lead(b) OVER (PARTITION BY doc_id ORDER BY i) AS next, count(*) OVER (PARTITION BY doc_id) AS n FROM b) WHERE doc_id % 7 <> 0 OR i <= n // 2"""


@query(f"WITH RECURSIVE {_BRACES}, {_aligned_sql(_QUOTED, _MARKS)} SELECT doc_id, k, ref FROM al")
def aligned_braces(spark, d):
    """Four of five braces of every document against all of them, of which some are narrations, some longer and some shorter; in every
    seventh document against the first half, so that there may be more quotations than marks."""
    found = spans.braces(_marked_docs(spark, d), ["doc_id"], "x")
    w = Window.partitionBy("doc_id").orderBy("start")
    found = found.withColumns({"i": F.row_number().over(w), "next": F.lead("quote").over(w), "n": F.count("*").over(Window.partitionBy("doc_id"))}).withColumnRenamed("quote", "q")
    quoted = found.where("i % 5 <> 0").select("doc_id", "start", "end", F.col("q").alias("quote"))
    marks = found.where("doc_id % 7 <> 0 OR i <= n div 2").select("doc_id", F.col("i").alias("pos"), F.when(F.col("i") % 4 == 0, -1).otherwise(F.col("i")).alias("ref"), F.expr(_AUTHORITY).alias("said"))
    return spans.placed(quoted, marks, "doc_id").select("doc_id", F.row_number().over(w).cast("long").alias("k"), "ref")


# --- translations


_REFS = f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY item_id) - 1)::INT AS ref, said FROM (SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(k='doc_id', t='documents')}) JOIN ({_GRAMS.format(k='item_id', t='benchmark')}) USING (g))
JOIN (SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w, i: CASE WHEN i % 9 = 0 THEN 'zzz' ELSE w END), ' ') AS said FROM benchmark) USING (item_id)"""


@query(
    f"""WITH RECURSIVE {_BRACES}, rf AS MATERIALIZED ({_REFS}), words AS (SELECT *, regexp_extract_all(said, '[a-z0-9]+') AS auth FROM rf),
{_aligned_sql(f"SELECT doc_id, i AS k, {_BAG.format('b')} AS words FROM b", f"SELECT doc_id, 2 * ref AS pos, ref, {_BAG.format('said')} AS words FROM rf WHERE ref % 3 = 0 UNION ALL SELECT doc_id, 2 * ref + 1, -1, [] FROM rf")},
br AS (SELECT b.doc_id, s AS start, s + length(b) AS e, ref, 0 AS kind FROM b JOIN al ON al.doc_id = b.doc_id AND al.k = b.i),
tx AS MATERIALIZED (SELECT doc_id, x, regexp_extract_all(lower(x), '[a-z0-9]+') AS w, string_split_regex(lower(x), '[a-z0-9]+') AS gaps FROM m WHERE doc_id IN (SELECT doc_id FROM rf)),
free AS (SELECT * FROM words WHERE (doc_id, ref) NOT IN (SELECT doc_id, ref FROM br) AND len(auth) >= 6),
tg AS (SELECT doc_id, run, min(j) AS j, count(*) AS n FROM (SELECT doc_id, j, array_to_string(w[j:j + 5], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS j FROM tx WHERE len(w) >= 6)) GROUP BY doc_id, run),
an AS (SELECT doc_id, ref, auth, i, j FROM (SELECT f.doc_id, f.ref, f.auth, f.i, tg.j, tg.n FROM (SELECT *, array_to_string(auth[i:i + 5], ' ') AS run FROM (SELECT *, unnest(range(1, len(auth) - 4)) AS i FROM free)) f JOIN tg ON tg.doc_id = f.doc_id AND tg.run = f.run QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.ref ORDER BY f.i) = 1) WHERE n = 1),
gr AS (SELECT an.doc_id, ref, dir, CASE WHEN dir < 0 THEN i - 1 ELSE i + 6 END AS a, CASE WHEN dir < 0 THEN j - 1 ELSE j + 6 END AS b, 3 AS budget, 0 AS n FROM an, (SELECT unnest([-1, 1]) AS dir)
      UNION ALL SELECT doc_id, ref, dir, a + step * dir, b + step * dir, budget - step + 1, n + step FROM (
        SELECT gr.*, CASE WHEN a BETWEEN 1 AND len(auth) AND b BETWEEN 1 AND len(w) THEN CASE WHEN auth[a] = w[b] THEN 1 WHEN budget > 0 AND a + dir BETWEEN 1 AND len(auth) AND b + dir BETWEEN 1 AND len(w) AND auth[a + dir] = w[b + dir] THEN 2 END END AS step
        FROM gr JOIN free USING (doc_id, ref) JOIN tx USING (doc_id)) WHERE step IS NOT NULL),
ex AS (SELECT doc_id, ref, an.j - l.n AS w0, an.j + 5 + r.n AS w1 FROM an JOIN (SELECT doc_id, ref, max(n) AS n FROM gr WHERE dir < 0 GROUP BY ALL) l USING (doc_id, ref) JOIN (SELECT doc_id, ref, max(n) AS n FROM gr WHERE dir > 0 GROUP BY ALL) r USING (doc_id, ref)),
pl AS (SELECT doc_id, ref, x, list_sum(list_transform(gaps[1:w0], lambda z: length(z))) + coalesce(list_sum(list_transform(w[1:w0 - 1], lambda z: length(z))), 0) AS s, list_sum(list_transform(gaps[1:w1], lambda z: length(z))) + list_sum(list_transform(w[1:w1], lambda z: length(z))) AS e FROM ex JOIN tx USING (doc_id)),
qm AS (SELECT *, CASE WHEN contains(left(x, s::BIGINT), '"') THEN s - strpos(reverse(left(x, s::BIGINT)), '"') + 1 END AS l, CASE WHEN contains(substring(x, e::BIGINT + 1), '"') THEN e + strpos(substring(x, e::BIGINT + 1), '"') - 1 END AS r FROM pl),
cand AS (SELECT doc_id, ref, CASE WHEN r - l <= (e - s) * 2.5 + 80 THEN l ELSE s END AS s, CASE WHEN r - l <= (e - s) * 2.5 + 80 THEN r ELSE e END AS e, row_number() OVER (PARTITION BY doc_id ORDER BY ref) AS k FROM qm),
tk AS (SELECT doc_id, 0::BIGINT AS k, coalesce((SELECT list({{'s': start::BIGINT, 'e': br.e::BIGINT, 'ref': br.ref, 'kind': 0}} ORDER BY start) FROM br WHERE br.doc_id = y.doc_id), []) AS spans FROM (SELECT DISTINCT doc_id FROM m) y
      UNION ALL SELECT tk.doc_id, cand.k, CASE WHEN len(list_filter(spans, lambda z: (z.s <= cand.s AND cand.s < z.e) OR (z.s < cand.e AND cand.e <= z.e))) > 0 THEN spans ELSE list_append(spans, {{'s': cand.s::BIGINT, 'e': cand.e::BIGINT, 'ref': cand.ref, 'kind': 1}}) END FROM tk JOIN cand ON cand.doc_id = tk.doc_id AND cand.k = tk.k + 1)
SELECT doc_id, z.s::INT AS start, z.e::INT AS "end", z.ref::INT AS ref, z.kind::INT AS kind FROM (SELECT doc_id, unnest(spans) AS z FROM (SELECT * FROM tk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1))"""
)
def translation_spans(spark, d):
    """Every document as a translation: its braces take marks, and items that share six words with it, every ninth word of theirs
    another, are the authorities that the rest of it may run with."""
    x, items = _marked_docs(spark, d), table(spark, d, "benchmark")
    left = docs(spark, d).select("doc_id", t.ascii_tokens("text").alias("w"))
    pairs = relational.shingle_join(left, items.select("item_id", t.ascii_tokens("text").alias("w")), 6, "w", "w", "doc_id", "item_id")
    met = pairs.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id")).distinct()
    changed = F.transform(t.ascii_tokens("text"), lambda w, i: F.when((i + 1) % 9 == 0, "zzz").otherwise(w))
    refs = met.join(items.select("item_id", F.array_join(changed, " ").alias("said")), "item_id")
    refs = refs.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("item_id")) - 1).alias("ref"), "said")
    refs = written(refs, "refs")  # read several times below
    marks = refs.where("ref % 3 = 0").select("doc_id", (2 * F.col("ref")).alias("pos"), "ref").unionByName(refs.select("doc_id", (2 * F.col("ref") + 1).alias("pos"), F.lit(-1).alias("ref")))
    made = spans.translated_spans(x, refs, marks, "doc_id", "x")
    return made.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


# --- originals


_PIECES = """SELECT doc_id, z, unnest(range(0, len(z))) AS i FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{}', '()'), '[^.?!؟
]+[.?!؟]?') AS z FROM documents)"""
_SPACE = WHITE.replace("{", "{{").replace("}", "}}")
_TRIM = f"regexp_replace(regexp_replace({{0}}, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '')"
_SAID = f"SELECT doc_id, CAST(i AS INT) AS pos, {_TRIM.format('z[i + 1]')} AS text FROM ({_PIECES}) WHERE i % 2 = 0"
_CHAPTERS = "SELECT 1 + item_id // 10 AS chapter, item_id % 10 AS verse, text FROM benchmark"


@query(
    f"""WITH br AS MATERIALIZED (SELECT doc_id, i, list_sum(list_transform(z[1:i], lambda y: length(y))) AS before, length(z[i + 1]) AS n, {_TRIM.format('z[i + 1]')} AS quote FROM ({_PIECES}) WHERE i % 2 = 0),
pl AS (SELECT doc_id, i, quote, (coalesce(before, 0) + i)::INT AS start, (coalesce(before, 0) + i + n + 2)::INT AS e, regexp_replace(quote, '[{WHITE}]+', ' ', 'g') AS key FROM br),
ov AS (SELECT doc_id, key, min(CASE WHEN (doc_id + i) % 3 = 0 THEN 'narration' ELSE '2:3' END) AS said FROM pl WHERE (doc_id + i) % 3 = 0 OR (doc_id + i) % 50 = 1 GROUP BY ALL),
lk AS MATERIALIZED (SELECT doc_id, pos, chapter || ':' || verse_start || CASE WHEN verse_end <> verse_start THEN '-' || verse_end ELSE '' END AS ref FROM ({_cascade_sql(_CHAPTERS, _SAID, 'doc_id, pos', _FOLDED, _NO_VOWELS, _NO_VOWELS.format(f"replace({_FOLDED}, ' ', '')"))})),
nm AS MATERIALIZED (SELECT pl.*, coalesce(ov.said, lk.ref, 'narration') AS ref FROM pl LEFT JOIN ov USING (doc_id, key) LEFT JOIN lk ON lk.doc_id = pl.doc_id AND lk.pos = pl.i),
rn AS (SELECT * FROM ({_longest_sql("SELECT doc_id, i::INT AS pos, quote AS text FROM nm WHERE ref = 'narration'")}))
SELECT nm.doc_id, start, e AS "end", ref, rn.first, rn.last, 1 + rn.verse // 10 AS chapter, rn.verse % 10 AS verse FROM nm LEFT JOIN rn ON rn.doc_id = nm.doc_id AND rn.pos = nm.i"""
)
def original_spans(spark, d):
    """Every other sentence of every document as a quotation, against the items in chapters of ten; a third of them are asserted to be
    narrations, a few to be another verse."""
    x = F.col("item_id")
    verses = table(spark, d, "benchmark").select((1 + F.floor(x / 10)).cast("long").alias("chapter"), (x % 10).alias("verse"), "text")
    own = docs(spark, d).select("doc_id", t.sentences(F.translate(F.coalesce("text", F.lit("")), "{}", "()")).alias("z"))
    braced = F.array_join(F.transform("z", lambda s, i: F.when(i % 2 == 0, F.concat(F.lit("{"), s, F.lit("}"))).otherwise(s)), "")
    rule = F.when((F.col("doc_id") + F.col("i")) % 3 == 0, "narration").when((F.col("doc_id") + F.col("i")) % 50 == 1, "2:3")
    said = own.select("doc_id", F.posexplode("z").alias("i", "quote")).where("i % 2 = 0").select(F.col("doc_id").alias("id"), "quote", rule.alias("is")).where("is IS NOT NULL")
    made = spans.original_spans(own.select("doc_id", braced.alias("text")), seeds.build(verses, quotes.PLAIN), "doc_id", overrides=said)
    return made.select("doc_id", "start", "end", "ref", "run.first", "run.last", "run.chapter", "run.verse")


# --- paragraphs


@query(
    f"""WITH {_BRACES}, p AS (SELECT doc_id, l, i - 1 AS par, coalesce(list_sum(list_transform(l[1:i - 1], lambda z: length(z) + 1)), 0) AS lo, length(l[i]) AS n FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(x, chr(10)) AS l FROM m))),
s AS (SELECT doc_id, i, s AS a, s + length(b) + CASE WHEN i % 3 = 0 THEN 40 ELSE 0 END AS z FROM b),
c AS (SELECT p.doc_id, par, i, a - lo AS a, z - lo AS z, row_number() OVER (PARTITION BY p.doc_id, par ORDER BY a, z) AS k FROM p JOIN s ON s.doc_id = p.doc_id AND a >= lo AND z <= lo + n),
r AS (SELECT doc_id, par, k, z AS last, true AS kept FROM c WHERE k = 1 UNION ALL SELECT c.doc_id, c.par, c.k, CASE WHEN c.a >= last THEN c.z ELSE last END, c.a >= last FROM r JOIN c ON c.doc_id = r.doc_id AND c.par = r.par AND c.k = r.k + 1)
SELECT c.doc_id, par::INT AS par, a::INT AS start, z::INT AS "end", i::INT AS ref, (a + 1)::INT AS run_start, (z - 1)::INT AS run_end FROM c JOIN r USING (doc_id, par, k) WHERE kept""".replace("WITH m", "WITH RECURSIVE m", 1)
)
def paragraph_spans(spark, d):
    """The lines of every document as paragraphs with the braces that lie in them; every third span goes on for 40 characters, so some
    overlap and some leave their line."""
    x = _marked_docs(spark, d)
    lines = x.select("doc_id", F.posexplode(F.split("x", "\n")).alias("par", "v"))
    w = Window.partitionBy("doc_id").orderBy("par").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("v") + 1).over(w), F.lit(0))).select("doc_id", "par", "start", (F.col("start") + F.length("v")).alias("end"))
    found = spans.braces(x, ["doc_id"], "x").withColumn("ref", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")))
    found = found.withColumn("end", F.col("end") + F.when(F.col("ref") % 3 == 0, 40).otherwise(0))
    runs = F.array(F.struct((F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end"), F.lit(0).alias("ref")))
    made = spans.in_paragraphs(lines, found.select("doc_id", "start", "end", "ref", F.lit(0).alias("kind"), runs.alias("runs")), "doc_id")
    one = made.select("doc_id", "par", F.explode("spans").alias("s"))
    return one.select("doc_id", "par", "s.start", "s.end", "s.ref", F.col("s.runs")[0]["start"].alias("run_start"), F.col("s.runs")[0]["end"].alias("run_end"))
