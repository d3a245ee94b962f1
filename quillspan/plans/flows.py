"""Queries of joins, samples, merges, quotations, corrections and published tables, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import models
from ..cluster import shared_dir
from ..functions import text as t
from ..operators import corrections, quotes, relational, retrieve, segment, small, spans
from ..sources import publish
from ..sources.readers import table
from .registry import WHITE, docs, query


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents) AND doc_id IN (SELECT doc_id FROM labels)")
def narrowed_hits(spark, d):
    hits = docs(spark, d).select("doc_id", F.col("source").alias("v"), F.col("lang").alias("cat"))
    first = hits.agg(F.min("v")).first()[0]
    return small.narrow(hits, vol=first, cat="en", quoted=table(spark, d, "labels"), key="doc_id").select("doc_id")


@query("SELECT event_id, CASE WHEN user_id BETWEEN 1 AND 37 THEN CAST(user_id AS INT) END AS vol, CASE WHEN event_type = 'view' THEN NULL ELSE event_type || '_' || user_id END AS id FROM events")
def checked_parameters(spark, d):
    x = table(spark, d, "events")
    code = F.when(F.col("event_type") == "view", F.lit("a b!")).otherwise(F.concat_ws("_", "event_type", F.col("user_id").cast("string")))
    return small.checked_params(x.select("event_id", F.col("user_id").cast("string").alias("vol"), code.alias("id")))


_BATCH = "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'answer ' || toxic ELSE ' ' END AS answer_en FROM labels UNION ALL SELECT -1 - doc_id, 'x' FROM labels WHERE toxic = 1"


def _merge(spark, d):
    x = table(spark, d, "labels")
    answer = F.when(F.col("quality") == 1, F.concat(F.lit("answer "), F.col("toxic").cast("string"))).otherwise(F.lit(" "))
    batch = x.select(F.col("doc_id").alias("id"), answer.alias("answer_en")).unionByName(x.where("toxic = 1").select((-1 - F.col("doc_id")).alias("id"), F.lit("x").alias("answer_en")))
    done = docs(spark, d).where("lang = 'fr'").select(F.col("doc_id").alias("id"), F.lit("old").alias("answer_en"))
    return small.merge_translations(done, batch, docs(spark, d).select(F.col("doc_id").alias("id")))


@query(f"WITH b AS (SELECT * FROM ({_BATCH}) WHERE trim(answer_en) <> '' AND id IN (SELECT doc_id FROM documents)), o AS (SELECT doc_id AS id FROM documents WHERE lang = 'fr') SELECT id, coalesce(b.answer_en, 'old') AS answer_en FROM o FULL JOIN b USING (id)")
def merged_translations(spark, d):
    return _merge(spark, d)[0]


@query(f"WITH x AS ({_BATCH}), b AS (SELECT * FROM x WHERE trim(answer_en) <> '' AND id IN (SELECT doc_id FROM documents)), o AS (SELECT doc_id AS id FROM documents WHERE lang = 'fr') SELECT CASE WHEN id IN (SELECT id FROM o) THEN 'replaced' ELSE 'inserted' END AS op, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT 'unknown', count(*) FROM x WHERE id NOT IN (SELECT doc_id FROM documents)")
def merge_counts(spark, d):
    return _merge(spark, d)[1]


@query("SELECT lang AS cat, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, min(doc_id) LIMIT 1")
def largest_category(spark, d):
    return small.largest_category(docs(spark, d).select("doc_id", F.col("lang").alias("cat")), "cat", "doc_id")


@query("SELECT count(DISTINCT source) AS volumes, count(*) AS hits FROM documents WHERE contains(lower(text), 'thand')")
def volumes_of_hits(spark, d):
    hits = docs(spark, d).where(F.contains(F.lower("text"), F.lit("thand")))
    return small.volumes_of(hits, "source")


@query("SELECT source, left(coalesce(text, ''), 30) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def first_of_each_opening(spark, d):
    x = docs(spark, d).select("source", F.left(F.coalesce("text", F.lit("")), F.lit(30)).alias("k"), "doc_id")
    return relational.first_of_each(x, ["source", "k"], ["doc_id"])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_of_each_kind(spark, d):
    x = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return small.one_of_each_kind(x, ["user_id"], "event_type", ["ts", "event_id"]).drop("ts")


@query("SELECT CAST(max(CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT)) + 1 AS BIGINT) AS number FROM customer")
def next_batch_number(spark, d):
    number = small.next_number(table(spark, d, "customer").select(F.col("c_name").alias("name")))
    return spark.createDataFrame([(number,)], "number long")


@query("SELECT count(*) AS files, CAST(sum(strlen(coalesce(html, ''))) AS BIGINT) AS bytes, round(avg(strlen(coalesce(html, ''))), 3) AS mean_bytes FROM pages")
def page_sizes(spark, d):
    return publish.sizes(table(spark, d, "pages"), "html")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents WHERE lang = 'de'")
def category_order(spark, d):
    x = docs(spark, d).where("lang = 'de'").select("source", "doc_id", "n_chars")
    return small.listed(x, ["source"], ["n_chars"], "doc_id").drop("n_chars")


@query("SELECT p_partkey, p_size AS vol, row_number() OVER (PARTITION BY p_size ORDER BY (p_partkey * 7) % 50, p_partkey) - 1 AS place FROM part")
def ranges_by_width(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("vol"), F.col("p_partkey").alias("lo"), (F.col("p_partkey") + (F.col("p_partkey") * 7) % 50).alias("hi"))
    return small.by_width(x, "vol", "lo", "hi", "p_partkey").select("p_partkey", "vol", F.col("place").cast("long").alias("place"))


_POINTS = "(10.0, 5.0, 'a'), (20.0, 7.0, 'b'), (35.0, 1.0, 'c'), (50.0, 9.5, 'd')"


@query(
    f"""WITH p(x, y, name) AS (VALUES {_POINTS}), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM p), q AS (SELECT event_id, value AS x FROM events),
l AS (SELECT event_id, CAST(coalesce(s.y + (s.y2 - s.y) * (q.x - s.x) / (s.x2 - s.x), CASE WHEN q.x < 10 THEN 5.0 ELSE 9.5 END) AS DOUBLE) AS y FROM q LEFT JOIN s ON q.x >= s.x AND q.x < s.x2),
n AS (SELECT event_id, arg_min(name, (abs(q.x - p.x), p.x)) AS name FROM q, p GROUP BY 1)
SELECT event_id, round(y, 6) AS y, name FROM l JOIN n USING (event_id)"""
)
def interpolated(spark, d):
    points = spark.sql(f"SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, name FROM VALUES {_POINTS} AS p(x, y, name)")
    q = table(spark, d, "events").select("event_id", F.col("value").alias("x"))
    on_line = relational.interpolate(points.select("x", "y"), q, "x", "y").select("event_id", F.round("y", 6).alias("y"))
    return on_line.join(relational.nearest_point(points, q, "x", "name", ["event_id"]), "event_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS place FROM documents ORDER BY place LIMIT 18")
def shuffled_lines(spark, d):
    top = small.shuffled(docs(spark, d).select("doc_id"), "doc_id", 7).limit(18)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id")).cast("long").alias("place"))


@query("SELECT DISTINCT place FROM (SELECT c_nationkey AS place FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def named_places(spark, d):
    none = F.lit(None).cast("int")
    pairs = table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), none.alias("b")).unionByName(table(spark, d, "supplier").select(none.alias("a"), F.col("s_nationkey").alias("b")))
    return small.endpoints(pairs)


@query("SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier")
def concatenated(spark, d):
    one = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    return small.appended(one, table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name")))


@query("SELECT n_nationkey, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def filled_volumes(spark, d):
    return small.filled_groups(table(spark, d, "nation"), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")


@query("SELECT count(l.doc_id) AS n, count(*) AS total, count(l.doc_id) > 0 AND count(l.doc_id) < count(*) AS applies FROM documents LEFT JOIN labels l USING (doc_id)")
def facet_applies(spark, d):
    x = docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("q")), "doc_id", "left")
    return small.applicable(x, F.col("q").isNotNull())


# --- published tables


@query("SELECT '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS value FROM nation")
def nations_as_array(spark, d):
    return publish.json_array(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("SELECT '{' || string_agg('\"' || n_nationkey || '\":{\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || '}' AS value FROM nation")
def nations_as_object(spark, d):
    return publish.json_object(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT event_id, '{\"id\":' || event_id || ',\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}' AS value FROM events")
def event_lines(spark, d):
    x = table(spark, d, "events")
    rows = publish.json_lines(publish.bundle(x, {"event_id": "id", "user_id": "u", "event_type": "t"}))
    return rows.select(F.get_json_object("value", "$.id").cast("long").alias("event_id"), "value")


@query("SELECT 'tables' AS work, count(*) AS count, count(l.doc_id) AS translated FROM documents LEFT JOIN labels l USING (doc_id)")
def bundle_header(spark, d):
    x = docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return publish.bundle_with_meta(x, {"doc_id": "id", "lang": "cat"}, F.col("toxic").isNotNull(), work="tables")[1]


@query("SELECT source, count(*) AS n, count(toxic) AS translated, round(count(toxic) / count(*), 6) AS share, count(DISTINCT source) AS groups, 0 AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source UNION ALL SELECT NULL, count(*), count(toxic), round(count(toxic) / count(*), 6), count(DISTINCT source), 1 FROM documents LEFT JOIN labels USING (doc_id)")
def volume_totals(spark, d):
    x = docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return publish.totals(x, "source", F.col("toxic").isNotNull())


@query(
    """SELECT 0 AS line, '' AS key, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' AS value
UNION ALL SELECT 1, page_id::VARCHAR, '<url><loc>https://site.example/' || page_id || '</loc></url>' FROM pages UNION ALL SELECT 2, '', '</urlset>'"""
)
def sitemap_file(spark, d):
    return publish.sitemap(table(spark, d, "pages"), "https://site.example", "page_id")


@query("SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), CASE WHEN trim(lang) <> '' THEN lang END, CASE WHEN trim(source) <> '' THEN source END, CASE WHEN trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' THEN text END)) AS x FROM documents")
def plain_records(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(publish.plain_record(["lang", "source", "text"]), 256).alias("x"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def core_and_rest_joined(spark, d):
    core, rest = publish.split_core_rest(docs(spark, d).select("doc_id", "text"), "doc_id", {"text": 1000})
    return publish.join_core_rest(core, rest, "doc_id", ["text"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def complete_join(spark, d):
    region = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return relational.require_complete(table(spark, d, "nation"), region, ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


# --- quotations

_VERSES = "SELECT 1 + item_id // 10 AS chapter, item_id % 10 AS verse, text FROM benchmark"


def _verses(spark, d):
    x = F.col("item_id")
    return table(spark, d, "benchmark").select((1 + F.floor(x / 10)).cast("long").alias("chapter"), (x % 10).alias("verse"), "text")


@query(f"WITH v AS ({_VERSES}), s AS (SELECT chapter, min(verse) AS a, min(verse) + 2 AS b FROM v GROUP BY 1) SELECT s.chapter || ':' || a || '-' || b AS spec, sha256(string_agg(text, ' ' ORDER BY verse)) AS said FROM s JOIN v ON v.chapter = s.chapter AND verse BETWEEN a AND b GROUP BY s.chapter, a, b UNION ALL SELECT '999:1', NULL UNION ALL SELECT 'none', NULL")
def asserted_verses(spark, d):
    v = _verses(spark, d)
    named = v.groupBy("chapter").agg(F.min("verse").alias("a")).select(F.concat(F.col("chapter").cast("string"), F.lit(":"), F.col("a").cast("string"), F.lit("-"), (F.col("a") + 2).cast("string")).alias("spec"))
    specs = named.unionByName(spark.createDataFrame([("999:1",), ("none",)], "spec string"))
    return quotes.asserted(specs, v).select("spec", F.sha2("said", 256).alias("said"))


_MARKED = "regexp_replace(text, '\\b([a-z]+ [a-z]+ [a-z]+)\\.', '{\\1}.', 'g')"


def _marked(c="text"):
    return F.regexp_replace(c, r"(?<![a-zA-Z0-9_])([a-z]+ [a-z]+ [a-z]+)\.", "{$1}.")


_BRACES = f"""m AS (SELECT doc_id, x, regexp_extract_all(x, '\\{{[^{{}}]+\\}}') AS b, string_split_regex(x, '\\{{[^{{}}]+\\}}') AS g FROM (SELECT doc_id, {_MARKED} AS x FROM documents)),
b AS (SELECT doc_id, x, i, b[i] AS b, list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(b[1:i - 1], lambda z: length(z))), 0) AS s FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM m))"""


def _marked_docs(spark, d):
    return docs(spark, d).select("doc_id", _marked().alias("x"))


def _braced_docs(spark, d):
    """The texts that have braces, with the array of them: a text stays in its row and meets no other."""
    own = _marked_docs(spark, d).where(F.contains("x", F.lit("{")))
    return spans.filled(own, ["doc_id", "x"], spans.brace_array(F.col("x")), "b")


@query(f'WITH {_BRACES} SELECT doc_id, CAST(s AS INT) AS start, CAST(s + length(b) AS INT) AS "end", trim(b, \'{{}}\') AS quote FROM b')
def brace_spans(spark, d):
    return spans.braces(_marked_docs(spark, d), ["doc_id"], "x")


@query(
    f"""WITH {_BRACES}, k AS (SELECT doc_id, x, s, s + length(b) AS e, i % 2 AS verse, b, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n, lag(s + length(b), 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM b),
r AS (SELECT doc_id, 2 * n AS n, substring(x, CAST(before AS INT) + 1, CAST(s - before AS INT)) AS run, 0 AS kind FROM k
      UNION ALL SELECT doc_id, 2 * n + 1, CASE WHEN verse = 1 THEN '﴿' || trim(b, '{{}}') || '﴾' ELSE '«' || trim(b, '{{}}') || '»' END, CASE WHEN verse = 1 THEN 1 ELSE 2 END FROM k
      UNION ALL SELECT doc_id, 2 * max(n) + 2, substring(any_value(x), CAST(max(e) AS INT) + 1), 0 FROM k GROUP BY 1),
c AS (SELECT *, regexp_replace(run, '[{WHITE}]+', ' ', 'g') AS y FROM r WHERE run <> ''),
o AS (SELECT *, min(CASE WHEN trim(y) <> '' THEN n END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN trim(y) <> '' THEN n END) OVER (PARTITION BY doc_id) AS hi FROM c)
SELECT doc_id, sha256(string_agg(kind || ':' || CASE WHEN n = hi AND kind = 0 THEN regexp_replace(y, '[{WHITE}]+([.؟?!])$', '\\1') ELSE y END, '|' ORDER BY n)) AS segments FROM o WHERE n BETWEEN lo AND hi GROUP BY 1"""
)
def rendered_runs(spark, d):
    """Every other brace of a document as a verse, the rest as narrations, and the prose between."""
    span = lambda b, i: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.when(i % 2 == 0, 0).otherwise(-1).alias("ref"), F.lit(0).alias("kind"))
    per = _braced_docs(spark, d).select("doc_id", "x", F.transform("b", span).alias("spans"))
    made = spans.segments(per, "x")
    said = F.transform("segments", lambda r: F.concat(r["kind"].cast("string"), F.lit(":"), r["run"]))
    return made.select("doc_id", F.sha2(F.array_join(said, "|"), 256).alias("segments"))


@query(
    f"""WITH {_BRACES}, w AS (SELECT doc_id, s, s + length(b) AS e, (length(x) // 3) AS lo, 2 * (length(x) // 3) AS hi FROM b)
SELECT doc_id, count(*) AS n, sha256(string_agg(CAST(s - lo AS BIGINT) || '-' || CAST(e - lo AS BIGINT) || '+' || CAST(s + 1 - lo AS BIGINT) || '-' || CAST(e - 1 - lo AS BIGINT), ',' ORDER BY s)) AS x FROM w WHERE s >= lo AND e <= hi GROUP BY 1"""
)
def rebased_spans(spark, d):
    """The braces in the middle third of every document and the runs inside them, counted from where that begins."""
    run = lambda b: F.array(F.struct((b["start"] + 1).alias("start"), (b["end"] - 1).alias("end"), F.lit(0).alias("ref")))
    span = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(0).alias("ref"), F.lit(0).alias("kind"), run(b).alias("runs"))
    own = _braced_docs(spark, d).select("doc_id", F.floor(F.length("x") / 3).cast("int").alias("third"), F.transform("b", span).alias("s"))
    per = spans.filled(own, ["doc_id"], quotes.rebase(F.col("s"), F.col("third"), 2 * F.col("third")), "s")
    place = lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))
    said = F.transform("s", lambda r: F.concat(place(r), F.lit("+"), place(r["runs"][0])))
    return per.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join(said, ","), 256).alias("x"))


@query("SELECT doc_id, lang AS ref, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS number, source FROM (SELECT min(doc_id) AS doc_id, lang, source FROM documents GROUP BY lang, source)")
def numbered_references(spark, d):
    """Languages as references of a source, numbered by where each first stands."""
    x = docs(spark, d).select("source", F.col("lang").alias("ref"), F.col("doc_id").alias("start"))
    first = x.groupBy("source", "ref").agg(F.min("start").alias("doc_id"))
    return spans.number_refs(x, "source").join(first, ["source", "ref"]).select("doc_id", "ref", F.col("number").cast("long").alias("number"), "source")


@query(f"WITH v AS ({_VERSES}), s AS (SELECT chapter, verse, reverse(text) AS text FROM v WHERE verse < 5) SELECT v.chapter, v.verse, v.text AS shown, coalesce(s.text, v.text) AS authority FROM v LEFT JOIN s USING (chapter, verse)")
def two_dictionaries(spark, d):
    v = _verses(spark, d)
    literal = v.where("verse < 5").withColumn("text", F.reverse("text"))
    return quotes.two_dictionaries(v.select("chapter", "verse"), literal, v, ["chapter", "verse"])


# --- corrections


def _entries(spark, d):
    """A correction for each French document: two replacements where the first is found just once, and a new category."""
    one = F.struct(F.lit("qe").alias("field"), F.lit("eau").alias("find"), F.lit("EAU").alias("with"))
    two = F.struct(F.lit("qe").alias("field"), F.lit("EAU").alias("find"), F.lit("Eau").alias("with"))
    none = F.array().cast("array<struct<field:string,find:string,with:string>>")
    fix = F.when((t.occurrences("text", "eau") == 1) & (t.occurrences("text", "EAU") == 0), F.array(one, two)).otherwise(none)
    entry = F.struct(F.lit("me").alias("by"), F.lit("w").alias("why"), fix.alias("replace"), F.create_map(F.lit("cat"), F.lit("neu")).alias("set"), F.lit(None).cast("array<struct<quote:string,is:string,why:string>>").alias("quotations"))
    return docs(spark, d).where("lang = 'fr'").select(F.lit("a.json").alias("file"), F.col("doc_id").alias("id"), entry.alias("entry"))


def _correctable(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("qe"), F.col("source").alias("cat"))


@query("SELECT doc_id AS id, CASE WHEN lang = 'fr' AND (length(text) - length(replace(text, 'eau', ''))) = 3 AND NOT contains(text, 'EAU') THEN replace(text, 'eau', 'Eau') ELSE coalesce(text, '') END AS qe, CASE WHEN lang = 'fr' THEN 'neu' ELSE source END AS cat FROM documents")
def corrections_applied(spark, d):
    return corrections.apply(_correctable(spark, d), _entries(spark, d))


@query("SELECT doc_id AS id, 'find does not occur exactly once' AS error FROM documents WHERE lang = 'de' AND (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'sch', ''))) <> 3 UNION ALL SELECT -1 - doc_id, 'unknown id' FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 'set: field not allowed' FROM documents WHERE lang = 'fr'")
def correction_problems(spark, d):
    x = docs(spark, d)
    fix = F.array(F.struct(F.lit("qe").alias("field"), F.lit("sch").alias("find"), F.lit("x").alias("with")))
    of = lambda lang, key, replace, set_: x.where(F.col("lang") == lang).select(F.lit("a.json").alias("file"), key.alias("id"), F.struct(F.lit("").alias("by"), F.lit("").alias("why"), replace.alias("replace"), set_.alias("set"), F.lit(None).cast("array<struct<quote:string,is:string,why:string>>").alias("quotations")).alias("entry"))
    none, keep = F.lit(None).cast("array<struct<field:string,find:string,with:string>>"), F.lit(None).cast("map<string,string>")
    entries = of("de", F.col("doc_id"), fix, keep).unionByName(of("es", -1 - F.col("doc_id"), none, keep)).unionByName(of("fr", F.col("doc_id"), none, F.create_map(F.lit("lang"), F.lit("x"))))
    return corrections.problems(_correctable(spark, d), entries)


# --- retrieval, passages and models


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1")
def stored_index_terms(spark, d):
    """Terms of an index that was written and read again, with how many documents have them."""
    folder = f"{shared_dir(spark)}/quillspan/index-{uuid.uuid4().hex}"
    retrieve.save_index(retrieve.bm25_index(docs(spark, d), "doc_id", t.ascii_tokens("text")), folder)
    index = retrieve.load_index(spark, folder)
    counted = index["postings"].groupBy("term").agg(F.sum("tf").alias("cf"))
    return index["terms"].join(counted, "term").select("term", "df", "cf")


@query("SELECT conv_id, count(*) AS records, CAST(min(page_start) AS BIGINT) AS first_page, CAST(max(page_end) AS BIGINT) AS last_page FROM (SELECT conv_id, rec, min(turn) AS page_start, max(turn) AS page_end FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM conversations) WHERE rec > 0 GROUP BY 1, 2 HAVING length(trim(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10)), ''))) >= 2 AND trim(coalesce(string_agg(CASE WHEN role <> 'assistant' THEN text END, chr(10)), '')) <> '') GROUP BY 1")
def record_pages(spark, d):
    """Turns as pages: from which page to which each conversation's records go."""
    made = segment.qa_records(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant", F.lit(False), page="turn")
    return made.groupBy("conv_id").agg(F.count("*").alias("records"), F.min("page_start").cast("long").alias("first_page"), F.max("page_end").cast("long").alias("last_page"))


@query("WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS n FROM documents) SELECT doc_id, format('d{:07d}', n) AS id FROM k")
def numbered_documents(spark, d):
    return segment.number_ids(docs(spark, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"], "d%07d").select("doc_id", "id")


@query("SELECT doc_id, '[stub] ' || substring(sha256('Translate.' || coalesce(text, '')), 1, 16) AS en, 'stub' AS engine FROM documents")
def translated(spark, d):
    cache = spark.createDataFrame([], "key string, en string, engine string")
    rows = docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return models.translate(rows, cache, "doc_id", "text")[0].select("doc_id", "en", "engine")


@query(f"WITH z AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '([.!?؟؛])[{WHITE}]+', '\\1' || chr(10), 'g') AS x FROM conversations) SELECT conv_id * 1000 + turn AS k, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(replace(upper(replace(x, 'ß', chr(1))), chr(1), 'SS'), '\\n+'), lambda s: regexp_replace(s, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')), lambda s: s <> ''), ' '), '') AS en FROM z")
def translated_sentences(spark, d):
    """Every turn, with a sharp s in capitals as two letters."""
    rows = table(spark, d, "conversations")
    return models.translate_sentences(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text"), "k", "text")
