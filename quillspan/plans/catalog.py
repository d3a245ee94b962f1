"""All queries of the engine by name, and the SQL they must agree with. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import quotes, relational, retrieve, seeds, segment
from ..sources import publish
from ..sources.readers import table
from ..streaming import events
from .registry import ORACLE_SQL, QUERIES, WHITE, docs, query

TERMS = ["thand", "erin", "tion", "heer"]


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_BM25 = f"""
t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, len(w) AS dl FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN ({', '.join(f"'{x}'" for x in TERMS)}) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM p JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 30)"""


@query(f"WITH {_BM25} SELECT doc_id, score FROM b")
def bm25_topk(spark, d):
    return retrieve.bm25_scan(docs(spark, d), "doc_id", t.ascii_tokens("text"), TERMS)


@query(f"WITH {_BM25} SELECT doc_id, score FROM b")
def bm25_index_topk(spark, d):
    return retrieve.bm25_search(retrieve.bm25_index(docs(spark, d), "doc_id", t.ascii_tokens("text")), "doc_id", TERMS)


@query(f"WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1")
def doc_freq(spark, d):
    index = retrieve.bm25_index(docs(spark, d), "doc_id", t.ascii_tokens("text"))
    return index["postings"].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS dl FROM documents")
def doc_len(spark, d):
    return docs(spark, d).select("doc_id", F.size(t.ascii_tokens("text")).cast("long").alias("dl"))


def _first_vector(spark, d) -> list:
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


_DENSE = """q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
d AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 30)"""


@query(f"WITH {_DENSE} SELECT vec_id, score FROM d")
def dense_topk(spark, d):
    return retrieve.dense_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d))


@query("WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 5")
def dense_similar(spark, d):
    return retrieve.similar_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", 7)


@query(
    f"""WITH {_DENSE}, {_BM25},
dr AS (SELECT vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS r FROM d),
lr AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM b)
SELECT id, coalesce(dr.score, 0.0) AS dense_score, coalesce(lr.score, 0.0) AS lexical_score, round(coalesce(1.0 / (60 + dr.r), 0) + coalesce(1.0 / (60 + lr.r), 0), 9) AS rrf_score
FROM dr FULL JOIN lr USING (id) ORDER BY rrf_score DESC, dr.r NULLS LAST, lr.r LIMIT 8"""
)
def rrf_hybrid(spark, d):
    dense = retrieve.ranked(dense_topk(spark, d).withColumnRenamed("vec_id", "id"), "id")
    lexical = retrieve.ranked(bm25_topk(spark, d).withColumnRenamed("doc_id", "id"), "id")
    return retrieve.fuse(dense, lexical, "id").drop("dense_rank", "lexical_rank")


@query(
    "WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT label, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q) "
    "SELECT label, round(least(1.0, greatest(0.0, (max(score) - 0.3) / 0.5)), 3) AS confidence, CAST(greatest(8, least(100, round((max(score) - 0.30) / 0.45 * 100))) AS INT) AS bar FROM s GROUP BY label"
)
def confidence(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, d)])
    best = table(spark, d, "embeddings").select("label", F.round(retrieve.dot("embedding", q), 6).alias("score")).groupBy("label").agg(F.max("score").alias("m"))
    return best.select("label", t.confidence(F.col("m")).alias("confidence"), t.relevance_pct(F.col("m")).alias("bar"))


@query("SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang")
def facet_sets(spark, d):
    return retrieve.facets(docs(spark, d), ["source", "lang"])


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 3")
def facets_top(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3)


@query("SELECT source, count(*) AS n, count(toxic) AS translated, round(count(toxic) / greatest(1, count(*)), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def volume_stats(spark, d):
    x = docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return publish.statistics(x, "source", F.col("toxic").isNotNull())


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def neighbours_lag_lead(spark, d):
    return relational.neighbours(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars, doc_id LIMIT 20")
def untranslated_queue(spark, d):
    return publish.queue(docs(spark, d).select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id"), "doc_id", F.col("n_chars"), 20)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def translated_semi(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query(
    "WITH n AS (SELECT doc_id, 1 AS quality, CAST(0 AS INT) AS toxic FROM documents WHERE lang = 'fr') "
    "SELECT doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.quality ELSE l.quality END AS quality, CASE WHEN n.doc_id IS NOT NULL THEN n.toxic ELSE l.toxic END AS toxic, "
    "CASE WHEN n.doc_id IS NULL THEN 'kept' WHEN l.doc_id IS NULL THEN 'inserted' ELSE 'replaced' END AS op FROM labels l FULL JOIN n USING (doc_id)"
)
def upsert_merge(spark, d):
    new = docs(spark, d).where("lang = 'fr'").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return relational.upsert(table(spark, d, "labels").select("doc_id", "quality", "toxic"), new, "doc_id")


_BANDS = "(1, 0, 100000, 'all', 0), (1, 0, 1000, 'short', 1), (1, 500, 1500, 'middle', 2), (1, 900, 1100, 'narrow', 3), (1, 1000, 1200, 'tie', 4)"


@query(f"WITH r(vol, lo, hi, title, ord) AS (VALUES {_BANDS}), m AS (SELECT doc_id, n_chars, title, row_number() OVER (PARTITION BY doc_id ORDER BY hi - lo, ord) AS k FROM documents LEFT JOIN r ON n_chars BETWEEN lo AND hi) SELECT doc_id, n_chars, coalesce(title, '') AS title FROM m WHERE k = 1")
def treatise_range_join(spark, d):
    bands = spark.sql(f"SELECT * FROM VALUES {_BANDS} AS r(vol, lo, hi, title, ord)")
    facts = docs(spark, d).select("doc_id", "n_chars", F.lit(1).alias("vol"))
    return relational.narrowest_range(facts, F.broadcast(bands), ["vol"], "n_chars", ["doc_id"]).select("doc_id", "n_chars", "title")


@query("WITH p AS (SELECT user_id, ts AS pts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, p.purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.pts")
def asof_lookup(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    return relational.as_of(e.select("user_id", "event_id", "ts"), p, ["user_id"], "ts", "ts", ["purchase"]).select("event_id", "purchase")


@query(
    "SELECT event_id, coalesce(first_value(tag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
    "last_value(tag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS page FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS tag FROM events)"
)
def page_backfill(spark, d):
    """Events as lines of a volume, of which a purchase carries the tag that ends a page."""
    raw = F.concat(F.lit("line"), F.when(F.col("event_type") == "purchase", F.concat(F.lit(" PageV1P"), F.col("event_id").cast("string"))).otherwise(F.lit("")))
    return segment.assign_pages(table(spark, d, "events").select("user_id", "event_id", raw.alias("raw")), ["user_id"], "event_id").select("event_id", F.col("page").cast("long").alias("page"))


@query("WITH h AS (SELECT *, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations) SELECT conv_id, turn, coalesce(trim(heading), '') AS heading FROM h WHERE role <> 'system'")
def heading_forward_fill(spark, d):
    """Conversations as lines, of which a system turn is a heading."""
    kind = F.when(F.col("role") == "system", "head").otherwise("para")
    lines = table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), F.lit(1).alias("level"), "text")
    return segment.heading_path(lines, ["conv_id"], "turn").select("conv_id", "turn", F.coalesce(F.try_element_at("heading_path", F.lit(1)), F.lit("")).alias("heading"))


_LINES = "SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS seq, unnest(string_split(text, chr(10))) AS value FROM documents"


# Every line gets one of the five kinds by its length; the SQL joins islands of lines, the query folds the marked-up text.
_KINDS = "CASE length(value) % 5 WHEN 0 THEN '# ' WHEN 1 THEN '~~' WHEN 2 THEN '### || ' ELSE '' END"


@query(
    f"""WITH k AS (SELECT doc_id, seq, trim({_KINDS} || value) AS v FROM ({_LINES})),
m AS (SELECT *, v = '' AS blank, starts_with(v, '~~') AS more, starts_with(v, '###') AS head, starts_with(v, '#') AS mark FROM k),
g AS (SELECT *, sum(CASE WHEN blank OR mark THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM m),
b AS (SELECT *, trim(CASE WHEN head THEN substring(v, 7) WHEN mark THEN substring(v, 2) WHEN more THEN substring(v, 3) ELSE v END) AS body FROM g)
SELECT doc_id, CAST(min(seq) AS INT) AS seq, CASE WHEN arg_min(head, seq) THEN 'head' ELSE 'para' END AS kind, sha256(string_agg(body, ' ' ORDER BY seq)) AS raw FROM b GROUP BY doc_id, island HAVING arg_min(mark, seq)"""
)
def logical_lines(spark, d):
    lines = segment.split_lines(docs(spark, d).select("doc_id", "text"), ["doc_id"])
    made = segment.logical_lines(lines.select("doc_id", "seq", F.expr(f"concat({_KINDS}, value)").alias("value")), ["doc_id"])
    return made.select("doc_id", "seq", "kind", F.sha2("raw", 256).alias("raw"))


@query(
    "WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM conversations), "
    "g AS (SELECT conv_id, rec, min(turn) AS first_seq, string_agg(CASE WHEN role <> 'assistant' THEN text END, chr(10) ORDER BY turn) AS q, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn) AS a FROM m WHERE rec > 0 GROUP BY 1, 2) "
    "SELECT conv_id, first_seq, length(trim(q)) AS q_chars, length(trim(a)) AS a_chars FROM g WHERE a IS NOT NULL AND length(trim(a)) >= 2"
)
def qa_segments(spark, d):
    rows = table(spark, d, "conversations")
    made = segment.qa_records(rows, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant", F.lit(False))
    return made.select("conv_id", "first_seq", F.length("question").cast("long").alias("q_chars"), F.length("answer").cast("long").alias("a_chars"))


# Lines over 1800 characters are split by a second recursion: sentences are joined up to 1200, what is over 1800 is cut.
# The sentences behind [.!] and white space are found whole, as this SQL has no look-behind.
@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i, trim(value) AS v FROM ({_LINES}) WHERE trim(value) <> ''),
s AS (SELECT doc_id, i, k, rtrim(x, ' ' || chr(9) || chr(13)) AS x FROM (SELECT doc_id, i, unnest(range(1, len(z) + 1)) AS k, unnest(z) AS x FROM (SELECT doc_id, i, regexp_extract_all(v, '(?s)(?:[^.!؟]|[.!؟]+[^.!؟\\s])*(?:[.!؟]+(?:\\s+|$)|$)') AS z FROM l WHERE length(v) > 1800)) WHERE x <> ''),
p AS (SELECT doc_id, i, k, CAST([] AS VARCHAR[]) AS done, CASE WHEN length(x) > 1800 THEN list_transform(range(0, (length(x) - 1) // 1800), lambda j: substring(x, j * 1800 + 1, 1800)) ELSE [] END AS cut, substring(x, ((length(x) - 1) // 1800) * 1800 + 1) AS buf FROM s WHERE k = 1
      UNION ALL SELECT n.doc_id, n.i, n.k, CASE WHEN n.fits THEN list_concat(n.done, n.cut) ELSE list_append(list_concat(n.done, n.cut), n.buf) END,
        CASE WHEN length(n.b) > 1800 THEN list_transform(range(0, (length(n.b) - 1) // 1800), lambda j: substring(n.b, j * 1800 + 1, 1800)) ELSE [] END, substring(n.b, ((length(n.b) - 1) // 1800) * 1800 + 1)
      FROM (SELECT p.doc_id, p.i, s.k, p.done, p.cut, p.buf, length(p.buf) + length(s.x) <= 1200 OR p.buf = '' AS fits, CASE WHEN p.buf = '' THEN s.x WHEN length(p.buf) + length(s.x) <= 1200 THEN p.buf || ' ' || s.x ELSE s.x END AS b FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i AND s.k = p.k + 1) n),
w AS (SELECT doc_id, i, list_filter(list_append(list_concat(done, cut), buf), lambda z: trim(z) <> '') AS pieces FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY k DESC) = 1),
f AS (SELECT doc_id, i, length(v) AS n, 0 AS c, length(v) > 1800 AS long FROM l WHERE i = 1
      UNION ALL SELECT l.doc_id, l.i, CASE WHEN l.v_long OR f.long OR (f.n + l.len > 1200 AND f.n >= 200) THEN l.len ELSE f.n + l.len END, CASE WHEN l.v_long OR f.long OR (f.n + l.len > 1200 AND f.n >= 200) THEN f.c + 1 ELSE f.c END, l.v_long
      FROM f JOIN (SELECT doc_id, i, length(v) AS len, length(v) > 1800 AS v_long FROM l) l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
g AS (SELECT f.doc_id, f.c, 0 AS k, string_agg(l.v, chr(10) ORDER BY f.i) AS text FROM f JOIN l USING (doc_id, i) WHERE NOT f.long GROUP BY 1, 2
      UNION ALL SELECT doc_id, c, unnest(range(0, len(pieces))), trim(unnest(pieces)) FROM f JOIN w USING (doc_id, i) WHERE f.long)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c, k) - 1 AS INT) AS chunk, text FROM g"""
)
def chunk_greedy(spark, d):
    """Passages of every document from all its lines."""
    lines = segment.split_lines(docs(spark, d).select("doc_id", "text"), ["doc_id"])
    v = t.strip_spaces("value")
    paras = lines.where(v != "").select("doc_id", "seq", v.alias("text"), F.array(F.lit("")).alias("heading_path"))
    return segment.chunks(paras, ["doc_id"], plain=True).select("doc_id", "chunk", "text")


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^.?!؟\n]+[.?!؟]?')) AS INT) AS n FROM documents")
def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", F.size(t.sentences("text")).alias("n"))


@query(
    "WITH s AS (SELECT doc_id, source, trim(x) AS line, i FROM (SELECT doc_id, source, unnest(range(0, len(z))) AS i, unnest(z) AS x FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^.?!؟\n]+[.?!؟]?') AS z FROM documents))), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s WHERE length(line) BETWEEN 45 AND 130 AND regexp_matches(line, '[.?!؟]$') AND NOT regexp_matches(line, '[{}]') AND length(regexp_replace(line, '[^\\p{L}]', '', 'g')) / length(line) >= 0.55) "
    "SELECT doc_id, source, line FROM g WHERE k = 1"
)
def line_sample(spark, d):
    s = docs(spark, d).select("doc_id", "source", F.posexplode(t.sentences("text")).alias("i", "x")).withColumn("line", F.trim("x"))
    return relational.first_of_each(s.where(t.good_line("line")), ["doc_id"], ["i"]).select("doc_id", "source", "line")


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) ELSE text END AS head, CASE WHEN length(text) > 1000 THEN substring(text, 1001) ELSE '' END AS tail, CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END AS more FROM documents")
def split_core_rest(spark, d):
    core, rest = publish.split_core_rest(docs(spark, d).select("doc_id", "text"), "doc_id", {"text": 1000})
    return core.join(rest.withColumnRenamed("text", "tail"), "doc_id", "left").select("doc_id", F.col("text").alias("head"), F.coalesce("tail", F.lit("")).alias("tail"), "more")


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def contains_match(spark, d):
    """Which documents hold a whole item: shingles find the candidates, so no document meets every item but those of fewer than eight words."""
    b, x = table(spark, d, "benchmark"), docs(spark, d)
    return relational.contained(x.select("doc_id", "text"), b.select("item_id", "text"), "doc_id", "item_id")


_GRAMS = "SELECT {k}, i, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 4)) AS i FROM (SELECT {k}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM {t}) WHERE len(w) >= 6)"


@query(f"WITH a AS ({_GRAMS.format(k='doc_id', t='documents')}), b AS ({_GRAMS.format(k='item_id', t='benchmark')}) SELECT doc_id, item_id, count(*) AS grams, CAST(min(a.i) - 1 AS INT) AS first_word FROM a JOIN b USING (g) GROUP BY 1, 2")
def ngram_match(spark, d):
    left = docs(spark, d).select("doc_id", t.ascii_tokens("text").alias("w"))
    right = table(spark, d, "benchmark").select("item_id", t.ascii_tokens("text").alias("w"))
    pairs = relational.shingle_join(left, right, 6, "w", "w", "doc_id", "item_id")
    return pairs.groupBy(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id")).agg(F.count("*").alias("grams"), F.min("left_pos").alias("first_word"))


@query("WITH h AS (SELECT doc_id, item_id, strpos(d.text, b.text) AS pos FROM documents d, benchmark b WHERE contains(d.text, b.text)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, item_id) - 1 AS ref FROM h) SELECT doc_id, item_id, ref FROM r")
def order_preserving_distinct(spark, d):
    """Each document's items numbered by where they first occur."""
    hits = contains_match(spark, d).join(docs(spark, d).select("doc_id", F.col("text").alias("x")), "doc_id").join(table(spark, d, "benchmark").withColumnRenamed("text", "y"), "item_id").select("doc_id", "item_id", F.position("y", "x").alias("pos"))
    return hits.select("doc_id", "item_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "item_id")) - 1).cast("long").alias("ref"))


@query(
    "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents), c AS (SELECT round, sum(count(*)) OVER (ORDER BY round) AS total FROM r GROUP BY round), "
    "m AS (SELECT min(round) AS last FROM c WHERE total >= 600) SELECT doc_id, source, CAST(round AS INT) AS round FROM r, m WHERE last IS NULL OR round <= last"
)
def round_robin_sample(spark, d):
    return relational.round_robin(docs(spark, d).select("doc_id", "source"), "source", ["doc_id"], 600)


@query("SELECT doc_id, substring(sha256('stub:' || coalesce(text, '')), 1, 16) AS key FROM documents")
def cache_key(spark, d):
    return docs(spark, d).select("doc_id", t.cache_key("stub", "text").alias("key"))


@query("SELECT doc_id, translate(CAST(n_chars AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits FROM documents")
def digits(spark, d):
    return docs(spark, d).select("doc_id", t.arabic_digits(F.col("n_chars")).alias("digits"))


@query("SELECT page_id, sha256(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(t.escape_html("html"), 256).alias("escaped"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[—–]', ', ', 'g'), '(?:,\\s*){2,}', ', ', 'g'), '\\s+,', ',', 'g'), ' {2,}', ' ', 'g') AS clean FROM documents")
def dash_clean(spark, d):
    return docs(spark, d).select("doc_id", t.clean_dashes("text").alias("clean"))


@query("WITH n AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM documents), c AS (SELECT *, length(substring(x, 1, 155)) - strpos(reverse(substring(x, 1, 155)), ' ') AS cut FROM n) SELECT doc_id, CASE WHEN length(x) <= 155 THEN x WHEN strpos(substring(x, 1, 155), ' ') > 0 AND cut > 93 THEN rtrim(substring(x, 1, cut)) || '…' ELSE rtrim(substring(x, 1, 155)) || '…' END AS snippet FROM c")
def snippet(spark, d):
    return docs(spark, d).select("doc_id", t.snippet("text").alias("snippet"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {_BM25}, k AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS n, doc_id FROM b ORDER BY n LIMIT 5) SELECT string_agg('[S' || n || '] (Vol. ' || d.doc_id || ' · p. 1)' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context FROM k JOIN documents d USING (doc_id)")
def rag_context(spark, d):
    from .. import models

    top = retrieve.ranked(bm25_topk(spark, d), "doc_id").where("rank < 5")
    one = F.lit(1)
    hits = docs(spark, d).select("doc_id", "text").join(F.broadcast(top), "doc_id")
    return models.context(hits, "rank", t.cite_en(F.col("doc_id"), one, one), "text")


@query("SELECT doc_id, CAST(floor((i - 1) / 8) AS INT) AS batch, count(*) AS sentences FROM (SELECT doc_id, unnest(range(1, len(z) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.?!؟\n]+[.?!؟]?') AS z FROM documents)) GROUP BY 1, 2")
def batches_of_eight(spark, d):
    cut = docs(spark, d).select("doc_id", F.posexplode(segment.batches_of(t.sentences("text"))).alias("batch", "b"))
    return cut.select("doc_id", "batch", F.size("b").cast("long").alias("sentences")).where("sentences > 0")


@query("SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents")
def running_starts(spark, d):
    return relational.running_starts(docs(spark, d).select("source", "doc_id", "n_chars"), ["source"], "doc_id", F.col("n_chars")).select("source", "doc_id", "start")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS INT) AS n, CAST(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS INT) AS letters FROM documents")
def occurrence_count(spark, d):
    return docs(spark, d).select("doc_id", t.occurrences("text", "the ").alias("n"), F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"))


@query("SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 3")
def dense_topk_per_label(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _first_vector(spark, d)])
    scored = table(spark, d, "embeddings").select("vec_id", "label", F.round(retrieve.dot("embedding", q), 6).alias("score"))
    return relational.top_per_group(scored, ["label"], [F.desc("score"), "vec_id"], 3).drop("rank")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.expr("current_timezone()")))
    made = events.tumbling(rows, "1 day")
    return made.select(F.from_utc_timestamp("start", F.expr("current_timezone()")).cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def _records(spark, d):
    """documents as records: the first line is the heading, the rest the answer."""
    x = docs(spark, d)
    return x.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("hi"), F.lit("").alias("q"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("a"), "source", "text")


_LAST = ", ".join(f"max(CASE WHEN t = {t} THEN pos END) OVER (PARTITION BY id, field ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p{t}" for t in range(3))


@query(
    f"""WITH r AS (SELECT doc_id AS id, lower(coalesce(string_split(text, chr(10))[1], '')) AS hi, lower(coalesce(substring(text, length(string_split(text, chr(10))[1]) + 2), '')) AS a FROM documents),
q(t, term) AS (VALUES (0, 'thand'), (1, 'erin'), (2, 'tion')), n AS (SELECT count(*) AS n FROM r),
df AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM r JOIN q ON contains(hi, term) OR contains(a, term), n GROUP BY t, n), total AS (SELECT sum(idf) AS total FROM df),
c AS (SELECT id, hi, a FROM r JOIN q ON contains(hi, term) OR contains(a, term) GROUP BY ALL HAVING count(*) = 3),
f AS (SELECT id, 'hi' AS field, hi AS x, 24.0 AS k, 3.0 AS w FROM c UNION ALL SELECT id, 'a', a, 2000.0, 0.7 FROM c),
m AS (SELECT id, field, t, regexp_extract_all(x, '\\b' || term || '\\w{{0,4}}\\b') AS hits, string_split_regex(x, '\\b' || term || '\\w{{0,4}}\\b') AS parts FROM f, q),
p AS (SELECT id, field, t, list_sum(list_transform(parts[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda z: length(z))), 0) AS pos FROM (SELECT *, unnest(range(1, least(len(hits), 120) + 1)) AS i FROM m)),
o AS (SELECT id, field, pos, {_LAST} FROM p),
s AS (SELECT id, field, min(pos - least(p0, p1, p2)) FILTER (WHERE (p0 IS NOT NULL)::INT + (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT = present) AS span, any_value(present) AS present FROM o JOIN (SELECT id, field, count(DISTINCT t) AS present FROM p GROUP BY 1, 2) USING (id, field) GROUP BY 1, 2),
z AS (SELECT id, field, any_value(w) * sum(idf) / (1 + ln(1 + any_value(length(x)) / any_value(k))) AS part, sum(idf) / any_value(total) AS share, 1 / (1 + ln(1 + any_value(length(x)) / any_value(k))) AS norm, any_value(span) AS span, any_value(present) AS present
      FROM f JOIN s USING (id, field) JOIN (SELECT DISTINCT id, field, t FROM p) USING (id, field) JOIN df USING (t), total GROUP BY id, field),
y AS (SELECT id, sum(part) AS part, max(CASE WHEN present = 1 THEN 0.12 / 3 ELSE least(1.0, 20 / greatest(span, 20)) * present / 3 END * CASE WHEN field = 'a' THEN 0.55 * norm ELSE 1 END) AS near, max(CASE WHEN field = 'hi' THEN share ELSE 0 END) AS subject FROM z GROUP BY id),
ph AS (SELECT id, regexp_matches(hi, e) OR regexp_matches(a, e) AS phrase FROM c, (SELECT '\\bthand\\w{{0,4}}[\\s،,;:]+\\berin\\w{{0,4}}[\\s،,;:]+\\btion\\w{{0,4}}' AS e)),
u AS (SELECT c.id, (coalesce(part, 0) + 2.2 * coalesce(near, 0) * total + CASE WHEN phrase THEN 1.2 * total ELSE 0 END) / total * (0.4 + 0.6 * coalesce(subject, 0)) AS score FROM c LEFT JOIN y USING (id) JOIN ph USING (id), total)
SELECT id, round(score, 6) AS score, CAST(greatest(1, floor(100 * (1 - exp(-score / 2.2)) + 0.5)) AS INT) AS pct FROM u"""
)
def lexical_search(spark, d):
    return retrieve.lexical_search(_records(spark, d), "thand erin tion")


@query(
    f"""WITH b AS (SELECT doc_id AS id, source, list_distinct(list_filter({_WORDS}, lambda x: length(x) > 2)) AS bag FROM documents),
e AS (SELECT id, source, len(bag) AS size, unnest(bag) AS word FROM b), o AS (SELECT unnest(bag) AS word FROM b WHERE id = 3), n AS (SELECT count(*) AS n FROM b),
f AS (SELECT word, ln(n / count(*)) AS w FROM e JOIN o USING (word), n GROUP BY word, n HAVING count(*) <= 0.2 * n),
s AS (SELECT id, round(sum(w) / sqrt(size) * CASE WHEN source = (SELECT source FROM b WHERE id = 3) THEN 1.35 ELSE 1 END, 6) AS score FROM e JOIN f USING (word) WHERE id <> 3 GROUP BY id, source, size ORDER BY score DESC, id LIMIT 6)
SELECT id, score, CAST(greatest(8, round(100 * score / max(score) OVER ())) AS INT) AS pct FROM s"""
)
def lexical_similar(spark, d):
    return retrieve.similar_by_words(_records(spark, d), "id", t.ascii_tokens("text"), F.col("source"), 3)


_BARE = "array_to_string(list_filter(l, lambda c, i: i = 1 OR c <> l[i - 1]), '')"


# Every reading's probes in order: the whole, what follows an opening formula, then its beginnings of six words or more and 80 % of its length;
# the fourth reading takes the whole alone. `verses`: chapter, verse, text; `said`: its key columns, text; `fold`, `bare`: text to reading
# 1 and, uncollapsed, to reading 4; `thin`: reading 2 to 3.
_FOLDED = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NO_VOWELS = "regexp_replace({0}, '[aeiou]', '', 'g')"


def _cascade_sql(verses: str, said: str, keys: str, fold: str, thin: str, bare: str, formulas: list[str] = ()) -> str:
    formula = " ".join(f"WHEN starts_with(f, {x}) AND length(f) > length({x}) + 12 THEN trim(substring(f, length({x}) + 1))" for x in (fold.format(f"'{y}'") for y in formulas))
    without = f"CASE {formula} END" if formula else "NULL::VARCHAR"
    return f"""WITH b AS MATERIALIZED (SELECT chapter, verse, row_number() OVER (ORDER BY chapter, verse) AS k, {fold.format('text')} AS r1, {bare.format('text')} AS r4 FROM ({verses})),
v AS (SELECT *, replace(r1, ' ', '') AS r2, {thin.format("replace(r1, ' ', '')")} AS r3 FROM b), w AS (SELECT * REPLACE ({_BARE} AS r4) FROM (SELECT *, string_split(r4, '') AS l FROM v)),
h AS (SELECT 1 AS r, string_agg(r1, ' ' ORDER BY k) AS hay FROM w UNION ALL SELECT 2, string_agg(r2, '' ORDER BY k) FROM w UNION ALL SELECT 3, string_agg(r3, '' ORDER BY k) FROM w UNION ALL SELECT 4, string_agg(r4, '' ORDER BY k) FROM w),
st AS (SELECT r, k, chapter, verse, sum(n) OVER (PARTITION BY r ORDER BY k) - n AS start FROM (SELECT 1 AS r, k, chapter, verse, length(r1) + 1 AS n FROM w UNION ALL SELECT 2, k, chapter, verse, length(r2) FROM w UNION ALL SELECT 3, k, chapter, verse, length(r3) FROM w UNION ALL SELECT 4, k, chapter, verse, length(r4) FROM w)),
s AS MATERIALIZED (SELECT {keys}, f, f4, string_split(f, ' ') AS words FROM (SELECT {keys}, {fold.format('text')} AS f, {bare.format('text')} AS f4 FROM ({said})) WHERE f <> ''), u AS (SELECT *, len(words) < 3 AS short, unnest(list_concat([len(words)], range(len(words) - 1, 5, -1))) AS n FROM s),
p AS (SELECT {keys}, short, f4, 2 * (len(words) - n) AS probe, array_to_string(words[1:n], ' ') AS x FROM u WHERE n = len(words) OR length(array_to_string(words[1:n], ' ')) >= 0.8 * length(f)
      UNION ALL SELECT {keys}, len(words) < 3, f4, 1, {without} FROM s),
k AS (SELECT {keys}, short, 1 AS r, probe, x AS needle FROM p UNION ALL SELECT {keys}, short, 2, probe, replace(x, ' ', '') FROM p UNION ALL SELECT {keys}, short, 3, probe, {thin.format("replace(x, ' ', '')")} FROM p
      UNION ALL SELECT {keys}, short, 4, probe, {_BARE} FROM (SELECT {keys}, short, probe, string_split(f4, '') AS l FROM p WHERE probe = 0)),
m AS (SELECT {keys}, r, probe, strpos(hay, needle) - 1 AS place, length(needle) AS n FROM k JOIN h USING (r) WHERE length(needle) >= 12 AND contains(hay, needle) AND NOT (short AND contains(substring(hay, strpos(hay, needle) + 1), needle))),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY r, probe) = 1),
y AS (SELECT {keys}, o.r, max(k) FILTER (WHERE start <= place) AS k0, max(k) FILTER (WHERE start <= place + n - 1) AS k1 FROM o JOIN st ON st.r = o.r GROUP BY {keys}, o.r, place, n)
SELECT {keys}, a.chapter, a.verse AS verse_start, CASE WHEN z.chapter = a.chapter THEN z.verse ELSE a.verse END AS verse_end, CAST(r AS INT) AS reading FROM y JOIN b a ON a.k = k0 JOIN b z ON z.k = k1"""


_SENTENCES = """SELECT doc_id, CAST(i AS INT) AS pos, z[i + 1] AS text FROM (SELECT doc_id, z, unnest(range(0, len(z))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.?!؟
]+[.?!؟]?') AS z FROM documents))"""


@query(_cascade_sql("SELECT 1 AS chapter, item_id AS verse, text FROM benchmark", _SENTENCES, "doc_id, pos", _FOLDED, _NO_VOWELS, _NO_VOWELS.format(f"replace({_FOLDED}, ' ', '')")).replace("SELECT doc_id, pos, a.chapter, ", "SELECT doc_id, pos, "))
def quotation_cascade(spark, d):
    """Benchmark items as the reference text; every document's sentences are looked up in it in four readings."""
    verses = table(spark, d, "benchmark").select(F.lit(1).cast("long").alias("chapter"), F.col("item_id").alias("verse"), "text")
    rows = docs(spark, d).select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "quote"))
    return seeds.identify(rows, seeds.build(verses, quotes.PLAIN)).where("found IS NOT NULL").select("doc_id", "pos", "found.verse_start", "found.verse_end", "found.reading")


#: Latin letters as Arabic ones. The verses are spelt with the marks of a vocalised print, the documents plainly.
_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyzáéíóúñäöü", "ابكدهفغحيجقلمنوثصرستعطوخىزائإؤآةأذض"
_SPELT = (("سا", "سٰ"), ("زا", "زىٰ"), ("كا", "كَوٰا"), ("ه ", "هِۦ "), ("حي", "حۦ"), ("ب", "بَ"), ("ن", "نۡ"))
#: How the documents differ, by doc_id: as they are, other word limits, no alefs, an open ta, after a formula.
_VARIANTS = {1: ("و ", "و"), 2: ("ا", ""), 3: ("ه", "ت")}
_MARK_SQL = "\\x{064B}-\\x{065F}\\x{0640}\\x{0670}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E4}\\x{06E7}-\\x{06ED}"
_VOWEL_SQL = "\\x{064B}-\\x{065F}\\x{0640}"


def _prepared_sql(x: str) -> str:
    """The rewrites of quotes.prepare without looking ahead: what follows is taken along."""
    rules = [(f"ى([{_VOWEL_SQL}]*)ٰ([{_VOWEL_SQL}]*)([^\\s{_MARK_SQL}])", "ا\\1\\2\\3")] * 2
    rules += [(f"و[{_VOWEL_SQL}]*ٰ[{_VOWEL_SQL}]*ا", "ا"), (f"و[{_VOWEL_SQL}]*ٰ[{_VOWEL_SQL}]*ة", "اة"), (f"([اى])([{_VOWEL_SQL}]*)ٰ", "\\1\\2")]
    rules += [(f"(ه[{_VOWEL_SQL}]*)ۦ([{_MARK_SQL}]*(?:\\s|$))", "\\1\\2"), ("[ۦۧ]", "ي")]
    for find, put in rules:
        x = f"regexp_replace({x}, '{find}', '{put}', 'g')"
    return x


def _folded_sql(x: str) -> str:
    """The index's form of a text without page tags."""
    marks = "\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E8}\\x{06EA}-\\x{06ED}"
    x = f"translate(replace(regexp_replace({x}, '[{marks}]', '', 'g'), 'ـ', ''), 'آأإٱىةؤئء', 'اااايهوي')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}{WHITE}_\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]', ' ', 'g'), '[{WHITE}]+', ' ', 'g'))"


def _verses_sql() -> str:
    x = f"translate(lower(text), '{_LATIN}', '{_ARABIC}')"
    for find, put in _SPELT:
        x = f"replace({x}, '{find}', '{put}')"
    return f"SELECT 1 + item_id // 10 AS chapter, item_id % 10 AS verse, {x} AS text FROM benchmark"


_PLAIN_AR = f"translate(lower(text), '{_LATIN}', '{_ARABIC}')"
_SAID_AR = f"""SELECT doc_id, pos, CASE doc_id % 6 {' '.join(f"WHEN {k} THEN replace(x, '{a}', '{b}')" for k, (a, b) in _VARIANTS.items())} WHEN 4 THEN 'بسم الله الرحمن الرحيم ' || x ELSE x END AS text FROM (SELECT doc_id, pos, {_PLAIN_AR} AS x FROM ({_SENTENCES}))
UNION ALL SELECT -1 - item_id, 0, {_PLAIN_AR} FROM (SELECT item_id, array_to_string(w[-8:], ' ') || ' ' || array_to_string(next[1:8], ' ') AS text FROM (SELECT item_id, w, lead(w) OVER (ORDER BY item_id) AS next FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)) WHERE next IS NOT NULL)"""
_FOLD_AR = _folded_sql(f"translate({_prepared_sql('@')}, 'ٰۥ۞۩\u2009', 'ا')").replace("{", "{{").replace("}", "}}").replace("@", "{0}")
_LOOSE_AR = "replace(replace(replace(" + _folded_sql(f"regexp_replace({_prepared_sql('@')}, '[ئؤ]|[يو][\u0654\u0655]', '', 'g')") + ", 'ت', 'ه'), ' ', ''), 'ا', '')"
_LOOSE_AR = _LOOSE_AR.replace("{", "{{").replace("}", "}}").replace("@", "{0}")


@query(_cascade_sql(_verses_sql(), _SAID_AR, "doc_id, pos", _FOLD_AR, "replace({0}, 'ا', '')", _LOOSE_AR, list(quotes.FORMULAS)))
def arabic_cascade(spark, d):
    """The items as vocalised Arabic in chapters of ten; sentences in plain spelling, and what ends an item and begins the next."""
    def plain(c):
        return F.translate(F.lower(c), _LATIN, _ARABIC)

    spelt = plain("text")
    for find, put in _SPELT:
        spelt = F.replace(spelt, F.lit(find), F.lit(put))
    items, x = table(spark, d, "benchmark"), F.col("item_id")
    verses = items.select((1 + F.floor(x / 10)).cast("long").alias("chapter"), (x % 10).alias("verse"), spelt.alias("text"))
    said = docs(spark, d).select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "s")).withColumn("x", plain("s"))
    of, quote = F.col("doc_id") % 6, F.col("x")
    for k, (find, put) in _VARIANTS.items():
        quote = F.when(of == k, F.replace("x", F.lit(find), F.lit(put))).otherwise(quote)
    said = said.select("doc_id", "pos", F.when(of == 4, F.concat(F.lit(quotes.FORMULAS[0] + " "), "x")).otherwise(quote).alias("quote"))
    words = items.select("item_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    following = words.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("next"))
    over = F.concat_ws(" ", F.slice("w", F.greatest(F.lit(1), F.size("w") - 7), 8), F.slice("next", 1, 8))
    borders = words.join(following, "item_id").select((-1 - x).alias("doc_id"), F.lit(0).alias("pos"), plain(over).alias("quote"))
    found = seeds.identify(said.unionByName(borders), seeds.build(verses, quotes.ARABIC)).where("found IS NOT NULL")
    return found.select("doc_id", "pos", "found.*")


_LAST_CUT = "CASE WHEN contains(w, {0}) THEN length(w) - strpos(reverse(w), {0}) ELSE -1 END"


# The tables hold no braces, so every place is level.
@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
z AS (SELECT doc_id, i, p[i] AS p FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(x, '[.!?؟؛]*[^.!?؟؛]+[.!?؟؛]*\\s*') AS p FROM d))),
e AS (SELECT doc_id, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS b, length(p) - length(regexp_extract(p, '^[.!?؟؛]*')) AS n FROM z),
c AS (SELECT doc_id, i, CAST(b - n AS BIGINT) AS a, CAST(b AS BIGINT) AS b, false AS cut FROM e
      UNION ALL SELECT doc_id, i, a + k + 1, b, true FROM (SELECT doc_id, i, a, b, CASE WHEN k1 > 248 THEN k1 WHEN k2 > 248 THEN k2 WHEN k3 > 248 THEN k3 END AS k FROM (SELECT doc_id, i, a, b, {_LAST_CUT.format("'،'")} AS k1, {_LAST_CUT.format("','")} AS k2, {_LAST_CUT.format("' '")} AS k3 FROM (SELECT c.doc_id, i, a, b, substring(x, CAST(a AS INT) + 1, 620) AS w FROM c JOIN d ON d.doc_id = c.doc_id WHERE b - a > 1240))) WHERE k IS NOT NULL),
p AS (SELECT DISTINCT doc_id, a AS p FROM c WHERE cut UNION SELECT doc_id, b FROM c),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS s, min(p) AS e FROM p WHERE p >= 620 GROUP BY doc_id UNION ALL SELECT r.doc_id, r.e, min(p.p) FROM r JOIN p ON p.doc_id = r.doc_id AND p.p >= r.e + 620 GROUP BY r.doc_id, r.e),
t AS (SELECT doc_id, length(x) AS n, coalesce(max(e), 0) AS last FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id, x)
SELECT doc_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM r UNION ALL SELECT doc_id, CAST(last AS INT), CAST(n AS INT) FROM t WHERE n > last OR n = 0"""
)
def paragraph_tiling(spark, d):
    return docs(spark, d).select("doc_id", F.explode(segment.tiling(F.coalesce("text", F.lit("")))).alias("r")).select("doc_id", F.col("r")[0].alias("start"), F.col("r")[1].alias("end"))


def _located(runs: str) -> str:
    """The runs (f1) with their readings and the first one that stands in the reference text; 0: too short to tell. What a run begins
    with is looked up among the reference's runs of 12 characters first."""
    forms = ("f1", "r2", "r3", "r4")
    tests = " ".join(f"WHEN g{k}.g IS NOT NULL AND contains(h{k}, {x}) THEN {k}" for k, x in enumerate(forms, 1))
    joins = " ".join(f"LEFT JOIN g g{k} ON g{k}.r = {k} AND length({x}) >= 12 AND g{k}.g = left({x}, 12)" for k, x in enumerate(forms, 1))
    return f"""SELECT doc_id, pos, i, e, f1, r2, r3, r4, CASE {tests} WHEN length(r4) < 12 THEN 0 END AS hit
    FROM (SELECT *, {_BARE} AS r4 FROM (SELECT *, string_split(r3, '') AS l FROM (SELECT *, regexp_replace(r2, '[aeiou]', '', 'g') AS r3 FROM (SELECT *, replace(f1, ' ', '') AS r2 FROM ({runs}))))) {joins}, h"""


_JOINED = "array_to_string(list_filter(x[i:{0}], lambda y: y <> ''), ' ')"


# Runs of six words that stand in a reading, and every longer one while they do, or while they are too short to tell.
def _longest_sql(said: str) -> str:
    return f"""WITH RECURSIVE b AS (SELECT item_id, {_FOLDED.format('text')} AS f FROM benchmark),
v AS (SELECT item_id, f AS r1, replace(f, ' ', '') AS r2, regexp_replace(replace(f, ' ', ''), '[aeiou]', '', 'g') AS r3 FROM b), w AS (SELECT *, {_BARE} AS r4 FROM (SELECT *, string_split(r3, '') AS l FROM v)),
h AS MATERIALIZED (SELECT string_agg(r1, ' ' ORDER BY item_id) AS h1, string_agg(r2, '' ORDER BY item_id) AS h2, string_agg(r3, '' ORDER BY item_id) AS h3, string_agg(r4, '' ORDER BY item_id) AS h4 FROM w),
st AS (SELECT r, item_id, sum(n) OVER (PARTITION BY r ORDER BY item_id) - n AS start FROM (SELECT 1 AS r, item_id, length(r1) + 1 AS n FROM w UNION ALL SELECT 2, item_id, length(r2) FROM w UNION ALL SELECT 3, item_id, length(r3) FROM w UNION ALL SELECT 4, item_id, length(r4) FROM w)),
q0 AS MATERIALIZED (SELECT doc_id, pos, list_transform(x, lambda y: {_FOLDED.format('y')}) AS x FROM (SELECT doc_id, pos, list_filter(string_split_regex(text, '[{WHITE}]+'), lambda y: y <> '') AS x FROM ({said})) WHERE len(x) >= 6),
g AS MATERIALIZED (SELECT DISTINCT r, hay[i:i + 11] AS g FROM (SELECT r, hay, unnest(range(1, length(hay) - 10)) AS i FROM (SELECT unnest([1, 2, 3, 4]) AS r, unnest([h1, h2, h3, h4]) AS hay FROM h))),
n AS (SELECT doc_id, pos, unnest([f1, r2, r3, r4]) AS form, unnest([1, 2, 3, 4]) AS r FROM (SELECT *, {_BARE} AS r4 FROM (SELECT *, string_split(r3, '') AS l FROM (SELECT *, regexp_replace(r2, '[aeiou]', '', 'g') AS r3 FROM (SELECT *, replace(f1, ' ', '') AS r2 FROM (SELECT doc_id, pos, array_to_string(list_filter(x, lambda y: y <> ''), ' ') AS f1 FROM q0)))))),
q AS MATERIALIZED (SELECT q0.* FROM q0 SEMI JOIN (SELECT doc_id, pos FROM (SELECT doc_id, pos, r, form[i:i + 11] AS g FROM (SELECT *, unnest(range(1, length(form) - 10)) AS i FROM n)) SEMI JOIN g USING (r, g)) USING (doc_id, pos)),
r AS ({_located("SELECT doc_id, pos, i, i + 5 AS e, " + _JOINED.format('i + 5') + " AS f1 FROM (SELECT doc_id, pos, x, unnest(range(1, len(x) - 4)) AS i FROM q)")}
      UNION ALL {_located("SELECT r.doc_id, r.pos, r.i, r.e + 1 AS e, " + _JOINED.format('e + 1') + " AS f1 FROM r JOIN q ON q.doc_id = r.doc_id AND q.pos = r.pos WHERE hit IS NOT NULL AND r.e < len(x)")}),
o AS (SELECT * FROM (SELECT * FROM r WHERE hit > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY e - i DESC, i) = 1) WHERE length(f1) >= 30),
p AS (SELECT o.*, strpos([h1, h2, h3, h4][hit], [f1, r2, r3, r4][hit]) - 1 AS place FROM o, h)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(i - 1 AS INT) AS first, CAST(e AS INT) AS last, max(item_id) AS verse FROM p JOIN st ON st.r = p.hit AND start <= place GROUP BY doc_id, pos, i, e"""


@query(_longest_sql(_SENTENCES))
def longest_run(spark, d):
    """The longest run of each sentence that stands word for word in the benchmark items."""
    verses = table(spark, d, "benchmark").select(F.lit(1).cast("long").alias("chapter"), F.col("item_id").alias("verse"), "text")
    rows = docs(spark, d).select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "quote"))
    found = seeds.longest_runs(rows, seeds.build(verses, quotes.PLAIN)).where("run IS NOT NULL")
    return found.select("doc_id", "pos", "run.first", "run.last", "run.verse")


@query("SELECT place, count(*) AS n FROM (SELECT c_nationkey AS place FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def place_visits(spark, d):
    from ..operators import small

    pairs = table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(table(spark, d, "supplier").select(F.lit(None).cast("int").alias("a"), F.col("s_nationkey").alias("b")))
    return small.visits(pairs).where("place IS NOT NULL")


@query("SELECT doc_id, url_encode(array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 12), ' ')) AS phrase FROM documents WHERE len(regexp_extract_all(text, '\\S+')) >= 3")
def lookup_links(spark, d):
    return docs(spark, d).select("doc_id", t.lookup_phrase("text").alias("phrase")).where("phrase IS NOT NULL")


@query("SELECT doc_id, CASE WHEN length(text) > 130 THEN rtrim(substring(text, 1, 130), ' ' || chr(10)) || '…' ELSE text END AS tip FROM documents")
def tooltips(spark, d):
    return docs(spark, d).select("doc_id", publish.trim_tooltip("text").alias("tip"))


@query("SELECT page_id, '<url><loc>https://site.example/' || page_id || '</loc></url>' AS value FROM pages")
def sitemap(spark, d):
    p = table(spark, d, "pages").select("page_id")
    return publish.sitemap_entries(p.withColumn("k", F.col("page_id")), "https://site.example", "k").withColumn("page_id", F.regexp_extract("value", r"/(\d+)</loc>", 1).cast("long"))


@query("SELECT doc_id, toxic, quality FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k FROM labels) WHERE (toxic = 1 AND k <= 40) OR (toxic = 0 AND k <= 60)")
def stratified_sample(spark, d):
    return relational.stratified(table(spark, d, "labels").select("doc_id", "toxic", "quality"), F.col("toxic") == 1, 100, ["doc_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def result_page(spark, d):
    return relational.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3)


from . import flows, records, spans, texts  # noqa: E402, F401  their queries register themselves

__all__ = ["ORACLE_SQL", "QUERIES"]
