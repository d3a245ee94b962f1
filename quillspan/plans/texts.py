"""Queries of the text functions, over whole tables. Marks, tags and braces that the tables lack are written into their texts
by rule first, in the query and in its SQL alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import segment, spans
from ..sources.readers import table
from .registry import docs, query

#: Arabic letters with marks in place of Latin ones, and a page tag and a milestone in front.
_LETTERS = ("aeioutnsr", "اأإىةتؤئء")
_AR = "replace(replace(translate(coalesce(text, ''), 'aeioutnsr', 'اأإىةتؤئء'), 'ت', 'تَ'), 'ا', 'ا۞ـ')"
_TAGGED = "'PageV01P002 ms12 ' || coalesce(text, '') || ' PageV1P3'"


def _arabic(c="text"):
    x = F.translate(F.coalesce(F.col(c), F.lit("")), *_LETTERS)
    return F.replace(F.replace(x, F.lit("ت"), F.lit("تَ")), F.lit("ا"), F.lit("ا۞ـ"))


def _tagged(c="text"):
    return F.concat(F.lit("PageV01P002 ms12 "), F.coalesce(F.col(c), F.lit("")), F.lit(" PageV1P3"))


def _one(spark, d, **columns):
    return docs(spark, d).select("doc_id", *[x.alias(n) for n, x in columns.items()])


_MARKS = "\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E8}\\x{06EA}-\\x{06ED}"
_MARKS_WIDE = "\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}\\x{0640}"


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace({_TAGGED}, 'PageV(\\d+)P(\\d+)', ' ', 'g'), '\\bms\\d+\\b', ' ', 'g')) AS x FROM documents")
def strip_markers(spark, d):
    return _one(spark, d, x=F.sha2(t.strip_markers(_tagged()), 256))


@query(f"SELECT doc_id, sha256(regexp_replace({_AR}, '[{_MARKS}]', '', 'g')) AS narrow, sha256(regexp_replace({_AR}, '[{_MARKS_WIDE}]', '', 'g')) AS wide FROM documents")
def strip_marks(spark, d):
    return _one(spark, d, narrow=F.sha2(t.strip_marks(_arabic()), 256), wide=F.sha2(t.strip_marks(_arabic(), wide=True), 256))


@query(f"SELECT doc_id, sha256(lower(translate(regexp_replace({_AR}, '[{_MARKS_WIDE}]', '', 'g'), 'آأإٱىؤئةء', 'ااااي' || 'ويه'))) AS x FROM documents")
def fold_for_search(spark, d):
    return _one(spark, d, x=F.sha2(t.fold_search(_arabic()), 256))


@query(
    f"""WITH m AS (SELECT doc_id, translate(replace(regexp_replace(regexp_replace(regexp_replace({_TAGGED.replace("coalesce(text, '')", _AR)}, 'PageV(\\d+)P(\\d+)', ' ', 'g'), '\\bms\\d+\\b', ' ', 'g'), '[{_MARKS}]', '', 'g'), 'ـ', ''), 'آأإٱىةؤئء', 'اااايهوي') AS x FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(x, '[^\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\s_\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]', ' ', 'g'), '\\s+', ' ', 'g'))) AS x FROM m"""
)
def fold_for_index(spark, d):
    x = F.concat(F.lit("PageV01P002 ms12 "), _arabic(), F.lit(" PageV1P3"))
    return _one(spark, d, x=F.sha2(t.fold(x), 256))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(replace({_TAGGED.replace('text', 'replace(text, chr(111), chr(1600))')}, chr(1600), ''), 'PageV(\\d+)P(\\d+)', ' ', 'g'), '\\bms\\d+\\b', ' ', 'g'), '\\s+', ' ', 'g'))) AS x FROM documents")
def clean_for_embedding(spark, d):
    return _one(spark, d, x=F.sha2(t.clean_for_embedding(F.concat(F.lit("PageV01P002 ms12 "), F.coalesce(F.replace("text", F.lit("o"), F.lit("ـ")), F.lit("")), F.lit(" PageV1P3"))), 256))


@query("SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS x, CAST(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS INT) AS words FROM documents")
def normalised_space(spark, d):
    return _one(spark, d, x=F.sha2(t.norm_ws("text"), 256), words=t.word_count("text"))


@query("SELECT doc_id, regexp_matches(CASE WHEN lang = 'fr' THEN translate(text, 'e', 'ي') ELSE coalesce(text, '') END, '[\\x{0600}-\\x{06FF}]') AS arabic FROM documents")
def has_arabic(spark, d):
    return _one(spark, d, arabic=t.has_arabic(F.when(F.col("lang") == "fr", F.translate("text", "e", "ي")).otherwise(F.coalesce("text", F.lit("")))))


_STOP = ", ".join(f"'{w}'" for w in t.STOP_EN + t.STOP_AR)


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 2) AS w FROM documents),
p AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w) GROUP BY 1, 2),
k AS (SELECT *, x NOT IN ({_STOP}) AS telling FROM p), a AS (SELECT *, max(telling) OVER (PARTITION BY doc_id) AS any_telling FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM a WHERE telling OR NOT any_telling)
SELECT doc_id, string_agg(x, ' ' ORDER BY n) AS terms FROM r WHERE n <= 12 GROUP BY 1"""
)
def content_tokens(spark, d):
    return _one(spark, d, terms=F.array_join(t.content_tokens(t.ascii_tokens("text")), " ")).where("terms <> ''")


@query("SELECT word, CASE WHEN length(regexp_replace(word, '(ing|ed|es|s)$', '')) >= 4 THEN regexp_replace(word, '(ing|ed|es|s)$', '') ELSE word END AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM documents) GROUP BY 1, 2")
def stems(spark, d):
    return docs(spark, d).select(F.explode(t.ascii_tokens("text")).alias("word")).groupBy("word", t.stem("word").alias("stem")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS l FROM documents) SELECT doc_id, sha256(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), '')) AS x FROM l")
def doubled_letters(spark, d):
    return _one(spark, d, x=F.sha2(t.collapse_doubled("text"), 256))


_CUT = """WITH h AS (SELECT doc_id, {x} AS x, substring({x}, 1, 201) AS h FROM documents), c AS (SELECT *, CASE WHEN contains(h, ' ') AND length(h) - strpos(reverse(h), ' ') >= 120 THEN length(h) - strpos(reverse(h), ' ') ELSE 200 END AS cut FROM h),
s AS (SELECT *, substring(x, 1, cut) AS s FROM c), o AS (SELECT *, length(s) - length(replace(s, '{{', '')) > length(s) - length(replace(s, '}}', '')) AS opens FROM s)
SELECT doc_id, CASE WHEN length(x) <= 200 THEN x ELSE regexp_replace(CASE WHEN opens THEN substring(s, 1, length(s) - strpos(reverse(s), '{{')) ELSE s END, '\\s+$', '') || ' …' END AS x FROM o"""
_BRACED = "replace(replace(coalesce(text, ''), 'th', '{th'), 'er', 'er}')"


def _braced():
    return F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("th"), F.lit("{th")), F.lit("er"), F.lit("er}"))


@query(_CUT.format(x=_BRACED))
def excerpts(spark, d):
    return _one(spark, d, x=t.excerpt(_braced(), 200))


@query(f"SELECT doc_id, sha256(replace(regexp_replace(replace(replace(replace({_BRACED}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\{{([^{{}}]+)\\}}', '<span class=\"quote\">﴿\\1﴾</span>', 'g'), chr(10), '<br>')) AS x, length({_BRACED}) - length(replace({_BRACED}, '{{', '')) = length({_BRACED}) - length(replace({_BRACED}, '}}', '')) AS level FROM documents")
def ornate_braces(spark, d):
    return _one(spark, d, x=F.sha2(t.ornate_braces(_braced()), 256), level=t.balanced(_braced()))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS x FROM pages")
def escape_quotes(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(t.escape_html("html", quotes=True), 256).alias("x"))


_AR_DIGITS = "translate(CAST({0} AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩')"


@query(f"SELECT l_orderkey, l_linenumber, 'Vol. ' || l_linenumber || ' · ' || CASE WHEN l_suppkey = l_partkey THEN 'p. ' || l_suppkey ELSE 'pp. ' || l_suppkey || '–' || l_partkey END AS en, 'المجلد ' || {_AR_DIGITS.format('l_linenumber')} || ' · ص ' || CASE WHEN l_suppkey = l_partkey THEN {_AR_DIGITS.format('l_suppkey')} ELSE {_AR_DIGITS.format('l_suppkey')} || '–' || {_AR_DIGITS.format('l_partkey')} END AS ar FROM lineitem")
def citations(spark, d):
    x = table(spark, d, "lineitem")
    v, a, b = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    return x.select("l_orderkey", "l_linenumber", t.cite_en(v, a, b).alias("en"), t.cite_ar(v, a, b).alias("ar"))


@query(f"SELECT p_partkey, CASE WHEN p_size = 1 THEN 'موضعٌ واحد' WHEN p_size = 2 THEN 'موضعان' WHEN p_size BETWEEN 3 AND 10 THEN {_AR_DIGITS.format('p_size')} || ' مواضع' ELSE {_AR_DIGITS.format('p_size')} || ' موضعاً' END AS places, format('{{:,}}', p_partkey * 1009) AS big FROM part")
def counted_nouns(spark, d):
    return table(spark, d, "part").select("p_partkey", t.counted(F.col("p_size")).alias("places"), t.thousands(F.col("p_partkey") * 1009).alias("big"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\\p{L}')) AS DOUBLE) / greatest(length(coalesce(text, '')), 1) AS share FROM documents")
def letter_shares(spark, d):
    return _one(spark, d, share=t.letter_share("text"))


@query("SELECT o_orderkey, CAST(round((o_custkey - o_custkey / 33.7) + 622) AS INT) AS year FROM orders")
def years(spark, d):
    return table(spark, d, "orders").select("o_orderkey", t.hijri_to_ce(F.col("o_custkey")).alias("year"))


_TILE_SQL = "regexp_extract_all({x}, '[^.!?؟؛]+[.!?؟؛]*\\s*')"


@query(f"SELECT doc_id, CAST(len({_TILE_SQL.format(x=chr(99) + 'oalesce(text, chr(32))')}) AS INT) AS n, sha256(coalesce(array_to_string({_TILE_SQL.format(x=chr(99) + 'oalesce(text, chr(32))')}, '|'), '')) AS x FROM documents")
def sentences_with_stops(spark, d):
    s = t.tile_sentences(F.coalesce("text", F.lit(" ")))
    return _one(spark, d, n=F.size(s), x=F.sha2(F.array_join(s, "|"), 256))


@query(
    """WITH z AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?؟؛])\\s+', '\\1' || chr(10), 'g') AS x FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(x, '\\n+'), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '') AS s FROM z)
SELECT doc_id, CAST(len(s) AS INT) AS n, sha256(coalesce(array_to_string(s, '|'), '')) AS x FROM l"""
)
def sentences_by_line(spark, d):
    s = t.line_sentences("text")
    return _one(spark, d, n=F.size(s), x=F.sha2(F.array_join(s, "|"), 256))


@query(
    """WITH m AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, string_split_regex(lower(coalesce(text, '')), '[a-z0-9]+') AS g FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, length(g[i]) AS gap, length(w[i]) AS len FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m)),
e AS (SELECT doc_id, i, word, sum(gap + len) OVER (PARTITION BY doc_id ORDER BY i) AS e, len FROM p)
SELECT doc_id, count(*) AS n, sha256(string_agg(word || ':' || CAST(e - len AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY i)) AS x FROM e GROUP BY 1"""
)
def word_offsets(spark, d):
    own = spans.filled(docs(spark, d), ["doc_id"], t.words_with_offsets("text"), "w")
    said = F.transform("w", lambda z: F.concat(z["word"], F.lit(":"), z["start"].cast("string"), F.lit("-"), z["end"].cast("string")))
    return own.select("doc_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join(said, ","), 256).alias("x"))


@query("SELECT event_id, regexp_replace(regexp_replace(regexp_replace('{\"a — b\": \"x' || ', ' || event_type || ', ' || 'y\", \"n\": ' || user_id || ', \"l\": [\"p' || ', ' || 'q\"]}', ' {2,}', ' ', 'g'), '\\s+,', ',', 'g'), 'zzz', '') AS j FROM events")
def json_dashes(spark, d):
    raw = F.concat(F.lit('{"a — b": "x— '), F.col("event_type"), F.lit('– y", "n": '), F.col("user_id").cast("string"), F.lit(', "l": ["p—q"]}'))
    return table(spark, d, "events").select("event_id", t.clean_json_dashes(raw).alias("j"))


# A word stands between characters that are no ASCII letters, numbers or underlines; two in a row need two passes, as the first takes the border.
_ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_ONE_WORD = "'(?i)(^|[^A-Za-z0-9_])(thand|tion)($|[^A-Za-z0-9_])', '\\1<mark>\\2</mark>\\3', 'g'"


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace({_ESCAPED}, {_ONE_WORD}), {_ONE_WORD.replace('(^|[^A-Za-z0-9_])', '(^|[^A-Za-z0-9_>])')})) AS x FROM documents")
def highlights(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(t.highlight("text", ["thand", "tion"]), 256).alias("x"))


_BETWEEN = f"[{_MARKS_WIDE}]*"
_IN_ARABIC = _BETWEEN.join(["[اأإآٱ]", "[يىئی]"]) + "|" + _BETWEEN.join(["ن", "[اأإآٱ]"])


@query(f"SELECT doc_id, sha256(regexp_replace(replace(replace(replace({_AR}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '({_IN_ARABIC})', '<mark>\\1</mark>', 'g')) AS x FROM documents")
def highlights_arabic(spark, d):
    """Arabic letters in any form, whatever marks stand between them."""
    return _one(spark, d, x=F.sha2(t.highlight(_arabic(), ["اي", "نا"]), 256))


# --- headings, topics and openers


_HEADED = "CASE WHEN length({0}) % 2 = 0 THEN '[ ' || {0} || ' ]' ELSE ' ' || {0} END"


@query(f"SELECT doc_id, CASE WHEN length(line) % 2 = 0 THEN trim(line, ' ' || chr(9)) ELSE trim(line, ' ' || chr(9)) END AS heading FROM (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS line FROM documents)")
def clean_headings(spark, d):
    line = F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))
    raw = F.when(F.length(line) % 2 == 0, F.concat(F.lit("[ "), line, F.lit(" ]"))).otherwise(F.concat(F.lit(" "), line))
    return _one(spark, d, heading=segment.clean_heading(raw))


_PATH = "[CASE WHEN lang = 'fr' THEN 'كتاب ' || source || ' (*)' ELSE '- ' || source || ' :' END, CASE WHEN doc_id % 3 = 0 THEN '- فصل -' WHEN doc_id % 3 = 1 THEN '( ** )' ELSE '[باب ' || lang || ' (*)].' END, CASE WHEN doc_id % 2 = 0 THEN 'مسألة في ' || lang WHEN doc_id % 5 = 0 THEN '(*)' ELSE '[' || lang || ']،' END]"


@query(
    f"""WITH p AS (SELECT doc_id, list_transform({_PATH}, lambda h: trim(regexp_replace(h, '\\(\\s*\\*+\\s*\\)', '', 'g'), ' :：،.-–—[]')) AS p FROM documents),
g AS (SELECT doc_id, p, list_filter(p, lambda h: h <> '' AND NOT regexp_matches(h, '^(فصل|مسألة)( |$)')) AS named, list_filter(p, lambda h: starts_with(h, 'كتاب') OR starts_with(h, 'باب')) AS book FROM p)
SELECT doc_id, coalesce(named[-1], p[-1]) AS topic, coalesce(book[1], named[1], '') AS category FROM g"""
)
def topics_and_categories(spark, d):
    path = F.expr(_PATH.replace("[CASE", "array(CASE", 1).removesuffix("]") + ")")
    return _one(spark, d, topic=segment.pick_topic(path), category=segment.pick_category(path))


_Q = "CASE WHEN length(text) % 3 = 0 THEN 'سئل الشيخ: ' || text WHEN length(text) % 3 = 1 THEN 'وسئل - ' || text ELSE text || ' (*) -' END"
_A = "CASE WHEN length(text) % 3 = 0 THEN 'فأجاب: ' || text WHEN length(text) % 3 = 1 THEN 'أجاب رحمه الله: ' || text ELSE text || ' (**)' END"


@query(
    f"""WITH x AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), y AS (SELECT *, strpos(left('وسئل - ' || text, 220), ':') AS colon FROM x),
z AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND length(text) % 3 = 1 AND colon > 0 THEN substring('وسئل - ' || text, colon + 1) ELSE text END AS x FROM y)
SELECT conv_id, turn, regexp_replace(regexp_replace(x, '\\(\\s*\\*+\\s*\\)', '', 'g'), '^[ :،\\-–—*\\n]+|[ :،\\-–—*\\n]+$', '', 'g') AS x FROM z"""
)
def question_answer_labels(spark, d):
    """Turns behind labels by rule: what is left without them is the turn, or what follows its first colon where that ends a label."""
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    q, a = segment.clean_question(F.expr(_Q)), segment.clean_answer(F.expr(_A))
    return rows.select("conv_id", "turn", F.when(F.col("role") == "user", q).otherwise(a).alias("x"))


_LINES = "SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS seq, unnest(string_split(text, chr(10))) AS value FROM documents"


@query(
    f"""WITH l AS (SELECT doc_id, seq, value, CASE WHEN starts_with(value, 'E') OR value = '' THEN 'head' ELSE 'para' END AS kind, 1 + length(value) % 9 AS level, trim(value) AS title FROM ({_LINES})),
h AS (SELECT doc_id, seq, level, title FROM l WHERE kind = 'head' AND title <> ''),
p AS (SELECT a.doc_id, a.seq, h.level, h.title FROM l a JOIN h ON h.doc_id = a.doc_id AND h.seq < a.seq WHERE a.kind = 'para' AND NOT EXISTS (SELECT 1 FROM h x WHERE x.doc_id = h.doc_id AND x.seq > h.seq AND x.seq < a.seq AND x.level <= h.level))
SELECT l.doc_id, l.seq::INT AS seq, sha256(coalesce(string_agg(p.title, '|' ORDER BY p.level), '')) AS path FROM l LEFT JOIN p USING (doc_id, seq) WHERE l.kind = 'para' GROUP BY 1, 2"""
)
def heading_paths(spark, d):
    """Lines by rule as headings of nine levels."""
    lines = segment.split_lines(docs(spark, d).where("text IS NOT NULL").select("doc_id", "text"), ["doc_id"])
    kind = F.when(F.col("value").startswith("E") | (F.col("value") == ""), "head").otherwise("para")
    made = segment.heading_path(lines.select("doc_id", "seq", kind.alias("kind"), (1 + F.length("value") % 9).alias("level"), F.col("value").alias("text")), ["doc_id"])
    return made.select("doc_id", "seq", F.sha2(F.array_join("heading_path", "|"), 256).alias("path"))


@query(
    f"""WITH l AS (SELECT doc_id, seq, CASE WHEN length(value) % 4 = 0 THEN 'PageV' || length(value) % 7 || 'P' || seq || ' PageV2P' || (seq + 1) WHEN length(value) % 4 = 1 THEN 'x PageV3P' || seq ELSE 'x' END AS raw FROM ({_LINES})),
tags AS (SELECT *, regexp_extract_all(raw, 'PageV\\d+P\\d+')[-1] AS tag FROM l),
f AS (SELECT *, coalesce(first_value(tag IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(tag IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'PageV0P0') AS t FROM tags)
SELECT doc_id, seq::INT AS seq, CAST(regexp_extract(t, 'V(\\d+)P', 1) AS INT) AS vol, CAST(regexp_extract(t, 'P(\\d+)$', 1) AS INT) AS page FROM f WHERE starts_with(raw, 'x')"""
)
def page_tags(spark, d):
    lines = segment.split_lines(docs(spark, d).where("text IS NOT NULL").select("doc_id", "text"), ["doc_id"])
    n, seq = F.length("value"), F.col("seq").cast("string")
    raw = F.when(n % 4 == 0, F.concat(F.lit("PageV"), (n % 7).cast("string"), F.lit("P"), seq, F.lit(" PageV2P"), (F.col("seq") + 1).cast("string"))).when(n % 4 == 1, F.concat(F.lit("x PageV3P"), seq)).otherwise(F.lit("x"))
    return segment.assign_pages(lines.select("doc_id", "seq", raw.alias("raw")), ["doc_id"]).select("doc_id", "seq", "vol", "page")


@query(
    """WITH s AS (SELECT p_size AS vol, p_partkey % 900 AS start, p_partkey % 900 + p_size - 5 AS "end", trim(p_name) AS title, p_partkey AS ord FROM part WHERE p_partkey % 2 = 0)
SELECT vol, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", title, ord FROM s WHERE "end" >= start AND "end" <= 999 AND length(title) >= 3
UNION ALL SELECT p_size + i, 1, 99999, trim(p_name), p_partkey FROM part, (SELECT unnest([0, 1, 2]) AS i) WHERE p_partkey % 2 = 1 AND p_size + 2 <= 40 AND length(trim(p_name)) >= 3"""
)
def index_entries(spark, d):
    """Parts as entries of a printed index, of one volume with pages or of three volumes."""
    size, key, s = F.col("p_size"), F.col("p_partkey"), lambda c: c.cast("string")
    one = F.concat(F.lit("- "), F.col("p_name"), F.lit(" "), s(size), F.lit(" / "), s(key % 900), F.lit(" - "), s(key % 900 + size - 5))
    many = F.concat("p_name", F.lit(" "), s(size), F.lit(" / "), s(size + 1), F.lit(" / "), s(size + 2))
    rows = table(spark, d, "part").select(key.alias("seq"), F.lit(0).alias("vol"), F.when(key % 2 == 0, one).otherwise(many).alias("text"))
    return segment.interval_dimension(rows)
