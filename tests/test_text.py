import re

from pyspark.sql import functions as F

from quillspan.functions import text as t


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_folding(spark):
    assert one(spark, t.fold("x"), x="أَحْمَدُ ــ  إلى مدرسةٍ، PageV01P002 ms12 مؤمن شيء") == "احمد الي مدرسه، مومن شي"
    assert one(spark, t.strip_marks("x"), x="ا۝ـَ") == "ا۝ـ"
    assert one(spark, t.strip_marks("x", wide=True), x="ا۝ـَ") == "ا"
    assert one(spark, t.clean_for_embedding("x"), x=" aـb  PageV01P003\n c ") == "ab c"


def test_tokens(spark):
    words = F.split("x", " ")
    assert one(spark, t.content_tokens(words), x="the dead a and dead help") == ["dead", "help"]
    assert one(spark, t.content_tokens(words), x="the and") == ["the", "and"]
    assert one(spark, t.stem("x"), x="seeking") == "seek" and one(spark, t.stem("x"), x="does") == "does"


def test_cuts(spark):
    assert one(spark, t.snippet("x", 10), x="abcdefgh ijkl") == "abcdefgh…"
    assert one(spark, t.snippet("x", 10), x="ab cdefghijklm") == "ab cdefghi…"
    assert one(spark, t.excerpt("x", 12), x="abcdefgh {ij kl} mn") == "abcdefgh …"
    assert one(spark, t.snippet("x"), x="") == ""


def test_small_ones(spark):
    assert one(spark, t.cite_en(F.col("v"), F.col("a"), F.col("b")), v=3, a=5, b=7) == "Vol. 3 · pp. 5–7"
    assert one(spark, t.cite_ar(F.col("v"), F.col("a"), F.col("b")), v=3, a=15, b=15) == "المجلد ٣ · ص ١٥"
    assert one(spark, t.clean_dashes("x"), x="a — b,, c ,d  e") == "a, b, c,d e"
    assert one(spark, t.occurrences("x", "aa"), x="aaaaa") == 2
    assert one(spark, t.word_count("x"), x="  a b ") == 2 and one(spark, t.word_count("x"), x=" ") == 0
    assert one(spark, t.hijri_to_ce(F.col("x")), x=728) == 1328
    assert one(spark, t.relevance_pct(F.col("x")), x=0.0) == 8 and one(spark, t.confidence(F.col("x")), x=0.55) == 0.5
    assert one(spark, t.highlight("x", ["dead", "ما"]), x="<deadline dead> مَا") == "&lt;deadline <mark>dead</mark>&gt; <mark>مَا</mark>"
    assert one(spark, t.ornate_braces("x"), x="a {b}\nc") == 'a <span class="quote">﴿b﴾</span><br>c'
    assert one(spark, t.collapse_doubled("x"), x="allaah") == "alah"
    assert one(spark, t.lookup_phrase("x"), x="a b c d") == "a%20b%20c%20d" and one(spark, t.lookup_phrase("x"), x="a b") is None


def test_words_with_offsets_without_python(spark):
    """Places are code points, whatever stands between the words; no batch of texts is turned into Python objects."""
    text = "\U0001f600 One, 2two  " * 150 + "é end"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    made = df.select("id", t.words_with_offsets("text").alias("w"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: [(z["word"], z["start"], z["end"]) for z in r["w"]] for r in made.collect()}
    assert got == {1: [(m[0], m.start(), m.end()) for m in re.finditer("[a-z0-9]+", text.lower())], 2: [], 3: []}
