import random
import re

from pyspark.sql import functions as F

from quillspan.operators import quotes, seeds, small, spans

VERSES = [(1, 1, "In the beginning the light was made upon the waters"), (1, 2, "and darkness fled before the morning star"), (2, 1, "A righteous keeper tends the sheep and guards the gate")]


def test_original_spans(spark):
    index = seeds.build(spark.createDataFrame(VERSES, "chapter long, verse long, text string"), quotes.PLAIN)
    text = "He said {darkness fled before the morning star} and {he told that darkness fled before the morning star a righteous man knew} and {by my word}"
    df = spark.createDataFrame([("a", text), ("b", "no quotation")], "id string, text string")
    over = spark.createDataFrame([("a", "by my word", "2:1")], "id string, quote string, is string")
    got = spans.original_spans(df, index, "id", overrides=over).orderBy("start").collect()
    assert [r["ref"] for r in got] == ["1:2", "narration", "2:1"] and text[got[0]["start"] : got[0]["end"]] == "{darkness fled before the morning star}"
    words = "he told that darkness fled before the morning star a righteous man knew".split()
    run = got[1]["run"]
    assert words[run["first"] : run["last"]] == "darkness fled before the morning star a righteous".split() and (run["chapter"], run["verse"]) == (1, 2)
    numbers = spans.number_refs(spans.original_spans(df, index, "id", overrides=over), "id").orderBy("number").collect()
    assert [(r["ref"], r["number"]) for r in numbers] == [("1:2", 0), ("2:1", 1)]


def _anchor(spark, text, auth):
    got = spans.anchored(spark.createDataFrame([(1, text)], "id int, text string"), spark.createDataFrame([(1, 0, auth)], "id int, ref int, said string"), "id").collect()
    return (got[0]["start"], got[0]["end"]) if got else None


def test_anchors_grow_over_gaps(spark):
    auth = "one two three four five six seven eight nine ten eleven twelve"
    text = "x two THREE other five six seven eight nine ten changed twelve y"
    a, b = _anchor(spark, text, auth)
    assert text[a:b] == "two THREE other five six seven eight nine ten changed twelve"
    assert _anchor(spark, text + " five six seven eight nine ten", auth) is None
    marked = 'he said "so two three four five six seven eight" then'
    a, b = _anchor(spark, marked, auth)
    assert marked[a:b] == "so two three four five six seven eight"
    assert _anchor(spark, "nothing alike", auth) is None and _anchor(spark, None, auth) is None and _anchor(spark, text, None) is None


def _grow(auth, words, i, j, step):
    n, gaps = 0, 3
    while 0 <= i < len(auth) and 0 <= j < len(words):
        if auth[i] == words[j]:
            n, i, j = n + 1, i + step, j + step
        elif gaps and 0 <= i + step < len(auth) and 0 <= j + step < len(words) and auth[i + step] == words[j + step]:
            n, gaps, i, j = n + 2, gaps - 1, i + 2 * step, j + 2 * step
        else:
            break
    return n


def test_anchors_against_plain_growth(spark):
    r, rows, refs, want = random.Random(8), [], [], {}
    for k in range(150):
        auth = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.choice([3, 6, 20, 40]))]
        words = list(auth)
        for _ in range(r.randint(0, 8)):
            words[r.randrange(len(words))] = "q"
        words = [r.choice("xy") for _ in range(r.randint(0, 3))] + words[r.randint(0, 4) :] + ["z"] * r.randint(0, 2)
        gap = lambda: r.choice([" ", ", ", "\n", " é ", "--"])
        text = "É " + "".join(w + gap() for w in words)
        rows.append((k, text))
        refs.append((k, 5, " ".join(auth)))
        at = next((i for i in range(len(auth) - 5) if any(words[j : j + 6] == auth[i : i + 6] for j in range(len(words)))), None)
        if at is not None:
            places = [j for j in range(len(words) - 5) if words[j : j + 6] == auth[at : at + 6]]
            if len(places) == 1:
                a, z = places[0] - _grow(auth, words, at - 1, places[0] - 1, -1), places[0] + 5 + _grow(auth, words, at + 6, places[0] + 6, 1)
                found = list(re.finditer("[a-z0-9]+", text.lower()))
                want[k] = (found[a].start(), found[z].end())
    got = spans.anchored(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(refs, "id int, ref int, said string"), "id").collect()
    assert {x["id"]: (x["start"], x["end"]) for x in got} == want and len(want) > 50


def _translated(spark, rows):
    """rows: text, [(ref, text)], marks."""
    texts = spark.createDataFrame([(i, x[0]) for i, x in enumerate(rows)], "id int, text string")
    refs = spark.createDataFrame([(i, *p) for i, x in enumerate(rows) for p in x[1]], "id int, ref int, said string")
    marks = spark.createDataFrame([(i, n, m) for i, x in enumerate(rows) for n, m in enumerate(x[2])], "id int, pos int, ref int")
    return spans.segments(spans.translated_spans(texts, refs, marks, "id"), "text").orderBy("id").collect()


def test_translated_spans_and_segments(spark):
    refs = [(0, "the light was made upon the waters"), (1, "darkness fled before the morning star"), (2, "a righteous keeper tends the sheep and guards the gate")]
    text = "He {the light was made upon waters} and {someone spoke} , for a righteous keeper tends the sheep always ."
    got = _translated(spark, [(text, refs, [0, -1])])[0]
    assert [(s["ref"], s["kind"]) for s in got["spans"]] == [(0, 0), (-1, 0), (2, 1)]
    assert text[got["spans"][2]["start"] : got["spans"][2]["end"]] == "a righteous keeper tends the sheep"
    assert [tuple(x) for x in got["segments"]] == [("He ", 0), ("﴿the light was made upon waters﴾", 1), (" and ", 0), ("«someone spoke»", 2), (" , for ", 0), ("﴿a righteous keeper tends the sheep﴾", 1), (" always.", 0)]


def test_aligned_marks_and_odd_segments(spark):
    refs = [(0, "the light was made upon the waters"), (1, "darkness fled before the star")]
    rows = [("{the light was made} {someone spoke}", refs, [0, 1]), ("{darkness fled}", refs, [0, 1]), ("{a} {b}", refs, [0]), (None, refs, []), ("  plain \n words  .", refs, [])]
    got = _translated(spark, rows)
    assert [[s["ref"] for s in r["spans"]] for r in got] == [[0, 1], [1], [-1, -1], [], []]
    assert [[tuple(x) for x in r["segments"]] for r in got] == [[("﴿the light was made﴾", 1), (" ", 0), ("﴿someone spoke﴾", 1)], [("﴿darkness fled﴾", 1)], [("«a»", 2), (" ", 0), ("«b»", 2)], [], [(" plain words.", 0)]]


def test_runs_inside_taken_spans_go(spark):
    refs = [(0, "one two three four five six seven"), (1, "three four five six seven eight nine"), (2, "six seven eight nine ten eleven twelve")]
    text = "{no such quotation} one two three four five six seven eight nine ten eleven twelve"
    got = _translated(spark, [(text, refs, [-1])])[0]["spans"]
    assert [(s["ref"], s["kind"]) for s in got] == [(-1, 0), (0, 1)]


def test_small_operators(spark):
    routes = spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string")
    assert {r["place"]: r["n"] for r in small.visits(routes).collect()} == {"x": 1, "y": 2, "z": 1}
    names = spark.createDataFrame([("batch_3",), ("batch_12",), ("x",)], "name string")
    assert small.next_number(names) == 13 and small.next_number(names.where("name = 'x'")) == 1
    p = small.checked_params(spark.createDataFrame([("5", "v01_a"), ("38", "a b"), ("x", "")], "vol string, id string")).collect()
    assert [(r["vol"], r["id"]) for r in p] == [(5, "v01_a"), (None, None), (None, None)]
    hits = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "a")], "id int, v int, cat string")
    assert [r["id"] for r in small.narrow(hits, vol=1, quoted=hits.where("id <> 1")).collect()] == [2]
    done = spark.createDataFrame([(1, "old")], "id int, answer_en string")
    batch = spark.createDataFrame([(1, "new"), (2, "two"), (3, " "), (9, "?")], "id int, answer_en string")
    merged, counts = small.merge_translations(done, batch, spark.range(1, 4).select(F.col("id").cast("int").alias("id")))
    assert sorted(map(tuple, merged.collect())) == [(1, "new"), (2, "two")]
    assert {r["op"]: r["n"] for r in counts.collect()} == {"inserted": 1, "replaced": 1, "unknown": 1}


def _documents(spark, path, texts):
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_places_of_many_matches(spark):
    """More matches than a block of the sums has, with characters of two words in UTF-16 between them."""
    text = "".join(f"\U0001f600{'-' * (i % 3)}{{q{i}}}" for i in range(200))
    df = spark.createDataFrame([(1, text), (2, "none {} here"), (3, None)], "id int, text string")
    got = [(r["start"], r["end"], r["quote"]) for r in spans.braces(df, ["id"]).orderBy("start").collect()]
    assert got == [(m.start(), m.end(), m[0][1:-1]) for m in re.finditer(r"\{[^{}]+\}", text)]


def test_rebased_spans_keep_a_text_in_its_row(spark, tmp_path):
    """No text is multiplied by its braces or grouped by: after the first dealing out nothing is shuffled."""
    from quillspan.plans.flows import rebased_spans

    made = rebased_spans(spark, _documents(spark, tmp_path, ["so it was then. " * 90, "no stop"]))
    assert [(r["doc_id"], r["n"]) for r in made.collect()] == [(0, 30)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") <= 1


def test_rendered_runs_keep_a_text_in_its_row(spark, tmp_path):
    from quillspan.plans.flows import rendered_runs

    made = rendered_runs(spark, _documents(spark, tmp_path, ["so it was then. one two three.", "no stop"]))
    assert [r["doc_id"] for r in made.collect()] == [0]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") <= 1


def test_records_are_aligned_many_in_a_call(spark):
    """No Python call and pandas frame for each record; a record without marks has narrations alone, one without braces no row."""
    quoted = spark.createDataFrame([(1, 5, 8, "b c"), (1, 0, 3, "a"), (2, 0, 1, "a"), (None, 0, 1, "x")], "id int, start int, end int, quote string")
    marks = spark.createDataFrame([(1, 1, 7, "a z"), (1, 2, -1, None), (1, 3, 9, "b c"), (3, 1, 1, "a"), (None, 1, 4, "x")], "id int, pos int, ref int, said string")
    made = spans.placed(quoted, marks, "id")
    assert made.columns == ["id", "start", "end", "quote", "ref"]
    assert "CoGroup" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["id"] or 0, r["start"], r["quote"], r["ref"]) for r in made.collect())
    assert got == [(0, 0, "x", 4), (1, 0, "a", 7), (1, 5, "b c", 9), (2, 0, "a", -1)]


def test_translation_spans_join_shingles_once(spark, tmp_path):
    """What items share with documents is found once and read again: the items are not in the plan that is left."""
    from quillspan.plans.spans import translation_spans

    folder = _documents(spark, tmp_path, ["so one two three four five six seven and it was then. " * 3])
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    made = translation_spans(spark, folder)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "item_id" not in plan and made.where("kind = 0").count() == 3


def test_originals_write_their_braces_once(spark, monkeypatch):
    """Quotations of no verse are in no table but that of the braces."""
    index = seeds.build(spark.createDataFrame(VERSES, "chapter long, verse long, text string"), quotes.PLAIN)
    text = " ".join(f"{{some other words number {i * 7919} that nobody wrote}}" for i in range(100)) + " {darkness fled before the morning star}"
    seen = []
    for module in (seeds, spans):
        def write(df, name, put=module.written):
            table = put(df, name)
            seen.append((name, table.count()))
            return table

        monkeypatch.setattr(module, "written", write)
    over = spark.createDataFrame([("a", "some other words  number 0 that nobody wrote", "2:1")], "id string, quote string, is string")
    got = spans.original_spans(spark.createDataFrame([("a", text)], "id string, text string"), index, "id", overrides=over).orderBy("start").collect()
    assert [r["ref"] for r in got] == ["2:1", *["narration"] * 99, "1:2"]
    assert [n for name, n in seen if name == "braces"] == [101]
    assert all(n <= 5 for name, n in seen if name in ("quotations", "near")) and "texts" not in dict(seen)
