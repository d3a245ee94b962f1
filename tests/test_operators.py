import json
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan import models
from quillspan.functions import text as t
from quillspan.operators import corrections, quotes, relational, retrieve
from quillspan.sources import publish, readers
from quillspan.streaming import events


def test_narrowest_range_and_as_of(spark):
    facts = spark.createDataFrame([(1, 1, 5), (2, 1, 50), (3, 2, 5)], "id int, vol int, page int")
    ranges = spark.createDataFrame([(1, 1, 100, "wide", 0), (1, 4, 6, "b", 2), (1, 3, 5, "a", 1)], "vol int, lo int, hi int, title string, ord int")
    got = {r["id"]: r["title"] for r in relational.narrowest_range(facts, ranges, ["vol"], "page", ["id"]).collect()}
    assert got == {1: "a", 2: "wide", 3: ""}
    left = spark.createDataFrame([("a", 0), ("a", 5), ("b", 5)], "k string, at int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, start int, v string")
    got = {(r["k"], r["at"]): r["v"] for r in relational.as_of(left, right, ["k"], "at", "start", ["v"]).collect()}
    assert got == {("a", 0): None, ("a", 5): "y", ("b", 5): None}


def test_set_operations(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, "id").collect())) == [(1, "a", "kept"), (2, None, "replaced"), (3, "c", "inserted")]
    with pytest.raises(ValueError):
        relational.require_complete(old, new, ["id"])
    assert [r["at"] for r in relational.contains_in_text(spark.createDataFrame([("lo",), ("zz",), ("",)], "n string"), "n", "hello").collect()] == [3, None, None]
    flagged = spark.range(20).select("id", (F.col("id") % 2 == 0).alias("f"))
    assert relational.stratified(flagged, F.col("f"), 10, ["id"]).where("f").count() == 4
    pts = spark.createDataFrame([(0.0, 0.0), (10.0, 5.0)], "x double, y double")
    assert [r["y"] for r in relational.interpolate(pts, spark.createDataFrame([(-1.0,), (4.0,), (99.0,)], "x double"), "x", "y").collect()] == [0.0, 2.0, 5.0]
    assert [r["id"] for r in relational.page(spark.range(25), ["id"], 2).collect()] == [20, 21, 22, 23, 24]


def test_fusion_ties(spark):
    d = spark.createDataFrame([(1, 0, 0.9), (2, 1, 0.8)], "id int, rank int, score double")
    x = spark.createDataFrame([(2, 0, 5.0), (1, 1, 4.0), (3, 2, 3.0)], "id int, rank int, score double")
    got = retrieve.fuse(d, x, "id", k=0).collect()
    assert [r["id"] for r in got] == [1, 2, 3] and got[2]["dense_score"] == 0.0 and len(got) <= 8


def test_smallest_window_equals_brute_force():
    import itertools

    r = random.Random(3)
    for _ in range(100):
        lists = [sorted(r.sample(range(60), r.randint(1, 5))) for _ in range(r.randint(2, 4))]
        assert retrieve.smallest_window(lists) == min(max(c) - min(c) for c in itertools.product(*lists))


def test_lexical_search(spark):
    rows = [(1, "help from the dead", "", "x"), (2, "", "seeking help", "the dead cannot"), (3, "deadline", "", "helpful " * 50), (4, "nothing", "", "")]
    got = retrieve.lexical_search(spark.createDataFrame(rows, "id int, hi string, q string, a string"), "help dead").collect()
    assert got[0]["id"] == 1 and sorted(r["id"] for r in got) == [1, 2, 3] and got[0]["pct"] > got[-1]["pct"]
    assert retrieve.lexical_search(spark.createDataFrame(rows, "id int, hi string, q string, a string"), "!").count() == 0


VERSES = [(1, 1, "In the beginning the light was made upon the waters"), (1, 2, "and darkness fled before the morning star"), (2, 1, "A righteous keeper tends the sheep and guards the gate")]


def test_references(spark):
    verses = spark.createDataFrame(VERSES, "chapter long, verse long, text string")
    assert quotes.verse_range("2:1") == (2, 1, 1)
    asked = spark.createDataFrame([("1:1-2",), ("2:1",), ("9:1",), ("x",), ("1:2-1",), (None,)], "spec string")
    said = {r["spec"]: r["said"] for r in quotes.asserted(asked, verses).collect()}
    assert said == {"1:1-2": f"{VERSES[0][2]} {VERSES[1][2]}", "2:1": VERSES[2][2], "9:1": None, "x": None, "1:2-1": None, None: None}
    for bad in ("x", "1:2-1"):
        with pytest.raises(ValueError):
            quotes.verse_range(bad)


def test_arabic_readings(spark):
    both = spark.createDataFrame([("ٱلَّيۡلَ وَٱلنَّهَارَ",), ("الليل والنهار",), ("نِعۡمَتَ ٱللَّهِ",), ("نعمة الله",)], "x string").select(quotes.readings(F.col("x")).alias("r")).collect()
    assert both[0]["r"][3] == both[1]["r"][3] and both[2]["r"][3] == both[3]["r"][3]


def test_align_equals_brute_force():
    import itertools

    r = random.Random(4)
    for _ in range(80):
        n = r.randint(1, 4)
        m = r.randint(n, 6)
        s = [[r.choice([0, 0.2, 0.35, 0.5, 0.9]) for _ in range(m)] for _ in range(n)]
        got = quotes.align(np.array(s))
        assert got == sorted(set(got)) and len(got) == n
        best = max(sum(s[i][c] for i, c in enumerate(cols)) for cols in itertools.combinations(range(m), n))
        assert abs(sum(s[i][c] for i, c in enumerate(got)) - best) < 1e-9
    assert quotes.align(np.array([[0.9], [0.9]])) == [None, None] and quotes.align(np.array([[0.1]])) == [0] and quotes.align(np.array([[0.5, 0.5]])) == [0]


def test_rebase(spark):
    spans = F.from_json(F.lit('[{"start":0,"end":4,"ref":1,"kind":0},{"start":10,"end":15,"ref":-1,"kind":0,"runs":[{"start":11,"end":14,"ref":2}]},{"start":12,"end":18,"ref":3,"kind":1},{"start":16,"end":18,"ref":4,"kind":1}]'), f"array<{quotes.SPAN}>")
    got = spark.range(1).select(quotes.rebase(spans, F.lit(8), F.lit(20)).alias("s")).first()["s"]
    assert [(x["start"], x["end"], x["ref"], x["kind"]) for x in got] == [(2, 7, -1, 0), (8, 10, 4, 1)] and [tuple(x) for x in got[0]["runs"]] == [(3, 6, 2)]


def _corrections(spark, *files):
    folder = tempfile.mkdtemp()
    for i, f in enumerate(files):
        with open(os.path.join(folder, f"{i}.json"), "w") as out:
            json.dump(f, out)
    return corrections.load(spark, folder)


def test_corrections(spark):
    recs = spark.createDataFrame([("a", "one two", "x {q z} y", "t"), ("b", "same same", "", "")], "id string, qe string, qa string, topic string")
    good = {"a": {"by": "me", "why": "w", "replace": [{"field": "qe", "find": "two", "with": "2"}, {"field": "qe", "find": "one 2", "with": "12"}], "set": {"topic": "new"}, "quotations": [{"quote": "q  z", "is": "1:2", "why": "w"}]}}
    done = {r["id"]: r for r in corrections.apply(recs, _corrections(spark, good)).collect()}
    assert done["a"]["qe"] == "12" and done["a"]["topic"] == "new" and done["b"]["qe"] == "same same"
    assert corrections.overrides(_corrections(spark, good)).first()["quote"] == "q z"
    bad = {"b": {"replace": [{"field": "qe", "find": "same", "with": "x"}, {"field": "id", "find": "b", "with": "x"}], "set": {"id": "1"}, "quotations": [{"quote": "none", "is": "1:2", "why": ""}]}, "zz": {}}
    errors = sorted(r["error"] for r in corrections.problems(recs, _corrections(spark, bad)).collect())
    assert errors == ["field not allowed", "find does not occur exactly once", "quotation is not in the text", "set: field not allowed", "unknown id"]
    with pytest.raises(ValueError):
        corrections.apply(recs, _corrections(spark, bad))
    with pytest.raises(ValueError):
        _corrections(spark, good, good)


def test_readers_and_publishing(spark, tmp_path):
    (tmp_path / "book.txt").write_text("meta\n#META#Header#End#\n# a\n~~b", encoding="utf-8")
    assert [r["value"] for r in readers.marked_text(spark, str(tmp_path / "book.txt")).orderBy("seq").collect()] == ["", "# a", "~~b"]
    (tmp_path / "v.json").write_text('[{"id": 1, "name": "n", "transliteration": "t", "verses": [{"id": 1, "text": "x", "translation": "y"}]}]')
    assert readers.verses(spark, str(tmp_path / "v.json")).first()["translation"] == "y"
    (tmp_path / "broken.json").write_text("{")
    assert readers.tolerant_json(spark, str(tmp_path / "none.json"), "map<string,string>").count() == 0
    (tmp_path / "r.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "r.jsonl"), "id int").count() == 2
    df = spark.createDataFrame([(1, "abcdef", None), (2, "ab", "x")], "id int, a string, b string")
    core, rest = publish.split_core_rest(df, "id", {"a": 3, "b": 3})
    assert rest.count() == 1 and [tuple(r) for r in publish.join_core_rest(core, rest, "id", ["a", "b"]).orderBy("id").collect()] == [(1, "abcdef", ""), (2, "ab", "x")]
    publish.write_pages(df, str(tmp_path / "pages"), "id", "a")
    assert sorted(os.listdir(tmp_path / "pages"))[-2:] == ["id=1", "id=2"]
    assert publish.sitemap_entries(df, "https://x", "id").first()["value"] == "<url><loc>https://x/1</loc></url>"


def test_models(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "some words"), (3, "other")], "id int, text string")
    vectors = models.embed(df, "id", "text").orderBy("id").collect()
    assert list(vectors[0]["embedding"]) == list(vectors[1]["embedding"])
    cache = spark.createDataFrame([], "key string, en string, engine string")
    done, full = models.translate(df, cache, "id", "text")
    assert full.count() == 2 and done.where("en IS NULL").count() == 0
    hits = spark.createDataFrame([(0, 4, "text a", 0.7), (1, 5, "text b", 0.5)], "rank int, v int, text string, dense_score double")
    got = models.answer("q", hits, "rank", t.cite_en(F.col("v"), F.lit(1), F.lit(2)), "text")
    assert got["confidence"] == 0.8 and models.answer("q", hits.where("false"), "rank", F.lit(""), "text")["answer"] == models.NO_SOURCES
    with pytest.raises(ValueError):
        models.get_model("nobody")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "2024-01-01 00:10:00", 1, "a", 1.0), (2, "2024-01-01 23:00:00", 1, "a", 2.0), (3, "2024-01-03 00:00:00", 1, "b", 1.0), (4, "2024-01-09 00:00:00", 2, "a", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    df.coalesce(1).write.parquet(str(src))
    made = lambda: events.event_stream(spark, str(src), df.schema, "*.parquet")
    got = events.run_once(events.tumbling(made()), "tumbling_t", str(tmp_path / "c1")).collect()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in got) == [("a", 2, 3.0), ("b", 1, 1.0)]
    assert events.run_once(events.sessions(made()), "sessions_t", str(tmp_path / "c2")).count() == 3
    assert events.run_once(events.sliding(made()), "sliding_t", str(tmp_path / "c3")).count() > 0


def test_contains_match_finds_short_items(spark, tmp_path):
    import duckdb

    from quillspan.plans.catalog import ORACLE_SQL, QUERIES

    texts = ["one two three four five six seven eight nine ten", "undone two threefold", "", None, "no such words", "one two three four five six sevens"]
    items = ["one", "one two", "one two three", "two three four five", "one two three four five six seven", "one two three four five six seven eight", "one two three four five six seven eight nine", "", None, "absent"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, cols in (("contains_match", ["doc_id", "item_id"]), ("order_preserving_distinct", ["doc_id", "item_id", "ref"])):
        want = c.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
        got = QUERIES[name](spark, str(tmp_path)).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 15


def test_texts_of_a_volume_are_read_as_texts_of_files(spark, tmp_path):
    """Many texts in a file keep their names, headers and line ends; repeated names, empty and null texts too."""
    from quillspan.sources import publish

    end = readers.HEADER_END
    texts = [(1, f"title\n{end}\nbody\r\n\n--x"), (2, "no header"), (3, ""), (4, None), (5, f"a\n{end}b\n{end}"), (2, "again\n"), (6, "\n"), (None, "x")]
    df = spark.createDataFrame(texts, "id long, x string").coalesce(1)
    boundary = publish.write_volumes(df, str(tmp_path / "v"), "id", "x")
    assert len(list((tmp_path / "v").glob("part-*"))) == 1
    got = {}
    for r in readers.marked_volumes(spark, str(tmp_path / "v"), boundary).orderBy("name", "seq").collect():
        got.setdefault((r["name"], r["seq"]), []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == {
        ("1", 0): [""], ("1", 1): ["body"], ("1", 2): [""], ("1", 3): ["--x"], ("2", 0): ["again", "no header"], ("2", 1): [""], ("3", 0): [""], ("4", 0): [""],
        (None, 0): ["x"], ("5", 0): ["b"], ("5", 1): [end], ("6", 0): [""], ("6", 1): [""],
    }


def test_marked_files_are_not_one_for_each_page(spark, tmp_path, monkeypatch):
    from quillspan.plans import records

    pages = spark.createDataFrame([(i, f"<p>{i}</p>\n") for i in range(60)] + [(7, None)], "page_id long, html string").coalesce(1)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(records, "_folder", lambda spark, name: str(tmp_path / name))
    rows = records.marked_files(spark, str(tmp_path)).collect()
    assert len(rows) == sum(3 + (i % 3 > 0) for i in range(60)) + 3
    assert len([p for p in (tmp_path / "marked").rglob("*") if p.is_file() and p.suffix == ".txt"]) == 1
