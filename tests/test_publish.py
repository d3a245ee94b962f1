"""Publishing as a whole, files with faults, bounded broadcasts and corrections."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import corrections, relational, segment, small
from quillspan.sources import publish, readers


def test_nothing_is_published_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "table")
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    publish.write_complete(left, spark.createDataFrame([(1, "p"), (2, "q")], "k int, y string"), ["k"], path)
    old = sorted(map(tuple, spark.read.parquet(path).collect()))
    with pytest.raises(ValueError):
        publish.write_complete(left, spark.createDataFrame([(1, "z")], "k int, y string"), ["k"], path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == old == [(1, "a", "p"), (2, "b", "q")]
    publish.write_complete(left, spark.createDataFrame([(1, "z"), (2, "z")], "k int, y string"), ["k"], path)
    assert {r["y"] for r in spark.read.parquet(path).collect()} == {"z"} and os.listdir(tmp_path) == ["table"]
    with pytest.raises(Exception):
        publish.publish(left.select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert spark.read.parquet(path).count() == 2 and os.listdir(tmp_path) == ["table"]


def test_vector_tables_are_checked(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, embedding array<float>")
    publish.write_vectors(rows([0.6, 0.8], [0.0, 0.0], [1.0, 0.0]), str(tmp_path / "v"), "id")
    for bad in (rows([0.6, 0.8], [1.0]), rows([2.0, 0.0]), rows([float("nan"), 0.0]), rows(None), rows([0.6, 0.8]).unionAll(rows([0.6, 0.8]))):
        with pytest.raises(ValueError):
            publish.write_vectors(bad, str(tmp_path / "v"), "id")
    assert spark.read.parquet(str(tmp_path / "v")).count() == 3


def test_json_files(spark, tmp_path):
    for name, text in (("a", '{"x": 1}'), ("b", '{"x": 1'), ("c", ""), ("d", "[1]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["path"][-6:-5]: (r["value"], r["broken"]) for r in readers.json_files(spark, str(tmp_path), "struct<x:int>").collect()}
    assert got["a"][0]["x"] == 1 and not got["a"][1] and got["b"] == (None, True) and "c" not in got and not got["d"][1]
    assert readers.json_files(spark, str(tmp_path / "none"), "struct<x:int>").count() == 0


def test_correction_types_and_order(spark, tmp_path):
    records = spark.createDataFrame([("a", "old text", "", "c"), ("b", "other", "", "c")], "id string, qa string, aa string, cat string")

    def load(x):
        folder = tmp_path / str(random.random())
        folder.mkdir()
        (folder / "x.json").write_text(json.dumps(x))
        return corrections.load(spark, str(folder))

    said = {"quotations": [{"quote": "new  words", "is": "narration"}]}
    good = load({"a": {"by": "m", "set": {"qa": "some new words here"}, **said}})
    assert corrections.problems(records, good).count() == 0
    assert corrections.apply(records, good).where("id = 'a'").first()["qa"] == "some new words here"
    bad = load({"a": {"by": "m", "set": {"qa": 5}}, "b": {"by": "m", "set": {"cat": None, "aa": "fine", "lang": 3}, **said}})
    assert sorted(map(tuple, corrections.problems(records, bad).collect())) == [("a", "set: not a string"), ("b", "quotation is not in the text"), ("b", "set: field not allowed"), ("b", "set: not a string")]


def test_headings_of_records(spark):
    x = spark.createDataFrame([(["باب الطهارة (*)", "- فصل -"],), (["كتاب الصلاة:", "(*)"],), ([],), (["( * )", "[فصل]"],)], "p array<string>")
    got = [tuple(r) for r in x.select(segment.pick_topic(F.col("p")), segment.pick_category(F.col("p"))).collect()]
    assert got == [("باب الطهارة", "باب الطهارة"), ("كتاب الصلاة", "كتاب الصلاة"), ("", ""), ("فصل", "")]


def test_contained_items(spark):
    r = random.Random(3)
    words = ["one", "two", "three", "four", "five"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "one  two three")]
    items = [(i, x) for i, x in enumerate(["ne", "one t", "e two thr", "one two three f", "wo three four five on", "five five five five five five five fi", "nowhere", "three four one two five four one two", "e  t"])]
    for _ in range(25):
        t = r.choice(texts[:60])[1]
        a = r.randrange(max(1, len(t)))
        items.append((len(items), t[a : a + r.randint(1, 60)] or "one"))
    got = relational.contained(spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(items, "i int, text string"), "d", "i").collect()
    want = sorted((d, i) for d, t in texts for i, x in items if t is not None and x in t)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_points(spark):
    r = np.random.default_rng(1)
    xs = sorted(set(r.uniform(0, 100, 30).round(1)))
    points = [(float(x), float(r.uniform(0, 9)), f"p{i}") for i, x in enumerate(xs)]
    asked = [(i, float(x)) for i, x in enumerate([*r.uniform(-10, 110, 200), *xs, (xs[0] + xs[1]) / 2])]
    p, q = spark.createDataFrame(points, "x double, y double, name string"), spark.createDataFrame(asked, "k int, x double")
    got = {x["k"]: x["y"] for x in relational.interpolate(p.select("x", "y"), q, "x", "y").collect()}
    assert all(abs(got[k] - np.interp(x, xs, [p[1] for p in points])) < 1e-9 for k, x in asked)
    near = {x["k"]: x["name"] for x in relational.nearest_point(p, q, "x", "name", ["k"]).collect()}
    assert all(near[k] == min(points, key=lambda p: (abs(p[0] - x), p[0]))[2] for k, x in asked)
    assert relational.nearest_point(p.where("false"), q, "x", "name", ["k"]).first()["name"] is None


def test_lists(spark):
    x = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 3), (4, "a", 3)], "id int, g string, n int")
    assert {r["id"]: r["place"] for r in small.listed(x, ["g"], ["n"], "id").collect()} == {1: 3, 2: 1, 3: 1, 4: 2}
    assert small.appended(x, x.select("n", "g", "id")).count() == 8 and tuple(small.volumes_of(x, "g").first()) == (2, 4)
