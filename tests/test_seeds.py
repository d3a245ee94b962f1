"""The distributed quotation index against plain searches of the whole text."""

import itertools
import random
import re

import pytest

from quillspan.operators import quotes, seeds

SCHEMA = "chapter long, verse long, text string"


def readings(x):
    """The four readings of a text, in plain Python."""
    fold = " ".join(re.sub(r"[^\w]|_", " ", (x or "").lower()).split())
    closed = fold.replace(" ", "")
    bare = re.sub("[aeiou]", "", closed)
    return [fold, closed, bare, "".join(c for c, _ in itertools.groupby(bare))]


class Book:
    def __init__(self, verses):
        self.verses = sorted(verses, key=lambda v: v[:2])
        read = [readings(v[2]) for v in self.verses]
        self.text = [(" " if k == 0 else "").join(r[k] for r in read) for k in range(4)]
        self.starts = [[sum(len(r[k]) + (k == 0) for r in read[:i]) for i in range(len(read))] for k in range(4)]

    def verses_of(self, reading, at, length):
        place = lambda p: max(i for i, s in enumerate(self.starts[reading]) if s <= p)
        a, z = self.verses[place(at)], self.verses[place(at + length - 1)]
        return (a[0], a[1], z[1] if z[0] == a[0] else a[1])

    def lookup(self, x):
        read = readings(x)
        words = read[0].split()
        probes = [read[0]] + [" ".join(words[:n]) for n in range(len(words) - 1, 5, -1) if len(" ".join(words[:n])) >= 0.8 * len(read[0])]
        for r in range(4):
            for probe in probes if r < 3 else [x]:
                needle = readings(probe)[r]
                at = self.text[r].find(needle)
                if len(needle) >= 12 and at >= 0 and not (len(words) < 3 and self.text[r].find(needle, at + 1) >= 0):
                    return (*self.verses_of(r, at, len(needle)), r + 1)
        return None

    def locate(self, x):
        read = readings(x)
        for r in range(4):
            at = self.text[r].find(read[r])
            if len(read[0].split()) >= 2 and len(read[r]) >= 12 and at >= 0:
                return (*self.verses_of(r, at, len(read[r])), r + 1)
        return None

    def longest(self, x):
        words, best = (x or "").split(), None
        for i in range(len(words)):
            for e in range(i + 6, len(words) + 1):
                hit = self.locate(" ".join(words[i:e]))
                if hit and (best is None or e - i > best[1] - best[0]):
                    best = (i, e, hit[0], hit[1], hit[2])
        return best if best and len(readings(" ".join(words[best[0] : best[1]]))[0]) >= 30 else None


WORDS = ["alpha", "beta", "gamma", "delta", "eps", "to", "a", "o", "tt", "ate", "eat", "-", "né", "Über", "light-was"]


def book(r, verses):
    return [(1 + i // 3, i % 3, " ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 5, 14])))) for i in range(verses)] + [(9, 9, " ".join(["same", "words"] * 20)), (9, 10, None), (9, 11, "the end of alpha and beta " * 60)]


def said(r, verses, many):
    words = " ".join(v[2] or "" for v in verses).split()
    out = [None, "", "a", "same words", "alpha", " ".join(words)]
    for _ in range(many):
        a = r.randrange(len(words))
        x = words[a : a + r.choice([1, 2, 3, 6, 9, 15, 40])]
        for _ in range(r.choice([0, 0, 1, 2])):
            x.insert(r.randrange(len(x) + 1), r.choice([*WORDS, "zeta", "bt"]))
        x = r.choice([" ".join, "  ".join, "".join])(x)
        out.append(r.choice([x, x.upper(), x.replace("e", ""), x.replace("t", "tt"), x + " zeta"]))
    return out + out[-3:]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotations_against_plain_search(spark, seed):
    r = random.Random(seed)
    verses = book(r, 30)
    plain, reference = Book(verses), seeds.build(spark.createDataFrame(verses, SCHEMA), quotes.PLAIN)
    texts = said(r, verses, 120)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, quote string")
    found = lambda df, n: {x["id"]: tuple(x[n]) if x[n] else None for x in df.collect()}
    got = found(seeds.identify(rows, reference), "found")
    want = {i: plain.lookup(x) for i, x in enumerate(texts)}
    assert got == want and {x[3] for x in want.values() if x} == {1, 2, 3, 4}
    assert found(seeds.locate(rows, reference), "found") == {i: plain.locate(x) for i, x in enumerate(texts)}
    runs = {i: plain.longest(x) for i, x in enumerate(texts) if len((x or "").split()) < 60}
    got = {i: x for i, x in found(seeds.longest_runs(rows, reference), "run").items() if i in runs}
    assert got == runs and sum(x is not None for x in runs.values()) > 20


def test_matches_end_in_their_chapter(spark):
    verses = [(1, 1, "In the beginning the light was made upon the waters"), (1, 2, "and darkness fled before the morning star"), (2, 1, "A righteous keeper tends the sheep")]
    reference = seeds.build(spark.createDataFrame(verses, SCHEMA), quotes.PLAIN)
    rows = spark.createDataFrame([("upon the waters and darkness",), ("morning star a righteous",)], "quote string")
    assert {tuple(r["found"]) for r in seeds.identify(rows, reference).collect()} == {(1, 1, 2, 1), (1, 2, 2, 1)}


def test_formula_and_arabic_readings(spark):
    verses = [(1, 1, "إِنَّآ أَعۡطَيۡنَٰكَ ٱلۡكَوۡثَرَ فَصَلِّ لِرَبِّكَ"), (2, 1, "ٱلَّذِينَ يُقِيمُونَ ٱلصَّلَوٰةَ"), (3, 1, "وَإِيتَآٓئِ ذِي ٱلۡقُرۡبَىٰ وَيَنۡهَىٰ")]
    reference = seeds.build(spark.createDataFrame(verses, SCHEMA), quotes.ARABIC)
    texts = ["بسم الله الرحمن الرحيم إنا أعطيناك الكوثر فصل لربك", "الذين يقيمون الصلاة", "وإيتاء ذي القربى وينهى", "كلام آخر لا يوجد في شيء"]
    got = {r["quote"]: r["found"] for r in seeds.identify(spark.createDataFrame([(x,) for x in texts], "quote string"), reference).collect()}
    assert [tuple(got[x])[:2] if got[x] else None for x in texts] == [(1, 1), (2, 1), (3, 1), None]
    assert got[texts[1]]["reading"] == 1 and got[texts[2]]["reading"] == 4


def test_empty_tables(spark):
    none, rows = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "some words that are said here and now")], "id long, quote string")
    reference = seeds.build(none, quotes.PLAIN)
    assert [r["found"] for r in seeds.identify(rows, reference).collect()] == [None]
    assert [r["run"] for r in seeds.longest_runs(rows, reference).collect()] == [None]
    assert seeds.identify(rows.where("false"), reference).count() == 0


def _written(monkeypatch, *modules):
    """Names and numbers of rows of the tables that are written from now on."""
    seen = []
    for module in modules:
        def write(df, name, put=module.written):
            table = put(df, name)
            seen.append((name, table.count()))
            return table

        monkeypatch.setattr(module, "written", write)
    return seen


@pytest.mark.parametrize("script", [quotes.PLAIN, quotes.ARABIC])
def test_only_texts_that_may_stand_are_written(spark, monkeypatch, script):
    """A text without runs of the reference is neither written nor shuffled; every row comes back."""
    x = "بكلام طويل جدا يقال في اول الكتاب ثم يعاد في اخره"
    y = [f"شيء اخر لا يوجد في الكتاب ابدا ويزيد عليه رقم {i * 7919}" for i in range(200)]
    reference = seeds.build(spark.createDataFrame([(1, 1, x)], SCHEMA), script)
    rows = spark.createDataFrame(list(enumerate([x, *y, None, x])), "id long, quote string")
    seen = _written(monkeypatch, seeds)
    got = {r["id"]: r["found"] for r in seeds.identify(rows, reference).collect()}
    assert len(got) == 203 and {i for i, f in got.items() if f} == {0, 202}
    assert 1 <= dict(seen)["quotations"] <= 5
    runs = {r["id"]: r["run"] for r in seeds.longest_runs(rows, reference).collect()}
    assert len(runs) == 203 and {i for i, f in runs.items() if f} == {0, 202}
    assert "texts" not in dict(seen) and 1 <= dict(seen)["near"] <= 5


def test_sieve_loses_no_key(spark):
    keys = spark.range(3000).selectExpr("1 AS reading", "cast(id AS string) AS gram")
    by = seeds.sieve(keys)
    rows = spark.range(30000).selectExpr("1 AS reading", "cast(id AS string) AS gram")
    key = ["reading", "gram"]
    assert seeds.sieved(rows, by, key).where("cast(gram AS int) < 3000").count() == 3000
    assert seeds.sieved(rows, by, key, outside=True).count() > 26500
    assert seeds.sieved(rows, seeds.sieve(keys.where("false")), key).count() == 0


def test_only_runs_that_are_sought_leave_the_reference(spark, monkeypatch):
    """No table has a row for each position of the reference, and of its runs those alone are joined that needles ask for."""
    seen = _written(monkeypatch, seeds)
    verses = [(1, i, f"verse number {i * 7919} of the long book that {i * 104729} people know") for i in range(300)]
    reference = seeds.build(spark.createDataFrame(verses, SCHEMA), quotes.PLAIN)
    rows = spark.createDataFrame([(verses[7][2],), (verses[250][2].upper(),), ("nowhere in the long book that is",)], "quote string")
    got = {r["quote"]: tuple(r["found"]) if r["found"] else None for r in seeds.identify(rows, reference).collect()}
    assert [got[r] for r in (verses[7][2], verses[250][2].upper())] == [(1, 7, 7, 1), (1, 250, 250, 1)] and list(got.values()).count(None) == 1
    grams = reference.grams.count()
    assert grams > 40_000 and max(n for _, n in seen) < grams / 10
    keys = reference.grams.where("reading = 1 AND pos IN (5, 9000)").select("reading", "gram")
    of = seeds.asked(reference, keys)
    assert of.join(keys, ["reading", "gram"]).select("pos").distinct().where("pos IN (5, 9000)").count() == 2 and of.count() < 1000


def test_runs_of_a_block_are_all_made(spark):
    texts = ["", "x" * 11, "abcdefghijkl", "".join(chr(0x627 + i % 30) for i in range(523)), "".join(chr(97 + i % 26) for i in range(76))]
    got = seeds._grams(spark.createDataFrame([(i, 1000 * i, x) for i, x in enumerate(texts)], "key long, at long, x string"), seeds.BLOCK)
    want = {(i, 1000 * i + k, x[k : k + 12]) for i, x in enumerate(texts) for k in range(min(seeds.BLOCK, len(x) - 11))}
    rows = [tuple(r) for r in got.select("key", "pos", "gram").collect()]
    assert len(rows) == len(want) and set(rows) == want
