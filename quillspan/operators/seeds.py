"""Where quotations stand in a reference text: an index of its runs of MIN_CHARS characters, as tables.

The verses, in order, are one text in each of four readings. It is cut into blocks of BLOCK characters, which are written; `grams` has a row for
every position of every reading with the run of MIN_CHARS characters that begins there, made from the blocks whenever it is read; `pieces`
says which verse a position is in. So the reference text is never gathered, neither on the driver nor in a task, and its size has no limit.

A text stands at a position if the runs that tile it, the last one ending where it ends, stand at the corresponding positions: an equal
join by position and run, which is exact. Candidates come from the tile that occurs most rarely. The longest verbatim
run of a quotation is the longest island of consecutive matches on one diagonal (position less offset).

Defined cases: null and empty texts and those shorter than MIN_CHARS in every reading are nowhere; equal texts are searched
once; verses without letters in a reading take no room in it; an empty reference has no quotation; a match that reaches into
another chapter ends with its first verse.

Most texts have no run of the reference. A sieve, a bit set of SIEVE_BITS bits at most that is sent to every task, drops them and what else
the reference cannot have before anything is shuffled or written; the joins behind it are exact, so it only saves work. Sieves of what is
sought drop the positions of the reference that nobody asks for in the same way.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import text as t
from . import quotes, relational
from .quotes import FORMULAS, MIN_CHARS, MIN_WORDS, PART_SHARE, PART_WORDS, RUN_CHARS, RUN_WORDS, Script

#: Characters of the reference text that one row of its cutting holds.
BLOCK = 512
#: Runs that are made from one strip of a block.
STRIP = 32
#: Bits of a sieve for each of its keys, as long as it has no more than SIEVE_BITS in all (8 MB).
BITS_A_KEY, SIEVE_BITS = 64, 1 << 26


@dataclass(frozen=True)
class Reference:
    grams: DataFrame  #: reading, pos, gram
    pieces: DataFrame  #: reading, block, start, end, chapter, verse
    script: Script
    sieve: DataFrame  #: of (reading, gram)


def _slots(key: list[Column], bits: Column) -> list[Column]:
    """The two bits of a key in a sieve of so many bits, a power of two."""
    h = F.xxhash64(*key)
    return [h.bitwiseAND(bits - 1), F.shiftright(h, 32).bitwiseAND(bits - 1)]


def sieve(keys: DataFrame) -> DataFrame:
    """One row with `bits`, a bit set in words of 64, in which two bits are set for each row of keys (all of its columns)."""
    many = keys.agg(F.approx_count_distinct(F.xxhash64(*keys.columns))).first()[0]
    size = min(SIEVE_BITS, max(1 << 12, 1 << (BITS_A_KEY * many - 1).bit_length() if many else 0))
    slots = F.array(*_slots([F.col(c) for c in keys.columns], F.lit(size).cast("long")))
    put = keys.select(F.explode(slots).alias("s")).groupBy(F.expr("s div 64").alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 AS int)))").alias("w"))
    words = keys.sparkSession.range(size // 64).join(put, "id", "left").select(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")).alias("z"))
    return written(words.agg(F.transform(F.sort_array(F.collect_list("z")), lambda z: z["w"]).alias("bits")), "sieve")


def sieved(df: DataFrame, by: DataFrame, *keys: list[Column], outside: bool = False) -> DataFrame:
    """The rows all of whose keys a sieve may have; `outside`: the others, of which it has not all keys for certain."""
    bits = by.withColumnRenamed("bits", "_bits")
    size = F.size("_bits").cast("long") * 64
    has = lambda s: F.getbit(F.get("_bits", F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1
    there = [has(s) for key in keys for s in _slots(key, size)]
    return df.join(F.broadcast(bits), functools.reduce(lambda a, b: a & b, there), "left_anti" if outside else "left_semi")


def build(verses: DataFrame, script: Script = quotes.ARABIC, chapter: str = "chapter", verse: str = "verse", text: str = "text") -> Reference:
    own = verses.select(F.col(chapter).alias("chapter"), F.col(verse).alias("verse"), script.read(F.col(text)).alias("r"))
    size = lambda k: F.length(F.col("r")[k]) + (1 if k == 0 else 0)
    own = relational.ordered_totals(own, ["chapter", "verse", "r"], {f"s{k}": size(k) for k in range(4)})
    forms = F.array(*[F.struct(F.lit(k + 1).alias("reading"), F.col(f"s{k}").alias("start"), (F.concat(F.col("r")[0], F.lit(" ")) if k == 0 else F.col("r")[k]).alias("x")) for k in range(4)])
    long = own.select("chapter", "verse", F.explode(forms).alias("f")).select("chapter", "verse", "f.*").where("x <> ''").withColumn("end", F.col("start") + F.length("x"))
    first = f"greatest(0, start - {MIN_CHARS - 1}) div {BLOCK}"
    cut = long.withColumn("block", F.explode(F.expr(f"sequence({first}, (end - 1) div {BLOCK})")))
    begin, stop = F.greatest("start", F.col("block") * BLOCK), F.least("end", (F.col("block") + 1) * BLOCK + MIN_CHARS - 1)
    cut = cut.select("reading", "block", "chapter", "verse", begin.alias("start"), stop.alias("end"), F.substring("x", (begin - F.col("start") + 1).cast("int"), (stop - begin).cast("int")).alias("x"))
    cut = written(cut.where("end > start"), "pieces")
    blocks = cut.groupBy("reading", "block").agg(F.array_sort(F.collect_list(F.struct("start", "x"))).alias("p"))
    blocks = blocks.select("reading", (F.col("block") * BLOCK).alias("at"), F.array_join(F.transform("p", lambda z: z["x"]), "").alias("x"))
    grams = _grams(written(blocks, "blocks"), BLOCK)
    return Reference(grams, cut.drop("x"), script, sieve(grams.select("reading", "gram")))


def _known(df: DataFrame, reference: Reference) -> DataFrame:
    """The rows whose run (reading, gram) the reference may have."""
    return sieved(df, reference.sieve, [F.col("reading"), F.col("gram")])


def asked(reference: Reference, keys: DataFrame) -> DataFrame:
    """The grams whose run some of the keys (reading, gram) may be: what a join with these has to shuffle of the reference."""
    return sieved(reference.grams, sieve(keys.select("reading", "gram")), [F.col("reading"), F.col("gram")])


def _grams(blocks: DataFrame, size: int) -> DataFrame:
    """A row (pos, gram) for each of the first `size` places of a block (at, x) where MIN_CHARS characters are left."""
    # A character of a string is found by counting from its beginning, so a block is cut into strips first.
    many, runs = F.least(F.lit(size), F.length("x") - MIN_CHARS + 1), F.length("_y") - MIN_CHARS + 1
    strips = blocks.where(F.length("x") >= MIN_CHARS).withColumn("_b", F.explode(F.sequence(F.lit(0), many - 1, F.lit(STRIP))))
    strips = strips.withColumn("_y", F.substring("x", F.col("_b") + 1, F.least(F.lit(STRIP), many - F.col("_b")) + MIN_CHARS - 1)).drop("x")
    placed = strips.withColumn("_i", F.explode(F.sequence(F.lit(0), runs - 1)))
    return placed.select(*[c for c in blocks.columns if c not in ("at", "x")], (F.col("at") + F.col("_b") + F.col("_i")).alias("pos"), F.substring("_y", F.col("_i") + 1, F.lit(MIN_CHARS)).alias("gram"))


def verse_of(places: DataFrame, at: str, reference: Reference, prefix: str) -> DataFrame:
    """places (reading, a position) with the chapter and verse there, named prefix_chapter and prefix_verse."""
    p = reference.pieces.select("reading", "block", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("chapter").alias(f"{prefix}_chapter"), F.col("verse").alias(f"{prefix}_verse"))
    both = places.withColumn("block", F.expr(f"`{at}` div {BLOCK}")).join(p, ["reading", "block"])
    return both.where((F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e"))).drop("block", "_s", "_e")


def clamped(places: DataFrame, start: str, last: str, reference: Reference) -> DataFrame:
    """places with chapter, verse_start and verse_end of the characters from start to last; a range ends in its first chapter."""
    both = verse_of(verse_of(places, start, reference, "_a"), last, reference, "_z")
    end = F.when(F.col("_a_chapter") == F.col("_z_chapter"), F.col("_z_verse")).otherwise(F.col("_a_verse"))
    return both.withColumns({"chapter": F.col("_a_chapter"), "verse_start": F.col("_a_verse"), "verse_end": end}).drop("_a_chapter", "_a_verse", "_z_chapter", "_z_verse")


NEEDLE = ["key", "reading", "kind"]


def candidates(needles: DataFrame, reference: Reference) -> DataFrame:
    """needles (key, reading, kind, whole, stem) with start, where one of their tiles stands: the one among those of the first `stem`
    characters that occurs most rarely, if all of these occur at all."""
    first = needles.where(F.length("whole") >= MIN_CHARS).withColumn("gram", F.left("whole", F.lit(MIN_CHARS)))
    some = _known(first, reference).drop("gram")  # most have not even their first tile
    cut = some.withColumn("_n", F.greatest(F.lit(1), F.expr(f"stem div {MIN_CHARS}"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cut = cut.select(*NEEDLE, "_n", (F.col("_i") * MIN_CHARS).alias("off"), F.substring("whole", F.col("_i") * MIN_CHARS + 1, F.lit(MIN_CHARS)).alias("gram"))
    cut = _known(cut, reference)
    known = asked(reference, cut).groupBy("reading", "gram").agg(F.count("*").alias("df"))
    rarest = cut.join(known, ["reading", "gram"]).groupBy(*NEEDLE, "_n").agg(F.count("*").alias("_found"), F.min(F.struct("df", "off", "gram")).alias("x")).where("_found = _n")
    seeds = written(rarest.select(*NEEDLE, F.col("x.off").alias("off"), F.col("x.gram").alias("gram")), "seeds")
    return seeds.join(asked(reference, seeds), ["reading", "gram"]).where("pos >= off").select(*NEEDLE, (F.col("pos") - F.col("off")).alias("start"))


def standing(found: DataFrame, needles: DataFrame, ends: DataFrame, reference: Reference) -> DataFrame:
    """Which probes stand where: NEEDLE, no, len, start. found: candidates; needles: with whole; ends: NEEDLE, no, len, the
    beginnings of `whole` that are sought (MIN_CHARS characters at least)."""
    own = ends.groupBy(*NEEDLE).agg(F.collect_list(F.struct("no", "len")).alias("ends")).join(needles.select(*NEEDLE, "whole"), NEEDLE)
    # Tiles at multiples of MIN_CHARS, as far as the longest probe needs them, and the one that ends each probe.
    most = F.expr(f"(array_max(transform(ends, e -> e.len)) - {MIN_CHARS}) div {MIN_CHARS}")
    offs = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), most.cast("int")), lambda i: i * MIN_CHARS), F.transform("ends", lambda e: e["len"] - MIN_CHARS)))
    tiles = own.select(*NEEDLE, "whole", F.explode(offs).alias("off")).select(*NEEDLE, "off", F.substring("whole", F.col("off") + 1, F.lit(MIN_CHARS)).alias("gram"))
    placed = found.join(tiles, NEEDLE).withColumn("pos", F.col("start") + F.col("off"))
    there = placed.join(asked(reference, tiles), ["reading", "pos", "gram"], "left_semi").groupBy(*NEEDLE, "start").agg(F.array_sort(F.collect_list("off")).alias("offs"))
    base = F.filter("offs", lambda o: o % MIN_CHARS == 0)
    run = F.size(F.filter(F.transform(base, lambda o, i: o == i * MIN_CHARS), lambda same: same))  # tiles from the first one on without a gap
    there = there.withColumn("_run", run).join(own.select(*NEEDLE, "ends"), NEEDLE)
    holds = F.filter("ends", lambda e: (F.floor((e["len"] - MIN_CHARS) / MIN_CHARS) + 1 <= F.col("_run")) & F.array_contains("offs", e["len"] - MIN_CHARS))
    return there.select(*NEEDLE, "start", F.explode(holds).alias("e")).select(*NEEDLE, "start", "e.*")


def _texts(rows: DataFrame, quote: str, script: Script) -> DataFrame:
    """key, r (readings), n (words): a row for each different text."""
    own = rows.select(F.col(quote).alias("x")).where("x IS NOT NULL").distinct()
    own = own.select(F.md5("x").alias("key"), script.read(F.col("x")).alias("r"))
    return own.withColumn("n", F.when(F.col("r")[0] == "", 0).otherwise(F.size(F.split(F.col("r")[0], " "))))


def _ends_of_words(texts: DataFrame, script: Script) -> DataFrame:
    """key, n, i (words up to here), c1 to c3: characters of each reading up to the end of every word."""
    words = texts.select("key", "n", F.posexplode(F.split(F.col("r")[0], " ")).alias("i", "w"))
    upto = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"c{k}": F.sum(F.length(script.shape(F.col("w"), k)) + (1 if k == 1 else 0)).over(upto) - (1 if k == 1 else 0) for k in (1, 2, 3)}
    return words.withColumns(sums).select("key", "n", (F.col("i") + 1).alias("i"), *sums)


def identify(rows: DataFrame, reference: Reference, quote: str = "quote") -> DataFrame:
    """The rows with found (chapter, verse_start, verse_end, reading), null where no reading has the quotation.

    The whole, the whole without an opening formula, and its beginnings of PART_WORDS words and PART_SHARE of its length, longest first,
    are sought in readings 1 to 3, the whole alone in reading 4; the first that stands somewhere wins, at its first place.
    Of fewer than MIN_WORDS words it must stand in one place alone."""
    script = reference.script
    whole, bare = F.col("r")[0], F.lit(None).cast("string")
    folded = rows.sparkSession.range(1).select(*[script.read(F.lit(f))[0].alias(f"f{i}") for i, f in enumerate(FORMULAS)]).first()
    for f in reversed([f for f in folded if f]):
        bare = F.when(whole.startswith(f) & (F.length(whole) > len(f) + MIN_CHARS), F.trim(F.substring(whole, len(f) + 1, 1 << 30))).otherwise(bare)
    bare_of = bare
    bare = F.col("bare")
    part = F.left(whole, F.ceil(F.length(whole) * PART_SHARE).cast("int"))
    of = lambda k, kind, x, stem: F.struct(F.lit(k).alias("reading"), F.lit(kind).alias("kind"), x.alias("whole"), F.length(stem).alias("stem"))
    forms = F.array(*[of(k, 0, script.shape(whole, k), script.shape(part, k)) for k in (1, 2, 3)], *[of(k, 1, x := script.shape(bare, k), x) for k in (1, 2, 3)], of(4, 0, F.col("r")[3], F.col("r")[3]))
    # Texts stay where they are read until the first and the last tile of a stem may be in the reference. An outer explode, as in spans.braces.
    read = rows.select(F.col(quote).alias("x")).where("x IS NOT NULL").withColumn("r", script.read(F.col("x"))).withColumn("bare", bare_of)
    tile = lambda i: [F.col("f.reading"), F.substring(F.col("f.whole"), i * MIN_CHARS + 1, F.lit(MIN_CHARS))]
    forms_of = read.select("x", F.explode_outer(forms).alias("f")).where(F.length("f.whole") >= MIN_CHARS)
    near = sieved(forms_of, reference.sieve, tile(F.lit(0)), tile(F.greatest(F.lit(1), F.expr(f"f.stem div {MIN_CHARS}")).cast("int") - 1)).select("x")
    texts = written(_texts(near, "x", script).withColumn("bare", bare_of), "quotations")
    needles = texts.select("key", "n", F.explode(forms).alias("f")).select("key", "n", "f.*").where(F.length("whole") >= MIN_CHARS)
    found = written(candidates(needles, reference), "candidates")
    met = needles.join(found.select(*NEEDLE).distinct(), NEEDLE)
    full = met.select(*NEEDLE, F.when(F.col("kind") == 0, 0).otherwise(1).alias("no"), F.length("whole").alias("len"))
    long = texts.where(F.col("n") > PART_WORDS).join(met.where("kind = 0 AND reading < 4").select("key").distinct(), "key")
    cuts = _ends_of_words(long, script).where((F.col("i") >= PART_WORDS) & (F.col("i") < F.col("n")))
    cuts = cuts.join(texts.select("key", F.length(whole).alias("_all")), "key").where(F.col("c1") >= PART_SHARE * F.col("_all"))
    lens = F.array(*[F.struct(F.lit(k).alias("reading"), F.col(f"c{k}").cast("int").alias("len")) for k in (1, 2, 3)])
    parts = cuts.select("key", (F.col("n") - F.col("i") + 1).alias("no"), F.explode(lens).alias("z")).select("key", "z.reading", F.lit(0).alias("kind"), "no", "z.len")
    ends = full.unionByName(parts.join(met.select(*NEEDLE), NEEDLE)).where(F.col("len") >= MIN_CHARS)
    stand = standing(found, needles, ends, reference).groupBy("key", "reading", "no", "len").agg(F.min("start").alias("start"), F.count("*").alias("places"))
    stand = stand.join(texts.select("key", "n"), "key").where((F.col("n") >= MIN_WORDS) | (F.col("places") == 1))
    best = stand.groupBy("key").agg(F.min(F.struct("reading", "no", "start", "len")).alias("b")).select("key", "b.reading", "b.start", (F.col("b.start") + F.col("b.len") - 1).alias("last"))
    named = clamped(best, "start", "last", reference).select(F.col("key").alias("_key"), F.struct("chapter", "verse_start", "verse_end", "reading").alias("found"))
    return _with_named(rows, quote, named, "found")


def _with_named(rows: DataFrame, quote: str, named: DataFrame, name: str) -> DataFrame:
    """rows with what named (_key, the digest of a text, and a column of that name) has for their texts, or null. Rows of texts that it
    certainly has not meet no join, so they are not shuffled; who filters by the column never reads them."""
    named = written(named, name)
    by, key = sieve(named.select("_key")), [F.md5(F.col(quote))]
    met = sieved(rows, by, key).withColumn("_key", key[0]).join(named, "_key", "left").drop("_key")
    none = sieved(rows, by, key, outside=True).withColumn(name, F.lit(None).cast(named.schema[name].dataType))
    return met.select(*none.columns).unionByName(none)


def locate(rows: DataFrame, reference: Reference, text: str = "quote") -> DataFrame:
    """The rows with found as in identify(), for texts of two words or more that stand as a whole, in the tightest reading that has them."""
    own = written(_texts(rows, text, reference.script).where("n >= 2"), "texts")
    needles = own.select("key", F.posexplode("r").alias("k", "whole")).select("key", (F.col("k") + 1).alias("reading"), F.lit(0).alias("kind"), "whole", F.length("whole").alias("stem"))
    needles = needles.where(F.length("whole") >= MIN_CHARS)
    found = candidates(needles, reference)
    stand = standing(found, needles, needles.select(*NEEDLE, F.lit(0).alias("no"), F.length("whole").alias("len")), reference)
    best = stand.groupBy("key").agg(F.min(F.struct("reading", "start", "len")).alias("b")).select("key", "b.reading", "b.start", (F.col("b.start") + F.col("b.len") - 1).alias("last"))
    named = clamped(best, "start", "last", reference).select(F.col("key").alias("_key"), F.struct("chapter", "verse_start", "verse_end", "reading").alias("found"))
    return rows.join(named, F.md5(F.col(text)) == F.col("_key"), "left").drop("_key")


#: Steps at which a quotation's runs are probed at first, by reading: a run of RUN_CHARS folded characters has one of them inside (in
#: reading 2 it has 16 characters at least, if all its words are single letters); readings 3 and 4 may be as short as MIN_CHARS.
STEPS = (RUN_CHARS - MIN_CHARS + 1, (RUN_CHARS + 2) // 2 - MIN_CHARS + 1, 1, 1)


def _all_grams(texts: DataFrame, steps: tuple | None = None) -> DataFrame:
    """key, reading, pos, gram of texts (key, r); at multiples of the readings' steps alone, if those are given."""
    long = texts.select("key", F.posexplode("r").alias("k", "x")).where(F.length("x") >= MIN_CHARS).withColumn("reading", F.col("k") + 1)
    at = F.explode(F.sequence(F.lit(0), F.expr(f"(length(x) - {MIN_CHARS}) div {BLOCK}")))
    blocks = long.withColumn("_b", at).select("key", "reading", (F.col("_b") * BLOCK).alias("at"), F.substring("x", (F.col("_b") * BLOCK + 1).cast("int"), F.lit(BLOCK + MIN_CHARS - 1)).alias("x"))
    if steps:
        step = F.element_at(F.array(*map(F.lit, steps)), F.col("reading"))
        first = F.pmod(-F.col("at"), step)
        blocks = blocks.withColumn("_last", F.least(F.lit(BLOCK), F.length("x") - MIN_CHARS + 1) - 1).where(first <= F.col("_last"))
        placed = blocks.withColumn("_i", F.explode(F.sequence(first, F.col("_last"), step)))
        return placed.select("key", "reading", (F.col("at") + F.col("_i")).alias("pos"), F.substring("x", (F.col("_i") + 1).cast("int"), F.lit(MIN_CHARS)).alias("gram"))
    return _grams(blocks, BLOCK)


def _word_places(words: DataFrame, script: Script) -> DataFrame:
    """words (key, i, w) with where each begins and ends in its text in every reading: s1, e1 to s4, e4.

    A word that is empty in a reading begins with the next one and ends with the one before. In reading 4 a letter that ends a word and
    begins the next is one."""
    read = words.select("key", "i", script.read(F.col("w")).alias("r"))
    by = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size, full = (lambda k: F.length(F.col("r")[k])), (lambda k: F.length(F.col("r")[k]) > 0)
    letter = F.last(F.when(full(3), F.right(F.col("r")[3], F.lit(1))), ignorenulls=True).over(by)
    read = read.withColumn("_met", (full(3) & F.coalesce(letter == F.left(F.col("r")[3], F.lit(1)), F.lit(False))).cast("int"))
    read = read.withColumn("_gap", (F.coalesce(F.sum(size(0)).over(by), F.lit(0)) > 0).cast("int"))  # reading 1 has a space before the word
    adds = {1: F.when(full(0), size(0) + F.col("_gap")).otherwise(0), 2: size(1), 3: size(2), 4: size(3) - F.col("_met")}
    sums = {f"_b{k}": F.coalesce(F.sum(x).over(by), F.lit(0)) for k, x in adds.items()}
    read = read.withColumns(sums)
    start = {1: F.col("_b1") + F.col("_gap"), 2: F.col("_b2"), 3: F.col("_b3"), 4: F.col("_b4") - F.col("_met")}
    return read.select("key", "i", *[f(k) for k in adds for f in (lambda k: start[k].alias(f"s{k}"), lambda k: (F.col(f"_b{k}") + adds[k]).alias(f"e{k}"))])


def longest_runs(rows: DataFrame, reference: Reference, quote: str = "quote") -> DataFrame:
    """The rows with run (first, last, chapter, verse, verse_end): the longest run of words (first to last, last excluded) that stands in the
    reference text in any reading, the first one of those, in the tightest reading and at its first place; null if it has
    fewer than RUN_WORDS words or RUN_CHARS folded characters."""
    script = reference.script
    def read(own):
        own = own.withColumn("words", t.tokens("x")).where(F.size("words") >= RUN_WORDS).withColumn("r", script.read(F.col("x")))
        return own.where(F.length(F.col("r")[0]) >= RUN_CHARS)

    # Texts stay where they are read until the reference may have one of their runs.
    own = read(rows.select(F.col(quote).alias("x")).where("x IS NOT NULL")).select(F.col("x").alias("key"), "r")
    near = read(_known(_all_grams(own, STEPS), reference).select(F.col("key").alias("x")).distinct())
    near = written(near.select(F.md5("x").alias("key"), "words", "r"), "near")
    met = _known(_all_grams(near).withColumnRenamed("pos", "off"), reference).join(reference.grams, ["reading", "gram"]).select("key", "reading", "off", (F.col("pos") - F.col("off")).alias("diagonal"))
    line = ["key", "reading", "diagonal"]
    met = met.withColumn("_island", F.col("off") - F.row_number().over(Window.partitionBy(*line).orderBy("off")))
    islands = met.groupBy(*line, "_island").agg(F.min("off").alias("lo"), (F.max("off") + MIN_CHARS).alias("hi"))
    islands = islands.where((F.col("reading") > 1) | (F.col("hi") - F.col("lo") >= RUN_CHARS))
    places = _word_places(near.join(islands.select("key").distinct(), "key", "left_semi").select("key", F.posexplode("words").alias("i", "w")), script)
    ends = F.array(*[F.struct(F.lit(k).alias("reading"), F.col(f"s{k}").alias("s"), F.col(f"e{k}").alias("e")) for k in (1, 2, 3, 4)])
    placed = places.select("key", "i", "s1", "e1", F.explode(ends).alias("z")).select("key", "i", "s1", "e1", "z.*")
    inside = islands.join(placed, ["key", "reading"]).where((F.col("s") >= F.col("lo")) & (F.col("e") <= F.col("hi")))
    runs = inside.groupBy(*line, "lo").agg(F.min(F.struct("i", "s", "s1")).alias("a"), F.max(F.struct("i", "e", "e1")).alias("z"))
    many = F.col("z.i") - F.col("a.i") + 1
    runs = runs.where((many >= RUN_WORDS) & (F.col("z.e") - F.col("a.s") >= MIN_CHARS)).select("key", F.struct((-many).alias("n"), F.col("a.i").alias("first"), "reading", (F.col("diagonal") + F.col("a.s")).alias("start"), (F.col("diagonal") + F.col("z.e") - 1).alias("stop"), (F.col("z.i") + 1).alias("last"), (F.col("z.e1") - F.col("a.s1")).alias("chars")).alias("b"))
    best = runs.groupBy("key").agg(F.min("b").alias("b")).where(F.col("b.chars") >= RUN_CHARS).select("key", "b.*")
    named = clamped(best, "start", "stop", reference)
    run = F.struct("first", "last", "chapter", F.col("verse_start").alias("verse"), "verse_end")
    return _with_named(rows, quote, named.select(F.col("key").alias("_key"), run.alias("run")), "run")
