"""Column to Column text functions: markers, Arabic folding, tokens, excerpts, escapes, citations and small formulas."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character sets that folding depends on.
MARKS = "ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ"
MARKS_WIDE = "ؐ-ًؚ-ٰٟۖ-ۭـ"
TATWEEL = "ـ"
ALEFS = "آأإٱ"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PAGE_TAG = r"PageV(\d+)P(\d+)"
SENTENCE = "[^.?!؟\n]+[.?!؟]?"
# Function words that a query drops while something else is left.
STOP_EN = "the and for from with that this these those are was were not but you all any can has had his her its our out who why how what when where which into upon than then they them their there have been about over under also such some more most other only very may shall will would could should does did said".split()
STOP_AR = "من في علي عن الي ان ما لا هذا هذه ذلك التي الذي هو هي قد كان مع او ثم بين لم لن اذا حتي عند بعد قبل كما لكن وقد وهو وهي ولا فان وان".split()


def _c(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def strip(x) -> Column:
    """Trims all Unicode white space."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def strip_spaces(x) -> Column:
    """Trims Unicode space separators (as SQL's trim does), but no tabs or line ends."""
    return F.regexp_replace(_c(x), r"^\p{Zs}+|\p{Zs}+\z", "")


def norm_ws(x) -> Column:
    return strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def strip_markers(x) -> Column:
    """Page tags and milestones become a space."""
    return F.regexp_replace(F.regexp_replace(_c(x), PAGE_TAG, " "), r"(?U)\bms\d+\b", " ")


def strip_marks(x, wide: bool = False) -> Column:
    """Drops combining marks; wide drops the whole U+06D6-06ED range and the tatweel too."""
    return F.regexp_replace(_c(x), f"[{MARKS_WIDE if wide else MARKS}]", "")


def clean_for_embedding(x) -> Column:
    return norm_ws(strip_markers(F.replace(_c(x), F.lit(TATWEEL), F.lit(""))))


def fold(x) -> Column:
    """The lexical index's form of a text."""
    t = F.replace(strip_marks(strip_markers(x)), F.lit(TATWEEL), F.lit(""))
    t = F.translate(t, ALEFS + "ىةؤئء", "ا" * len(ALEFS) + "يهوي")
    return norm_ws(F.regexp_replace(t, r"(?U)[^؀-ۿݐ-ݿ\s\w]", " "))


def fold_search(x) -> Column:
    """The search page's form: wide marks dropped, letters unified, lower case, punctuation kept."""
    return F.lower(F.translate(strip_marks(x, wide=True), ALEFS + "ىؤئةء", "ا" * len(ALEFS) + "يويه"))


def has_arabic(x) -> Column:
    return _c(x).rlike("[؀-ۿ]")


def tokens(x) -> Column:
    return F.filter(F.split(norm_ws(x), " "), lambda t: t != "")


def ascii_tokens(x) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(words: Column, limit: int = 12) -> Column:
    """Distinct words of two letters or digits at least, without function words unless that leaves none, `limit` at most."""
    usable = F.array_distinct(F.filter(words, lambda w: F.length(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")) >= 2))
    kept = F.filter(usable, lambda w: ~w.isin(STOP_EN + STOP_AR))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(usable), 1, limit)


def stem(x) -> Column:
    """The word without ing, ed, es or s, if four letters are left."""
    cut = F.regexp_replace(_c(x), "(ing|ed|es|s)$", "")
    return F.when(F.length(cut) >= 4, cut).otherwise(_c(x))


def sentences(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(SENTENCE), F.lit(0))


def tile_sentences(x) -> Column:
    """Sentences with the stops and the space behind them; stops that stand alone belong to none."""
    return F.regexp_extract_all(_c(x), F.lit(r"(?U)[^.!?؟؛]+[.!?؟؛]*\s*"), F.lit(0))


def line_sentences(x) -> Column:
    """Sentences cut behind . ! ? and their Arabic forms and at line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_c(x), r"(?U)(?<=[.!?؟؛])\s+|\n+"), strip), lambda s: s != "")


#: Elements that one step of running_sums copies at most.
SUM_BLOCK = 64


def running_sums(sizes: Column) -> Column:
    """For each size of an array the sum up to it, itself included. Blocks are summed first and then moved by what stands before them,
    so that no step copies a long array."""
    let = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is computed once, however often f uses it
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    none = F.array().cast("array<int>")
    grown = lambda a, z: F.concat(a, F.array(last(a) + z))
    starts = lambda s: F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(SUM_BLOCK))
    blocks = lambda s: F.transform(starts(s), lambda b: F.aggregate(F.slice(s, b + 1, F.lit(SUM_BLOCK)), none, grown))
    before = lambda i: F.aggregate(i, F.array(F.lit(0)), lambda a, x: grown(a, last(x)))
    moved = lambda i: F.zip_with(i, F.slice(before(i), F.lit(1), F.size(i)), lambda x, at: F.transform(x, lambda z: z + at))
    return F.flatten(let(sizes, lambda s: let(blocks(s), moved)))


def places(x: Column, pattern: str) -> Column:
    """array<struct<found,start,end>>: every match of a regular expression with its place in the text. What stands between the
    matches and the matches themselves are two arrays, whose lengths add up to the places."""
    found, gaps = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern, -1)
    let = lambda y, f: F.transform(F.array(y), f)[0]

    def placed(own):
        ends = running_sums(F.zip_with(F.slice(own["gaps"], F.lit(1), F.size(own["found"])), own["found"], lambda g, w: F.length(g) + F.length(w)))
        return F.zip_with(own["found"], ends, lambda w, e: F.struct(w.alias("found"), (e - F.length(w)).alias("start"), e.alias("end")))

    return let(F.struct(found.alias("found"), gaps.alias("gaps")), placed)


def words_with_offsets(x) -> Column:
    """array<struct<word,start,end>> of lower-case ASCII words with their places in the text."""
    return F.transform(places(F.lower(_c(x)), "[a-z0-9]+"), lambda z: F.struct(z["found"].alias("word"), z["start"].alias("start"), z["end"].alias("end")))


def thousands(x) -> Column:
    return F.format_number(x, 0)


# The forms that count words take in Arabic: one, two, three to ten, more.
PASSAGES_AR = ("موضعٌ واحد", "موضعان", "مواضع", "موضعاً")
VOLUMES_AR = ("مجلدٍ واحد", "مجلدين", "مجلدات", "مجلداً")


def counted(n: Column, forms: tuple[str, str, str, str] = PASSAGES_AR) -> Column:
    """A number with its noun: alone for one and two, in the plural from three to ten, else in the singular."""
    one, two, few, many = forms
    return F.when(n == 1, one).when(n == 2, two).otherwise(F.concat(arabic_digits(n), F.lit(" "), F.when(n.between(3, 10), few).otherwise(many)))


def clean_json_dashes(x) -> Column:
    """clean_dashes for every string value in a JSON text, however deep; keys and other values stay."""
    token = r'"(?:[^"\\]|\\.)*"\s*:?|[^"]+'
    parts = F.regexp_extract_all(_c(x), F.lit(token), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"') & ~p.endswith(":"), clean_dashes(p)).otherwise(p)), "")


def collapse_doubled(x) -> Column:
    return F.regexp_replace(_c(x), r"(?s)(.)\1+", "$1")


def snippet(x, limit: int = 155) -> Column:
    """At most `limit` characters, cut at a space behind 60 % of them if there is one."""
    t = norm_ws(x)
    head = F.substring(t, 1, limit)
    cut = F.lit(limit) - F.locate(" ", F.reverse(head))
    at = F.when((F.locate(" ", head) > 0) & (cut > limit * 0.6), cut).otherwise(F.lit(limit))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, at.cast("int")), r"\s+$", ""), F.lit("…")))


def excerpt(x, limit: int) -> Column:
    """As snippet, but white space stays, and an opening brace that would be left open is cut off."""
    t = _c(x)
    head = F.substring(t, 1, limit + 1)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (last >= limit * 0.6), last).otherwise(F.lit(limit))
    s = F.left(t, cut.cast("int"))
    opens = F.length(F.replace(s, F.lit("{"), F.lit(""))) < F.length(F.replace(s, F.lit("}"), F.lit("")))
    closed = F.when(opens, F.left(s, (F.length(s) - F.locate("{", F.reverse(s))).cast("int"))).otherwise(s)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(closed, r"(?U)\s+$", ""), F.lit(" …")))


def escape_html(x, quotes: bool = False) -> Column:
    t = F.replace(F.replace(F.replace(_c(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else t


def ornate_braces(x) -> Column:
    """{quotation} in ornate brackets, line breaks as markup."""
    t = F.regexp_replace(escape_html(x), r"\{([^{}]+)\}", "<span class=\"quote\">﴿$1﴾</span>")
    return F.replace(t, F.lit("\n"), F.lit("<br>"))


def arabic_digits(x) -> Column:
    return F.translate(F.coalesce(x, F.lit("")).cast("string"), "0123456789", ARABIC_DIGITS)


def clean_dashes(x) -> Column:
    t = F.regexp_replace(_c(x), "[—–]", ", ")
    t = F.regexp_replace(t, r"(?:,\s*){2,}", ", ")
    return F.regexp_replace(F.regexp_replace(t, r"\s+,", ","), " {2,}", " ")


def cache_key(provider: str, x) -> Column:
    return F.left(F.sha2(F.concat(F.lit(provider + ":"), _c(x)), 256), F.lit(16))


def word_count(x) -> Column:
    t = norm_ws(x)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def lookup_phrase(x, n: int = 12) -> Column:
    """The first n words, URL-encoded; null under three words."""
    w = tokens(x)
    coded = F.url_encode(F.array_join(F.slice(w, 1, n), " "))
    for form, rfc in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):  # from form encoding to that of addresses
        coded = F.replace(coded, F.lit(form), F.lit(rfc))
    return F.when(F.size(w) >= 3, coded)


def occurrences(x, find) -> Column:
    """Non-overlapping occurrences of a column's or constant text."""
    f = find if isinstance(find, Column) else F.lit(find)
    return F.when(F.length(f) > 0, ((F.length(_c(x)) - F.length(F.replace(_c(x), f, F.lit("")))) / F.length(f)).cast("int")).otherwise(0)


def balanced(x) -> Column:
    return occurrences(x, "{") == occurrences(x, "}")


def letter_share(x) -> Column:
    return F.regexp_count(_c(x), F.lit(r"\p{L}")) / F.greatest(F.length(_c(x)), F.lit(1))


def good_line(x) -> Column:
    """45 to 130 characters, ends a sentence, mostly letters, no brace left."""
    t = _c(x)
    return F.length(t).between(45, 130) & t.rlike("[.?!؟]$") & (letter_share(t) >= 0.55) & ~t.rlike("[{}]")


def cite_en(volume, start, end) -> Column:
    pages = F.when(start == end, F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("–"), end.cast("string")))
    return F.concat(F.lit("Vol. "), volume.cast("string"), F.lit(" · "), pages)


def cite_ar(volume, start, end) -> Column:
    pages = F.when(start == end, arabic_digits(start)).otherwise(F.concat(arabic_digits(start), F.lit("–"), arabic_digits(end)))
    return F.concat(F.lit("المجلد "), arabic_digits(volume), F.lit(" · ص "), pages)


def hijri_to_ce(year) -> Column:
    return F.round(year - year / 33.7 + 622).cast("int")


def relevance_pct(score) -> Column:
    return F.greatest(F.lit(8), F.least(F.lit(100), F.round((score - 0.30) / 0.45 * 100).cast("int")))


def confidence(best) -> Column:
    return F.coalesce(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (best - 0.3) / 0.5)), 3), F.lit(0.0))


def highlight(x, words: list[str]) -> Column:
    """Wraps whole Latin words and Arabic letter sequences (any form, with or without marks) in <mark>, after escaping."""
    forms = {"ا": "[اأإآٱ]", "ي": "[يىئی]", "و": "[وؤ]", "ه": "[هة]"}  # fixed values: the forms of a letter that count as one
    between = "[ؐ-ًؚ-ٰٟۖ-ۭـ]*"
    parts = [between.join(forms.get(c, re.escape(c)) for c in w) if re.search("[؀-ۿ]", w) else rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])" for w in words]
    t = escape_html(x)
    return F.regexp_replace(t, "(?iu)(" + "|".join(parts) + ")", "<mark>$1</mark>") if parts else t
