"""Ranking: BM25, dense vectors, reciprocal-rank fusion, lexical field search, neighbours by shared words, facets."""

from __future__ import annotations

import itertools
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as t

K1, B = 1.5, 0.75


def dot(a, b) -> Column:
    double = lambda x: F.transform(F.col(x) if isinstance(x, str) else x, lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def bm25_index(docs: DataFrame, key: str, words: Column) -> dict[str, DataFrame]:
    """Tables of an inverted index: postings(term, key, tf), lengths(key, dl), terms(term, df)."""
    tokens = docs.select(key, words.alias("w"))
    postings = tokens.select(key, F.explode("w").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return {"postings": postings, "lengths": tokens.select(key, F.size("w").cast("long").alias("dl")), "terms": postings.groupBy("term").agg(F.count("*").alias("df"))}


def save_index(index: dict[str, DataFrame], folder: str) -> None:
    """The tables as Parquet, postings and terms in order of terms, so that a query reads the row groups of its terms alone."""
    for name, df in index.items():
        (df if name == "lengths" else df.repartitionByRange("term").sortWithinPartitions("term")).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "terms")}


def _score(tf, df, n, dl, avgdl) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + F.lit(K1) * (1 - B + B * dl / avgdl))


def bm25_search(index: dict[str, DataFrame], key: str, query: list[str], k: int = SETTINGS.top_lexical) -> DataFrame:
    """The k best documents for the query's distinct words, from index tables; only scores above 0."""
    stats = index["lengths"].agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = index["postings"].where(F.col("term").isin(query)).join(index["terms"].where(F.col("term").isin(query)), "term")
    scored = hits.join(index["lengths"], key).crossJoin(F.broadcast(stats)).select(key, _score(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl")).alias("s"))
    return scored.groupBy(key).agg(F.round(F.sum("s"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k).where("score > 0")


def bm25_scan(docs: DataFrame, key: str, words: Column, query: list[str], k: int = SETTINGS.top_lexical) -> DataFrame:
    """bm25_search without an index, for a query that runs once: texts are read once, and only counts are shuffled; the statistics and the scores share that shuffle."""
    terms = list(dict.fromkeys(query))
    same = lambda q: lambda x: x == F.lit(q)
    tf = docs.select(key, words.alias("w")).select(key, F.size("w").alias("dl"), *[F.size(F.filter("w", same(q))).alias(f"tf{i}") for i, q in enumerate(terms)]).repartition(F.col(key), F.col("dl"))
    # The count uses the key, so both branches need the same columns and Spark plans the shuffle once.
    stats = F.broadcast(tf.agg((F.count(key) + F.count_if(F.col(key).isNull())).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))]))
    score = sum((_score(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("dl"), F.col("avgdl")) for i in range(len(terms))), F.lit(0.0))
    # No filter on the counts here: it would be pushed below the shuffle and count the words a second time.
    return tf.crossJoin(stats).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k).where("score > 0")


def dense_topk(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = SETTINGS.top_dense) -> DataFrame:
    """The k vectors of the largest dot product with one query vector, which goes along as a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(dot(vector, q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def similar_vectors(vectors: DataFrame, key: str, vector: str, seed, k: int = 5) -> DataFrame:
    """The k vectors nearest to that of the seed key, without itself."""
    found = vectors.where(F.col(key) == seed).select(vector).first()
    if found is None:
        return vectors.where("false").select(key, F.lit(0.0).alias("score"))
    return dense_topk(vectors.where(F.col(key) != seed), key, vector, found[0], k)


def ranked(hits: DataFrame, key: str, score: str = "score") -> DataFrame:
    """0-based ranks of a short list (a top-k, so one task sees at most k rows)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)


def fuse(dense: DataFrame, lexical: DataFrame, key: str, k: int | None = SETTINGS.top_final, c: int = SETTINGS.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; ties by dense rank, then lexical rank; k = 0 or None means the default."""
    d = dense.select(key, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    x = lexical.select(key, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    part = lambda r: F.coalesce(1 / (F.lit(c) + F.col(r)), F.lit(0.0))
    both = d.join(x, key, "full_outer").select(key, F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.round(part("dense_rank") + part("lexical_rank"), 9).alias("rrf_score"), "dense_rank", "lexical_rank")
    return both.orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank")).limit(k or SETTINGS.top_final)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n of every column, by grouping sets: one pass."""
    out = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g{c}") for c in columns])
    name = F.coalesce(*[F.when(F.col(f"_g{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"_g{c}") == 0, F.col(c).cast("string")) for c in columns])
    return out.select(name.alias("facet"), value.alias("value"), "n")


# --- lexical field search

# Length constants and weights of the three fields, and of proximity and phrase.
K_LEN = {"hi": 24.0, "q": 420.0, "a": 2000.0}
WEIGHT = {"hi": 3.0, "q": 2.0, "a": 0.7}
PROXIMITY, PHRASE, SCALE = 2.2, 1.2, 2.2
MAX_POSITIONS, OTHER_FORM = 120, 0.6
# The glossary of terms, each with the forms that it may take.
LEXICON = {
    "help": ["istighathah", "الاستغاثة", "يستغيث"], "aid": ["istighathah", "الاستغاثة", "يستغيث"], "dead": ["deceased", "الموتى", "الميت"], "grave": ["graves", "tomb", "القبور"],
    "intermediary": ["wasitah", "واسطة", "الوسائط"], "tawassul": ["التوسل", "وسيلة"], "intercession": ["shafaah", "الشفاعة"], "divorce": ["repudiation", "الطلاق"],
    "anger": ["angry", "الغضب"], "prayer": ["salah", "الصلاة"], "congregation": ["congregational", "الجماعة"], "fasting": ["ramadan", "الصيام", "الصوم"],
    "zakat": ["alms", "الزكاة"], "usury": ["riba", "الربا"], "innovation": ["bidah", "البدعة"], "oath": ["اليمين", "النذر"], "inheritance": ["الميراث", "الفرائض"],
    "endowment": ["waqf", "الوقف"], "ablution": ["wudu", "الوضوء"], "purity": ["الطهارة"], "pilgrimage": ["hajj", "الحج"], "marriage": ["nikah", "النكاح"],
    "saints": ["awliya", "الأولياء"], "attributes": ["sifat", "الصفات"],
}
_FOLD = {**dict.fromkeys("آأإٱ", "ا"), "ى": "ي", "ؤ": "و", "ئ": "ي", "ة": "ه", "ء": ""}


def fold_word(word: str) -> str:
    """The fold of functions.text.fold_search, for a query's own words."""
    return "".join(_FOLD.get(c, c) for c in re.sub(f"[{t.MARKS_WIDE}]", "", word)).lower()


def query_terms(query: str, limit: int = 12) -> list[str]:
    words = fold_word(query).split()
    usable = [w for w in dict.fromkeys(words) if sum(c.isalnum() for c in w) >= 2]
    kept = [w for w in usable if w not in t.STOP_EN and w not in t.STOP_AR]
    return (kept or usable)[:limit]


def expand(term: str, lexicon: dict[str, list[str]] = LEXICON) -> list[str]:
    listed = lexicon.get(term) or lexicon.get(re.sub("(ing|ed|es|s)$", "", term)) or []
    return list(dict.fromkeys([term] + [f for f in map(fold_word, listed) if f]))


# White space and marks that may part the words of a phrase.
_BETWEEN = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff،,;:]+"


def _arabic(form: str) -> bool:
    return bool(re.search("[؀-ۿ]", form))


def _pattern(form: str) -> str:
    """An Arabic form anywhere; a Latin one at word borders (ASCII ones), without its ending and with up to four more letters."""
    if _arabic(form):
        return re.escape(form)
    cut = re.sub("(ing|ed|es|s)$", "", form)
    return rf"\b{re.escape(cut if len(cut) >= 4 else form)}\w{{0,4}}\b"


def phrase_pattern(terms: list[str]) -> str:
    """The terms one after another, with nothing but white space and commas between; Latin ones may go on for four letters."""
    return _BETWEEN.join(re.escape(x) if _arabic(x) else rf"\b{re.escape(x)}\w{{0,4}}" for x in terms)


def smallest_window(positions: list[list[int]]) -> int:
    """The shortest span that holds one position of every list."""
    events = sorted((p, i) for i, own in enumerate(positions) for p in own)
    last: dict[int, int] = {}
    best = 1 << 60
    for p, i in events:
        last[i] = p
        if len(last) == len(positions):
            best = min(best, p - min(last.values()))
    return best


@dataclass(frozen=True)
class Scorer:
    """Scores one record for a query: forms of each term (its own first, then the glossary's), and each term's weight."""

    forms: list[list[str]]
    idf: list[float]

    def __post_init__(self):
        made = [(re.compile(_pattern(f[0]), re.A), re.compile("|".join(map(_pattern, f[1:])), re.A) if f[1:] else None) for f in self.forms]
        terms = [f[0] for f in self.forms]
        object.__setattr__(self, "patterns", made)
        object.__setattr__(self, "total", sum(self.idf) or 1.0)
        object.__setattr__(self, "room", sum(len(x) + 1 for x in terms) + 4)
        object.__setattr__(self, "phrase", re.compile(phrase_pattern(terms), re.A | re.I) if len(terms) > 1 else None)

    def field(self, text: str, name: str) -> tuple[float, float, float]:
        """(what the field adds, its share of the query's weight, its proximity)."""
        mass, places = 0.0, []
        for (own, other), weight in zip(self.patterns, self.idf):
            for pattern, worth in ((own, 1.0), (other, OTHER_FORM)):
                if pattern and (at := [m.start() for m in itertools.islice(pattern.finditer(text), MAX_POSITIONS)]):
                    places.append(at)
                    mass += weight * worth
                    break
        if not mass:
            return 0.0, 0.0, 0.0
        norm = 1 / (1 + math.log(1 + len(text) / K_LEN[name]))
        return WEIGHT[name] * mass * norm, mass / self.total, self.near(places) * (0.55 * norm if name == "a" else 1.0)

    def near(self, places: list[list[int]]) -> float:
        if len(self.forms) == 1:
            return 1.0
        cover = len(places) / len(self.forms)
        if len(places) == 1:
            return 0.12 * cover
        return min(1.0, self.room / max(smallest_window(places), self.room)) * cover

    def score(self, hi: str, q: str, a: str) -> float:
        parts = [self.field(x, name) for name, x in (("hi", hi), ("q", q), ("a", a))]
        raw = sum(p[0] for p in parts) + PROXIMITY * max(p[2] for p in parts) * self.total
        if self.phrase and any(map(self.phrase.search, (hi, q, a))):
            raw += PHRASE * self.total
        subject = max(parts[0][1], parts[1][1])
        return raw / self.total * (0.4 + 0.6 * subject)


def lexical_search(records: DataFrame, query: str, key: str = "id", fields: tuple[str, str, str] = ("hi", "q", "a"), order: tuple[str, ...] = ()) -> DataFrame:
    """key, score, pct of every candidate, best first (ties by the columns order, such as volume and page, then key): candidates hold all of two terms or 70 % of more; mass by
    field and idf, the tightest window of terms, and the phrase count.

    Candidate search and document frequencies are native; scoring runs as an Arrow function over candidates alone."""
    import pandas as pd

    terms = query_terms(query)
    empty = "`%s` %s, score double, pct int" % (key, records.schema[key].dataType.simpleString())
    if not terms:
        return records.sparkSession.createDataFrame([], empty)
    rows = records.select(key, *order, *[t.fold_search(F.col(c)).alias(f) for c, f in zip(fields, ("hi", "q", "a"))])
    has = lambda v: F.contains("hi", F.lit(v)) | F.contains("q", F.lit(v)) | F.contains("a", F.lit(v))
    forms = [expand(x) for x in terms]
    flat = list(dict.fromkeys(f for own in forms for f in own))
    count = rows.agg(F.count("*").alias("n"), *[F.count_if(has(f)).alias(f"d{i}") for i, f in enumerate(flat)]).first()
    n = count["n"]
    df = {f: count[f"d{i}"] for i, f in enumerate(flat)}
    forms = [[own[0]] + [f for f in own[1:] if 0 < df[f] <= max(max(4 * df[own[0]], 0.02 * n), 0.08 * n)] for own in forms]
    any_of = [has(own[0]) if len(own) == 1 else F.greatest(*[has(f) for f in own]) for own in forms]
    if all(len(own) == 1 for own in forms):
        union = [df[own[0]] for own in forms]
    else:
        union = rows.agg(*[F.count_if(a).alias(f"t{i}") for i, a in enumerate(any_of)]).first()
    idf = [math.log(1 + (n - union[i] + 0.5) / (union[i] + 0.5)) for i in range(len(terms))]
    total = sum(idf) or 1.0
    need = len(terms) if len(terms) <= 2 else math.ceil(0.7 * len(terms))
    candidates = rows.where(sum((a.cast("int") for a in any_of), F.lit(0)) >= need)
    scorer = Scorer(forms, idf)

    def run(batches):
        for b in batches:
            s = [scorer.score(*x) for x in zip(b["hi"], b["q"], b["a"])]
            out = {key: b[key], "score": s, "pct": [max(1, int(100 * (1 - math.exp(-v / SCALE)) + 0.5)) for v in s]}
            yield pd.DataFrame(out | {c: b[c] for c in order})

    kind = empty + "".join(f", `{c}` {records.schema[c].dataType.simpleString()}" for c in order)
    scored = candidates.mapInPandas(run, kind).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), *order, key).select(key, "score", "pct")


def similar_by_words(records: DataFrame, key: str, words: Column, category: Column, seed, k: int = 6) -> DataFrame:
    """The k records that share the most telling words with the seed: sum of ln(N / df) over the square root of the bag,
    1.35 times that in the seed's category, with pct relative to the best (8 at least)."""
    bags = records.select(key, category.alias("cat"), F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)).alias("bag"))
    seed_row = bags.where(F.col(key) == seed)
    n = bags.agg(F.count("*").alias("n"))
    pairs = bags.select(key, "cat", F.size("bag").alias("size"), F.explode("bag").alias("word"))
    own = seed_row.select(F.explode("bag").alias("word"))
    shared = pairs.join(F.broadcast(own), "word")  # a seed's own words: one record's bag
    df = shared.groupBy("word").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where("df <= 0.2 * n").select("word", F.ln(F.col("n") / F.col("df")).alias("w"))
    summed = shared.where(F.col(key) != seed).join(df, "word").groupBy(key, "cat", "size").agg(F.sum("w").alias("w"))
    same = (F.col("cat") == F.col("seed_cat")) & (F.coalesce("cat", F.lit("")) != "")
    scored = summed.crossJoin(F.broadcast(seed_row.select(F.col("cat").alias("seed_cat")))).select(key, F.round(F.col("w") / F.sqrt("size") * F.when(same, 1.35).otherwise(1.0), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("pct", F.greatest(F.lit(8), F.round(100 * F.col("score") / F.max("score").over(Window.partitionBy())).cast("int")))
