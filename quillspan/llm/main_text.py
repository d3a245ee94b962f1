"""Main text of HTML pages: gradient-boosted trees over the features of DOM nodes, decoded hierarchically.

Every node gets the odds that its subtree holds main text. Decoding takes the likeliest labelling in which a node with main text has only
ancestors with main text, so an ancestor and its descendants never contradict each other. The text nodes kept are joined by block:
white space inside a block becomes one space, blocks are parted by an empty line.

The trees are trained on the driver from labelled pages built by rule (TRAINING_PAGES of them): articles under many kinds of
containers among menus, headers, footers, sidebars, adverts, notices, forms and reader comments.

Defined cases: null and empty html give the empty text; markup that is never closed ends with the page; repeated rows are
repeated; an empty table gives no rows; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted
from .common import column, prepare, read_table, slices
from .html_nodes import HIDDEN, INLINE, features, ordered, parse

TRAINING_PAGES = 750


# --- labelled pages


class _Maker:
    """Builds one page; main text is marked, so that parsing gives the labels."""

    MARK = "\ue000"

    def __init__(self, r: random.Random):
        self.r = r

    def word(self) -> str:
        r = self.r
        return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "é", "ü"]) for _ in range(r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def prose(self, a: int = 1, b: int = 6) -> str:
        if self.r.random() < 0.06:
            return self.words(1, 3).capitalize() + "."
        return " ".join(self.words(2, 22).capitalize() + self.r.choice([".", ".", "?", "!", "!!", "...", "%%%"]) for _ in range(self.r.randint(a, b)))

    def tag(self, name: str, inner: str, cls: str | None = None) -> str:
        attribute = f' {self.r.choice(["class", "class", "id"])}="{cls}"' if cls else ""
        return f"<{name}{attribute}>{inner}</{name}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 2)}</a>' for _ in range(n)]
        return self.tag("ul", "".join(self.tag("li", i) for i in items)) if self.r.random() < 0.7 else " | ".join(items)

    def boilerplate(self, what: str) -> str:
        r = self.r
        text = lambda: self.prose(1, 3) if r.random() < 0.6 else self.words(2, 9)
        if what == "nav":
            return self.tag(r.choice(["nav", "div", "ul", "header"]), self.links(r.randint(3, 9)), r.choice(["menu", "nav", "navbar", "breadcrumb", "main-menu", "navigation"])) if r.random() < 0.6 else f"<nav>{self.links(r.randint(3, 9))}</nav>"
        if what == "header":
            return self.tag("header", r.choice(["", self.tag("h1", self.words(1, 4)), self.tag("a", self.words(1, 3))]) + self.tag(r.choice(["p", "div", "span"]), text())) if r.random() < 0.6 else self.tag("div", text() + self.links(2), r.choice(["header", "masthead", "site-header", "top-bar", "banner"]))
        if what == "footer":
            inner = f"&copy; {self.words(1, 3)} &middot; {text()}"
            inner = r.choice([inner, self.tag("p", inner), self.links(3) + inner])
            return self.tag("footer", inner) if r.random() < 0.7 else self.tag("div", inner, r.choice(["footer", "site-footer", "copyright", "bottom"]))
        if what == "side":
            inner = self.tag("h3", self.words(1, 3)) + r.choice([self.links(r.randint(2, 7)), self.tag("p", text()), text()])
            return self.tag("aside", inner, r.choice([None, "sidebar", "related"])) if r.random() < 0.5 else self.tag(r.choice(["div", "section"]), inner, r.choice(["sidebar", "side", "related-posts", "widget", "recommended", "promo"]))
        if what == "advert":
            return self.tag(r.choice(["div", "div", "aside", "section", "p", "ins"]), text(), r.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "advertisement", "ad-slot-1"]))
        if what == "notice":
            inner = r.choice([text(), self.tag("p", text()) + "<button>OK</button>"])
            return self.tag(r.choice(["div", "section", "div", "aside"]), inner, r.choice(["cookie-notice", "cookie", "consent", "notice", "alert", "newsletter", "subscribe-box", "gdpr-banner", "popup", "modal"]))
        if what == "form":
            return self.tag("form", self.tag(r.choice(["label", "p", "div"]), text()) + "<input name=q><button>Go</button>", r.choice([None, "search", "login", "signup"]))
        one = lambda: self.tag(r.choice(["div", "li", "article", "p"]), self.tag(r.choice(["b", "span", "p"]), self.word()) + self.tag("p", self.prose(1, 3)), r.choice(["comment", "reply", None]))
        return self.tag(r.choice(["section", "div", "ol", "ul"]), self.tag("h2", self.words(1, 2)) + "".join(one() for _ in range(r.randint(1, 6))), r.choice(["comments", "comment-list", "discussion", "replies", "reader-comments", "disqus"]))

    def article(self, bare: bool = False) -> str:
        r, m = self.r, self.MARK
        mark = lambda s: m + s
        title = self.words(2, 9).capitalize()
        parts = [self.tag("h1", mark(title))] if r.random() < 0.9 else []
        if parts and r.random() < 0.2:
            byline = self.tag(r.choice(["time", "span", "p"]), self.words(1, 3), r.choice([None, "byline", "meta"])) if r.random() < 0.5 else ""
            parts = [self.tag("header", parts[0] + byline)]
        kind, name = r.random(), self.word()
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.72:
                inner = mark(self.prose())
                if r.random() < 0.2:
                    inner += f' <a href="/{self.word()}">{mark(self.words(1, 3))}</a> {mark(self.words(1, 6))}.'
                if r.random() < 0.15:
                    inner = f"<b>{inner}" if r.random() < 0.5 else f"<em>{inner}</em>"
                parts.append(f"<p>{inner}<br>" if r.random() < 0.2 else (self.tag("div", inner, r.choice([None, name])) if kind < 0.25 else self.tag("p", inner)))
            elif k < 0.8:
                parts.append(self.tag(r.choice(["h2", "h3"]), mark(self.words(1, 6))))
            elif k < 0.86:
                parts.append(self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", mark(self.words(2, 12))) for _ in range(r.randint(2, 5)))))
            elif k < 0.9:
                parts.append(self.tag("blockquote", mark(self.prose(1, 2))))
            elif k < 0.94:
                cells = lambda tag, n: self.tag("tr", "".join(self.tag(tag, mark(self.words(1, r.choice([1, 3, 12])))) for _ in range(n)))
                width = r.randint(1, 4)
                parts.append(self.tag("table", cells("th", width) * (r.random() < 0.5) + "".join(cells("td", width) for _ in range(r.randint(1, 5)))))
            else:
                parts.append(self.boilerplate(r.choice(["advert", "advert", "side", "notice", "form"])))
        if len(parts) == 0:
            parts = [f"<p>{mark(self.prose())}</p>"]
        if r.random() < 0.15:
            parts += [self.tag("section", self.tag(r.choice(["h2", "h2", "h3"]), mark(self.words(1, 6))) + "".join(self.tag("p", mark(self.prose())) for _ in range(r.randint(1, 4)))) for _ in range(r.randint(1, 4))]
        if r.random() < 0.1:
            parts.append(self.boilerplate("talk"))
        body = "".join(parts)
        if bare:
            return body
        shape = r.random()
        if shape < 0.5:
            return self.tag("article", body, r.choice([None, None, "post", "article"]))
        if shape < 0.65:
            return self.tag("main", body if r.random() < 0.5 else self.tag("article", body))
        return self.tag(r.choice(["div", "div", "section"]), body, r.choice([self.word(), self.word(), None, "content", "post-body", "entry-content", "article", "main-content", "story", "text", "article-body"]))

    def page(self) -> str:
        r = self.r
        shape = r.random()
        if shape < 0.02:
            return self.MARK + self.prose()
        if shape < 0.06:
            return self.tag(r.choice(["p", "div", "body"]), self.MARK + self.prose())
        if shape < 0.17:  # a heading and what follows it, straight in the body or in boxes that say nothing
            kind = r.choice(["p", "div"])
            one = self.tag(r.choice(["h1", "h1", "h2"]), self.MARK + self.words(2, 9).capitalize())
            one += "".join(self.tag("ul", self.tag("li", self.MARK + self.prose())) if r.random() < 0.05 else self.tag(kind, self.MARK + self.prose(), self.word() if kind == "div" else None) for _ in range(r.randint(1, 8)))
            foot = r.choice(["", "", self.boilerplate("footer"), self.tag("div", "&copy; " + self.words(2, 4))])
            lead = r.choice(["", "", self.boilerplate("nav"), self.tag("div", self.links(2))])
            for _ in range(r.choice([0, 0, 1, 2])):
                one = self.tag(r.choice(["div", "div", "section"]), one, r.choice([None, self.word()]))
            if r.random() < 0.3:
                one = self.tag("div", one + self.boilerplate("side"), r.choice([None, self.word()]))
            return f"<html><body>{lead}{one}{foot}</body></html>"
        before = [self.boilerplate(k) for k in ("nav", "header", "advert", "notice", "side", "form") if r.random() < 0.45]
        after = [self.boilerplate(k) for k in ("talk", "side", "advert", "nav", "notice", "form") if r.random() < 0.35] + ([self.boilerplate("footer")] if r.random() < 0.85 else [])
        r.shuffle(before)
        if shape < 0.23:  # nothing around the text but a little of the page's furniture, or nothing at all
            before, after = before[: r.randint(0, 2)], after[len(after) - r.randint(0, min(1, len(after))) :]
        article = self.article(bare=shape < 0.34)
        if 0.3 < shape < 0.4:
            deep = r.choice([1, 1, 2, 3, 12])
            article = "<div>" * deep + article + "</div>" * deep
        elif 0.23 < shape < 0.27:  # laid out by a table
            rows = [*before, article, *after]
            return "<html><body><table>" + "".join(f"<tr><td>{x}</td></tr>" for x in rows) + "</table></body></html>"
        inner = "".join(before) + article + "".join(after)
        if r.random() < 0.3:
            inner = self.tag("div", inner, r.choice(["page", "wrapper", "container", "layout"]))
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title><script>var t="</p>";</script></head><body>{inner}' + r.choice(["</body></html>", ""])


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 3):
    """(nodes, labels) of pages built by rule; a node's label says whether its subtree holds main text."""
    r = random.Random(seed)
    for _ in range(n):
        nodes = ordered(parse(_Maker(r).page()))
        label = {id(x): False for x in nodes}
        for x in nodes:
            if x.tag == "#text" and _Maker.MARK in x.text:
                x.text = x.text.replace(_Maker.MARK, "")
                y = x
                while y is not None:
                    label[id(y)] = True
                    y = y.parent
        yield nodes, np.array([label[id(x)] for x in nodes])


@functools.cache
def default_model() -> Boosted:
    """The model from the pages built by rule, trained once for each driver process."""
    return train()


def train(pages=None) -> Boosted:
    """The model from labelled pages, an iterable of (nodes, labels)."""
    x, y = zip(*[(features(nodes), labels) for nodes, labels in (pages or labelled_pages())])
    return Boosted.fit(np.concatenate(x), np.concatenate(y).astype(float))


# --- extraction


def decode(nodes, odds: np.ndarray) -> np.ndarray:
    """The likeliest consistent labelling: a node is kept only if its parent is, and the root always is.

    An only child holds main text just where its parent does, so such a chain has one vote, the mean of its nodes'."""
    place = {id(n): i for i, n in enumerate(nodes)}
    top = np.arange(len(nodes))
    for i, n in enumerate(nodes):
        if n.parent is not None and n.alone and n.parent.parent is not None:
            top[i] = top[place[id(n.parent)]]
    mean = np.bincount(top, odds, len(nodes)) / np.maximum(1, np.bincount(top, minlength=len(nodes)))
    yes, no = -np.logaddexp(0, -mean), -np.logaddexp(0, mean)
    yes[top != np.arange(len(nodes))] = no[top != np.arange(len(nodes))] = 0
    # without: the best score of the subtree if its top is left out; within: if it is kept
    within, without = yes.copy(), no.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        without[p] += without[i]
        within[p] += max(within[i], without[i])
    keep = np.zeros(len(nodes), bool)
    for i, n in enumerate(nodes):
        if n.parent is None:
            keep[i] = True
        elif keep[place[id(n.parent)]] and n.tag not in HIDDEN:
            keep[i] = top[i] != i or within[i] > without[i]
    return keep


def assemble(root, nodes, keep: np.ndarray) -> str:
    """Kept text by block, in page order."""
    kept = {id(n) for n, k in zip(nodes, keep) if k}
    blocks: list[list[str]] = [[]]
    todo: list = [root]
    while todo:
        n = todo.pop()
        if n is None:
            blocks.append([])
        elif n.tag == "#text" or n.tag == "#space":
            if n.tag == "#space" or id(n) in kept:
                blocks[-1].append(n.text)
        else:
            if n.tag == "br":
                blocks[-1].append(" ")
            if n is not root and id(n) not in kept:
                if n.tag not in INLINE:
                    blocks.append([])
                continue
            edge = [] if n.tag in INLINE else [None]
            todo.extend(edge + list(reversed(n.children)) + edge)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def extract(pages: list[str], model: Boosted) -> list[str]:
    roots = [parse(p) for p in pages]
    nodes = [ordered(r) for r in roots]
    if not nodes:
        return []
    odds = model.log_odds(np.concatenate([features(n) for n in nodes]))
    at = np.cumsum([0] + [len(n) for n in nodes])
    return [assemble(r, n, decode(n, odds[a:b])) for r, n, a, b in zip(roots, nodes, at[:-1], at[1:])]


def main_texts(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    prepare(spark)
    known = spark.sparkContext.broadcast(model or default_model())

    def run(batches):
        for whole in batches:
            for b in slices(whole, "html"):
                texts = extract([h or "" for h in column(b, "html").to_pylist()], known.value)
                yield pa.RecordBatch.from_arrays([column(b, "k"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["k", "text", "n_chars"])

    rows = pages.select(F.struct("page_id", "url").alias("k"), F.col("html").cast("string").alias("html"))
    kind = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, kind).select("k.page_id", "k.url", "text", "n_chars")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))


QUERIES = {"op5_main_text": op5_main_text}
ORACLE_SQL: dict[str, str] = {}
