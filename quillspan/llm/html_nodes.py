"""A small, tolerant HTML tree and the features of its nodes."""

from __future__ import annotations

import bisect
import html
import math
import re

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|select|canvas)(?=[\s/>])([^>]*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements left out up to their end tag. The first two hold raw text, to the end of the page without one, as in browsers;
#: the others are ordinary nodes if they are empty (/>), never end or hold a start tag of their kind.
_CODE = {t: re.compile(rf"<(/){t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style")}
_ENDS = _CODE | {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in "noscript template iframe textarea select canvas".split()}
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Left out where they show no text.
_DRAWN = frozenset(("svg", "object"))
#: Tags without a node: a formula belongs to the text around it and is judged with it.
_MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mmultiscripts mstyle mpadded menclose mfenced semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr object svg g defs symbol use path circle ellipse line polygon polyline rect tspan".split())
HIDDEN = frozenset("head title button option input".split())
#: What a start tag ends when it is open: its own kind of item, up to the list or table it is in.
_CLOSES = {t: ({"p"}, frozenset()) for t in "address article aside blockquote center details div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_CLOSES |= {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements of which a bare one around a single other element says nothing of its own.
_PLAIN = frozenset("div span section center body html".split())
_ITEMS = frozenset("li td th dt dd".split())
_SCOPE = frozenset("table td th caption button body html".split())

KINDS = [
    ("article", "article main"), ("section", "section"), ("div", "div center"), ("p", "p pre blockquote"), ("heading", "h1 h2 h3 h4 h5 h6"), ("list", "ul ol dl menu"), ("item", "li dt dd"),
    ("nav", "nav"), ("header", "header hgroup"), ("footer", "footer address"), ("aside", "aside"), ("form", "form fieldset label legend"), ("table", "table tbody thead tfoot tr"), ("cell", "td th caption"),
    ("link", "a"), ("inline", "b strong i em span small font mark code time"), ("figure", "figure figcaption"), ("body", "html body"), ("text", "#text"),
]
_KIND = {t: i for i, (_, tags) in enumerate(KINDS) for t in tags.split()}
#: Words in class, id, role and itemprop attributes, by what they tell.
TOKENS = [
    ("body", "article content main post entry story body text articlebody blog page prose copy"),
    ("navigation", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc links sitemap tabs skip"),
    ("edge", "header masthead topbar top banner footer foot bottom copyright colophon legal"),
    ("side", "sidebar aside side rail widget related recommended recommendations more trending popular tags promo teaser"),
    ("advert", "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promoted adsense dfp taboola outbrain"),
    ("notice", "cookie cookies consent gdpr notice alert modal popup overlay toast paywall subscribe subscription newsletter signup banner"),
    ("talk", "comment comments commentlist reply replies discussion disqus respond reviews thread"),
    ("share", "share sharing social follow author byline meta login search form widget print"),
]
_GROUP: dict[str, list[int]] = {}
for _i, (_, _ws) in enumerate(TOKENS):
    for _w in _ws.split():
        _GROUP.setdefault(_w, []).append(_i)

NAMES = [*[f"is_{k}" for k, _ in KINDS], *[f"own_{k}" for k, _ in TOKENS], *[f"above_{k}" for k, _ in TOKENS], "depth", "children", "place", "siblings", "log_text", "page_share", "parent_share", "link_share", "tags_per_char", "paragraphs", "stops", "word_length", "items", "above_nav", "above_edge", "above_aside", "above_form", "above_article", "sibling_p", "longest_sibling"]


class Node:
    __slots__ = ("above", "alone", "among", "beyond", "children", "depth", "groups", "items", "kind", "length", "link", "paragraphs", "parent", "stops", "tag", "tags", "text", "words", "wraps")

    def __init__(self, tag: str, parent: Node | None, groups=()):
        self.tag, self.parent, self.groups, self.children = tag, parent, groups, []
        self.kind = _KIND.get(tag, -1)
        self.text = None


def _groups(attributes: str) -> tuple[int, ...]:
    found: set[int] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()):
            found.update(_GROUP.get(w, ()))
    return tuple(found)


class _Open:
    """The open elements, and where those of each tag are among them, so that no tag walks its ancestors: what it ends is found by its
    place, and every element is left once."""

    def __init__(self):
        self.root = Node("#root", None)
        self.nodes: list[Node] = [self.root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> Node:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        return node

    def _leave(self, place: int) -> Node:
        """Ends the element there and all inside it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()
        return self.nodes[-1]

    def _last(self, tags) -> int:
        """The place of the innermost open element of these tags, 0 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def end(self, tag: str) -> Node:
        """An end tag ends the innermost element of its kind, but not across the edge of a table, cell or button."""
        here = self._last((tag,))
        return self._leave(here) if here > (0 if tag in _SCOPE else self._last(_SCOPE)) else self.nodes[-1]

    def close(self, tag: str) -> Node:
        """What a start tag ends: an item the innermost of its kind or else the outermost paragraph, others the outermost of what
        they end; nothing across the list or table that they are in."""
        ends, stop = _CLOSES[tag]
        edge = self._last(stop | (_SCOPE - ends))
        if tag in _ITEMS and (own := self._last(ends - {"p"})) > edge:
            return self._leave(own)
        first = [p[i] for t in ends if (p := self.places.get(t)) and (i := bisect.bisect_right(p, edge)) < len(p)]
        return self._leave(min(first)) if first else self.nodes[-1]


def parse(page: str) -> Node:
    """The tree of a page; text nodes have the tag #text and their raw text. Comments and the elements of _ENDS are left out."""
    open_ = _Open()
    root = now = open_.root
    at = 0
    unended: set[str] = set()
    drawn = formula = False
    edge = page.rfind(">") + 1  # behind it no tag ends, and a comment would be open
    if (opened := page.rfind("<!--")) >= 0 and page.find("-->", opened) < 0:
        edge = len(page)
    while m := _TOKEN.search(page, at, max(at, edge)):
        if m.start() > at:
            _put(now, page[at : m.start()], formula)
        at, formula = m.end(), False
        if m[1]:
            tag, attributes = m[1].lower(), m[2]
            if tag in _CODE or (tag not in unended and not attributes.rstrip().endswith("/")):
                end = _ENDS[tag].search(page, at)
                if tag in _CODE or (end and end[1]):
                    at = end.end() if end else len(page)
                    continue
                if not end:
                    unended.add(tag)
        elif m[4]:
            tag, attributes = m[4].lower(), m[5]
            if tag in _MATH:
                formula = True
                continue
        else:
            continue
        if m[3]:
            now = open_.end(tag)
            continue
        if tag in _CLOSES:
            now = open_.close(tag)
        node = Node(tag, now, _groups(attributes) if attributes else ())
        now.children.append(node)
        drawn = drawn or tag in _DRAWN
        if tag not in VOID and not (attributes or "").rstrip().endswith("/"):
            now = open_.push(node)
    if at < len(page):
        _put(now, page[at:], formula)
    if drawn:
        _prune(root)
    return root


def _prune(root: Node) -> None:
    nodes = ordered(root)
    says: set[int] = set()
    for n in reversed(nodes):
        if n.parent is not None and (n.tag == "#text" or (id(n) in says and n.tag not in HIDDEN)):
            says.add(id(n.parent))
    for n in nodes:
        n.children = [c for c in n.children if c.tag not in _DRAWN or id(c) in says]


def _put(parent: Node, text: str, join: bool) -> None:
    if join and parent.children and parent.children[-1].tag == "#text":
        parent.children[-1].text += html.unescape(text)
    elif text.strip():
        node = Node("#text", parent)
        node.text = html.unescape(text)
        parent.children.append(node)
    elif parent.children and parent.children[-1].tag == "#text":
        parent.children[-1].text += " "
    else:  # white space between inline elements still parts words
        node = Node("#space", parent)
        node.text = " "
        parent.children.append(node)


def ordered(root: Node) -> list[Node]:
    """All nodes but white space, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in reversed(n.children) if c.tag != "#space")
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row of NAMES for every node of ordered()."""
    for n in reversed(nodes):
        if n.tag == "#text":
            n.length, n.words, n.stops, n.tags, n.paragraphs, n.items = len(n.text.strip()), n.text.count(" ") + 1, sum(map(n.text.count, ".!?")), 0, 0, 0
            n.link = 0
        else:
            n.length = n.words = n.stops = n.link = n.paragraphs = n.items = 0
            n.tags = 1
            for c in n.children:
                if c.tag == "#space":
                    continue
                n.length += c.length
                n.words += c.words
                n.stops += c.stops
                n.tags += c.tags
                n.link += c.link
                n.paragraphs += c.paragraphs
                n.items += c.items
            if n.tag == "a":
                n.link = n.length
            n.paragraphs += n.tag == "p"
            n.items += n.tag == "li"
    total = max(1, nodes[0].length)
    own_groups, above_groups, numbers = [], [], []
    for n in nodes:
        p = n.parent
        own = [c for c in n.children if c.tag != "#space"]
        n.wraps = len(own) == 1 and own[0].tag != "#text" and n.tag in _PLAIN and not n.groups
        mask = 0
        for g in n.groups:
            mask |= 1 << g
        size, length = n.length, max(1, n.length)
        if p is None:
            n.above, n.alone, n.depth, n.beyond = (0, 0, 0, 0, 0), False, 0, 0
            numbers.append((0.0,) * 20)
        else:
            a, t = p.above, p.tag
            n.above = (a[0] or t == "nav", a[1] or t in ("header", "footer"), a[2] or t == "aside", a[3] or t == "form", a[4] or t in ("article", "main"))
            n.depth = p.depth + (not p.wraps)
            place, siblings, paragraphs, longest = n.among
            numbers.append((n.depth, len(n.children), place, siblings, math.log1p(size), size / total, size / max(1, p.length), n.link / length, n.tags / length, n.paragraphs, n.stops, size / max(1, n.words), n.items, *n.above, paragraphs, longest))
        own_groups.append(mask)
        above_groups.append(n.beyond)
        if own:
            last, paragraphs, longest = max(1, len(own) - 1), sum(c.tag == "p" for c in own), math.log1p(max(c.length for c in own))
            for k, c in enumerate(own):
                c.alone, c.among, c.beyond = len(own) == 1, (k / last, len(own), paragraphs, longest), n.beyond | mask
    kind = np.array([n.kind for n in nodes])[:, None] == np.arange(len(KINDS))
    bits = 1 << np.arange(len(TOKENS))
    return np.concatenate((kind, np.array(own_groups)[:, None] & bits > 0, np.array(above_groups)[:, None] & bits > 0, np.array(numbers)), axis=1, dtype=np.float32)
