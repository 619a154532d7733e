"""Main text of web pages by composite text density.

The page becomes a tree. Every node has its characters, tags, link characters and link tags; its composite
density is characters per tag, discounted for links. The node with the largest sum of child densities is
the heart of the text, the smallest density on its path to the body is the threshold, and each part of
the page that reaches the threshold gives its own maximum-sum subtree. Navigation, scripts and hidden
parts never count, nor do parts that call themselves adverts or comments. Forms, asides and parts that call themselves notices or
sidebars do only where they hold most of the page's text, and a part whose name only begins like one of these also where little of
it is links: there the density decides.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossbook.llm.text import only, slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr object q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br img math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
                     "menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table tbody thead tfoot select body html".split())
DROPPED = frozenset("nav footer button select dialog menu input head annotation".split())
LIKELY = frozenset("form aside fieldset".split())                    # out unless they hold most of the page's text
# Words by which parts of a page that are not its text are called in class, id and role.
CALLED = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
                   "popup modal overlay sidebar aside side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social "
                   "related recommended comment comments commentlist disqus replies respond newsletter subscribe signup login search searchbox form pagination pager "
                   "widget skip complementary contentinfo dialog hidden".split())
# Those that say whose text it is; such a part stays out however much of the page it holds.
FIRM = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr comment comments "
                 "commentlist disqus replies respond newsletter".split())
# Words that make a name a likely one whatever follows, and words that say nothing beside a called one.
PREFIXES = frozenset("ad ads advert advertisement banner cookie gdpr sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments disqus newsletter "
                     "widget related popup modal sponsored promo footer pagination".split())
PARTS = frozenset("site page main global top bottom left right primary secondary js bar box button buttons link links list item items container wrapper wrap block "
                  "section area panel inner outer holder icon icons title".split())
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_SKIP, _ATTR, _EQUAL, _VALUE = (re.compile(p) for p in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
OUT, FIRMLY, NAMED, MAYBE = "out", "firmly", "named", "maybe"
LINKED = 1 / 3                       # share of link text from which a part that only may be called something is taken for it


class Node:
    """`why` says what speaks against a part: OUT and FIRMLY always drop it, NAMED and MAYBE are looked at in `_release`."""

    __slots__ = ("tag", "parent", "kids", "drop", "why", "chars", "tags", "link_chars", "link_tags", "density", "sum", "marked", "under")

    def __init__(self, tag: str, parent: Node | None, why: str = ""):
        self.tag, self.parent, self.why, self.drop, self.kids = tag, parent, why, bool(why), []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.marked = self.under = False


def _verdict(tag: str, attrs: dict[str, str], inside_article: bool) -> str:
    """What speaks against a part, by its element and by the names in class, id and role.

    A name whose words all are known names of parts that are not text counts firmly or as named; one that only begins with such a
    word may be anything.
    """
    if tag in DROPPED or tag == "header" and not inside_article:
        return OUT
    if not attrs or tag in ("body", "html", "article", "main"):
        return NAMED if tag in LIKELY else ""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _NONE.search(attrs.get("style", "")):
        return OUT
    out = NAMED if tag in LIKELY else ""
    for name in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in CALLED for w in words) and all(w in CALLED or w in PARTS for w in words):
            if any(w in FIRM for w in words):
                return FIRMLY
            out = NAMED
        elif words and words[0] in PREFIXES and not out:
            out = NAMED if words[0] in FIRM else MAYBE
    return out


def _release(root: Node) -> None:
    """Let named parts count where they hold more than half of the page's text, and parts that may be named also where little of
    their text is links."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.why not in (OUT, FIRMLY):
            nodes.append(n)
            todo += [k for k in n.kids if isinstance(k, Node)]
    if not any(n.why for n in nodes):
        return
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    for n in reversed(nodes):
        chars[id(n)] = sum(len(k.strip()) if isinstance(k, str) else chars.get(id(k), 0) for k in n.kids)
        links[id(n)] = chars[id(n)] if n.tag == "a" else sum(links.get(id(k), 0) for k in n.kids if isinstance(k, Node))
    for n in nodes:
        if n.why and (2 * chars[id(n)] > chars[id(root)] or n.why == MAYBE and links[id(n)] < LINKED * chars[id(n)]):
            n.drop = False


def _attributes(page: str, at: int, gone: dict[str, int]) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag from `at` on, whether it closes itself, and the place after it.

    A quote without a second one is an ordinary sign; `gone` remembers from where on a quote does not come again.
    """
    attrs: dict[str, str] = {}
    while True:
        skipped = _SKIP.match(page, at)
        at = skipped.end()
        if at >= len(page):
            return attrs, False, at
        if page[at] == ">":
            return attrs, skipped.group().endswith("/"), at + 1
        name = _ATTR.match(page, at)
        at = name.end()
        equal = _EQUAL.match(page, at)
        if not equal:
            attrs.setdefault(name.group().lower(), "")
            continue
        at = equal.end()
        quote = page[at:at + 1]
        if quote in ('"', "'") and at < gone.get(quote, len(page)):
            end = page.find(quote, at + 1)
            if end >= 0:
                attrs.setdefault(name.group().lower(), page[at + 1:end])
                at = end + 1
                continue
            gone[quote] = at
        value = _VALUE.match(page, at)
        attrs.setdefault(name.group().lower(), value.group())
        at = value.end()


def parse(page: str) -> Node:
    """A tree whose kids are nodes and pieces of text; closing tags that are missing are supplied. One pass over the page."""
    root = Node("html", None)
    here, at, articles = root, 0, 0
    opened: Counter[str] = Counter({"html": 1})
    gone: dict[str, int] = {}
    start = page.find("<")
    while start >= 0:
        m = _TAG.match(page, start)
        if not m:
            start = page.find("<", start + 1)
            continue
        if start > at:
            here.kids.append(page[at:start])
        if not m[2]:
            end = page.find("-->" if m.group() == "<!--" else ">", m.end())
            at = len(page) if end < 0 else end + (3 if m.group() == "<!--" else 1)
            start = page.find("<", at)
            continue
        tag = m[2].lower()
        attrs, closed, at = _attributes(page, m.end(), gone)
        if m[1]:
            up = here if opened[tag] else None
            while up and up.tag != tag and not (up.tag in FENCE and tag in INLINE):
                up = up.parent
            if up and up.tag == tag and up.parent:
                while here is not up.parent:
                    articles -= here.tag == "article"
                    opened[here.tag] -= 1
                    here = here.parent
            elif tag == "br":
                here.kids.append(" ")
        elif tag in RAW or tag == "xmp":
            if not closed:
                end = _END[tag].search(page, at)
                if tag == "xmp":
                    here.kids.append(Node("pre", here))
                    here.kids[-1].kids.append(entities.escape(page[at:end.start() if end else len(page)]))
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else len(page)
        else:
            closing = {"p"} if tag in CLOSES_P else SAME.get(tag, ())
            if closing:
                up = here
                while up and up.tag not in closing and up.tag not in FENCE and (up.tag in INLINE or up.tag in ("p", "td", "th")):
                    up = up.parent
                if up and up.tag in closing and up.parent:
                    while here is not up.parent:
                        opened[here.tag] -= 1
                        here = here.parent
            if tag not in ("html", "body") or not opened[tag]:
                node = Node(tag, here, _verdict(tag, attrs, articles > 0))
                here.kids.append(node)
                if tag not in VOID and not closed or tag in ("a", "p", "div", "span"):
                    here = node
                    opened[tag] += 1
                    articles += tag == "article"
        start = page.find("<", at)
    if at < len(page):
        here.kids.append(page[at:])
    return root


_END = {tag: re.compile(rf"</{tag}[\s>/]", re.I) for tag in (*RAW, "xmp")}


def _path(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _order(root: Node) -> list[Node]:
    """All nodes that count, parents before their children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.drop:
            out.append(n)
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums; the nodes in page order."""
    nodes = _order(root)
    for n in reversed(nodes):
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(k.strip())
            elif not k.drop:
                n.chars += k.chars
                n.tags += k.tags + (k.tag not in VOID)
                n.link_chars += k.chars if k.tag == "a" else k.link_chars
                n.link_tags += (1 if k.tag == "a" else 0) + k.link_tags
    whole = max((n for n in nodes if n.tag == "body"), key=lambda n: n.chars, default=root)
    ratio = whole.link_chars / whole.chars if whole.chars else 0.0
    for n in nodes:
        if not n.chars:
            continue
        plain = max(n.chars - n.link_chars, 1)
        per_tag = n.chars / max(n.tags, 1)
        base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
        n.density = per_tag * max(0.0, math.log(max(n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1), 1.0), max(base, 1.0001)))
    for n in nodes:
        kids = [k.density for k in n.kids if isinstance(k, Node) and not k.drop]
        n.sum = sum(kids) if kids else n.density
    return nodes


def _text(node: Node, blocks: list[str]) -> None:
    """Append the blocks below a node that counts, in page order."""
    piece: list[str] = []

    def flush() -> None:
        line = " ".join(entities.unescape("".join(piece)).split())
        if line:
            blocks.append(line)
        piece.clear()

    todo: list = [node]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            piece.append(k)
        elif k.drop:
            if k.tag not in INLINE:
                flush()
        elif k.tag == "br":
            piece.append(" ")
        elif k.tag in INLINE:
            todo += reversed(k.kids)
        else:
            flush()
            todo.append(None)
            todo += reversed(k.kids)
    flush()


def extract(page: str | None) -> str:
    """The main text: blocks joined by line feeds; empty for a null page or one without text."""
    if not page:
        return ""
    root = parse(page)
    _release(root)
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    ordered = _order(body)
    inside = [n for n in ordered if n.chars and n.tag not in INLINE]
    if not inside:
        return ""
    heart = max(inside, key=lambda n: n.sum)
    threshold = min(n.density for n in _path(heart) if n is body or n.parent)
    top: dict[int, Node] = {}
    for n in reversed(inside):                       # children first: the maximum-sum node of every subtree
        best = n
        for k in n.kids:
            if isinstance(k, Node) and id(k) in top and top[id(k)].sum > best.sum:
                best = top[id(k)]
        top[id(n)] = best
    for n in ordered:                                # parents first: `under` tells that a marked node is above or here
        n.under = n.marked or n is not body and n.parent.under
        if id(n) in top and n.density >= threshold and not n.under:
            top[id(n)].marked = True
            n.under = n.marked
    blocks: list[str] = []
    for n in ordered:
        above = n is not body and n.parent.under
        n.under = above or n.marked
        if n.marked and not above:
            _text(n, blocks)
    return "\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html, ...).

    A null or empty page, and one without text, give an empty text. Repeated rows give one row each.
    Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
