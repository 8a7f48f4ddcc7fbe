"""Main text of HTML pages by composite text density.

A page becomes a DOM; script, navigation, form and advert subtrees are cut. Every remaining node
gets its composite text density (characters per tag, adjusted by its share of link text), every
parent the sum of its children's densities. The node of the largest sum is the article's core; the
smallest density on its path to the body is the threshold above which the neighbours of that path
belong to the article as well.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Tags whose subtree is never article text.
CUT = frozenset("script style noscript template head title nav footer aside form button select option textarea input label fieldset iframe object embed svg canvas audio video map menu dialog xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of a class, id or role that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
BESIDE = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer contentinfo sidebar aside complementary "
    "cookie cookies consent gdpr notice notices newsletter popup modal paywall ad ads adv advert adverts advertisement advertising adsense "
    "sponsor sponsors sponsored promo promoted banner banners searchbox login signup comment comments disqus replies reviews feedback disclaimer disclaimers".split()
)
#: Words of what is article text only if it is as dense as the article.
DOUBTFUL = frozenset("share sharing social related recommended recommendations widget widgets tags toc subscribe subscription alert alerts overlay dialog search respond reply discussion rail".split())
#: Words that show a container of the article itself, unless one of its words is in ``SURELY``.
ARTICLE = frozenset("article articlebody content main post entry story body".split())
SURELY = frozenset("comment comments ad ads advert adverts sponsored sidebar footer nav menu cookie newsletter banner promo notice".split())
#: What else names written as one word are put together of.
FILLERS = frozenset("area bar block body box by button col column container content feed form global google head holder inner item items left link links list main outer page panel post article entry story primary right row secondary section side site slot sub text thread title top bottom unit wrap wrapper zone".split())
#: Start tags that end an open element of the same group (fixed by the HTML standard).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd center".split())

#: A bit for each kind of implied end, and one for the row of a cell.
KINDS = {x: 1 << i for i, x in enumerate(("p", "row", *CLOSES))}
#: End tags of raw text, in either case.
RAW_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])", re.IGNORECASE | re.ASCII) for x in RAW}

#: Elements that an implied end does not cross.
SCOPES = frozenset("body html article section div td th blockquote main".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: One attribute after the other, so that what stands within a value is never taken for a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+|"[^"]*+"|'[^']*+'|\S""")
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDING = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "within", "chars", "tags", "link_chars", "link_tags", "density", "total", "order", "linked", "chosen", "own_chosen", "doubtful", "without")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.items, self.cut = tag, parent, [], cut
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))  # an article or main
        self.chars = self.tags = self.link_chars = self.link_tags = self.order = 0
        self.density = self.total = 0.0
        self.doubtful = False
        self.without = 0  # bits of ``KINDS``: no such implied end from here on upwards
        self.linked = self.chosen = self.own_chosen = False  # in a link; the subtree is article text, or the node's own text


def attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag; the first of equal names counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        if m[1]:
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


PARTS = BESIDE | DOUBTFUL | FILLERS | {"header"}
LONGEST = max(map(len, PARTS))


def _compound(word: str) -> set[str]:
    """What a name written as one word says of its block: ``siteheader`` is a header, ``commentary`` nothing.

    The word must be made of ``PARTS`` from end to end, the last part as long as possible; a header of an article is its own.
    """
    last = [0] * (len(word) + 1)  # length of the last part of each prefix that is made of parts
    for end in range(2, len(word) + 1):
        for a in range(max(0, end - LONGEST), end - 1):
            if (a == 0 or last[a]) and word[a:end] in PARTS:
                last[end] = end - a
                break
    if not last[-1]:
        return set()
    found, end = set(), len(word)
    while end:
        found.add(word[end - last[end] : end])
        end -= last[end]
    says = found - FILLERS
    if "header" in found and found & {"site", "global"}:
        return says | {"masthead"}  # the site's header wherever it stands
    return says - {"header"} if found & ARTICLE else says


_short_compound = lru_cache(100_000)(_compound)


def _judged(tag: str, source: str, within: bool) -> tuple[bool, bool]:
    """Whether a start tag opens a subtree that lies beside the article, or may do so; ``within`` an article a header is its own."""
    if tag in CUT or tag == "header" and not within:
        return True, False
    if not source or tag in ("html", "body"):
        return False, False
    named = attributes(source)
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or HIDING.search(named.get("style", "")):
        return True, False
    words: set[str] = set()
    for name in ("class", "id", "role"):
        for token in named.get(name, "").split():
            words.update(SPLIT.split(CAMEL.sub("-", token).lower()), (token.lower(),))
    for w in words - BESIDE - DOUBTFUL - ARTICLE:
        words = words | (_short_compound(w) if len(w) <= 40 else _compound(w))
    if tag in ("article", "main") or words & ARTICLE:
        return bool(words & SURELY), False
    return bool(words & BESIDE) or "header" in words and not within, bool(words & DOUBTFUL)


def parse(page: str) -> Node:
    """DOM of a page: implied ends, void and raw-text elements; a tag cut off by the end of the page is dropped.

    Linear in the page: ``open_`` counts the open elements of each tag, so that no end tag looks
    for an element that is not there, and one that is found is closed. A search for an implied end
    that finds nothing marks the elements it passed, and no later search of its kind passes them again.
    """
    root = at = Node("#root", None)
    open_: Counter = Counter()
    pos, n = 0, len(page)

    def close(node: Node) -> Node:
        """The parent, after the elements down to ``at`` have been closed."""
        x = at
        while x is not node.parent:
            open_[x.tag] -= 1
            x = x.parent
        return node.parent

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            at.items.append(html.unescape(page[pos:]))
            break
        if lt > pos:
            at.items.append(html.unescape(page[pos:lt]))
        c = page[lt + 1 : lt + 2]
        if c in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                if end < 0:  # never closed: the rest of the page is the comment
                    break
                pos = end + 3
            else:
                end = page.find(">", lt)
                pos = end + 1 if end >= 0 else n
            continue
        m = TAG.match(page, lt) or PLAIN_TAG.match(page, lt)
        if not m:
            if c == "/" or c.isalpha() and c.isascii():
                end = page.find(">", lt)
                pos = end + 1 if end >= 0 else n
            else:
                at.items.append("<")
                pos = lt + 1
            continue
        pos, tag = m.end(), m[2].lower()
        if m[1]:
            if open_[tag] and tag not in ("body", "html"):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close(node)
            elif tag == "p":
                at.items.append(Node("p", at))
            continue
        if tag in ENDS_P and open_["p"] or any(open_[x] for x in CLOSES.get(tag, ())):
            stops, group = SCOPE.get(tag, ()), CLOSES.get(tag, frozenset())
            ends_p = tag in ENDS_P
            kind = KINDS[tag if tag in CLOSES else "p"]
            last, node = None, at
            while node is not root and node.tag not in SCOPES and node.tag not in stops and not node.without & kind:
                if node.tag in group or ends_p and node.tag == "p":
                    last = node
                    break
                node = node.parent
            if last is None and node.tag in group and node is not root and not node.without & kind:  # a cell, which bounds what is in it
                last = node
                if tag not in ("td", "th"):
                    while node is not root and node.tag not in stops and node.tag != "tr" and not node.without & KINDS["row"]:
                        node = node.parent
                    if node.tag == "tr":
                        last = node
                    else:
                        x = last
                        while x is not node:
                            x.without |= KINDS["row"]
                            x = x.parent
            if last is None:
                x = at
                while x is not node:
                    x.without |= kind
                    x = x.parent
            if last is not None:
                at = close(last)
        if tag in ("html", "body") and open_[tag]:
            continue
        if tag == "body" and at.tag == "head":
            at = close(at)
        beside, doubtful = _judged(tag, m[3], at.within or at.tag in ("article", "main"))
        node = Node(tag, at, at.cut or beside)
        node.doubtful = doubtful
        at.items.append(node)
        if tag in RAW and not m[3].endswith("/"):
            found = RAW_ENDS[tag].search(page, pos)
            end = found.start() if found else -1
            stop = page.find(">", end) if end >= 0 else -1
            if node.cut is False:
                node.items.append(html.unescape(page[pos : end if end >= 0 else n]))
            pos = stop + 1 if stop >= 0 else n
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
            open_[tag] += 1
    return root


def _nodes(root: Node) -> list[Node]:
    """All uncut nodes, parents before children, in page order; no recursion, as pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.order = len(out)
        out.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.cut]
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters a tag, by the logarithm of how few of them are links.

    C / T * log_b(C / LC * T / LT) with b = ln(C / NLC * LC + share * C + e), where NLC are the
    characters outside links and ``share`` is the body's LC / C; counts of none are taken as 1.
    """
    if not chars:
        return 0.0
    tags, outside, link_chars, link_tags = max(tags, 1), max(chars - link_chars, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / outside * link_chars + share * chars + math.e)
    return chars / tags * max(0.0, math.log(chars / link_chars * tags / link_tags)) / math.log(base)


def _measure(nodes: list[Node], body: Node) -> None:
    for node in nodes:
        node.linked = node.tag == "a" or node.parent is not None and node.parent.linked
    for node in reversed(nodes):
        own = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        node.chars += own
        if node.linked:
            node.link_chars += own
        if node is not body:
            p = node.parent
            p.chars += node.chars
            p.link_chars += node.link_chars
            p.tags += node.tags + 1
            p.link_tags += node.link_tags + (node.tag == "a")
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        if node is not body:
            node.parent.total += node.density


def core_of(nodes: list[Node], body: Node) -> Node:
    """The node of the largest sum of its children's densities; of equal ones the longer, then the first."""
    core = max(nodes, key=lambda x: (x.total, x.chars, -x.order))
    if not core.total:
        return body
    while core is not body and core.tag in INLINE:  # the block that an inline node is part of
        core = core.parent
    return core


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, one space between them, white space folded."""
    if not page:
        return ""
    root = parse(page)
    nodes = _nodes(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    if body is not root:
        nodes = _nodes(body)
    _measure(nodes, body)
    core = core_of(nodes, body)
    core.chosen = True
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min((x.density for x in path if x.density > 0), default=0.0)
    for child, parent in zip(path, path[1:], strict=False):  # neighbours of the path that are as dense
        parent.own_chosen = True
        inside = parent.within or parent.tag in ("article", "main")
        for x in parent.items:
            if x is child or not isinstance(x, Node) or x.cut or not x.chars:
                continue
            # Within an article or main only what is mostly links has to be as dense.
            x.chosen = x.density >= threshold or inside and 2 * x.link_chars <= x.chars
    out: list[str] = []
    stack: list = [(body, False, False)]
    while stack:
        x, taken, own = stack.pop()
        if isinstance(x, str):
            if taken or own:
                out.append(x)
            continue
        if x is None or x.cut or x.doubtful and x.density < threshold:
            out.append(" ")
            continue
        taken = taken or x.chosen
        if x.tag not in INLINE:
            out.append(" ")
            stack.append((None, True, True))
        stack += [(y, taken, x.own_chosen) for y in reversed(x.items)]
    return " ".join("".join(out).split())


def extractor_udf():
    @F.pandas_udf("text string, n_chars long")
    def of_pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            texts = [main_text(p) for p in pages.fillna("")]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return of_pages


def extract(pages: DataFrame, *, source: str = "html") -> DataFrame:
    """Append ``text`` and ``n_chars`` (code points) of the article in each page's whole HTML.

    One narrow stage without a shuffle, so an empty table gives an empty one. A null or empty page
    gives an empty text; pages are read whole, in time linear in their length and with no limit to
    how deep they nest. Of subtrees of equal density sums the longer is the article, then the
    first. Repeated rows and null ids each get their result; input columns named ``text`` or
    ``n_chars`` are replaced.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(*kept, extractor_udf()(F.col(f"`{source}`")).alias("__fl_page"))
    return out.select(*kept, "__fl_page.text", "__fl_page.n_chars")
