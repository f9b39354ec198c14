"""Main text of web pages by composite text density.

A page is read into its element tree.  The density of an element is its characters per
tag, adjusted by the share of characters and tags in links; marks inside a block (``b``,
``i``, ``br``) don't split text, so they aren't counted as tags.  An element's density
sum adds up the densities of its children and of its own text.  Text in elements that
name themselves as something else (menus, headers, footers, asides, adverts, notices,
reader comments: by element, class, id or role) weighs nothing in both, unless the page
has no other text; scripts, styles, forms and the like are no text at all.

The element with the largest density sum is the text's subtree.  Where one of its
children has at least half of its own sum, the child is, so that a wrapper around a short
article doesn't win by what stands beside the article.  The smallest density on the path
from the subtree to the body is the threshold.  Inside the subtree, lists of links and
named parts below the threshold go and all else stays.  Beside the path, headings before
the subtree belong to the text, and what reaches the threshold and is a paragraph, list
or table, or a part of several blocks with a density sum near the subtree's.  An article or main part around the
subtree takes its place.

Pages are independent: one pass, no shuffle, each task holds one page at a time.

Defined results: a null or empty page has an empty text.  Markup that never ends goes
to the end of the page.  A page without any element is one block of text.  Character
references are decoded in each run of text between two tags.  White space is what
``str.split`` takes for it, no-break spaces included.  Repeated rows each get a result.
``extract_pages`` gives its own columns only, so no column can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*))(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

# Element names of HTML and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Blocks before which an open paragraph ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end an open element of the same kind, up to the list or table around it.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
DROPPED = frozenset("head form script style noscript template iframe object svg math canvas button select input textarea dialog title".split())
NAMED = frozenset("nav header footer aside menu".split())
#: Elements that hold text of their own, as opposed to parts of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl blockquote pre table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
MAIN = frozenset("article main".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget complementary contentinfo".split()
)
#: A child with this share of the largest sum takes its place; parts beside it count from this share on; links of a list of links.
NEAR, PART, LINKS = 0.5, 0.3, 3


def is_part(attrs: str) -> bool:
    """True if a class, id or role names a part of the page that isn't its text."""
    for m in _ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = re.split(r"[-_]+", name)
            if words[0] not in ("has", "no", "with", "is") and (words[0] in PARTS or words[-1] in PARTS):
                return True
    return False


class Tree:
    """Elements in page order; the first is the page.  A parent stands before its children."""

    def __init__(self, html: str):
        self.tag, self.parent, self.drop, self.named, self.pieces = ["#page"], [0], [False], [False], []
        stack, at, n = [0], 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            end = m.start() if m else n
            if end > at:
                self.pieces.append((stack[-1], unescape(html[at:end])))
            if not m:
                break
            at = m.end()
            name = (m["tag"] or m["tag2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        del stack[k:]
                        self.pieces.append((stack[-1], None if name not in INLINE else ""))
                        break
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            self._close_before(stack, name)
            if name in ("html", "body") and name in self.tag:
                continue
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            # Articles that hold the text may have any class, but not those inside another one.
            whole = name in ("html", "body") or (name in MAIN and not any(self.tag[k] in MAIN for k in stack))
            self.drop.append(self.drop[stack[-1]] or name in DROPPED)
            self.named.append(self.named[stack[-1]] or (not whole and (name in NAMED or is_part(attrs))))
            if name not in INLINE:
                self.pieces.append((node, None))
            if name in RAW:
                shut = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(html, at)
                at = shut.end() if shut else n
            elif name not in VOID and not attrs.endswith("/"):
                stack.append(node)

    def _close_before(self, stack: list[int], name: str) -> None:
        if name == "body":
            del stack[1 + (len(stack) > 1 and self.tag[stack[1]] == "html") :]
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "p":
                    del stack[k:]
                    break
                if self.tag[stack[k]] not in INLINE:
                    break
        if name in SIBLINGS:
            ended, around = SIBLINGS[name]
            last = None
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in around:
                    break
                if self.tag[stack[k]] in ended.split():
                    last = k
            if last:
                del stack[last:]


def _density(c: float, t: int, lc: float, lt: int, share: float) -> float:
    """Characters per tag, times the logarithm of characters and tags to those in links; its base grows with both."""
    if not c:
        return 0.0
    lt = max(1, lt)
    base = log(c * lc / max(1, c - lc) + share * c + e)
    weight = log(c / max(1, lc) * t / lt)
    return c / t * max(0.0, weight / log(base) if base > e else weight + 1)


class Sums:
    """Characters, tags and links of every element, what lies in it included."""

    def __init__(self, tree: Tree, names: bool):
        n = len(tree.tag)
        self.chars, self.tags, self.link_chars, self.link_tags, self.own, self.own_links, self.blocks = ([0] * n for _ in range(7))
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = tree.tag[k] == "a" or in_link[tree.parent[k]]
        for node, text in tree.pieces:
            if text and not tree.drop[node] and not (names and tree.named[node]):
                size = len("".join(text.split()))
                self.own[node] += size
                if in_link[node]:
                    self.own_links[node] += size
        self.chars, self.link_chars = self.own.copy(), self.own_links.copy()
        for k in range(n - 1, 0, -1):
            if not tree.drop[k]:
                p, link = tree.parent[k], tree.tag[k] == "a"
                self.chars[p] += self.chars[k]
                self.link_chars[p] += self.link_chars[k]
                self.tags[p] += self.tags[k] + (link or tree.tag[k] not in INLINE)
                self.link_tags[p] += self.link_tags[k] + link
                self.blocks[p] += bool(self.chars[k]) and tree.tag[k] not in INLINE
        self.share = self.link_chars[0] / max(1, self.chars[0])


def densities(tree: Tree, sums: Sums) -> tuple[list[float], list[float]]:
    """Composite text density and density sum of every element; 0 for elements without text that counts."""
    n = len(tree.tag)
    density = [_density(sums.chars[k], max(1, sums.tags[k]), sums.link_chars[k], sums.link_tags[k], sums.share) for k in range(n)]
    total = [_density(sums.own[k], 1, sums.own_links[k], 1, sums.share) for k in range(n)]
    for k in range(1, n):
        total[tree.parent[k]] += density[k]
    return density, total


def selected(tree: Tree) -> list[bool]:
    """Whether each element belongs to the text."""
    n = len(tree.tag)
    sums = Sums(tree, True)
    if not sums.chars[0]:
        sums = Sums(tree, False)
    density, total = densities(tree, sums)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[tree.parent[k]].append(k)
    best = max(range(n), key=lambda k: (total[k], -k))
    while (inner := max(children[best], key=lambda k: (total[k], -k), default=None)) is not None and total[inner] >= NEAR * total[best] > 0 and sums.blocks[inner] + bool(sums.own[inner]) > 1:
        best = inner
    path = [best]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    threshold = min((density[k] for k in path if density[k] > 0), default=0.0)
    whole = next((k for k in reversed(path) if tree.tag[k] in MAIN), None)
    top = best if whole is None else whole

    def beside(k: int) -> bool:
        rich = sums.blocks[k] > 1 and total[k] >= PART * total[best]
        return bool(sums.chars[k]) and (tree.tag[k] in HEADINGS and k < best or density[k] >= threshold and (tree.tag[k] in TEXTUAL or rich))

    def links(k: int) -> bool:
        return tree.tag[k] not in INLINE and sums.link_tags[k] >= LINKS and 2 * sums.link_chars[k] > sums.chars[k]

    on_path = set(path[1:])
    keep = [False] * n
    for k in range(n):
        up = k > 0 and keep[tree.parent[k]]
        chosen = up or k == top or (whole is None and k not in on_path and tree.parent[k] in on_path and beside(k))
        below = density[k] < threshold and (tree.named[k] or links(k))
        keep[k] = chosen and not tree.drop[k] and (k == top or not below)
    return keep


def extract(html: str | None) -> str:
    """The main text: blocks in page order, white space as one space."""
    if not html:
        return ""
    tree = Tree(html)
    keep = selected(tree)
    return " ".join("".join(" " if text is None else text for node, text in tree.pieces if keep[node]).split())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "html"] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[c for c in batch.schema.names if c != "html"] + ["text", "n_chars"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
