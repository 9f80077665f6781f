"""Operator 11: main text of HTML pages by the distribution of text over lines.

Markup is stripped and a page becomes lines, one for each block. A line's length is that of its text outside of links and outside of
what is no content by its element or its name (menus, forms, adverts, comments and the like: `DROPPED`, `ASIDE`). Lengths are summed over
windows of WINDOW lines. The text surges where a window of the page's dense part begins and dives where a window is empty; of all such stretches
the longest one is the main text. What is kept are the lines between surge and dive, and where one
article or container holds that stretch, all of its other lines as well, so short lines at its ends and behind an advert are not lost.

Null and empty pages, and pages without text, give the empty text. Pages that end in the middle of a tag, a comment or an
element count as closed there. Character references are decoded, also those without a semicolon that HTML allows. A line break
inside a block is white space. Repeated rows give equal rows; of stretches of equal length the first is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lines of a window; a window is dense with so many characters, or with so large a part of the page's densest one.
WINDOW, DENSE, PART = 3, 86, 0.25
#: Elements inside each other; deeper ones count as part of the one around them, as in browsers.
DEPTH = 512

# Names of HTML. Elements that begin and end a line:
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
# without an end tag;
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# whose content is no markup;
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# of the head alone;
HEAD = frozenset("base link meta noscript script style template title".split())
# and those that are closed by one of their own kind, up to the elements that part them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Elements that are never content; `header` is, inside of an article.
DROPPED = frozenset("head script style noscript template iframe object applet svg math canvas audio video map nav aside menu footer button select textarea datalist dialog xmp noembed noframes".split())
MAIN = frozenset(("article", "main"))
#: Words of classes, ids and roles of elements that are beside the content, and words that may stand with them.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer "
    "cookie cookies consent gdpr notice notices notification alert banner popup modal overlay comment comments commentlist discussion disqus reply replies respond responses share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login toolbar pagination pager widget widgets copyright contentinfo complementary form search teaser teasers".split()
)
BESIDE = frozenset("box block wrap wrapper container list area section bar item inner outer content top bottom left right site page primary secondary global links link text slot unit post posts article entry blog user reader main col column row group module panel thread count the our your policy message".split())
PAGE_HEADER = frozenset("header masthead topbar".split())
#: How reader comments are headed where nothing else tells them.
COMMENTS = re.compile(r"^\W*\d*\s*(reader |user )?(comments?|kommentare?|commentaires?|comentarios?|leave a (reply|comment))\W*(\(\d+\)|\d*)\W*$", re.I)
RIGHTS = re.compile(r"^\s*(©|\(c\)|copyright\b)", re.I)

_VALUE = r"""=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^>"'\s][^>\s]*+)?+"""
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|{_VALUE})*+)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I) for name in RAW}
_NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(slots=True)
class Node:
    name: str
    parent: int
    dropped: bool
    beside: bool = False
    main: bool = False
    link: bool = False


@dataclass
class Page:
    """Nodes of a page, and its lines: text, length outside of links, node and heading level."""

    nodes: list[Node] = field(default_factory=lambda: [Node("", -1, False)])
    text: list[str] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    head: list[bool] = field(default_factory=list)


def _beside(name: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """(whether an element is named as something beside the content, whether it is named as the content)."""
    beside = main = False
    for key, *values in _NAMED.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            beside = True
        elif key == "itemprop" or key == "role":
            main |= value.lower() in ("articlebody", "main", "article")
            beside |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
        elif key in ("class", "id"):
            for one in value.split():
                own = [w.lower() for w in _WORD.findall(one)]
                rest = [w for w in own if w not in ASIDE]
                if len(rest) < len(own) and all(w in BESIDE for w in rest):
                    beside = True
                if not within and own and PAGE_HEADER & set(own) and all(w in BESIDE - {"post", "article", "entry", "blog", "content", "section"} for w in own if w not in PAGE_HEADER):
                    beside = True
    return beside and name not in ("html", "body", "main"), main


def parsed(html: str) -> Page:
    """Lines of a page; unclosed and misplaced tags are mended as far as lines need it."""
    page, stack = Page(), [0]
    words: list[str] = []
    outside = 0

    def flush() -> None:
        nonlocal words, outside
        text = " ".join("".join(words).split())
        if text:
            page.text.append(text)
            page.length.append(min(outside, len(text)))
            page.node.append(stack[-1])
            page.head.append(any(page.nodes[n].name == "h1" for n in stack))
        words, outside = [], 0

    def close(names: frozenset | set, until: frozenset | set) -> None:
        """End the innermost open element of these names, and all in it; none if one of `until` is inside of it."""
        for i in range(len(stack) - 1, 0, -1):
            name = page.nodes[stack[i]].name
            if name in names:
                del stack[i:]
                return
            if name in until:
                return

    def said(text: str) -> None:
        nonlocal outside
        if text:
            text = unescape(text) if "&" in text else text
            words.append(text)
            if not page.nodes[stack[-1]].link:
                outside += len(text.strip())

    at = 0
    while True:
        m = _MARKUP.search(html, at)
        said(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name, ends = m["name"].lower(), bool(m["end"])
        if page.nodes[stack[-1]].name == "head" and name not in HEAD:
            flush()
            stack.pop()
        if name in BLOCKS:
            flush()
        elif name == "br":
            words.append(" ")
        if ends:
            if name not in ("body", "html", "br"):
                close({name}, frozenset() if name in BLOCKS else BLOCKS)
            continue
        if name in BLOCKS:
            close({"p"}, BLOCKS - {"p"})
            if name in ENDS:
                close(*ENDS[name])
        if name in RAW:
            at = _RAW_END[name].search(html, at).end()
            continue
        if name in VOID or name in ("html", "body") and any(page.nodes[n].name == name for n in stack):
            continue
        up = page.nodes[stack[-1]]
        within = up.main
        beside, main = _beside(name, m["rest"], within) if m["rest"] else (False, False)
        beside |= name == "form"  # unless it is around the whole page
        dropped = up.dropped or name in DROPPED or name == "header" and not within
        if len(stack) < DEPTH and (name in BLOCKS or name == "a" or dropped != up.dropped or beside):
            if m["rest"].rstrip().endswith("/") and name not in BLOCKS and name != "a":
                continue
            page.nodes.append(Node(name, stack[-1], dropped, beside, up.main or main or name in MAIN, up.link or name == "a"))
            stack.append(len(page.nodes) - 1)
    flush()
    return page


def _trails(page: Page) -> list[list[int]]:
    """Nodes around each line, the outermost first."""
    out = []
    for n in page.node:
        trail = []
        while n >= 0:
            trail.append(n)
            n = page.nodes[n].parent
        out.append(trail[::-1])
    return out


def _live(page: Page, trails: list[list[int]]) -> np.ndarray:
    """Lines that are not beside the content. An element that holds the main one is never beside it; if nothing is left, names decide nothing."""
    holds = set()
    for n in page.nodes:
        if n.name in MAIN and not n.beside:
            up = n.parent
            while up > 0:
                holds.add(up)
                up = page.nodes[up].parent
    dropped = np.array([page.nodes[t[-1]].dropped for t in trails], bool)
    beside = np.array([any(page.nodes[n].beside and n not in holds for n in t) for t in trails], bool)
    for i, text in enumerate(page.text):  # reader comments under a heading of their own last to the end of its container
        if not dropped[i] and not beside[i] and len(text) < 40 and page.nodes[page.node[i]].name in ("h2", "h3", "h4") and COMMENTS.match(text):
            over = trails[i][-2] if len(trails[i]) > 1 else 0
            beside[i:] |= np.array([over in t for t in trails[i:]], bool)
    live = ~(dropped | beside)
    return live if live.any() else ~dropped


def main_lines(page: Page) -> list[int]:
    """Numbers of the lines that are the page's main text."""
    if not page.text:
        return []
    trails = _trails(page)
    live = _live(page, trails)
    length = np.where(live, page.length, 0)
    sums = np.convolve(length, np.ones(WINDOW, np.int64))  # sums[i]: the window that ends with line i
    window = sums[WINDOW - 1 :]  # window[i]: the one that begins with it
    if not len(window) or not window.max():
        window = sums[-len(length) :]
    dense = min(DENSE, PART * window.max())
    full = np.flatnonzero(length)
    if not len(full):
        return []
    parts = np.split(full, np.flatnonzero(np.diff(full) > WINDOW) + 1)  # a dive: a whole window is empty
    parts = [p for p in parts if window[p[0] : p[-1] + 1].max() >= dense] or parts
    best = max(parts, key=lambda p: (length[p].sum(), -p[0]))
    surge, dive = int(best[0]), int(best[-1])
    weight: dict[int, int] = {}
    for i in best.tolist():
        for n in trails[i]:
            weight[n] = weight.get(n, 0) + int(length[i])
    total = weight[0]
    articles = [n for n, w in weight.items() if page.nodes[n].name in MAIN and 2 * w >= total]
    shared = [n for n, w in weight.items() if w == total]
    over = min(articles) if articles else max(shared)
    if not articles and len(best) == 1:  # a line alone: what is around its own block
        over = page.nodes[over].parent if page.nodes[over].parent > 0 else over
    whole = page.nodes[over].name not in ("", "html", "body")
    kept = [i for i in range(len(page.text)) if live[i] and (over in trails[i] if whole else surge <= i <= dive)]
    if not articles and not any(page.head[i] for i in kept):  # the heading, where it stands before the container
        kept = [i for i in range(kept[0]) if live[i] and page.head[i]][-1:] + kept
    while not whole and len(kept) > 1 and RIGHTS.match(page.text[kept[-1]]):
        kept.pop()
    return kept


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    return "\n".join(page.text[i] for i in main_lines(page))


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` without `html` and with `text`, the main text; an older column of that name is replaced."""
    kept = [c for c in pages.columns if c not in (html, text)]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(made, pa.string())], names=schema.names)

    return pages.select(*[pages[c] for c in kept], pages[html]).mapInArrow(run, schema)
