"""Main text of web pages by tag-path ratios.

A page becomes a run of text blocks, each with its root-to-leaf tag path (tags with their classes and ids). Text
length and punctuation are summed up for each path over its blocks; the two ratios are smoothed along the page, fused
by their product, averaged for each path and thresholded, which selects the content paths. The smallest element that
holds nearly all selected text is the article. Its text is that of the selected paths, of headings and of other parts
of running text, but for parts below it that are named as something else.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style title head noscript template iframe svg math canvas object audio video textarea select option datalist button noembed noframes".split())
ASIDE = frozenset("nav header footer aside menu dialog".split())
FORMS = frozenset("form fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of running text, none of which is an article by itself.
PARTS = HEADINGS | frozenset("p li dt dd ul ol dl td th tr thead tbody tfoot table caption pre blockquote figure figcaption address".split())
#: An element whose class, id or role has one of these words is no article, unless it is said not to have it.
NOT_CONTENT = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination pager popup promo promoted promotion related reply replies respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
REMARKS = frozenset("comment comments disqus reply replies respond".split())
SAID_OF_OTHERS = frozenset("with without has have no not is".split())
#: A block of a class or id with one of these words is part of the running text even where it's short.
TITLES = frozenset("title headline heading subtitle subhead lead lede intro summary caption quote".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S | re.I)
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、,!?;:]")


#: Why an element may be no part of the article: it is certain, said by its tag, a form, said by its name, or reader comments.
CERTAIN, BY_TAG, BY_FORM, BY_NAME, BY_REMARKS = 1, 2, 3, 4, 5


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int
    depth: int
    apart: int
    named: bool = False
    titled: bool = False


@dataclass(slots=True)
class Block:
    path: int
    node: int
    text: list[str] = field(default_factory=list)
    linked: int = 0


def _named(tag: str, attributes: str) -> tuple[str, int, bool]:
    """(step of the tag path, why it may be no part of the article or 0, whether its name is that of a title)."""
    names, apart, titled = [], CERTAIN if tag in SKIPPED else BY_TAG if tag in ASIDE else BY_FORM if tag in FORMS else 0, False
    for name, a, b, c in _NAMES.findall(attributes) if attributes else ():
        name, value = name.lower(), html.unescape(a or b or c).lower()
        if name in ("class", "id"):
            tokens = value.split()
            names += tokens
            for token in tokens if tag not in ("html", "body", "article", "main") else ():
                words = _WORDS.findall(token)
                titled |= not TITLES.isdisjoint(words)
                if not NOT_CONTENT.isdisjoint(words) and SAID_OF_OTHERS.isdisjoint(words):
                    apart = apart or (BY_NAME if REMARKS.isdisjoint(words) else BY_REMARKS)
        elif name == "role":
            apart = apart or BY_NAME * (value.strip() in NOT_CONTENT_ROLES)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            apart = CERTAIN
    return ".".join([tag, *names]), apart, titled


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """The elements and the text blocks of a page; what is certainly no text (scripts, hidden parts) is left out.

    End tags close the nearest open element of their name; ``p``, ``li``, ``dt``, ``dd``, table cells and rows end as
    HTML says; what is left open ends with the page. Tag paths are numbered, so that depth costs nothing.
    """
    elements, blocks = [Element("html", -1, 0, 0, 0)], []
    paths: dict[tuple[int, str], int] = {}
    stack, block = [0], None
    holders, unseen, opened = [0], [], Counter(html=1)  # open block elements, open elements without text, how often each tag is open
    at, n = 0, len(page)

    def add(text: str) -> None:
        nonlocal block
        if unseen or not text:
            return
        if block is None:
            if not text.strip():
                return
            block = Block(elements[holders[-1]].path, holders[-1])
            blocks.append(block)
        block.text.append(text)
        if opened["a"]:
            block.linked += len(text.strip())

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[elements[node].tag] -= 1
        first = stack[depth]
        del stack[depth:]
        for listed in (holders, unseen):
            while listed and listed[-1] >= first:
                listed.pop()

    while at < n:
        match = _MARKUP.search(page, at)
        if match is None:
            add(html.unescape(page[at:]))
            break
        if match.start() > at:
            add(html.unescape(page[at : match.start()]))
        at = match.end()
        if match["cdata"] is not None:
            add(match["cdata"])
        if match["tag"] is None:
            continue
        tag = match["tag"].lower()
        if tag == "br" or tag not in INLINE:
            block = None
        if match["close"]:
            if opened[tag] and (tag != "html" or opened[tag] > 1):
                for depth in range(len(stack) - 1, 0, -1):
                    if elements[stack[depth]].tag == tag:
                        close(depth)
                        break
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        closing = {"p"} if tag in CLOSES_P else {"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {"tr", "td", "th"} if tag == "tr" else {"option"} if tag == "option" else ()
        if any(opened[c] for c in closing):
            for depth in range(len(stack) - 1, 0, -1):
                here = elements[stack[depth]].tag
                if here in closing:
                    close(depth)
                    if tag != "tr" or here == "tr":
                        break
                elif here not in INLINE and not (tag == "tr" and here in ("td", "th")):
                    break
        step, apart, titled = _named(tag, match["attributes"])
        above = elements[stack[-1]]
        elements.append(Element(tag, stack[-1], paths.setdefault((above.path, step), len(paths) + 1), above.depth + 1, apart, step != tag, titled))
        if tag in VOID or match["attributes"].endswith("/") and tag not in RAW and tag not in CLOSES_P:
            continue
        if tag in RAW:  # its text is no markup; all of these are skipped
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = end.start() if end else n
        stack.append(len(elements) - 1)
        opened[tag] += 1
        if tag not in INLINE:
            holders.append(len(elements) - 1)
        if apart == CERTAIN:
            unseen.append(len(elements) - 1)
    return elements, blocks


def _smooth(values: np.ndarray, reach: int = 2) -> np.ndarray:
    """Gaussian smoothing along the page, the ends repeated."""
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(reach / 2, 1)) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def _container(elements: list[Element], node: int) -> int:
    """The nearest element from here outwards that isn't a part of running text."""
    while node > 0 and elements[node].tag in PARTS:
        node = elements[node].parent
    return node


def _sums(elements: list[Element], own: np.ndarray) -> np.ndarray:
    """For each element what it and all below it have; parents come before their children."""
    out = own.tolist()
    for i in range(len(elements) - 1, 0, -1):
        out[elements[i].parent] += out[i]
    return np.array(out)


def _left_out(elements: list[Element], blocks: list[Block], size: np.ndarray) -> np.ndarray:
    """Whether each element is no part of any article.

    What is set apart by its tag or name goes with all below it, unless the article is in it: unless it holds every
    ``article`` and ``main`` of the page, or, where the page has none, a form or a named element holds nearly all text
    and at least two paragraphs or headings.
    """
    n = len(elements)
    node = np.array([b.node for b in blocks], np.int64)
    mass = _sums(elements, np.bincount(node, size, n))
    remarks, roots, texts = np.zeros(n, bool), np.zeros(n), np.zeros(n)
    np.add.at(texts, node, 1)
    for i, e in enumerate(elements):
        remarks[i] = e.apart == BY_REMARKS or e.parent >= 0 and remarks[e.parent]
        roots[i] = e.tag in ("article", "main") and not remarks[i] and mass[i] > 0
        texts[i] = min(texts[i], e.tag == "p" or e.tag in HEADINGS)
    inside, texts = _sums(elements, roots), _sums(elements, texts)
    gone = np.zeros(n, bool)
    for i, e in enumerate(elements[1:], 1):
        if e.apart and e.apart != CERTAIN and inside[0]:
            gone[i] = inside[i] < inside[0]
        elif e.apart:
            gone[i] = e.apart in (CERTAIN, BY_TAG) or mass[i] < 0.8 * mass[0] or texts[i] < 2
        gone[i] |= gone[e.parent]
    return gone


def content_blocks(elements: list[Element], blocks: list[Block]) -> list[Block]:
    """The blocks of the article, in page order.

    For each tag path: the text length and the punctuation of its blocks, without linked text, over its blocks. Both
    ratios are smoothed along the blocks, multiplied (one added to punctuation, so that short unpunctuated articles
    count), averaged for each path and compared with the mean less half a deviation, which selects paths. Of the
    elements that hold at least 0.9 of the selected text the deepest is the core; an ``article`` or ``main`` element
    around it is the article. Without one, the article is the container of the core (never a paragraph, heading, list
    or table), and of the least container of all selected blocks the selected ones and the headings, and paragraphs and
    headings right beside the container. Within the article a block of a path that isn't selected stays if it is a
    heading, a plain paragraph or another part of running text, is named as a title, or has punctuation: an
    ``Advertisement`` in an element of its own goes.
    """
    if not blocks:
        return []
    sizes = np.array([sum(map(len, b.text)) for b in blocks], np.float64)
    gone = _left_out(elements, blocks, sizes)
    blocks = [b for b in blocks if not gone[b.node]]
    if not blocks:
        return []
    texts = ["".join(b.text) for b in blocks]
    length = np.array([max(len(t.strip()) - b.linked, 0) for t, b in zip(texts, blocks, strict=True)], np.float64)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], np.float64)
    _, path = np.unique(np.array([b.path for b in blocks]), return_inverse=True)
    count = np.bincount(path)
    by_length, by_marks = (np.bincount(path, v) / count for v in (length, marks))
    fused = _smooth(by_length[path]) * (1 + _smooth(by_marks[path]))
    selected = ((np.bincount(path, fused) / count) >= max(fused.mean() - 0.5 * fused.std(), 1e-9))[path]
    nodes = np.array([b.node for b in blocks], np.int64)
    weight = _sums(elements, np.bincount(nodes, length * selected, len(elements)))
    total = float(weight[0])
    if total == 0:
        return []
    depth = np.array([e.depth for e in elements])
    deepest = lambda share: int(np.argmax(np.where(weight >= share * total, depth, -1)))
    root = node = deepest(0.9)
    while node >= 0:
        if elements[node].tag in ("article", "main"):
            root = node
            break
        node = elements[node].parent
    around, beside = root, -2
    if node < 0:
        root = _container(elements, root)
        beside = elements[root].parent if root else -2
        around = _container(elements, deepest(1 - 1e-9))
        if sum(b.node == around for b in blocks) and not any(elements[b.node].parent == around for b in blocks):
            around = max(elements[around].parent, 0)  # one block by itself: its heading is beside it

    def within(node: int, inside: dict[int, bool]) -> bool:
        seen = []
        while node not in inside:
            seen.append(node)
            node = elements[node].parent
        for s in seen:
            inside[s] = inside[node]
        return inside[node]

    def running(block: Block, marked: float) -> bool:
        own = elements[block.node]
        return block.node == root or own.tag in HEADINGS or marked > 0 or own.tag in PARTS and (own.tag != "p" or not own.named) or own.titled

    core, wide = {root: True, -1: False}, {around: True, -1: False}
    return [
        b
        for b, chosen, own, marked in zip(blocks, selected, length, marks, strict=True)
        if within(b.node, core) and (chosen or running(b, marked))
        or (chosen or elements[b.node].tag in HEADINGS) and within(b.node, wide)
        or own and elements[b.node].parent == beside and elements[b.node].tag in HEADINGS | {"p"}
    ]


def main_text(page: str | None) -> str:
    """Blocks of the article, white space made one space, joined by one space; empty if there is none."""
    if not page:
        return ""
    parts = (" ".join("".join(b.text).split()) for b in content_blocks(*parse(page)))
    return " ".join(p for p in parts if p)


@pandas_udf(T.StringType())
def main_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text, na_action=None).astype("object")


def extract_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> the same rows with text string and n_chars long (code points).

    Null and empty html, and pages without text, give an empty text. Pages are parsed each by itself, in one pass and
    whole. html is dropped; other columns pass through, but of those two names.
    """
    return (
        pages.select(*[c for c in pages.columns if c not in ("text", "n_chars")])
        .withColumn("text", main_text_udf("html"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .drop("html")
    )
