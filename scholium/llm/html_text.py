"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks, cut where block-level tags open or
close. Each block has its number of words and the share of them in links, the
same of the blocks before and after it, and what its surroundings are called. A
decision tree, grown from the small labelled pages of ``html_samples``, tells
main text from menus, notices, adverts, forms, footers and reader comments. Names settle
what surroundings are called after; where nothing is named, words and links of the block and
of its neighbours decide, such as a short line between long ones against one between menus.

Classes of html and body, and classes for a state or layout, name nothing; main starts
afresh within named surroundings, and so does article, but for those of comments,
adverts and related pages and for nav, footer, aside, menu and dialog elements.

Scripts, styles and the head are no text. The tokenizer is one pass of a
regular expression over the page, an end tag without its start costs no search, and so a page costs time in proportion to its length
and memory in proportion to the page itself.

Defined results: a null or empty html, and one without main text, give an
empty text of 0 characters; unclosed or stray tags close with their container, an
unclosed head at the first thing that cannot stand in one; a CDATA section that is closed is text, any other a comment, and an unclosed select,
button, object or the like holds nothing; the text of formulas stays;
rows with a null or repeated page_id give a row each; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .html_samples import PAGES

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_CALLED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_WORDS = re.compile(r"[a-z]+")

#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe svg head title textarea select button object canvas audio video".split())
RAW = frozenset("script style textarea title noscript template iframe annotation annotation-xml".split())
#: What can stand in a head; anything else ends it, as HTML lets authors leave out </head>.
IN_HEAD = frozenset("html head base basefont bgsound link meta script style noscript template title".split())
#: Skipped elements that hold others of their name; each other one that is opened anew before it is closed was never closed.
NESTED = frozenset(["svg"])
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()) | MATH
VOID = frozenset("br img input hr meta link wbr area base col embed source track".split())
MAIN_TAGS = frozenset("article main".split())
SIDE_TAGS = frozenset("nav footer aside menu dialog".split())
#: Words of classes, ids and roles that name main text or what surrounds it.
MAIN_WORDS = frozenset("article main content post entry story body text".split())
SIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies copyright disclaimer disqus footer form header login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted related replies reply respond search share sharing sidebar social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Words that make a class a state or layout of a page, such as has-sidebar, comments-open or header-fixed, and not a name.
STATE_WORDS = frozenset("active disabled enabled closed fixed full has is layout no off on open show shown sticky visible with without".split())
#: Names whose blocks have articles of their own, which don't start afresh.
HOLDERS = frozenset("ad ads advert advertisement adverts comment comments disqus promo promoted related replies reply respond sponsor sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = {"p": 1, "li": 3, "dd": 3, "dt": 3, "td": 4, "th": 4, "blockquote": 1, "pre": 1, "figcaption": 1} | dict.fromkeys(HEADINGS, 2)
#: A form, or what is named like surroundings, that holds this share of a page's words, and so many, is the page.
WRAPPED, WRAPPED_WORDS = 0.5, 60
FEATURES = ["words", "links", "before_words", "before_links", "after_words", "after_links", "main", "side", "kind", "stop"]


@dataclass
class Block:
    text: str
    words: int
    links: float
    main: int
    side: int
    kind: int
    label: int | None = None
    cause: int = 0


def _called(tag: str) -> tuple[int, int]:
    """Whether a tag's class, id or role names main text, and whether its surroundings (2: such as have articles of their own)."""
    main = side = 0
    for found in _CALLED.findall(tag):
        for name in "".join(found).lower().split():
            words = set(_WORDS.findall(name))
            if words & MAIN_WORDS:
                main, words = 1, words - {"header"}  # an article's header holds its title
            if words & SIDE_WORDS and not words & STATE_WORDS:
                side = max(side, 2 if words & HOLDERS else 1)
    return int(main and not side), side


def _hidden(tag: str) -> bool:
    """Whether a tag has the attribute hidden, or a style that displays nothing; what other attributes say counts for nothing."""
    low = tag.lower()
    if "hidden" not in low and "display" not in low:
        return False
    found = [(a.lower(), v) for a, v in _ATTRIBUTE.findall(tag, len(_NAME.match(tag)[0]))]
    return any(a == "hidden" or a == "style" and _NONE.search(v) for a, v in found)


class _Ahead:
    """Whether an element that is opened at a place of the page is closed; each name's tags are sought once over the page."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def _find(self, tag: str, at: int) -> int:
        found = self.next.get(tag, -1)
        if found < at:
            m = re.compile(rf"{tag}(?=[\s/>])", re.I).search(self.page, at)
            found = self.next[tag] = m.start() if m else len(self.page)
        return found

    def closed(self, name: str, at: int) -> bool:
        end = self._find(f"</{name}", at)
        return end < len(self.page) and (name in NESTED or self._find(f"<{name}", at) > end)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    nowhere = ("", 0, 0, 0, None, 0)
    stack: list[tuple[str, int, int, int, int | None, int]] = []
    opened: Counter[str] = Counter()  # so that a stray end costs no look through the stack
    unended: set[str] = set()
    pieces: list[tuple[str, bool]] = []
    link, skip, causes = False, 0, 0
    now = nowhere
    ahead = _Ahead(page)

    def flush():
        if pieces:
            text = " ".join(entities.unescape("".join(p for p, _ in pieces)).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(p.split()) for p, in_link in pieces if in_link)
                out.append(Block(text, words, min(1.0, linked / words), now[1], int(now[2] > 0), now[3], now[4], now[5] if now[2] == 1 else 0))
            pieces.clear()

    def cut(depth: int):
        nonlocal skip
        gone = stack[depth:]
        skip -= sum(t[0] in SKIPPED for t in gone)
        opened.subtract(t[0] for t in gone)
        del stack[depth:]

    def end_head():
        depth = next((i for i, t in enumerate(stack[:2]) if t[0] == "head"), None)
        if depth is not None:
            cut(depth)

    at, end = 0, len(page)
    sections = page.rfind("]]>")
    while at < end:
        m = _TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            if skip and stack[-1][0] == "head" and token.strip():
                end_head()
                now = stack[-1] if stack else nowhere
            if not skip:
                pieces.append((token, link))
            continue
        named = _NAME.match(token)
        if not named:
            if page.startswith("<![CDATA[", m.start()) and m.start() < sections:
                at = page.index("]]>", m.start()) + 3
                if not skip:
                    pieces.append((page[m.start() + 9 : at - 3].replace("&", "&amp;"), link))
            continue
        name = named[1].lower()
        closing = token[1] == "/"
        if skip and not closing and name not in IN_HEAD:
            end_head()
            now = stack[-1] if stack else nowhere
        if name in RAW and not closing:
            stop = None if name in unended else re.compile(rf"</{name}\s*[^>]*>?", re.I).search(page, at)
            if not stop:
                unended.add(name)
            at = stop.end() if stop else at if name.startswith("annotation") else end
            continue
        if name in INLINE:
            if name == "a":
                link = not closing
            elif name == "br":
                pieces.append((" ", link))
            continue
        flush()
        if closing:
            if opened[name] > 0:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                link = False
        elif name == "head" and any(t[0] != "html" for t in stack):
            pass
        elif name not in VOID and not token.endswith("/>") and (name not in SKIPPED or name == "head" or ahead.closed(name, at)):
            if name in KINDS and stack and stack[-1][0] in ("p", "li", "dd", "dt", "td", "th", *HEADINGS) and (stack[-1][0] in ("p", *HEADINGS) or stack[-1][0] == name):
                cut(len(stack) - 1)
            _, main, side, _, label, cause = stack[-1] if stack else nowhere
            by_main, by_side = _called(token) if name not in ("html", "body") else (0, 0)
            if name in SIDE_TAGS:
                side = 2
            elif name == "main" or _ROLE.search(token):
                main, side = 1, 3 if side == 3 else 0
            elif name == "form" or by_side or name == "header" and not main:
                if max(by_side, 1) >= side:
                    causes += 1
                    cause = causes
                side = max(side, by_side, 1)
            elif name in MAIN_TAGS:
                main, side = 1, side if side > 1 else 0
            elif by_main:
                main = 1
            if name not in ("html", "body") and _hidden(token):
                side = 3
            if " data-main" in token:
                label = int('data-main="1"' in token)
            stack.append((name, main, side, KINDS.get(name, 0), label, cause))
            opened[name] += 1
            skip += name in SKIPPED
        now = stack[-1] if stack else nowhere
    flush()
    held = Counter()
    for b in out:
        held[b.cause] += b.words
    whole = {c for c, n in held.items() if c and n >= WRAPPED_WORDS and n > WRAPPED * sum(held.values())}
    for b in out:
        if b.cause in whole:
            b.side = 0
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    n = len(found)
    if not n:
        return np.empty((0, len(FEATURES)))
    words, links = np.array([b.words for b in found], float), np.array([b.links for b in found])
    shifted = lambda x, k: np.r_[0.0, x[:-1]] if k > 0 else np.r_[x[1:], 0.0]
    rest = np.array([(b.main, b.side, b.kind, b.text[-1] in ".!?…:;\"”»)") for b in found], float)
    return np.column_stack([words, links, shifted(words, 1), shifted(links, 1), shifted(words, -1), shifted(links, -1), rest])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 2):
    """A decision tree by Gini impurity: a share of main text, or (feature, threshold, at most, above)."""
    share = float(y.mean())
    if not depth or share in (0.0, 1.0) or len(y) < 2 * leaf:
        return share
    best = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
            if leaf <= i <= len(y) - leaf:
                a, b = ones[i - 1] / i, (ones[-1] - ones[i - 1]) / (len(y) - i)
                impurity = i * a * (1 - a) + (len(y) - i) * b * (1 - b)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, j, (v[i - 1] + v[i]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf)


def decide(tree, row) -> float:
    while not isinstance(tree, float):
        j, threshold, low, high = tree
        tree = low if row[j] <= threshold else high
    return tree


def trained():
    """The tree of the labelled pages: text in an element with data-main="1" is main text."""
    rows = [blocks(p) for p in PAGES]
    x = np.concatenate([features(r) for r in rows])
    y = np.array([b.label == 1 for r in rows for b in r], float)
    return grow(x, y)


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if decide(tree, row) >= 0.5)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    tree = trained()

    def run(batches):
        for batch in batches:
            texts = [main_text(h, tree) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
