"""Main text of web pages: flat text blocks, shallow features, and a decision tree trained on a small table.

A page becomes a flat list of text blocks. Each block is described by its word count, its link density, those
of the blocks before and after it, and what the elements around it say about themselves (an article, a menu,
an advert). A CART tree, trained on the blocks of ``labelled_pages``, tells content from boilerplate.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that end a line of text, elements without content, and elements whose content is no markup.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object audio video canvas select datalist button".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "head", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "title"}
# An opening tag of the key ends an open element of the value, up to the nearest list or table.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select menu article section div nav aside body html".split())
# What elements say about their content, by tag, by role, and by words of class and id.
MENU_TAGS = frozenset("nav header footer aside form menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
MENU_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
MAIN_ROLES = frozenset("article main".split())
#: Words of elements whose articles are not the page's own.
FOREIGN_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot comment comments commentlist discussion disqus related recommend recommended replies reply respond promo promoted promotion sponsor sponsored teaser widget widgets modal popup".split())
MENU_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus feedback footer gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related recommend recommended replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article content entry post story text body main maincontent articlebody postcontent entrycontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Pages parsed at once.
PAGES = 64


class Block(NamedTuple):
    """A run of text without a block boundary inside."""

    text: str
    words: int
    linked: int
    cue: int  # 1: inside of an element that names itself content; -1: inside of a menu, notice, advert; 0: neither
    heading: bool
    listed: bool


@lru_cache(maxsize=65536)
def _cue(tag: str, attributes: str) -> int:
    """-1, 0 or 1 for what an element says about its content; -2 if it is hidden."""
    says = 0
    if tag in ("html", "body"):
        return 0  # what a page says of itself as a whole tells no part from another
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = html.unescape(a or b or c), name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return -2
            if name == "role":
                says = -1 if value.lower() in MENU_ROLES else 1 if value.lower() in MAIN_ROLES else says
            elif name in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                if words & MENU_WORDS and not (tag in MAIN_TAGS and words & MAIN_WORDS):
                    says = -1
                elif words & MAIN_WORDS and not says:
                    says = 1
    if tag in MENU_TAGS and says == 0:
        return -1
    return 1 if tag in MAIN_TAGS and says == 0 else says


@lru_cache(maxsize=65536)
def _foreign(tag: str, attributes: str) -> bool:
    """Whether articles inside of an element are not the page's own."""
    words = {w.lower() for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for w in _WORD.findall(html.unescape(a or b or c))}
    return tag in MENU_TAGS - {"form"} or bool(words & FOREIGN_WORDS)


def blocks(page: str) -> list[Block]:
    """The flat list of text blocks of a page, in page order, boilerplate included."""
    out: list[Block] = []
    open_: list[tuple[str, int, int, bool]] = []  # tag, cue here, depth of links, whether articles here are foreign
    parts: list[tuple[str, bool]] = []
    count: Counter[str] = Counter()  # of open elements
    endless: set[str] = set()  # raw elements that no end follows
    cue, links, headings, lists, foreign = 0, 0, 0, 0, False

    def flush() -> None:
        if not parts:
            return
        words = "".join([p for p, _ in parts]).split()
        if words:
            linked = sum([len(p.split()) for p, inside in parts if inside])
            out.append(Block(" ".join(words), len(words), linked, cue, headings > 0, lists > 0))
        parts.clear()

    def push(tag: str, attributes: str) -> None:
        nonlocal cue, headings, lists, foreign
        says = _cue(tag, attributes)
        if tag == "header" and says == -1 and cue == 1:
            says = 0  # the heading of an article is part of it
        inner = cue == -1 and says == 1 and tag in MAIN_TAGS and not foreign  # undoes what a wrapper says
        if says and says != cue and (cue > -1 or inner):
            flush()
        open_.append((tag, cue, links, foreign))
        count[tag] += 1
        foreign = foreign or says == -1 and _foreign(tag, attributes)
        headings += len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        lists += tag == "li"
        if says and (cue >= 0 or inner or cue == -1 and says == -2):
            cue = says

    def pop_to(depth: int) -> None:
        nonlocal cue, links, headings, lists, foreign
        while len(open_) > depth:
            tag, before, had, foreign = open_.pop()
            count[tag] -= 1
            if before != cue:
                flush()
            headings -= len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            lists -= tag == "li"
            cue, links = before, had

    def close(tag: str) -> None:
        if not count[tag]:
            return
        for depth in range(len(open_) - 1, -1, -1):
            if open_[depth][0] == tag:
                pop_to(depth)
                return

    def say(raw: str) -> None:
        if cue > -2 and raw:
            parts.append((html.unescape(raw) if "&" in raw else raw, links > 0))

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        found = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if not found:  # a lone "<" is text
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = found.end()
        tag = (found.group(2) or "").lower()
        if not tag:
            continue
        closing, attributes = found.group(1), found.group(3)
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            parts.append((" ", False))
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            close(tag)
            continue
        if tag in RAW_TAGS and not (attributes or "").endswith("/"):
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end is None and tag in ("button", "select", "object", "audio", "video", "canvas", "svg", "math", "datalist"):
                endless.add(tag)
                continue  # without an end the rest of the page isn't its content
            at = end.end() if end else size
            continue
        if tag in VOID_TAGS or (attributes or "").endswith("/") and tag not in BLOCK_TAGS and tag != "a":
            continue
        if tag in CLOSES_P and count["p"]:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == "p":
                    pop_to(depth)
                    break
                if open_[depth][0] in BLOCK_TAGS:
                    break
        if tag in IMPLIED_END and any(count[t] for t in IMPLIED_END[tag]):
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] in IMPLIED_END[tag]:
                    pop_to(depth)
                    break
                if open_[depth][0] in SCOPES:
                    break
        push(tag, attributes or "")
        if tag == "a":
            links += 1
    flush()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "cue", "heading", "listed", "named")


def features(page: list[Block]) -> np.ndarray:
    """One row per block, columns as in FEATURES; ``named``: some block of the page is inside of a content element."""
    n = len(page)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array([b.words for b in page], float)
    density = np.array([min(1.0, b.linked / b.words) if b.words else 0.0 for b in page])
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    out[:, 6] = [max(b.cue, -1) for b in page]
    out[:, 7] = [b.heading for b in page]
    out[:, 8] = [b.listed for b in page]
    out[:, 9] = any(b.cue == 1 for b in page)
    return out


class DecisionTree:
    """CART for two classes: Gini impurity, axis-parallel splits at midpoints, ties to the first feature."""

    def __init__(self, depth: int = 8, least: int = 1):
        self.depth, self.least = depth, least
        self.root: tuple | float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(x, y.astype(float), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple | float:
        share = float(y.mean()) if len(y) else 0.0
        if depth == 0 or share in (0.0, 1.0):
            return share
        best = (share * (1 - share) * len(y) - 1e-12, -1, 0.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= self.least) & (len(y) - cut >= self.least)]
            if len(cut):
                a, b = t[cut - 1], t[-1] - t[cut - 1]
                cost = a * (1 - a / cut) + b * (1 - b / (len(y) - cut))
                i = int(cost.argmin())
                if cost[i] < best[0] - 1e-12:
                    best = (float(cost[i]), j, float(v[cut[i] - 1] + v[cut[i]]) / 2)
        if best[1] < 0:
            return share
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, float):
                out[rows] = node
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


class Invented:
    """Pages of invented words, with a mark of content on each block; the same seed gives the same pages."""

    def __init__(self, seed: int):
        self.rng, self.made = random.Random(seed), 0

    def words(self, least: int, most: int) -> str:
        """A line that occurs once."""
        self.made += 1
        n = self.rng.randint(least, most)
        return " ".join(["".join(self.rng.choice(("ra", "ne", "to", "li", "sum", "ka")) for _ in range(self.rng.randint(1, 4))) for _ in range(n - 1)] + [f"x{self.made}"])

    def link(self, least: int, most: int) -> str:
        return f"<a href='/{self.made}'>{self.words(least, most)}</a>"

    def links(self, n: int, least: int, most: int, gap: str) -> str:
        return gap.join(self.link(least, most) for _ in range(n))

    def menu(self) -> list[str]:
        """Blocks of links above or below an article: lists, lines, paths."""
        n = self.rng.randint(4, 12)
        kind = self.rng.randrange(4)
        if kind == 0:
            return [f"<ul>{''.join(f'<li>{self.link(1, 4)}</li>' for _ in range(n))}</ul>"]
        if kind == 1:
            return [f"<div>{self.links(n, 1, 6, self.rng.choice((' | ', ' ', ' - ')))}</div>"]
        if kind == 2:
            return [f"<p>{self.links(self.rng.randint(2, 4), 1, 3, ' / ')} {self.words(1, 2)}</p>"]
        return [f"<table><tr>{''.join(f'<td>{self.link(1, 3)}</td>' for _ in range(n))}</tr></table>"]

    def note(self) -> list[str]:
        """Taglines, notices, legal lines, adverts: words around links, or few words among blocks of links."""
        kind = self.rng.randrange(4)
        if kind == 0:
            return [f"<div>{self.words(2, 9)}</div>"]
        if kind == 1:
            return [f"<div>{self.words(6, 30)} {self.link(2, 12)} {self.words(1, 4)}</div>"]
        if kind == 2:
            return [f"<p>{self.words(3, 14)}</p>"]
        return [f"<div>{self.link(5, 20)}</div>"]

    def related(self) -> list[str]:
        """Headings over links to other articles, each with a teaser or without."""
        out = [f"<h3>{self.words(1, 4)}</h3>"]
        for _ in range(self.rng.randint(2, 6)):
            out.append(self.rng.choice(("<p>{}</p>", "<li>{}</li>", "<h4>{}</h4>")).format(self.link(4, 14)))
            if self.rng.random() < 0.4:
                out.append(f"<p>{self.words(6, 18)}</p>")
        return out

    def article(self) -> list[str]:
        """A heading, paragraphs of all lengths (dialogue among them), headings between, lists, links in the text."""
        out = [f"<h1>{self.words(2, 12)}</h1>"]
        for _ in range(self.rng.randint(2, 14)):
            kind = self.rng.random()
            if kind < 0.5:
                out.append(f"<p>{self.words(22, 140)}</p>")
            elif kind < 0.62:
                out.append(f"<p>{self.words(10, 22)}</p>")
            elif kind < 0.74:
                out += [f"<p>{self.words(2, 9)}</p>" for _ in range(self.rng.randint(1, 3))]
            elif kind < 0.84:
                out.append(f"<p>{self.words(12, 60)} {self.link(1, 6)} {self.words(8, 40)}</p>")
            elif kind < 0.92:
                out += [f"<h2>{self.words(1, 8)}</h2>", f"<p>{self.words(30, 120)}</p>"]
            else:
                out += [f"<ul><li>{self.words(5, 25)}</li><li>{self.words(5, 25)}</li><li>{self.words(8, 30)}</li></ul>", f"<p>{self.words(20, 90)}</p>"]
        return [*out, f"<p>{self.words(18, 120)}</p>"]

    def plain_page(self) -> tuple[str, tuple[str, ...]]:
        """No element says what it holds: word counts and link densities alone tell."""
        some = lambda *kinds: [x for _ in range(self.rng.randint(1, 3)) for x in self.rng.choice(kinds)()]
        above = some(self.note, self.menu, self.menu) if self.rng.random() < 0.85 else []
        below = some(self.menu, self.note, self.related, self.related) + self.menu() if self.rng.random() < 0.75 else []
        body = self.article() if self.rng.random() < 0.9 else []
        if not body:  # a page without an article: one note, or several blocks
            above, below = self.note() if self.rng.random() < 0.5 else above, []
        wrap = self.rng.choice(("{}", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"))
        return f"<body>{''.join(above)}{wrap.format(''.join(body))}{''.join(below)}</body>", tuple(b.text for x in body for b in blocks(x))

    def named_page(self) -> tuple[str, tuple[str, ...]]:
        """Elements that name themselves hold blocks of every size."""
        title, one, two, last = self.words(1, 10), self.words(1, 200), self.words(1, 60), self.words(1, 25)
        body, keep = f"<h1>{title}</h1><p>{one}</p><p>{two}</p><p>{last}</p>", (title, one, two, last)
        note, ad, foot = self.words(3, 30), self.words(3, 25), f"<footer>{self.words(4, 25)}</footer>"
        menu = "".join(self.menu())
        kind = max(0, self.rng.randrange(6) - 2)
        if kind == 0:
            # any of the parts around an article may lack, and all of the article but one paragraph
            some = lambda x: x if self.rng.random() < 0.5 else ""
            whole = self.rng.random() < 0.6
            inside = body if whole else f"<p>{last}</p>"
            return f"<body>{some(f'<nav>{menu}</nav>')}{some(f'<div class=ad>{ad}</div>')}<article>{inside}</article>{some(foot)}</body>", keep if whole else (last,)
        if kind == 1:
            item, talk = self.words(1, 9), f"<section id='comments'><h2>{self.words(1, 3)}</h2><p>{self.words(3, 60)}</p><p>{self.words(3, 60)}</p></section>"
            side = f"<aside><h3>{self.words(1, 3)}</h3><p>{note}</p><ul><li>{self.link(3, 20)}</li></ul></aside>"
            return f"<body><header><p>{self.words(3, 30)}</p>{menu}</header><main>{body}<ul><li>{item}</li></ul>{talk}</main>{side}{foot}</body>", (*keep, item)
        if kind == 2:
            return f"<body><div class='cookie-notice'>{note}</div><div class='post-content'>{body}<div class='share'>{ad}</div></div><div id='sidebar'><p>{self.words(3, 90)}</p></div></body>", keep
        text, source = self.words(2, 60), self.words(1, 12)
        return f"<body>{menu}<article>{body}<p>{text} <a href='/x'>there</a></p><p><a href='/s'>{source}</a></p></article><p>{note}</p><p>{self.words(20, 60)}</p></body>", (*keep, f"{text} there", source)


#: Invented pages of the labelled table, of each kind.
PAGES_TRAINED = 300


@lru_cache(maxsize=2)
def labelled_pages(seed: int = 3, n: int = PAGES_TRAINED) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The labelled table: invented pages, and the texts of their content blocks. Every other block is boilerplate."""
    make = Invented(seed)
    return tuple(page for _ in range(n) for page in (make.named_page(), make.plain_page()))


def labelled_blocks(pages: Iterable[tuple[str, tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    x, y = [], []
    for page, keep in pages:
        found, kept = blocks(page), set(keep)
        x.append(features(found))
        y.append(np.array([b.text in kept for b in found]))
    return np.concatenate(x), np.concatenate(y)


@lru_cache(maxsize=1)
def trained_tree() -> DecisionTree:
    return DecisionTree(depth=9, least=5).fit(*labelled_blocks(labelled_pages()))


def main_texts(pages: list[str]) -> list[str]:
    """The content blocks of each page, joined by line ends; the tree judges the blocks of all pages at once."""
    found = [blocks(p) for p in pages]
    if not any(found):
        return [""] * len(pages)
    keep = iter((trained_tree().predict(np.concatenate([features(f) for f in found])) > 0.5).tolist())
    return ["\n".join([b.text for b in f if next(keep)]) for f in found]


def main_text(page: str) -> str:
    return main_texts([page])[0]


def extracted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            part = batch.slice(at, PAGES)
            text = main_texts(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the main text of the whole page.

    White space inside of a block becomes one space, blocks are joined by one line end. Null and empty pages,
    and pages of boilerplate alone, give an empty text. Unclosed and wrongly nested elements are closed as a
    browser would roughly do. Repeated rows give repeated rows; an empty table gives an empty table; other
    columns don't matter.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(extracted_batches, "page_id long, url string, text string, n_chars long")
