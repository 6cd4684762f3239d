"""Main text of web pages, block by block.

A page is cut into flat blocks of text at block-level tags. A block has its word count, its
link density (share of words inside links), both of the block before and after, and two
marks: whether it lies in an element named as main text or in an article, and whether it or
an element around it is named or typed as something else (menu, footer, advert, comment,
form ...). A decision tree, grown from the labelled blocks below, tells main text from the
rest. The second mark is not taken from body, from words of main or article, from classes of
state (``has-sidebar``) or from a heading's id, and an article or main within a marked
element that is neither comments nor hidden does not inherit it. Within an article a name
counts by its last word that is not one for a piece of a part (``share-bar``, but not
``share-price``), and links are text unless they are marked.

Defined results: a null page, a page without text or without main text has an empty text.
Unclosed tags, attributes with ``>`` in quotes and cut-off character references are read
the way browsers read them: ``head`` needs no end tag, a self-closed ``svg`` or ``math`` is
empty, and an open element without text ends with the element around it. Repeated rows give repeated results. Only ``page_id``, ``url``
and ``html`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callglass.llm.words import mapped, small_batches

# HTML's element names by what they mean for text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = set("address article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table td tr ul".split())
MAIN = {"article", "main"}
OTHER = {"aside", "dialog", "fieldset", "footer", "form", "menu", "nav"}
#: Elements whose content is no markup: it ends at the element's end tag only.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in "iframe noembed noframes noscript script style textarea title".split()}
#: Elements with markup of no text of the page. They end at their end tag or at that of an element around them, which those in FENCES do not let through.
UNSEEN = set("audio button canvas math object select svg template video".split())
FOREIGN, INNER = {"svg", "math"}, set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
FENCES = {"object", "select", "template"} | INNER
#: Start tags that end an open svg or math, as HTML says, and those that end a select.
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup "
    "table tt u ul var article aside footer header main nav section".split()
)
AFTER_SELECT = set("select input textarea table caption tbody tfoot thead tr td th".split())
# Words in class, id and role by which pages name their parts.
OTHER_WORDS = set(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer "
    "disqus discussion footer gdpr hidden login masthead menu meta modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup "
    "promo promoted promotion reader recommended related replies reply respond search share sharebar sharing sidebar signin signup skip social sponsor sponsored subscribe "
    "subscription taboola tags teaser thread threads toolbar topbar widget widgets contentinfo complementary".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus discussion replies reply respond thread threads".split())
#: Words that say which piece of a part it is (share-bar, ad-slot), so that the word before them tells what the part is.
PIECE_WORDS = set(
    "area article articles bar block body bottom box btn button buttons center code col column container content cta field form frame group header heading holder icon icons "
    "image img info inner input item items label left line link links list main media me module more news now outer panel posts region right row section sections slot space "
    "stories strip text this title today top unit us wrap wrapper zone".split()
)
#: Class words that tell a state of a page or part (has-sidebar, comments-open), not what it is.
STATE = re.compile(r"^(?:has|no|not|with|without)(?=[-_A-Z])|[-_](?:open|opened|closed|enabled|disabled|on|off)$")
#: Marks of a part that is something else: by its name or words, a form, comments, hidden.
NAMED_OTHER, FORM, COMMENT, HIDDEN = 1, 2, 4, 8
#: In place of the number of marked containers around it: an article named a comment.
COMMENTS = 1 << 30
MAIN_WORDS = set("article articlebody content entry main post story".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\s*/?\s*[^\s\"'>/=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?)*?)\s*/?>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# The labelled table: words, link density, both before, both after, in an element named as main text (1) or an article (2), named as other; main text or not.
LABELLED = np.array([
    # menus, breadcrumbs, lists of links
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0), (4, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (6, 1.0, 6, 1.0, 7, 1.0, 1, 0, 0), (9, 1.0, 40, 0.0, 8, 1.0, 1, 0, 0), (12, 0.8, 9, 1.0, 11, 0.9, 0, 0, 0), (20, 0.7, 12, 0.8, 5, 1.0, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (3, 1.0, 2, 1.0, 50, 0.0, 0, 1, 0), (2, 1.0, 80, 0.0, 2, 1.0, 1, 1, 0), (7, 1.0, 7, 1.0, 7, 1.0, 0, 1, 0),
    # adverts, notices, side columns, forms, comments, footers
    (8, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0), (30, 0.0, 1, 1.0, 50, 0.0, 0, 1, 0), (60, 0.1, 40, 0.0, 40, 0.0, 1, 1, 0), (5, 0.0, 90, 0.0, 4, 0.0, 1, 1, 0),
    (25, 0.0, 30, 0.0, 20, 0.0, 0, 1, 0), (120, 0.0, 15, 0.0, 80, 0.0, 0, 1, 0), (14, 0.2, 100, 0.0, 0, 0.0, 0, 1, 0), (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0),
    (9, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0), (45, 0.0, 4, 0.5, 44, 0.0, 1, 1, 0), (1, 0.0, 120, 0.0, 30, 0.0, 1, 1, 0), (200, 0.0, 50, 0.0, 150, 0.0, 1, 1, 0),
    # unnamed remains: dates, copyright lines, labels of forms
    (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0), (5, 0.4, 4, 1.0, 3, 1.0, 0, 0, 0), (6, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0), (7, 0.3, 5, 0.5, 6, 0.0, 0, 0, 0), (5, 0.0, 4, 0.0, 5, 0.0, 0, 0, 0), (8, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0),
    # paragraphs and headings in an element for main text
    (1, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (2, 0.0, 1, 0.0, 70, 0.0, 1, 0, 1), (4, 0.0, 8, 0.0, 0, 0.0, 1, 0, 1),
    (12, 0.0, 30, 0.0, 90, 0.0, 1, 0, 1), (80, 0.0, 10, 0.0, 2, 0.0, 1, 0, 1), (300, 0.02, 50, 0.0, 60, 0.0, 1, 0, 1), (10, 0.0, 6, 1.0, 50, 0.0, 1, 0, 1),
    (25, 0.2, 40, 0.0, 30, 0.1, 1, 0, 1), (3, 0.0, 0, 0.0, 3, 0.0, 1, 0, 1), (9, 0.3, 30, 0.0, 50, 0.0, 1, 0, 1), (50, 0.0, 8, 1.0, 12, 0.0, 1, 0, 1),
    (2, 0.0, 90, 0.0, 7, 1.0, 1, 0, 1), (6, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1), (15, 0.4, 70, 0.0, 5, 0.0, 1, 0, 1), (1, 0.0, 3, 1.0, 1, 0.0, 1, 0, 1),
    # the same on pages whose body, article or wrapper has a state or a form's name, and headings named like other parts
    (14, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1), (2, 0.0, 40, 0.0, 60, 0.0, 1, 0, 1), (4, 0.0, 60, 0.0, 25, 0.0, 1, 0, 1), (1, 0.0, 25, 0.0, 14, 0.0, 1, 0, 1),
    (70, 0.1, 4, 0.0, 3, 0.0, 1, 0, 1), (5, 0.0, 2, 1.0, 3, 1.0, 1, 0, 1), (2, 0.0, 70, 0.0, 40, 0.0, 1, 1, 0), (40, 0.0, 2, 0.0, 3, 0.0, 1, 1, 0),
    # in an article: paragraphs that are one link, lists of linked sources, and what is named as other there
    (7, 1.0, 60, 0.0, 40, 0.0, 2, 0, 1), (5, 1.0, 6, 1.0, 7, 1.0, 2, 0, 1), (2, 1.0, 1, 1.0, 3, 1.0, 2, 0, 1), (12, 0.8, 9, 1.0, 0, 0.0, 2, 0, 1),
    (9, 1.0, 0, 0.0, 0, 0.0, 2, 0, 1), (40, 0.0, 30, 0.0, 20, 0.0, 2, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 2, 0, 1), (5, 0.5, 4, 1.0, 3, 1.0, 2, 0, 1),
    (30, 0.0, 40, 0.0, 30, 0.0, 2, 1, 0), (3, 1.0, 2, 1.0, 4, 1.0, 2, 1, 0), (1, 0.0, 90, 0.0, 2, 0.0, 2, 1, 0), (12, 0.2, 30, 0.0, 0, 0.0, 2, 1, 0),
    # one link between paragraphs of a part named as main text
    (7, 1.0, 60, 0.0, 40, 0.0, 1, 0, 1), (8, 1.0, 30, 0.0, 12, 0.1, 1, 0, 1),
    # pages of one short block, one of marks alone
    (0, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (8, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0),
    # pages without such an element
    (40, 0.0, 30, 0.0, 60, 0.0, 0, 0, 1), (90, 0.05, 3, 1.0, 70, 0.0, 0, 0, 1), (25, 0.0, 50, 0.0, 4, 0.0, 0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (18, 0.1, 40, 0.0, 30, 0.0, 0, 0, 1), (5, 0.0, 60, 0.0, 80, 0.0, 0, 0, 1), (1, 0.0, 50, 0.0, 45, 0.0, 0, 0, 1), (9, 0.0, 2, 1.0, 70, 0.0, 0, 0, 1),
    (12, 0.0, 40, 0.0, 35, 0.1, 0, 0, 1), (35, 0.2, 60, 0.1, 2, 1.0, 0, 0, 1), (3, 0.0, 30, 0.0, 55, 0.0, 0, 0, 1), (60, 0.0, 9, 0.0, 6, 0.0, 0, 0, 1),
])


class Tree:
    """Binary splits that lower the Gini impurity most; leaves hold the more frequent label."""

    def __init__(self, rows: np.ndarray, depth: int = 8) -> None:
        label = rows[:, -1]
        self.answer, self.split = bool(label.mean() > 0.5), None
        if depth == 0 or len(set(label.tolist())) < 2:
            return
        best = None
        for column in range(rows.shape[1] - 1):
            values = np.unique(rows[:, column])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, column] < cut
                cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (label[low], label[~low]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, column, cut)
        if best is not None:
            low = rows[:, best[1]] < best[2]
            self.split, self.low, self.high = best[1:], Tree(rows[low], depth - 1), Tree(rows[~low], depth - 1)

    def __call__(self, features: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(features), self.answer)
        column, cut = self.split
        return np.where(features[:, column] < cut, self.low(features), self.high(features))


def told(token: str, inner: bool) -> set[str]:
    """Words of a class, id or role that say what a part is.

    Within an article only the last word does that is not a piece of a part: ``share-bar`` is
    for sharing, ``share-price`` is a price.
    """
    found = [w.lower() for w in WORD.findall(token)]
    if not inner:
        return set(found)
    while found and (found[-1] in PIECE_WORDS or found[-1].isdigit() or len(found[-1]) == 1):
        found.pop()
    return set(found[-1:])


@lru_cache(65_536)
def marks(name: str, rest: str, inner: bool = False) -> tuple[bool, int]:
    """Whether a start tag says main text, and the marks by which it says something else.

    Body and html have no marks. Words mark neither main nor article, except that an article
    may be named a comment (see ``judged``). An id marks a container only, as that of a
    heading or paragraph is made from its text. ``inner`` tells that it lies in an article or main.
    """
    main, other = name in MAIN, (FORM if name in ("form", "fieldset") else NAMED_OTHER) if name in OTHER else 0
    if name in ("html", "body"):
        return main, other
    for key, value in NAMED.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            other |= HIDDEN
        elif name in MAIN:
            if name == "article" and key == "class" and COMMENT_WORDS & set(value.lower().split()):
                other |= COMMENT
        elif key in ("class", "role") or key == "id" and name in CONTAINERS:
            found = {w for token in value.split() if not STATE.search(token) for w in told(token, inner)}
            if found & OTHER_WORDS:
                other |= COMMENT if found & COMMENT_WORDS else NAMED_OTHER
            elif found & MAIN_WORDS:
                main = True
    return main, other


class Part(NamedTuple):
    """An open container: what it and those around it say."""

    name: str = ""
    main: bool = False
    other: int = 0
    #: Marked containers around it; whether it lies in an article or main, and the marked containers around the innermost of them.
    marked: int = 0
    inner: bool = False
    level: int = 0


def inside(part: Part, name: str, rest: str) -> Part:
    """The part that a container's start tag opens."""
    main, other = marks(name, rest, part.inner)
    if name == "header" and not part.main:  # of the page; an article's own header holds its heading
        other |= NAMED_OTHER
    marked = part.marked + bool(other & (NAMED_OTHER | FORM))
    if name in MAIN:  # marks of what is around it are those of a wrapper, unless it is a comment or hidden
        level = COMMENTS if other & COMMENT or part.level == COMMENTS else part.marked
        return Part(name, True, part.other & (COMMENT | HIDDEN) | other & ~COMMENT, marked, True, level)
    return Part(name, part.main or main, part.other | other, marked, part.inner, part.level)


class Unseen:
    """The open elements from the outermost unseen one inwards."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, int]] = []  # name, whether markup in it is that of svg or math, place of the last fence
        self.places: dict[str, list[int]] = {}

    def __bool__(self) -> bool:
        return bool(self.open)

    @property
    def foreign(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    @property
    def fence(self) -> int:
        return self.open[-1][2] if self.open else -1

    @property
    def in_select(self) -> bool:
        return self.fence >= 0 and self.open[self.fence][0] == "select"

    def place(self, name: str) -> int:
        return (self.places.get(name) or [-1])[-1]

    def push(self, name: str) -> None:
        foreign = name in FOREIGN or self.foreign and name not in INNER and name not in UNSEEN
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, foreign, len(self.open) if name in FENCES else self.fence))

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop()[0]].pop()

    def break_out(self) -> None:
        while self.foreign:
            self.cut(len(self.open) - 1)

    def start(self, name: str, empty: bool) -> bool:
        """Reads a start tag; whether it is unseen itself."""
        foreign = self.foreign
        if foreign and name in BREAKOUT:
            self.break_out()
            foreign = False
        elif self.in_select and name in AFTER_SELECT:
            self.cut(self.fence)
            if name == "select":  # HTML reads it as the end tag
                return True
        elif name == "button" and self.place("button") > self.fence:
            self.cut(self.place("button"))
        if not self.open and name not in UNSEEN:
            return False
        inside = name in UNSEEN or (name in INNER if foreign else name in BLOCKS and name not in ("p", "hr"))
        if inside and not (empty and (foreign or name in FOREIGN)):
            self.push(name)
        return True

    def end(self, name: str, around: list[tuple]) -> bool:
        """Reads an end tag; whether it is unseen itself."""
        if self.foreign and name in ("p", "br"):
            self.break_out()
        elif self.place(name) >= max(self.fence, 0):
            self.cut(self.place(name))
            return True
        elif self.in_select and name in AFTER_SELECT and any(a[0] == name for a in around):
            self.cut(self.fence)
        elif name in BLOCKS and name != "p" and self.fence < 0 and (name not in CONTAINERS or any(a[0] == name for a in around)):
            self.cut(0)
        return bool(self.open)


def blocks(html: str) -> list[tuple[str, int, int, int, bool]]:
    """Text, words, words in links, in an element named as main text (1) or in an article or main (2), named as other: of each block of a page, in order."""
    out: list[tuple[str, int, int, Part, int]] = []
    around = [Part()]
    pieces: list[str] = []
    linked: list[str] = []
    own, in_link = 0, False
    unseen = Unseen()

    def close() -> None:
        nonlocal own
        if pieces:
            words = unescape("".join(pieces)).split()
            if words:
                said = len(words) if any(map(str.isalnum, chain.from_iterable(words))) else 0  # marks alone say nothing
                out.append((" ".join(words), said, len(unescape(" ".join(linked)).split()), around[-1], around[-1].other | own))
            pieces.clear()
            linked.clear()
        own = 0

    at = 0
    while tag := TAG.search(html, at):
        if tag.start() > at and not unseen:
            text = html[at : tag.start()]
            pieces.append(text)
            if in_link:
                linked.append(text)
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name, end = name.lower(), bool(tag["end"])
        empty = "/" in html[tag.end("rest") : at]
        if name in RAW and not end and not unseen.foreign:
            if name == "textarea":
                unseen.start(name, False)
            stop = RAW[name].search(html, at)
            at = stop.end() if stop else len(html)
        elif (unseen or name in UNSEEN and not end) and (unseen.end(name, around) if end else unseen.start(name, empty)):
            continue
        elif name == "a":
            in_link = not end
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            close()
            in_link = False
            if name in CONTAINERS:
                if end:
                    for k in range(len(around) - 1, 0, -1):
                        if around[k].name == name:
                            del around[k:]
                            break
                else:
                    around.append(inside(around[-1], name, tag["rest"]))
            elif not end:
                own = marks(name, tag["rest"], around[-1].inner)[1]
    if at < len(html) and not unseen:
        pieces.append(html[at:])
        if in_link:
            linked.append(html[at:])
    close()
    return judged(out)


def judged(found: list[tuple[str, int, int, Part, int]]) -> list[tuple[str, int, int, int, bool]]:
    """Weighs a page's parts against each other.

    Articles in marked containers (related articles, say) are main text unless articles in
    fewer marked containers have more text. Articles named comments are main text only if
    the page has no others (an opinion). A form that has more text than all else unmarked is
    a wrapper of the page.
    """
    text: dict[int, int] = {}
    for _, words, linked, part, other in found:
        if part.inner and not other:
            text[part.level] = text.get(part.level, 0) + words - linked
    most = max(text, key=lambda level: (level < COMMENTS, text[level], -level), default=0)
    others = [other or (NAMED_OTHER if part.inner and part.level > most else 0) for _, _, _, part, other in found]
    plain, form = (sum(words - linked for (_, words, linked, _, _), other in zip(found, others) if other == kind) for kind in (0, FORM))
    wrapper = form > plain
    return [(t, words, linked, part.main + part.inner, bool(other) and not (wrapper and other == FORM)) for (t, words, linked, part, _), other in zip(found, others)]


def features(words: np.ndarray, linked: np.ndarray, main: np.ndarray, other: np.ndarray, page: np.ndarray) -> np.ndarray:
    density = np.minimum(linked / np.maximum(words, 1), 1.0)
    same = page[1:] == page[:-1]
    columns = [words, density]
    for step in (1, -1):
        for x in (words, density):
            near = np.zeros(len(x))
            if step == 1:
                near[1:] = np.where(same, x[:-1], 0)
            else:
                near[:-1] = np.where(same, x[1:], 0)
            columns.append(near)
    return np.stack([*columns, main, other], 1).astype(float)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = Tree(LABELLED)
    for batch in batches:
        found = [blocks(h or "") for h in batch.column("html").to_pylist()]
        flat = [b for page in found for b in page]
        texts: list[list[str]] = [[] for _ in found]
        if flat:
            page = np.repeat(np.arange(len(found)), [len(p) for p in found])
            text, *rest = zip(*flat)
            keep = tree(features(*map(np.array, rest), page))
            for k in np.flatnonzero(keep).tolist():
                texts[page[k]].append(text[k])
        joined = ["\n".join(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(joined, pa.string()), pa.array(list(map(len, joined)), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    small_batches(pages.sparkSession, 250)
    return mapped(pages.select("page_id", "url", "html"), extract, "page_id long, url string, text string, n_chars long")
