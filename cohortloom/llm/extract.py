"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into text blocks.  A classifier's log odds and what the markup
says of a block's containers are its ties to the two terminals; blocks next to
each other, and children of one element, are tied to each other the more the
nearer they are in the tree.  The minimum cut is the cheapest labelling.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import map_slices, slices, texts, typed

#: Largest move of a weight that ends the block classifier's fit.
STILL = 1e-8
#: Log odds that a container's markup adds to what lies inside.
INSIDE_ARTICLE, INSIDE_BOILERPLATE = 4.0, -8.0
#: The same of a word that may as well name a subject: text can outweigh it.
MAYBE_BOILERPLATE = -3.0
#: Tie of neighbouring blocks of one parent; each further step in the tree halves it.
TIE = 1.0

# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label
    mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot
    mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics""".split())
DROPPED = ("script", "style", "noscript", "template", "svg", "annotation-xml", "annotation", "iframe", "object", "canvas",
           "textarea", "select", "title")
BAD_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
GOOD_TAGS = frozenset("article main".split())
#: Elements that hold the content: words of their attributes tell what else is on the page.
WHOLE = GOOD_TAGS | {"html", "body"}
BAD_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo
    promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer
    masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social related recommended comment comments
    commentlist reply replies respond disqus discussion pagination pager search form copyright
    legal disclaimer toolbar skip hidden contentinfo complementary""".split())
#: Bad words that subjects share, and words that name no subject beside a bad one.
SUBJECT_WORDS = frozenset("legal social related form search discussion".split())
PLAIN_WORDS = frozenset("""area bar block body bottom box button card cell col column container content count
    end entry footer form group head header heading holder icon inner item items label left link links
    list main meta panel right row section slot start text thread title top unit wrap wrapper""".split())
GOOD_WORDS = frozenset("article articlebody content entry main post story".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>|<(?P<raw>" + "|".join(DROPPED) + r")\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/a-z][^>]*+>|[^<]+|<", re.I | re.S)
_OPENED = re.compile(r"<[!?/a-z]", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-hidden|style|hidden)\b(?:\s*=\s*"
                        r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    tag: str
    linked: int      # characters inside links
    hint: float      # log odds that the containers' markup gives
    step: int        # steps in the tree from the block before
    sibling: int     # the block before under the same parent, or -1


def _blame(name: str) -> float:
    """Log odds of one class or id: bad words count in full where the name ends in one
    or in a word that names no subject, as in site-footer and comment-list, and less
    in names like form-of-government or where the word itself may be a subject."""
    words = [w.lower() for w in _WORD.findall(name)]
    bad = BAD_WORDS.intersection([*words, name.lower()])
    if not bad:
        return 0.0
    sure = words and (words[-1] in BAD_WORDS or words[-1] in PLAIN_WORDS)
    return INSIDE_BOILERPLATE if sure and bad - SUBJECT_WORDS else MAYBE_BOILERPLATE


def _hint(tag: str, rest: str, inside: bool) -> float:
    """What an element's name and attributes say of the text inside."""
    hint = INSIDE_ARTICLE if tag in GOOD_TAGS else INSIDE_BOILERPLATE if tag in BAD_TAGS else 0.0
    if tag == "header" and not inside:
        hint = INSIDE_BOILERPLATE
    for name, value in _ATTRIBUTE.findall(rest) if rest.strip() else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" \
                or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hint += INSIDE_BOILERPLATE
        elif name in ("class", "id", "role", "itemprop"):
            words = {w.lower() for w in _WORD.findall(value)} | {value.lower()}
            if tag not in WHOLE and (words & BAD_WORDS or "header" in words and not inside):
                hint += min(map(_blame, value.split()), default=0.0) if words & BAD_WORDS else INSIDE_BOILERPLATE
            elif words & GOOD_WORDS and tag not in ("html", "body"):
                hint += INSIDE_ARTICLE / 2
    return hint


class _Page:
    """Reads a page's pieces in order and collects its blocks."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, float, bool, int]] = [("", 0.0, False, 0)]  # tag, hint, inside, number
        self.parts: list[str] = []
        self.link, self.linked = False, 0
        self.made, self.low, self.depth, self.last = 0, 1, 1, {}

    def flush(self):
        """The text since the last border, if any, as a block of the open element."""
        text = " ".join(unescape("".join(self.parts)).split())
        self.parts.clear()
        linked, self.linked = self.linked, 0
        if not text:
            return
        depth = len(self.open)
        tag, hint, _, _ = self.open[-1]
        parent = self.open[-2][3] if depth > 1 else -1
        step = (self.depth - self.low) + (depth - self.low)
        self.blocks.append(Block(text, tag, min(linked, len(text)), hint, step,
                                 self.last.get(parent, -1)))
        self.last[parent] = len(self.blocks) - 1
        self.low = self.depth = depth

    def enter(self, tag: str, rest: str):
        if tag == "p" or tag not in ("li", "dd", "dt", "td", "th", "tr", "option"):
            self.leave("p", False)
        elif self.open[-1][0] == tag:
            self.leave(tag)
        if tag not in VOID and not rest.endswith("/"):
            _, hint, inside, _ = self.open[-1]
            self.made += 1
            self.open.append((tag, hint + _hint(tag, rest, inside), inside or tag in GOOD_TAGS, self.made))

    def leave(self, tag: str, far: bool = True):
        """Close the innermost open ``tag``; unless ``far``, only if it is the open element."""
        for back in range(len(self.open) - 1, 0, -1):
            if self.open[back][0] == tag:
                del self.open[back:]
                self.low = min(self.low, back)
                break
            if not far:
                break

    def read(self, html: str) -> list[Block]:
        if _OPENED.search(html, html.rfind(">") + 1):
            html += ">"  # a tag that the page's end cuts off goes to the end
        for m in _PIECE.finditer(html):
            tag = m["tag"]
            if tag is None:
                piece = m.group()
                if m["raw"] is None and (piece == "<" or piece[0] != "<"):
                    self.parts.append(piece)
                    if self.link:
                        self.linked += len(piece)
                continue
            tag = tag.lower()
            if tag == "br":
                self.parts.append(" ")
            elif tag in INLINE:
                if tag == "a":
                    self.link = not m["close"]
            else:
                self.flush()
                if m["close"]:
                    self.leave(tag)
                    self.link = False
                else:
                    self.enter(tag, m["rest"])
        self.flush()
        return self.blocks


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles and comments have none."""
    return _Page().read(html)


def features(b: Block, place: float) -> list[float]:
    """What the classifier sees: the text itself, nothing of its containers."""
    n = len(b.text)
    return [1.0, b.linked / n, math.log1p(n) / 5, float(b.text[-1] in ".!?:\"'”»…"),
            min(b.text.count(",") / n * 50, 2.0), float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
            float(b.tag == "li"), float(b.tag in ("p", "blockquote", "pre")), float("©" in b.text),
            place, place * place]


#: Weights that pages without telling markup are judged by if there is nothing to learn from.
UNTAUGHT = np.array([-2.0, -4.0, 2.0, 1.0, 0.5, 0.5, -0.5, 1.0, -3.0, 0.0, 0.0])
UPPER = np.triu_indices(len(UNTAUGHT))


def _matrix(found: list[Block]) -> np.ndarray:
    last = max(len(found) - 1, 1)
    return np.array([features(b, i / last) for i, b in enumerate(found)])


def _moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, slope and the curvature's upper half at ``w``, one after the other; they add up."""
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    curve = (x * (p * (1 - p))[:, None]).T @ x
    return np.concatenate([[(np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), curve[UPPER]])


def newton(moments: Callable[[np.ndarray], np.ndarray], rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards ``UNTAUGHT``.

    ``moments`` gives the sums of ``_moments`` over all rows.  A step is halved until it
    lowers the loss; the fit ends with a step that moves no weight by more than ``STILL``.
    """
    n = len(UNTAUGHT)

    def at(w):
        sums = moments(w)
        curve = np.zeros((n, n))
        curve[UPPER] = sums[n + 1:]
        curve = curve + np.triu(curve, 1).T + np.eye(n)
        drawn = w - UNTAUGHT
        return sums[0] + (drawn ** 2).sum() / 2, np.linalg.solve(curve, sums[1:n + 1] + drawn)

    w = UNTAUGHT.copy()
    loss, step = at(w)
    for _ in range(rounds):
        if np.abs(step).max() <= STILL:
            break
        lower, further = at(w - step)
        if lower > loss * (1 + 1e-12):
            step = step / 2
            continue
        w, loss, step = w - step, lower, further
    return w


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights of rows that are at hand."""
    return newton(lambda w: _moments(x, y, w))


def _told(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks whose containers' markup is plain."""
    found = blocks(html)
    keep = [i for i, b in enumerate(found) if b.hint > 0 or b.hint < MAYBE_BOILERPLATE]
    if not keep:
        return np.zeros((0, len(UNTAUGHT)), np.float32), np.zeros(0, np.float32)
    return (_matrix(found)[keep].astype(np.float32),
            np.array([found[i].hint > 0 for i in keep], np.float32))


def learn(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    """Weights of the block classifier, from blocks of all pages whose containers' markup is plain.

    The blocks' features are written once; each Newton step is one job that adds up loss,
    slope and curvature over all of them, of which 78 numbers come to the driver.  The
    order of the sums shows in the last digits only, and weights are rounded above those.
    """
    def run(batches):
        for batch in slices(batches):
            told = [_told(html) for html in texts(batch, html_col)]
            yield pa.record_batch([pa.array([np.concatenate([t[i] for t in told]).tobytes()], pa.binary())
                                   for i in (0, 1)], names=["x", "y"])

    rows = cut(pages.select(html_col).mapInArrow(run, "x binary, y binary"))
    width = 1 + len(UNTAUGHT) + len(UPPER[0])

    def moments(w):
        def add(batches):
            sums = np.zeros(width)
            for batch in batches:
                for a, b in zip(batch["x"], batch["y"]):
                    x = np.frombuffer(a.as_py(), np.float32).reshape(-1, len(w)).astype(float)
                    sums += _moments(x, np.frombuffer(b.as_py(), np.float32).astype(float), w)
            yield pa.record_batch([pa.array([sums.tolist()])], names=["sums"])

        total = rows.mapInArrow(add, "sums array<double>").select(
            *[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).first()
        return np.array([v or 0.0 for v in total])

    return newton(moments).round(6)


class Network:
    """A flow network of blocks between two terminals."""

    def __init__(self, odds: list[float]):
        """Positive odds tie a block to the source, negative ones to the sink."""
        n = len(odds)
        self.source, self.sink = n, n + 1
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n + 2)]
        for i, odd in enumerate(odds):
            self.add(self.source, i, odd, 0.0) if odd > 0 else self.add(i, self.sink, -odd, 0.0)

    def add(self, a: int, b: int, there: float, back: float):
        for at, end, room in ((a, b, there), (b, a, back)):
            self.out[at].append(len(self.to))
            self.to.append(end)
            self.room.append(room)

    def levels(self) -> list[int]:
        level = [-1] * len(self.out)
        level[self.source] = 0
        queue = deque([self.source])
        while queue:
            at = queue.popleft()
            for e in self.out[at]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[at] + 1
                    queue.append(self.to[e])
        return level

    def cut(self) -> list[int]:
        """Send the greatest flow; the levels of what the source still reaches."""
        to, room, out = self.to, self.room, self.out
        while (level := self.levels())[self.sink] >= 0:
            turn, path, at = [0] * len(out), [], self.source
            while True:
                if at == self.sink:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    path, at = [], self.source
                while turn[at] < len(out[at]):
                    e = out[at][turn[at]]
                    if room[e] > 1e-12 and level[to[e]] == level[at] + 1:
                        break
                    turn[at] += 1
                else:
                    if at == self.source:
                        break
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                    continue
                path.append(e)
                at = to[e]
        return level


def content(found: list[Block], weights: np.ndarray) -> list[Block]:
    """The blocks on the source's side of the minimum cut."""
    if not found:
        return []
    odds = (np.clip(_matrix(found) @ weights, -6, 6) + [b.hint for b in found]).tolist()
    net = Network(odds)
    for i, b in enumerate(found):
        if i:
            tie = TIE * 0.5 ** max(b.step - 2, 0)
            net.add(i - 1, i, tie, tie)
        if 0 <= b.sibling < i - 1:
            net.add(b.sibling, i, TIE / 2, TIE / 2)
    level = net.cut()
    return [b for i, b in enumerate(found) if level[i] >= 0]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page: its content blocks, joined by empty lines.

    Null, empty and boilerplate-only pages have an empty text; markup that never
    ends goes to the end of the page.  Repeated rows stay; other columns are not
    read.  The classifier is learned first; each page is then cut by itself.
    """
    pages = pages.select(id_col, url_col, html_col)
    weights = learn(pages, html_col)

    def step(batch):
        found = ["\n\n".join(b.text for b in content(blocks(h), weights)) for h in texts(batch, html_col)]
        return pa.record_batch([batch.column(id_col), batch.column(url_col), pa.array(found, pa.string()),
                                pa.array([len(t) for t in found], pa.int64())],
                               names=[id_col, url_col, "text", "n_chars"])

    return map_slices(pages, lambda: step,
                      f"{typed(pages, id_col)}, {typed(pages, url_col)}, text string, n_chars long")
