"""Personal data: fixed patterns, completed by a skip-chain conditional random field.

The patterns take digits greedily and are never tried again, so they lose
entities that stand next to other numbers, or that repeat in another dress.  The
field labels the tokens of a document jointly: neighbours share a potential, and
so do distant tokens with the same letters and digits.  Tokens of a pattern's
match are observed; loopy message passing carries their labels along the edges.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_slices, serve, slices, texts, typed

KINDS = ("email", "ip", "card", "phone")
#: Labels of tokens: 0 is none, then the kinds.
LABELS = len(KINDS) + 1
#: Buckets of token features; they bound what is counted and sent to the driver.
BUCKETS = 1 << 13
#: Rounds of messages, and the share of the old message kept in each.
ROUNDS, DAMPING = 30, 0.3
#: Probability of a kind from which an unobserved token is taken.
SURE = 0.5
#: Added to every count.
SMOOTH = 0.1
#: Largest log potential of an edge.  Patterns never match certain neighbours, so
#: what they show of pairs counts as a leaning, not as a rule.
LEANING = 2.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_EDGE = ".,;:!?\"'<>[]{}|"


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ip_fits(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _card_fits(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and kind; failing ones are dropped."""
    found, free = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        low = max(free, text.rfind("@", 0, m.start()) + 1)
        local = text[low:m.start()]
        start = low + len(local.rstrip(_LOCAL))
        if start < m.start():
            free = m.end()
            found.append(Span(start, 0, free))
    found += [Span(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_fits(m.group())]
    found += [Span(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _card_fits(m.group())]
    if "+" in text:
        found += [Span(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                  if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found)


class Token(NamedTuple):
    start: int
    end: int
    text: str
    follows: bool  # only white space lies between it and the token before


def candidates(text: str) -> list[Token]:
    """Tokens with a digit or an at sign, without the punctuation around them.

    All other tokens are certain to be none, so the field falls into the runs of
    these; leaving the others out changes no probability.
    """
    found, free = [], 0
    for m in _SIGN.finditer(text):
        if m.start() < free:
            continue
        gap = text[free:m.start()]
        before = gap.rstrip()
        tail = "" if before != gap else gap.rsplit(None, 1)[-1] if gap else ""
        end = _REST.match(text, m.start()).end()
        follows = bool(found) and not gap[:len(gap) - len(tail)].strip()
        raw = tail + text[m.start():end]
        core = raw.lstrip(_EDGE)
        start = end - len(core)
        core = core.rstrip(_EDGE)
        found.append(Token(start, start + len(core), core, follows))
        free = end
    return found


def outline(token: str) -> str:
    """Runs of digits by length, letters as one sign, and which checks the whole token passes."""
    marks = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{{{m.end() - m.start()}}}", token))
    if _CARD.fullmatch(token):
        return f"card {_card_fits(token)} {marks}"
    if _IP.fullmatch(token):
        return f"ip {_ip_fits(token)}"
    at = token.find("@")
    if at > 0 and _DOMAIN.fullmatch(token, at):
        return f"email {not token[:at].strip(_LOCAL)}"
    return marks


def features(tokens: list[Token]) -> np.ndarray:
    """The bucket of each token's outline.

    What stands beside a token is left to the edges: the patterns fail just
    where certain neighbours meet, and a feature of them would learn that.
    """
    return np.array([zlib.crc32(outline(t.text).encode()) % BUCKETS for t in tokens], np.int64)


def observed(tokens: list[Token], spans: list[Span]) -> np.ndarray:
    """The label that a pattern's match gives each token; 0 where none covers it."""
    labels, at = np.zeros(len(tokens), np.int64), 0
    for i, t in enumerate(tokens):
        while at and spans[at - 1].end > t.start:
            at -= 1
        while at < len(spans) and spans[at].end <= t.start:
            at += 1
        if at < len(spans) and spans[at].start < t.end:
            labels[i] = spans[at].kind + 1
    return labels


def edges(tokens: list[Token]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbours; skip edges from each token to the next like it.

    Tokens are alike if they hold the same letters and digits.  Linking each to
    the next one keeps a group of repeats connected with one edge a token.
    """
    chain = [(i - 1, i) for i, t in enumerate(tokens) if t.follows]
    skip, seen = [], {}
    for i, t in enumerate(tokens):
        key = "".join(c for c in t.text.lower() if c.isalnum())
        if len(key) >= 6:  # short numbers repeat by chance
            if key in seen and seen[key] != i - 1:
                skip.append((seen[key], i))
            seen[key] = i
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


#: Rows of the count table: features, then pairs of chain and of skip edges.
CHAIN, SKIP = BUCKETS, BUCKETS + LABELS
CELLS = (BUCKETS + 2 * LABELS) * LABELS


def count_cells(text: str) -> Counter:
    """Cells of the count table that one text adds to."""
    cells: Counter = Counter()
    tokens = candidates(text)
    if not tokens:
        return cells
    label = observed(tokens, base_spans(text))
    cells.update((features(tokens) * LABELS + label).tolist())
    for pairs, base in zip(edges(tokens), (CHAIN, SKIP)):
        cells.update(((base + label[pairs[:, 0]]) * LABELS + label[pairs[:, 1]]).tolist())
    return cells


class Field(NamedTuple):
    """Log potentials: of each bucket, of neighbours, of tokens alike."""
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def estimate(cells: np.ndarray) -> Field:
    """Piecewise estimates: conditional logs of the features, and of each pair
    how much more often its labels meet than they would by chance.  Before
    anything is counted, equal labels are a little likelier to meet."""
    table = cells.reshape(-1, LABELS).astype(float)

    def meeting(pairs):
        pairs = pairs + pairs.T + SMOOTH + np.eye(LABELS)
        share = pairs / pairs.sum()
        alone = share.sum(axis=0)
        return np.clip(np.log(share / np.outer(alone, alone)), -LEANING, LEANING)

    prior = np.full(LABELS, SMOOTH) + np.eye(LABELS)[0]  # an outline never seen is none
    seen = table[:CHAIN] + prior
    unary = np.log(seen / seen.sum(axis=1, keepdims=True))
    return Field(unary, meeting(table[CHAIN:SKIP]), meeting(table[SKIP:]))


def learn(docs: DataFrame, text_col: str = "text") -> Field:
    """The field of all documents, counted in Spark; only the fixed cells reach the driver."""
    def run(batches):
        serve(__name__)
        for batch in slices(batches):
            cells: Counter = Counter()
            for text in texts(batch, text_col):
                cells.update(count_cells(text))
            yield pa.record_batch([pa.array(list(cells), pa.int64()),
                                   pa.array(list(cells.values()), pa.int64())], names=["cell", "n"])

    counted = docs.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell") \
        .agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(CELLS)
    for cell, n in counted:
        cells[cell] = n
    return estimate(cells)


def marginals(field: Field, tokens: list[Token], label: np.ndarray) -> np.ndarray:
    """Label probabilities of each token by loopy sum-product messages."""
    unary = field.unary[features(tokens)]
    unary[label > 0] = np.where(np.arange(LABELS) == label[label > 0, None], 0.0, -50.0)
    chain, skip = edges(tokens)
    ends = np.concatenate([chain, skip])
    potential = np.exp(np.concatenate([np.broadcast_to(p, (len(e), LABELS, LABELS))
                                       for p, e in ((field.chain, chain), (field.skip, skip))]))
    source = np.concatenate([ends[:, 0], ends[:, 1]])
    target = np.concatenate([ends[:, 1], ends[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.roll(np.arange(len(source)), len(ends))  # the message the other way
    messages = np.zeros((len(source), LABELS))
    belief = unary
    for _ in range(ROUNDS if len(source) else 0):
        out = belief[source] - messages[back]
        out -= out.max(axis=1, keepdims=True)
        fresh = np.log(np.einsum("el,elm->em", np.exp(out), potential) + 1e-300)
        fresh -= fresh.max(axis=1, keepdims=True)
        fresh = DAMPING * messages + (1 - DAMPING) * fresh
        moved = np.abs(fresh - messages).max()
        messages, belief = fresh, unary.copy()
        np.add.at(belief, target, messages)
        if moved < 1e-4:
            break
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def spans_of(field: Field, text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, all spans) of a text, by start and kind.

    An added span covers a run of neighbouring tokens of one kind; it never
    overlaps a pattern's span.
    """
    base = base_spans(text)
    tokens = candidates(text)
    if not tokens:
        return base, base
    label = observed(tokens, base)
    if label.all():
        return base, base
    chances = marginals(field, tokens, label)
    best = chances.argmax(axis=1)
    added: list[Span] = []
    for i, t in enumerate(tokens):
        if label[i] or not best[i] or chances[i, best[i]] < SURE:
            continue
        kind = int(best[i]) - 1
        if added and t.follows and added[-1].end == tokens[i - 1].end and added[-1].kind == kind:
            added[-1] = added[-1]._replace(end=t.end)
        else:
            added.append(Span(t.start, kind, t.end))
    return base, sorted([*base, *added])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every whole text: arrays of struct (kind, start, end).

    ``base`` holds the fixed patterns' matches, ``spans`` these and what the
    field adds; positions are code points, the end is exclusive.  Null and empty
    texts have none; other columns are not read; repeated rows stay.  The field
    is learned from all of ``docs`` first; nothing but its counts is shuffled.
    """
    docs = docs.select(id_col, text_col)
    field = learn(docs, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def step(batch):
        pairs = [spans_of(field, t) for t in texts(batch, text_col)]
        columns = [pa.array([[(KINDS[s.kind], s.start, s.end) for s in p[n]] for p in pairs], kind)
                   for n in (0, 1)]
        return pa.record_batch([batch.column(id_col), *columns], names=[id_col, "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return map_slices(docs, lambda: step, f"{typed(docs, id_col)}, base {spans}, spans {spans}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlaps merge."""
    parts, free = [], 0
    for s in spans:
        if s.start >= free:
            parts += [text[free:s.start], f"<{KINDS[s.kind]}>"]
        free = max(free, s.end)
    return "".join([*parts, text[free:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced in the text; null stays null.

    Where a text changes, its length in ``chars_col`` follows, if there is such a column.
    """
    names, field = docs.columns, learn(docs, text_col)
    at = names.index(text_col)
    sized = names.index(chars_col) if chars_col in names else None

    def step(batch):
        old = batch.column(at).to_pylist()
        new = [None if t is None else redacted(t, spans_of(field, t)[1]) for t in old]
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.string())
        if sized is not None:
            sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(sized).to_pylist(), old, new)]
            columns[sized] = pa.array(sizes, batch.column(sized).type)
        return pa.record_batch(columns, names=names)

    return map_slices(docs, lambda: step, ", ".join(typed(docs, c) for c in names))
