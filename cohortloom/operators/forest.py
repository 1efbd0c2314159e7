"""A grid of random forests from a few deep ones.

Points of a grid that differ in the number of trees, the greatest depth or the
least node to be split ask for parts of one forest: its first trees, cut off at
a depth or at small nodes.  Random choices depend on the seed, the tree and the
place in it, not on these settings, so the parts are what separate fits give.
What is left to be grown goes to tasks by (node, fold, settings, trees); they
return votes of the held-out samples, which are added up in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import map_array, put_array, shared_uri

#: What makes another forest of a point, with the value where the point names none.
GROWN = {"criterion": "gini", "max_features": None, "class_weight": None, "min_samples_leaf": 1}
#: What asks for a part of a forest.
CUT = {"max_depth": None, "min_samples_split": 2}
TREES = 100
#: Bytes of a node's vectors up to which tasks grow its trees; Spark ML's forests have no such bound.
GROUP_BYTES = 64 << 20
#: Rows of trees that are grown at once: enough to make up for a step's fixed cost, few enough for a core's cache.
AT_ONCE = 1 << 16
#: Rows that are weighed at once, of all probes together: few enough for a core's cache.
WEIGHED = 1 << 16
#: Deepest level; a depth of none means this.
DEEPEST = 30
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Tree(NamedTuple):
    """Nodes of a tree, level by level; a leaf's children are itself."""
    depth: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    samples: np.ndarray  # distinct ones
    weights: np.ndarray  # by class


def gains(left: np.ndarray, total: np.ndarray, criterion: str) -> np.ndarray:
    """How well a split parts the classes, up to what does not depend on the split.

    ``left`` has the weights of the left side by class on its last axis.
    """
    right = total - left
    if criterion == "gini":
        return sum((s * s).sum(-1) / np.maximum(s.sum(-1), 1e-300) for s in (left, right))
    return sum((s * np.log(np.maximum(s, 1e-300))).sum(-1) - (t := s.sum(-1)) * np.log(np.maximum(t, 1e-300))
               for s in (left, right))


def wanted_features(number, of: int) -> int:
    """How many probes a node looks at."""
    named = {None: of, "all": of, "sqrt": int(of ** 0.5), "log2": int(np.log2(max(of, 1)))}
    return max(1, named[number] if number in named else int(number))


def side_gain(counts: list[np.ndarray], criterion: str, table: np.ndarray | None, room: np.ndarray) -> np.ndarray:
    """What one side adds to ``gains``: an array per class, which numpy adds up much faster than a
    short last axis.

    ``counts`` are whole; ``table`` has n * log(n) of them; ``room`` holds three rows of floats
    to work in, of which the first is the answer.
    """
    part, whole, own = room
    if criterion == "gini":
        for c, n in enumerate(counts):
            np.copyto(own if c else whole, n)
            if c:
                whole += own
                own *= own
                part += own
            else:
                np.multiply(whole, whole, out=part)
        return np.divide(part, np.maximum(whole, 1e-300, out=whole), out=part)
    size = counts[0].copy()
    weighed(counts[0], table, part)
    for n in counts[1:]:
        part += weighed(n, table, own)
        size += n
    return np.subtract(part, weighed(size, table, own), out=part)


def weighed(s: np.ndarray, table: np.ndarray | None, out: np.ndarray | None = None) -> np.ndarray:
    """s * log(s), zero at zero."""
    if table is not None:
        return table.take(s, out=out, mode="clip")
    return np.multiply(s, np.log(np.maximum(s, 1e-300)), out=out)


def parted_gains(left: list[np.ndarray], total: list[np.ndarray], criterion: str) -> np.ndarray:
    """``gains`` with an array per class, of any weights."""
    sides = []
    for side in (left, [t - s for s, t in zip(left, total)]):
        whole = side[0].copy()
        for s in side[1:]:
            whole += s
        if criterion == "gini":
            part = side[0] * side[0]
            for s in side[1:]:
                part += s * s
            part /= np.maximum(whole, 1e-300, out=whole)
        else:
            part = weighed(side[0], None)
            for s in side[1:]:
                part += weighed(s, None)
            part -= weighed(whole, None)
        sides.append(part)
    sides[0] += sides[1]
    return sides[0]


class Ranks(NamedTuple):
    """Places of rows in the order of each probe's distinct values."""
    of: np.ndarray  # probes by rows
    values: np.ndarray  # of all probes, one after the other
    firsts: np.ndarray  # where a probe's values begin


def ranked(x: np.ndarray) -> Ranks:
    of, values = np.empty((x.shape[1], len(x)), np.uint32), []
    for probe in range(x.shape[1]):
        found, of[probe] = np.unique(x[:, probe], return_inverse=True)
        values.append(found)
    sizes = np.array([len(v) for v in values])
    return Ranks(of, np.concatenate(values), np.cumsum(sizes) - sizes)


class Level(NamedTuple):
    """The open nodes of a level: rows node by node, and their ranks and packed weights by row."""
    members: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    ranks: np.ndarray
    words: list[np.ndarray]
    total: np.ndarray  # weights by class and node
    tree: np.ndarray


class How(NamedTuple):
    """What splits go by; ``share`` classes to a packed word, ``field`` bits each."""
    number: int
    least: int
    criterion: str
    table: np.ndarray | None
    share: int
    field: int


def grow(x: np.ndarray, y: np.ndarray, weights: np.ndarray, classes: int, settings: dict, key: int) -> Tree:
    """One tree on rows with positive weight."""
    return grow_all(x, y, [(np.arange(len(y)), weights, key)], classes, settings)[0]


def grow_all(x: np.ndarray | None, y: np.ndarray, draws: list[tuple[np.ndarray, np.ndarray, int]], classes: int,
             settings: dict, order: Ranks | None = None) -> list[Tree]:
    """A tree for each (rows, their positive weights, key), grown level by level, all at once.

    All nodes of a level are split at once.  Where weights are whole, a node's rows are
    sorted for the probes that it looks at only: node, rank of the value and row are one
    number.  Weights of all classes are fields of another, whose running sums wrap around
    and are exact again once the node's start is taken off.  Sums of other weights depend on
    their order; they are summed over all rows of a tree's level, sorted for every probe.
    """
    order = ranked(x) if order is None else order
    probes, least = len(order.of), int(settings["min_samples_leaf"])
    number = wanted_features(settings["max_features"], probes)
    rows, weights = (np.concatenate([d[n] for d in draws]) for n in (0, 1))
    sizes = np.array([len(d[0]) for d in draws])  # of the open nodes; the roots first
    most = max(int(d[1].sum()) for d in draws)
    exact = bool((weights == np.floor(weights)).all()) and weights.sum() < 1 << 52
    field = most.bit_length()  # bits that hold any sum within a tree
    how = How(number, least, settings["criterion"], None, max(1, 64 // field), field)
    if exact:
        words = packed(y[rows], weights.astype(np.uint64), classes, how)
        if how.criterion != "gini":
            how = how._replace(table=weighed(np.arange(most + 1, dtype=float), None) if most < 1 << 24 else None)
    else:
        spread = np.zeros((classes, len(rows)))
        spread[y[rows], np.arange(len(rows))] = weights
        words = list(spread)
    every = number >= probes or not exact  # whether rows are kept sorted for every probe
    ranks = order.of.take(rows, axis=1)
    members = np.arange(len(rows))
    salts = mixed((np.arange(probes).astype(np.uint64) + np.uint64(1)) * _MIX[0])
    place = np.array([d[2] for d in draws], np.uint64)  # names each open node by its way from the root
    tree, ids, made = np.arange(len(draws)), np.zeros(len(draws), int), np.ones(len(draws), int)
    parents = np.zeros(len(draws), int)
    whole = Sorted.of(ranks, np.repeat(tree, sizes), tree) if every else None
    parts: list[tuple] = []
    for depth in range(DEEPEST + 1):
        starts = np.cumsum(sizes) - sizes
        if exact:
            total = unpacked([np.add.reduceat(w.take(members), starts) for w in words], classes, how)
        else:
            whole = whole.joined(starts, sizes) if depth else whole
            total = np.add.reduceat(spread[:, whole.rows[0]], starts, axis=1)
        level = Level(members, starts, sizes, ranks, words, total, tree)
        feature, cut, below = np.full(len(sizes), -1), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        if depth < DEEPEST:
            open_ = np.flatnonzero(((total > 0).sum(axis=0) > 1) & (sizes >= 2 * max(least, 1)))
            if not exact:
                top, on, low, high = whole.weighted_best(level, open_, place[open_], salts, how)
            elif every:
                whole = whole.kept(open_, sizes)
                top, on, low, high = whole.best(level, open_, how)
            else:
                top, on, low, high = best_splits(level, open_, place[open_], salts, how)
            found = top > -np.inf
            at, on = open_[found], on[found]
            feature[at], below[at] = on, low[found]
            lower, upper = order.values[order.firsts[on] + low[found]], order.values[order.firsts[on] + high[found]]
            middle = lower + (upper - lower) / 2
            cut[at] = np.where(middle < upper, middle, lower)
        left = feature >= 0
        split = np.bincount(tree[left], minlength=len(draws))
        earlier = (np.cumsum(split) - split)[tree]  # split nodes of this level in the trees before
        child = np.where(left, made[tree] + 2 * (np.cumsum(left) - 1 - earlier), ids)
        parts.append((tree, np.full(len(ids), depth), np.where(left, feature, 0), cut, child, child + left, parents,
                      sizes, total.T.astype(float)))
        if not left.any():
            break
        # Rows of split nodes go on, those of a node's left child first.
        wide = 2 * int(left.sum())
        node = np.repeat(np.arange(len(sizes)), sizes)
        goes_on = left[node]
        members, node = members[goes_on], node[goes_on]
        right = ranks[feature[node], members] > below[node]
        if every:
            side = np.zeros(len(rows), np.uint8)
            side[members] = 1 + right
            whole = whole.split(left, side)
        goes = 2 * (np.cumsum(left) - 1)[node] + right
        sizes = np.bincount(goes, minlength=wide)
        members = members[np.argsort(goes.astype(np.uint16) if wide < 1 << 16 else goes, kind="stable")]
        place = mixed(np.repeat(place[left], 2) * _MIX[0] + np.tile(np.array([1, 2], np.uint64), int(left.sum())))
        parents, tree = np.repeat(ids[left], 2), np.repeat(tree[left], 2)
        ids = np.stack([child[left], child[left] + 1], axis=1).ravel()
        made = made + 2 * split
    owner, *columns = (np.concatenate(c) for c in zip(*parts))
    by_tree = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(draws)))[:-1]
    return [Tree(*c) for c in zip(*(np.split(c[by_tree], ends) for c in columns))]


def packed(kind: np.ndarray, weights: np.ndarray, classes: int, how: How) -> list[np.ndarray]:
    """Words with a row's weight in the field of its class."""
    words = []
    for first in range(0, classes, how.share):
        own = (kind >= first) & (kind < first + how.share)
        words.append(np.where(own, weights << np.where(own, (kind - first) * how.field, 0).astype(np.uint64), np.uint64(0)))
    return words


def unpacked(words: list[np.ndarray], classes: int, how: How) -> np.ndarray:
    """Weights by class out of packed words."""
    mask = np.uint64((1 << how.field) - 1)
    return np.stack([(words[c // how.share] >> np.uint64(c % how.share * how.field) & mask).astype(np.int64)
                     for c in range(classes)])


class Sorted(NamedTuple):
    """Rows of nodes sorted for every probe."""
    nodes: np.ndarray  # in the order in which their rows come
    rows: np.ndarray  # probes by rows

    @classmethod
    def of(cls, ranks: np.ndarray, own: np.ndarray, nodes: np.ndarray) -> Sorted:
        bits = len(nodes).bit_length(), int(ranks.max(initial=0)).bit_length(), len(own).bit_length()
        rows = np.arange(len(own))
        return cls(nodes, np.stack([by_rank(own, r, rows, *bits)[1] for r in ranks]))

    def split(self, left: np.ndarray, side: np.ndarray) -> Sorted:
        """The children of the nodes that are split, all left ones first; a row's side is 1, 2 or, if it stays, 0."""
        child = 2 * (np.cumsum(left) - 1)[self.nodes[left[self.nodes]]]
        goes = side[self.rows]
        return Sorted(np.concatenate([child, child + 1]), np.concatenate(
            [self.rows[goes == n].reshape(len(goes), -1) for n in (1, 2)], axis=1))

    def places(self, wanted: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the rows of the nodes at these positions are."""
        own = sizes[self.nodes]
        starts, wide = (np.cumsum(own) - own)[wanted], own[wanted]
        return np.arange(wide.sum()) + np.repeat(starts - (np.cumsum(wide) - wide), wide)

    def kept(self, open_: np.ndarray, sizes: np.ndarray) -> Sorted:
        """Only open nodes and their rows."""
        if len(open_) == len(self.nodes):
            return self
        held = np.zeros(len(sizes), bool)
        held[open_] = True
        wanted = np.flatnonzero(held[self.nodes])
        return Sorted(self.nodes[wanted], self.rows.take(self.places(wanted, sizes), axis=1))

    def joined(self, starts: np.ndarray, sizes: np.ndarray) -> Sorted:
        """Nodes in their own order."""
        wanted = np.argsort(self.nodes, kind="stable")
        return Sorted(self.nodes[wanted], self.rows.take(self.places(wanted, sizes), axis=1))

    def best(self, level: Level, open_: np.ndarray, how: How) -> tuple[np.ndarray, ...]:
        """(gain, probe, ranks below and above) of the best split of each open node; of equal gains the first probe's."""
        out = np.full((4, len(level.sizes)), -np.inf)
        of, here = np.arange(len(self.rows)), self.nodes
        if len(here):
            found = weigh(level, np.repeat(of, len(here)), np.tile(here, len(of)), how, self.rows.ravel())
            gain, low, high, _ = found.reshape(4, len(of), len(here))
            first, at = gain.argmax(axis=0), np.arange(len(here))
            out[:, here] = gain[first, at], first, low[first, at], high[first, at]
        top, *rest = out[:, open_]
        return top, *(np.maximum(r, 0).astype(np.int64) for r in rest)

    def weighted_best(self, level: Level, open_: np.ndarray, place: np.ndarray, salts: np.ndarray,
                      how: How) -> tuple[np.ndarray, ...]:
        """``best`` for weights of any kind: of so many probes that vary in a node, in the order that its place gives."""
        starts, sizes, tree = level.starts, level.sizes, level.tree
        alone = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))  # the first open node of each tree
        width, all_rows = self.rows.shape[1], level.ranks.shape[1]
        edges = [*starts[alone].tolist(), width]
        first, last = starts[open_], (starts + sizes - 1)[open_]
        varied = np.stack([r[o[first]] < r[o[last]] for r, o in zip(level.ranks, self.rows)])
        if how.number < len(salts) and len(open_):
            turn = mixed(place ^ salts[:, None]).astype(float)
            turn[~varied] = np.inf
            varied &= turn <= np.partition(turn, how.number - 1, axis=0)[how.number - 1]
        top = np.full(len(sizes), -np.inf)
        feature, low, high = (np.zeros(len(sizes), np.int64) for _ in range(3))
        weights, flat, step = np.stack(level.words), level.ranks.ravel(), max(1, WEIGHED // width)
        for at in range(0, len(salts), step):
            probe, n = np.nonzero(varied[at:at + step])
            if not len(probe):
                continue
            node = open_[n]
            rows = self.rows[at:at + step].ravel()
            sums = weights.take(rows, axis=1).reshape(len(weights), -1, width)
            for a, b in zip(edges, edges[1:]):
                np.cumsum(sums[:, :, a:b], axis=2, out=sums[:, :, a:b])
            before = sums[:, probe, starts[node] - 1]
            before[:, np.isin(node, alone)] = 0.0
            wide = sizes[node]
            last = np.cumsum(wide) - 1
            begins = last - wide + 1
            own = np.repeat(np.arange(len(node)), wide)
            here = np.arange(len(own)) + np.repeat(probe * width + starts[node] - begins, wide)
            left = [s.take(here) - np.repeat(b, wide) for s, b in zip(sums.reshape(len(sums), -1), before)]
            rank = flat.take(rows.take(here) + np.repeat((probe + at) * all_rows, wide))
            gain = parted_gains(left, [np.repeat(t[node], wide) for t in level.total], how.criterion)
            best, hits = peaks(gain, fitting(rank, last, wide, how.least), own, wide, begins)
            found = np.full((sums.shape[1], len(sizes)), -np.inf)
            found[probe, node] = best
            mark = np.zeros(found.shape, np.int64)  # where the best split of each lies
            mark[probe[own[hits]], node[own[hits]]] = hits
            on = found.argmax(axis=0)
            better = np.flatnonzero((gained := found.max(axis=0)) > top)
            hit = mark[on[better], better]
            top[better], feature[better], low[better], high[better] = \
                gained[better], at + on[better], rank[hit], rank[hit + 1]
        return tuple(c[open_] for c in (top, feature, low, high))


def fitting(rank: np.ndarray, last: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Behind which rows a group of so many sorted rows may be split."""
    fits = np.zeros(len(rank), bool)
    np.less(rank[:-1], rank[1:], out=fits[:-1])
    fits[last] = False
    if least > 1:
        inside = np.arange(1, len(rank) + 1) - np.repeat(last - sizes + 1, sizes)
        fits &= (inside >= least) & (np.repeat(sizes, sizes) - inside >= least)
    return fits


def peaks(gain: np.ndarray, fits: np.ndarray, own: np.ndarray, sizes: np.ndarray,
          begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each group's best gain, the first place that has it, of groups that can be split)."""
    gain[~fits] = -np.inf
    best = np.maximum.reduceat(gain, begins)
    hits = np.flatnonzero((gain == np.repeat(best, sizes)) & fits)
    return best, hits[np.append(True, own[hits[1:]] != own[hits[:-1]])] if len(hits) else hits


def best_splits(level: Level, nodes: np.ndarray, place: np.ndarray, salts: np.ndarray,
                how: How) -> tuple[np.ndarray, ...]:
    """(gain, probe, ranks below and above) of the best split of each of the nodes.

    A node looks at so many probes that vary in it, in the order that its place
    gives them; of equal gains the first probe's counts.
    """
    of, number = len(salts), how.number
    top = np.full(len(nodes), -np.inf)
    feature, low, high = (np.zeros(len(nodes), np.int64) for _ in range(3))

    def look(some: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Weigh the asked probes (nodes by any number of them, rising); whether each varies."""
        by_probe = np.argsort(asked.ravel().astype(np.uint16 if of < 1 << 16 else np.int64), kind="stable")
        found = np.empty((4, asked.size))
        found[:, by_probe] = weigh(level, asked.ravel()[by_probe], nodes[some][by_probe // asked.shape[1]], how)
        gain, under, over, varied = found.reshape(4, *asked.shape)
        first = gain.argmax(axis=1)
        row = np.arange(len(some))
        best, probe = gain[row, first], asked[row, first]
        better = (best > top[some]) | ((best == top[some]) & (best > -np.inf) & (probe < feature[some]))
        on, row = some[better], row[better]
        top[on], feature[on] = best[better], probe[better]
        low[on], high[on] = under[row, first[better]], over[row, first[better]]
        return varied.astype(bool)

    bits = np.uint64((1 << of.bit_length()) - 1)
    step = max(1, WEIGHED // of)
    for at in range(0, len(nodes), step):
        some = np.arange(at, min(at + step, len(nodes)))
        turn = mixed(place[some][:, None] ^ salts) & ~bits | np.arange(of, dtype=np.uint64)  # a probe's number ends it
        turn.sort(axis=1)
        turn = (turn & bits).astype(np.int64)
        lack, seen = np.full(len(some), number), np.zeros(len(some), int)
        while len(some):
            for wide in np.unique(np.minimum(lack, of - seen)):  # as many as each lacks
                here = np.flatnonzero(np.minimum(lack, of - seen) == wide)
                asked = np.sort(turn[here[:, None], seen[here][:, None] + np.arange(wide)], axis=1)
                seen[here] += wide
                lack[here] -= look(some[here], asked).sum(axis=1)
            more = (lack > 0) & (seen < of)
            some, turn, lack, seen = some[more], turn[more], lack[more], seen[more]
    return top, feature, low, high


def by_rank(own: np.ndarray, rank: np.ndarray, rows: np.ndarray, own_bits: int, rank_bits: int,
            row_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, rows) sorted by owner, rank and row: numbers are sorted much faster than places are found."""
    if own_bits + rank_bits + row_bits > 64:
        turn = np.lexsort((rows, rank, own))
        return rank[turn], rows[turn]
    key = own.astype(np.uint64)
    key <<= np.uint64(rank_bits)
    key |= rank
    key <<= np.uint64(row_bits)
    key |= rows.astype(np.uint64)
    key.sort()
    rows = (key & np.uint64((1 << row_bits) - 1)).view(np.int64)
    key >>= np.uint64(row_bits)
    key &= np.uint64((1 << rank_bits) - 1)
    return key, rows


def weigh(level: Level, probes: np.ndarray, nodes: np.ndarray, how: How, sorted_: np.ndarray | None = None) -> np.ndarray:
    """(gain, rank below, rank above, whether it varies) of the best split of each (probe, node), of whole weights.

    ``sorted_``: their rows one after the other, each by rank; without it they are sorted here.
    """
    out = np.zeros((4, len(probes)))
    sizes_ = level.sizes[nodes]
    ends = np.cumsum(sizes_)
    classes, width = len(level.total), level.ranks.shape[1]
    row_bits, rank_bits = width.bit_length(), int(level.ranks.max(initial=0)).bit_length()
    flat, mask, a = level.ranks.ravel(), np.uint64((1 << how.field) - 1), 0
    most = max(WEIGHED, int(sizes_.max(initial=0)))
    sums_, room = np.empty((2, classes, most), np.uint64), np.empty((2, 3, most))
    while a < len(probes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes_[a] + WEIGHED, "right")))
        sizes, on = sizes_[a:b], nodes[a:b]
        last = np.cumsum(sizes) - 1
        begins = last - sizes + 1
        own = np.repeat(np.arange(b - a), sizes)
        if sorted_ is not None:
            rows = sorted_[ends[a] - sizes_[a]:ends[b - 1]]
            rank = flat.take(rows + np.repeat(probes[a:b] * width, sizes))
        else:
            rows = level.members.take(np.arange(len(own)) + np.repeat(level.starts[on] - begins, sizes))
            rank, rows = by_rank(own, flat.take(rows + np.repeat(probes[a:b] * width, sizes)), rows,
                                 (b - a).bit_length(), rank_bits, row_bits)
        left, right = sums_[:, :, :len(rows)].view(np.int64)
        for n, word in enumerate(level.words):
            sums = word.take(rows)
            before = sums[begins]
            np.cumsum(sums, out=sums)
            sums -= np.repeat(sums[begins] - before, sizes)
            for c in range(n * how.share, min(n * how.share + how.share, classes)):
                field = np.right_shift(sums, np.uint64(c % how.share * how.field), out=sums_[0, c, :len(rows)])
                field &= mask
        for c in range(classes):
            np.subtract(np.repeat(level.total[c, on], sizes), left[c], out=right[c])
        gain, other = (side_gain(list(side), how.criterion, how.table, room[n, :, :len(rows)])
                       for n, side in enumerate((left, right)))
        gain += other
        best, hits = peaks(gain, fitting(rank, last, sizes, how.least), own, sizes, begins)
        out[0, a:b] = best
        out[1, a + own[hits]], out[2, a + own[hits]] = rank[hits], rank[hits + 1]
        out[3, a:b] = rank[begins] < rank[last]
        a = b
    return out


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The deepest node of each row."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(int(tree.depth.max())):
        at = np.where(x[rows, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
    return at


def cut_nodes(tree: Tree, cuts: list[tuple[int, int]]) -> np.ndarray:
    """For each (depth, least node to be split) and node, the node that it belongs to after the cut."""
    deepest, smallest = (np.array(c)[:, None] for c in zip(*cuts))
    ends = (tree.depth >= deepest) | (tree.samples < smallest)
    out = np.tile(np.arange(len(tree.depth)), (len(cuts), 1))
    for depth in range(1, int(tree.depth.max()) + 1):
        nodes = np.flatnonzero(tree.depth == depth)
        above = tree.parent[nodes]
        gone = ends[:, above] | (out[:, above] != above)
        out[:, nodes] = np.where(gone, out[:, above], nodes)
    return out


def tree_key(seed: int, number: int) -> int:
    return int(mixed(np.array([seed * 1_000_003 + number + 1], np.uint64) * _MIX[0])[0])


def drawn(y: np.ndarray, classes: int, settings: dict, number: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows of a forest's tree of that number, drawn with replacement, their weights, and the tree's key."""
    key = tree_key(seed, number)
    weights = np.bincount(np.random.default_rng(key).integers(0, len(y), len(y)), minlength=len(y)).astype(float)
    held = np.flatnonzero(weights > 0)
    if settings["class_weight"] == "balanced":
        of = np.bincount(y, minlength=classes)
        weights *= (len(y) / ((of > 0).sum() * np.maximum(of, 1)))[y]
    return held, weights[held], key


def grown(x: np.ndarray | None, y: np.ndarray, classes: int, settings: dict, numbers: range, seed: int,
          order: Ranks | None = None) -> Iterator[Tree]:
    """A forest's trees of those numbers, as many grown at once as have ``AT_ONCE`` rows; the ranks of the
    rows say all of them."""
    some, order = max(1, AT_ONCE // max(len(y), 1)), ranked(x) if order is None else order
    for at in range(0, len(numbers), some):
        yield from grow_all(x, y, [drawn(y, classes, settings, n, seed) for n in numbers[at:at + some]], classes, settings, order)


def forest_votes(x: np.ndarray, y: np.ndarray, check: np.ndarray, classes: int, settings: dict,
                 trees: range, cuts: list[tuple[int, int]], seed: int) -> np.ndarray:
    """(cuts, rows of ``check``, classes): shares of the classes, added up over the trees."""
    votes = np.zeros((len(cuts), len(check), classes))
    for tree in grown(x, y, classes, settings, trees, seed) if len(y) else ():
        shares = tree.weights / tree.weights.sum(axis=1, keepdims=True)
        votes += shares[cut_nodes(tree, cuts)[:, leaves(tree, check)]]
    return votes


class Grid(NamedTuple):
    """A grid taken apart: the forests to grow, the cuts, and the blocks of trees."""
    points: list[dict]
    forests: list[dict]
    cuts: list[tuple[int, int]]
    blocks: list[range]


def take_apart(points: list[dict]) -> Grid:
    forests, cuts, numbers = [], [], set()
    for p in points:
        settings, cut = settings_of(p), cut_of(p)
        forests += [settings] * (settings not in forests)
        cuts += [cut] * (cut not in cuts)
        numbers.add(int(p.get("n_estimators", TREES)))
    ends = sorted(numbers)
    return Grid(points, forests, cuts, [range(a, b) for a, b in zip([0, *ends], ends)])


def settings_of(point: dict) -> dict:
    return {k: point.get(k, v) for k, v in GROWN.items()}


def cut_of(point: dict) -> tuple[int, int]:
    found = {k: point.get(k, v) for k, v in CUT.items()}
    return int(found["max_depth"] or DEEPEST), int(found["min_samples_split"])


def votes(rows: DataFrame, grid: Grid, k: int, seed: int) -> DataFrame:
    """(node_id, fold, point, sample_id, cancer_type, votes) of every point on the fold's samples.

    ``rows``: (node_id, sample_id, cancer_type, label, classes, fold, train_of,
    x), the vectors of a node on the probes chosen without ``train_of``.  A
    group holds one node's vectors, which the caller keeps within ``GROUP_BYTES``.
    """
    work = F.array(*(F.struct(F.lit(f).alias("forest"), F.lit(b).alias("block"))
                     for f in range(len(grid.forests)) for b in range(len(grid.blocks))))
    spread = rows.withColumn("work", F.explode(work)).select("*", "work.forest", "work.block").drop("work")
    groups = len(grid.forests) * len(grid.blocks) * k

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        node, fold, forest, block = key
        part = part.sort_values("sample_id", kind="stable")  # the same forest however rows arrive
        x, y = np.array(part["x"].tolist(), float), part["label"].to_numpy()
        held = (part["fold"] == fold).to_numpy()
        classes = int(part["classes"].iat[0])
        found = forest_votes(x[~held], y[~held], x[held], classes, grid.forests[forest], grid.blocks[block],
                             grid.cuts, seed)
        some = part[held]
        return pd.concat([pd.DataFrame({
            "node_id": node, "fold": fold, "forest": forest, "block": block, "cut": c,
            "sample_id": some["sample_id"], "cancer_type": some["cancer_type"],
            "votes": list(found[c])}) for c in range(len(grid.cuts))])

    sample = rows.schema["sample_id"].dataType.simpleString()
    counted = spread.repartition(max(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))),
                                 "node_id", "train_of", "forest", "block") \
        .groupBy("node_id", F.col("train_of").alias("train_of"), "forest", "block").applyInPandas(
            run, "node_id string, fold int, forest int, block int, cut int, "
                 f"sample_id {sample}, cancer_type string, votes array<double>")
    asked = rows.sparkSession.createDataFrame(
        [(n, grid.forests.index(settings_of(p)), grid.cuts.index(cut_of(p)), b)
         for n, p in enumerate(grid.points) for b, trees in enumerate(grid.blocks)
         if trees.stop <= int(p.get("n_estimators", TREES))], "point int, forest int, cut int, block int")
    each = counted.join(F.broadcast(asked), ["forest", "cut", "block"])  # as many rows as points and blocks
    return each.select("node_id", "fold", "point", "sample_id", "cancer_type", F.posexplode("votes").alias("at", "v")) \
        .groupBy("node_id", "fold", "point", "sample_id", "cancer_type", "at").agg(F.sum("v").alias("v")) \
        .groupBy("node_id", "fold", "point", "sample_id", "cancer_type").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("votes"))


# -- a forest as a model ------------------------------------------------------------

def impurities(weights: np.ndarray, criterion: str) -> np.ndarray:
    shares = weights / weights.sum(axis=1, keepdims=True)
    if criterion == "gini":
        return 1 - (shares ** 2).sum(axis=1)
    return -(shares * np.log2(np.maximum(shares, 1e-300))).sum(axis=1)


def node_kind(classes: int) -> np.dtype:
    """A stored node; a leaf's children are itself."""
    return np.dtype([("feature", "<i4"), ("left", "<i4"), ("right", "<i4"), ("threshold", "<f8"), ("weights", "<f8", classes)])


def kept_nodes(tree: Tree, point: dict, probes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(the nodes that the point's cut leaves, what each probe adds to purity, the depth)."""
    cut, settings = cut_of(point), settings_of(point)
    kept = np.flatnonzero(cut_nodes(tree, [cut])[0] == np.arange(len(tree.depth)))
    ids = np.full(len(tree.depth), -1)
    ids[kept] = np.arange(len(kept))
    inner = (tree.left != np.arange(len(ids))) & (tree.depth < cut[0]) & (tree.samples >= cut[1])
    impurity, size = impurities(tree.weights, settings["criterion"]), tree.weights.sum(axis=1)
    below = (size[tree.left] * impurity[tree.left] + size[tree.right] * impurity[tree.right]) / size
    own = inner[kept]
    nodes = np.zeros(len(kept), node_kind(tree.weights.shape[1]))
    nodes["feature"], nodes["threshold"], nodes["weights"] = tree.feature[kept], tree.threshold[kept], tree.weights[kept]
    nodes["left"], nodes["right"] = (np.where(own, ids[side[kept]], ids[kept]) for side in (tree.left, tree.right))
    split = kept[own]
    gained = np.bincount(tree.feature[split], ((impurity - below) * size)[split], minlength=probes)
    return nodes, gained / gained.sum() if gained.sum() else gained, int(tree.depth[kept].max())


class Grown(NamedTuple):
    """What the driver knows of a stored tree."""
    depth: int


class Forest:
    """A forest whose trees lie in shared storage, where the tasks that score map them.

    Deep trees grow with the rows that they are fitted on: the driver holds none of them.
    Votes and importances are those that Spark ML's forests give.
    """

    def __init__(self, root: str, classes: int, trees: list[Grown], importances: list[float]):
        self.root, self.classes, self.trees, self.featureImportances = root, classes, trees, Vectors.dense(importances)

    @property
    def getNumTrees(self) -> int:  # noqa: N802  named as Spark ML's
        return len(self.trees)

    @property
    def stages(self) -> list[Forest]:
        """Itself, as the last stage of a pipeline."""
        return [self]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with ``features`` get a ``probability`` of every class and a ``prediction``."""
        root, number, classes = self.root, len(self.trees), self.classes

        def run(x: pd.Series) -> pd.Series:
            votes = stored_votes(root, number, classes, np.array(x.tolist(), float).reshape(len(x), -1))
            total = votes.sum(axis=1, keepdims=True)
            return pd.Series(list(np.divide(votes, total, out=votes, where=total > 0)))

        scored = rows.withColumn("probability", F.pandas_udf(run, "array<double>")(vector_to_array("features")))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumns({"prediction": best.cast("double"), "probability": array_to_vector("probability")})

    def save(self, spark: SparkSession, path: str) -> None:
        """Trees stay files of their own; a task copies each."""
        root, target, classes = self.root, shared_uri(f"{path}/trees"), self.classes

        def copy(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for n in part["id"]:
                    put_array(target, f"{n}", map_array(root, f"{n}", node_kind(classes)))
                yield part

        number = len(self.trees)
        spark.range(0, number, 1, min(number, COPIED)).mapInPandas(copy, "id long").agg(F.count(F.lit(1))).collect()
        spark.createDataFrame(
            [(classes, [t.depth for t in self.trees], self.featureImportances.toArray().tolist())],
            "classes int, depths array<int>, importances array<double>").coalesce(1).write.mode("overwrite").parquet(
                f"{path}/about")


def load(spark: SparkSession, path: str) -> Forest:
    r = spark.read.parquet(f"{path}/about").first()
    return Forest(shared_uri(f"{path}/trees"), r.classes, [Grown(d) for d in r.depths], r.importances)


@lru_cache(maxsize=1)
def stored_trees(root: str, number: int, classes: int) -> list[np.ndarray]:
    """A forest's trees, mapped; a worker keeps those of one forest."""
    return [map_array(root, f"{n}", node_kind(classes)) for n in range(number)]


def stored_votes(root: str, number: int, classes: int, x: np.ndarray) -> np.ndarray:
    """(rows, classes): shares of the classes, added up over the stored trees."""
    votes = np.zeros((len(x), classes))
    for nodes in stored_trees(root, number, classes):
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            here = nodes[at[rows]]
            below = np.where(x[rows, here["feature"]] <= here["threshold"], here["left"], here["right"])
            on = below != at[rows]
            rows, below = rows[on], below[on]
            at[rows] = below
        weights = nodes["weights"][at]
        votes += weights / weights.sum(axis=1, keepdims=True)
    return votes


#: Trees that one task grows of a forest to be kept, and tasks that copy them.
TOGETHER, COPIED = 25, 8


def model(rows: DataFrame, labelled: DataFrame, point: dict, seed: int, path: str, together: int = TOGETHER) -> Forest:
    """The point's forest on ``rows`` (sample_id, label, x); ``labelled`` names the number of classes.

    One task ranks the rows and stores the ranks; those that grow the trees map them and
    keep only what their own trees draw, and store each tree.
    """
    spark, trees = rows.sparkSession, int(point.get("n_estimators", TREES))
    classes = int(labelled.schema["label"].metadata["ml_attr"]["num_vals"])
    settings, root = settings_of(point), shared_uri(path)

    def rank(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        order = pc.sort_indices(part["sample_id"])  # the same forest however rows arrive; ties stay as they come
        part = part.take(order).combine_chunks()
        y = part["label"].to_numpy().astype(np.int64)
        x = pc.list_flatten(part["x"]).to_numpy().reshape(len(y), -1)
        found = ranked(x)
        for name, array in zip(("ranks", "values", "firsts", "label"), (*found, y)):
            put_array(root, name, array)
        return pa.table({"rows": [len(y)], "probes": [x.shape[1]]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for group in part["id"]:
                y = np.array(map_array(root, "label", np.int64))
                order = Ranks(map_array(root, "ranks", np.uint32).reshape(-1, len(y)), map_array(root, "values", float),
                              np.array(map_array(root, "firsts", np.int64)))
                own = range(group * together, min((group + 1) * together, trees))
                for n, tree in zip(own, grown(None, y, classes, settings, own, seed, order)):
                    nodes, gained, depth = kept_nodes(tree, point, len(order.of))
                    put_array(f"{root}/trees", f"{n}", nodes)
                    yield pd.DataFrame({"tree": [n], "depth": [depth], "gained": [gained]})

    rows.select("sample_id", F.col("label").cast("int").alias("label"), "x").groupBy().applyInArrow(
        rank, "rows long, probes long").collect()
    groups = -(-trees // together)
    done = spark.range(0, groups, 1, groups).mapInPandas(run, "tree int, depth int, gained array<double>").collect()
    done = sorted(done, key=lambda r: r.tree)  # a number and a list as long as the probes for every tree
    total = np.sum([r.gained for r in done], axis=0)
    return Forest(f"{root}/trees", classes, [Grown(r.depth) for r in done],
                  (total / total.sum() if total.sum() else total).tolist())
