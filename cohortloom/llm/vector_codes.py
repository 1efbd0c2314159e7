"""Vectors as short codes: Lloyd's codebooks for parts of vectors, over cover trees.

Every block of vectors has, for each part position, a cover tree of its rows.
A node knows its range of rows in tree order, so that cumulative sums give the
sum of its subtree; if by the triangle inequality one entry is nearest to all of
a subtree, the whole subtree is assigned at once, else its children are looked
at, and in the end single rows.  All numbers are whole and results exact.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from io import BytesIO
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors, and components, of a block; and rows of a tree's leaf.
BLOCK, CELLS, LEAF = 4096, 1 << 22, 16
#: Components are cut here, errors and their sums at the end of a long.
MOST, LONG = 1 << 62, (1 << 63) - 1
#: Share by which a bound may be off through rounding; far more than square roots are.
SLACK = 1e-9
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53


class Tree(NamedTuple):
    """A cover tree; the arrays but ``order`` have an entry per node, children after parents."""
    order: np.ndarray   # rows, those of a subtree next to each other
    start: np.ndarray   # of the node's range in ``order``
    stop: np.ndarray
    pivot: np.ndarray   # the row at the node's centre
    radius: np.ndarray  # no row of the node is farther from the pivot
    child: np.ndarray   # first child
    children: np.ndarray


def exact(most: int, rows: int, width: int) -> type:
    """Doubles if sums of so many rows and squared distances stay whole in them, else Python integers."""
    return np.float64 if most * max(rows, 4 * PARTS * most * width) < EXACT else object


def as_numbers(m: np.ndarray, kind: type) -> np.ndarray:
    """The integers in that kind; objects are Python integers, without an end."""
    return m.astype(kind) if kind is np.float64 else np.array(m.tolist(), object).reshape(m.shape)


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    if rows.dtype == object:
        return np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)
    return (rows ** 2).sum(axis=1)[:, None] - 2 * (rows @ centres.T) + (centres ** 2).sum(axis=1)


def cover_tree(rows: np.ndarray) -> Tree:
    """The rows as a tree: a node's children lie farther apart than half its
    radius, its rows no farther than that from their child, and its pivot is one."""
    order = np.arange(len(rows))
    nodes = [[0, len(rows), 0, 0.0, 0, 0]]
    away = squared(rows, rows[:1])[:, 0]
    far = {0: away}  # squared distances of a node's rows from its pivot
    at = 0
    while at < len(nodes):
        start, stop, pivot = nodes[at][:3]
        here, least = order[start:stop], far.pop(at)
        radius = float(least.max()) ** 0.5
        nodes[at][3] = radius * (1 + SLACK)
        if stop - start > LEAF and radius:
            least, nearest, pivots = least.copy(), np.zeros(len(here), int), [pivot]
            inside = rows[here]
            while float(least.max()) > radius * radius / 4:
                next_ = int(least.argmax())
                new = squared(inside, inside[next_:next_ + 1])[:, 0]
                closer = new < least
                least[closer], nearest[closer] = new[closer], len(pivots)
                pivots.append(int(here[next_]))
            by = np.argsort(nearest, kind="stable")
            order[start:stop] = here[by]
            ends = start + np.cumsum([0, *np.bincount(nearest, minlength=len(pivots))])
            nodes[at][4:] = [len(nodes), len(pivots)]
            for p, a, b in zip(pivots, ends.tolist(), ends[1:].tolist()):
                far[len(nodes)] = least[by[a - start:b - start]]
                nodes.append([a, b, p, 0.0, 0, 0])
        at += 1
    columns = [np.array(c) for c in zip(*nodes)]
    whole = [columns[i].astype(np.int32) for i in (0, 1, 2, 4, 5)]
    return Tree(order.astype(np.int32), *whole[:3], columns[3].astype(np.float64), *whole[3:])


def nearest(tree: Tree, rows: np.ndarray, centres: np.ndarray):
    """(nodes, their entries, single rows, their entries): every row is in one of
    the nodes or single; ties go to the lower entry."""
    entries = [tuple(c) for c in centres.tolist()]
    used = np.array([i for i, c in enumerate(entries) if c not in entries[:i]])  # an equal lower one wins
    centres = centres[used]
    front, whole, whole_to, single = np.zeros(min(len(rows), 1), int), [], [], []
    while len(front):
        away = squared(rows[tree.pivot[front]], centres)
        best = away.argmin(axis=1)
        root = np.sqrt(np.maximum(away.astype(np.float64), 0.0))
        own = root[np.arange(len(front)), best]
        root[np.arange(len(front)), best] = np.inf
        other, radius = root.min(axis=1), tree.radius[front]
        sure = (radius == 0) | (other - own > 2 * radius + SLACK * (np.where(np.isinf(other), 0.0, other) + own))
        whole.append(front[sure])
        whole_to.append(used[best[sure]])
        open_ = front[~sure]
        leaf = tree.children[open_] == 0
        single += [tree.order[tree.start[n]:tree.stop[n]] for n in open_[leaf]]
        inner = open_[~leaf]
        front = np.concatenate([np.arange(tree.child[n], tree.child[n] + tree.children[n]) for n in inner]) \
            if len(inner) else np.zeros(0, int)
    alone = np.concatenate(single) if single else np.zeros(0, int)
    to = used[squared(rows[alone], centres).argmin(axis=1)] if len(alone) else np.zeros(0, int)
    empty = np.zeros(0, int)
    return np.concatenate([empty, *whole]), np.concatenate([empty, *whole_to]), alone, to


def packed(trees: list[Tree], rows: np.ndarray) -> bytes:
    """A block's rows, as small integers as hold them, and its trees."""
    most = int(np.abs(rows).max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
    out = BytesIO()
    np.savez(out, rows=rows.astype(kind), **{f"{n}-{f}": a for n, t in enumerate(trees) for f, a in t._asdict().items()})
    return out.getvalue()


def unpacked(data: bytes) -> tuple[np.ndarray, list[Tree]]:
    found = np.load(BytesIO(data))
    return found["rows"], [Tree(*(found[f"{n}-{f}"] for f in Tree._fields)) for n in range(PARTS)]


def part_of(rows: np.ndarray, part: int) -> np.ndarray:
    """One of the equal consecutive parts of all rows."""
    width = rows.shape[1] // PARTS
    return rows[:, part * width:(part + 1) * width]


def in_numbers(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codebooks as numbers that are exact for all that is done with them."""
    most = max(int(np.abs(rows).max(initial=0)), max((abs(int(x)) for x in books.flat), default=0))
    kind = exact(most, len(rows), max(rows.shape[1] // PARTS, 1))
    return as_numbers(rows, kind), as_numbers(books, kind)


def whole(lists: pa.Array, width: int) -> np.ndarray:
    """``SCALE`` times each component, rounded down; shorter vectors are filled with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        flat = np.floor(float(SCALE) * lists.flatten().to_numpy(zero_copy_only=False))
    inside = np.abs(flat) < MOST
    numbers = np.where(inside, flat, 0.0).astype(np.int64)
    numbers[~inside] = np.where(flat[~inside] > 0, MOST, -MOST)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = numbers
    return out


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """(ids, labels, block): the rows of every partition in blocks with their trees."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        held, count = [], 0
        most = max(1, min(BLOCK, CELLS // max(width, 1)))

        def flush():
            rows = np.concatenate([whole(b.column("vector"), width) for b in held])
            numbers, _ = in_numbers(rows, np.zeros((0, 0)))
            trees = [cover_tree(part_of(numbers, p)) for p in range(PARTS)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.concat_arrays(
                [b.column(c) for b in held])) for c in ("vec_id", "label")]
            return pa.record_batch([*lists, pa.array([packed(trees, rows)], pa.binary())],
                                   names=["ids", "labels", "block"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(most - count, batch.num_rows - at)
                held.append(batch.slice(at, take))
                count, at = count + take, at + take
                if count == most:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return vectors.select("vec_id", "label", "vector").mapInArrow(
        run, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, block binary")


def sums(packs: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, total, n): per entry, how many parts are nearest to it and their sums."""
    def run(batches):
        parts, entries, width = books.shape
        total, n = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for data in batch.column("block"):
                rows, trees = unpacked(data.as_py())
                rows, near = in_numbers(rows, books)
                for p, tree in enumerate(trees):
                    mine = part_of(rows, p)
                    nodes, to, alone, alone_to = nearest(tree, mine, near[p])
                    running = np.concatenate([mine[:1] * 0, np.cumsum(mine[tree.order], axis=0)])
                    found = np.zeros((entries, width), mine.dtype)
                    np.add.at(found, to, running[tree.stop[nodes]] - running[tree.start[nodes]])
                    np.add.at(found, alone_to, mine[alone])
                    total[p] += as_numbers(found.astype(np.int64) if found.dtype != object else found, object)
                    n[p] += np.bincount(to, tree.stop[nodes] - tree.start[nodes], entries).astype(np.int64) \
                        + np.bincount(alone_to, minlength=entries)
        where = [(p, e, i) for p, e in zip(*np.nonzero(n)) for i in range(width)]
        columns = list(zip(*where)) or [()] * 3
        yield pa.record_batch(
            [*(pa.array(list(map(int, c)), pa.int32()) for c in columns),
             pa.array([Decimal(int(total[w])) for w in where], pa.decimal128(38, 0)),
             pa.array([int(n[w[:2]]) for w in where], pa.int64())], names=["part", "entry", "place", "total", "n"])

    return packs.select("block").mapInArrow(
        run, "part int, entry int, place int, total decimal(38,0), n long") \
        .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def coded(packs: DataFrame, books: np.ndarray, id_kind: str, label_kind: str) -> DataFrame:
    """(vec_id, label, code, error) of every row of the blocks."""
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                rows, trees = unpacked(batch.column("block")[at].as_py())
                rows, near = in_numbers(rows, books)
                code, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), rows.dtype)
                for p, tree in enumerate(trees):
                    nodes, to, alone, alone_to = nearest(tree, part_of(rows, p), near[p])
                    for a, b, entry in zip(tree.start[nodes], tree.stop[nodes], to):
                        code[tree.order[a:b], p] = entry
                    code[alone, p] = alone_to
                    error = error + ((part_of(rows, p) - near[p][code[:, p]]) ** 2).sum(axis=1)
                yield pa.record_batch(
                    [batch.column("ids").slice(at, 1).flatten(), batch.column("labels").slice(at, 1).flatten(),
                     pa.array([row.tobytes().hex() for row in code]),
                     pa.array([min(int(e), LONG) for e in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

    return packs.mapInArrow(run, f"vec_id {id_kind}, label {label_kind}, code string, error long")


def usable(values: Column) -> Column:
    """The vector as doubles; null if it is null or a component is missing or not finite."""
    wide = F.transform(values, lambda x: x.cast("double"))
    return F.when(F.forall(wide, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), wide)


def first_books(vectors: DataFrame, width: int) -> np.ndarray:
    """The parts of the vectors with the least ids, by part, entry and place."""
    ids = [r[0] for r in vectors.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()]
    wanted = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        wanted = F.coalesce(wanted, F.lit(False)) | F.col("vec_id").isNull()
    found = {r.vec_id: r.vector for r in vectors.where(wanted).groupBy("vec_id").agg(F.min("vector").alias("vector")).collect()}
    rows = whole(pa.array([found[i] for i in ids], pa.list_(pa.float64())), width)
    return np.stack([part_of(rows, p) for p in range(PARTS)])


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector.

    Components count as floor(4096 * x).  Rows whose vector is null or holds a
    null or non-finite component are dropped.  Vectors are cut into eight equal
    parts; where the longest one's length is no multiple of eight, and for
    shorter vectors, zeros fill them up.  A part position's codebook starts with
    that part of the vectors with the 16 least distinct ids (all, if fewer; of
    several rows with one id the least vector; a null id comes last), and is
    moved six times to the componentwise floor of its parts' mean.  Ties go to
    the lower entry, entries that nothing is nearest to stay.  ``code`` has two
    hexadecimal digits per part, ``error`` the squared distances' sum, and
    ``label_error`` its sum over rows with an equal label, null ones together.
    Integers beyond 2^62 are cut to it, errors beyond a long to its end.
    Repeated rows count and are coded each; other columns are not read.

    Vectors are read three times and move nowhere: trees are built where the rows
    are and written once; a round sends the driver 16 sums per part, whatever the
    number of rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          usable(F.col(vector_col)).alias("vector")).where("vector IS NOT NULL")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    books = first_books(rows, width)
    packs = cut(blocks(rows, width))
    for _ in range(ROUNDS if books.size else 0):
        for r in sums(packs, books).collect():
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.flat).encode()).hexdigest()
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    out = cut(coded(packs, books, *kinds))
    totals = out.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
        .alias("label_error"))
    return out.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
