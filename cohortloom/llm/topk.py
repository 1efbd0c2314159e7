"""Exact top-k search by inner product, block at a time with bounds.

Vectors lie in ranges of a rough order of likeness.  A range's blocks know the
least and the greatest value of every component, so that their sums over a query
bound every score inside; blocks are scored from the highest bound down until it
falls below the k-th score found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

#: Vectors of a range, which is one task's part, and of a block in it.
RANGE, BLOCK = 16_384, 512
#: Ranges whose queries meet another range's blocks in one task.
TOGETHER = 16
#: Whole numbers below this are exact as doubles.
EXACT = 2.0 ** 53
LONG = (-(2 ** 63), 2 ** 63 - 1)


def whole_numbers(m: np.ndarray) -> np.ndarray:
    """The matrix with Python integers, for sums that doubles do not hold exactly."""
    return np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)


def within_long(scores: np.ndarray) -> np.ndarray:
    """Python integers cut to the ends of a long; doubles are exact and far from them."""
    return np.clip(scores, *LONG) if scores.dtype == object else scores


def padded(m: np.ndarray, dims: int) -> np.ndarray:
    """Rows with zeros up to ``dims`` components."""
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def best_of(query: np.ndarray, own: int, floor: int, k: int, ids: np.ndarray, vectors: np.ndarray,
            bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the query's k best in a range, from scores of ``floor`` on."""
    top_ids, top = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
    bounds = within_long(bounds)
    for b in np.argsort(-bounds, kind="stable"):
        kth = max(floor, top[-1]) if len(top) == k else floor
        if bounds[b] < kth:
            break
        part = slice(b * BLOCK, (b + 1) * BLOCK)
        scores = within_long(vectors[part] @ query)
        fit = (scores >= kth) & (ids[part] != own)
        top_ids, top = np.append(top_ids, ids[part][fit]), np.append(top, scores[fit])
        order = np.lexsort((top_ids, -top))[:k]
        top_ids, top = top_ids[order], top[order]
    return top_ids, top


def search(queries: np.ndarray, own: np.ndarray, floors: list[int], k: int, ids: np.ndarray,
           vectors: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For each query: (number, ids, scores) of its k best among the vectors."""
    dims = max(queries.shape[1], vectors.shape[1])
    queries, vectors, low, high = (padded(m, dims) for m in (queries, vectors, low, high))
    most = np.maximum(np.abs(low), np.abs(high)).max(axis=0, initial=0.0)
    if (np.abs(queries) @ most).max(initial=0.0) >= EXACT:
        queries, vectors, low, high = (whole_numbers(m) for m in (queries, vectors, low, high))
    zero = queries * 0
    bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
    for n in range(len(queries)):
        yield n, *best_of(queries[n], own[n], floors[n], k, ids, vectors, bounds[n])


def blocks(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest component values of every block."""
    starts = range(0, len(vectors), BLOCK)
    return tuple(np.array([f(vectors[s:s + BLOCK], axis=0) for s in starts])
                 for f in (np.min, np.max))


def _matrix(lists: pa.Array) -> np.ndarray:
    """1024 times each component, rounded down; shorter vectors are filled with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = np.floor(1024.0 * flat)
    return out


PACKED = "shard int, part int, ids array<long>, vectors binary, queries array<int>, floors array<long>"


def pack(k: int, query_every: int):
    """Rows of a partition as ranges: vectors, and the queries among them with a
    score that the k-th best reaches at least, from a search of their own range."""
    def one(shard: int, flushed: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        asked = np.flatnonzero(ids % query_every == 0)
        low, high = blocks(vectors)
        found = search(vectors[asked], ids[asked], [LONG[0]] * len(asked), k, ids, vectors, low, high)
        floors = [int(s[-1]) if len(s) == k else LONG[0] for _, _, s in found]
        return pa.record_batch(
            [pa.array([shard], pa.int32()), pa.array([flushed], pa.int32()), pa.array([ids]),
             pa.array([vectors.tobytes()], pa.binary()), pa.array([asked.astype(np.int32)]),
             pa.array([floors], pa.list_(pa.int64()))],
            names=["shard", "part", "ids", "vectors", "queries", "floors"])

    def run(batches):
        shard, flushed, held, count = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            dims = max(v.shape[1] for _, v in held)
            return one(shard, flushed, np.concatenate([i for i, _ in held]),
                       np.concatenate([padded(v, dims) for _, v in held]))

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held.append((part.column("vec_id").to_numpy(), _matrix(part.column("vector"))))
                count += part.num_rows
                if count >= RANGE:
                    yield flush()
                    flushed, held, count = flushed + 1, [], 0
        if held:
            yield flush()

    return run


def _rows(table: pa.Table, *names: str):
    """Python rows of the columns, vectors as matrices."""
    for row in table.select(["ids", "vectors", *names]).to_pylist():
        ids = np.array(row["ids"], np.int64)
        yield ids, np.frombuffer(row["vectors"]).reshape(len(ids), -1), *(row[n] for n in names)


def usable(values: Column) -> Column:
    """The vector as doubles; null if a component is missing or its 1024-fold not finite."""
    wide = F.transform(values, lambda x: x.cast("double"))
    return F.when(F.forall(wide, lambda x: x.isNotNull() & (F.abs(x * 1024.0) < float("inf"))), wide)


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every query.

    Components count as floor(1024 * x).  Queries are the rows whose id is
    divisible by ``query_every``; candidates all rows with another id; the score
    is the inner product as a whole number (at the ends of a long if beyond),
    equal scores (as
    cut to a long) rank by id.  Rows with a null id, and vectors that are null or
    hold a null or non-finite component, take no part; shorter vectors count as
    filled up with zeros.  Repeated rows are candidates each, and queries each.

    Every query meets every range, in groups of bounded size; what a range sends
    back are at most k rows for each query.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          usable(F.col(vector_col)).alias("vector")) \
        .where("vec_id IS NOT NULL AND vector IS NOT NULL")
    sizes = F.transform("vector", lambda x: F.abs(x))
    lead = F.array_position(sizes, F.array_max(sizes))
    place = lead * F.when(F.element_at("vector", F.greatest(lead, F.lit(1)).cast("int")) < 0, -1).otherwise(1)
    rows = rows.withColumn("place", F.when(F.size("vector") > 0, place).otherwise(0))
    parts = max(1, -(-rows.count() // RANGE))
    ranges = cut(rows.repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id")
                 .select("vec_id", "vector").mapInArrow(pack(k, query_every), PACKED))
    last = ranges.agg(F.max("shard")).first()[0]
    every = F.explode(F.sequence(F.lit(0), F.lit(last or 0)))

    def only_queries(batches):
        for batch in batches:
            packed = pa.Table.from_batches([batch])
            for ids, m, chosen, *rest in _rows(packed, "queries", "shard", "part", "floors"):
                yield pa.record_batch(
                    [pa.array([rest[0]], pa.int32()), pa.array([rest[1]], pa.int32()),
                     pa.array([ids[chosen]]), pa.array([m[chosen].tobytes()], pa.binary()),
                     pa.array([rest[2]], pa.list_(pa.int64()))],
                    names=["home", "part", "ids", "vectors", "floors"])

    asked = ranges.where(F.size("queries") > 0).mapInArrow(
        only_queries, "home int, part int, ids array<long>, vectors binary, floors array<long>")
    asked = asked.withColumn("set", F.floor(F.col("home") / TOGETHER)).withColumn("shard", every)
    sets = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((last or 0) // TOGETHER).cast("long"))).alias("set")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = {c: [] for c in ("query", "query_id", "vec_id", "score")}
        for ids, m in _rows(left):
            low, high = blocks(m)
            for own, queries, floors, home, part in _rows(right, "floors", "home", "part"):
                for n, best, scores in search(queries, own, floors, k, ids, m, low, high):
                    found["query"] += [(home << 40) + (part << 15) + n] * len(best)
                    found["query_id"] += [int(own[n])] * len(best)
                    found["vec_id"] += best.tolist()
                    found["score"] += [int(s) for s in scores.tolist()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    met = ranges.select("shard", "ids", "vectors", sets).groupBy("shard", "set").cogroup(
        asked.groupBy("shard", "set")).applyInArrow(
        meet, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
