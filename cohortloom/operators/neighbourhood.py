"""Cohort embedding that keeps neighbourhoods: near graph, layout, projection.

The near graph starts from samples that lie close along a few random directions and
is mended by neighbour descent: the neighbours of one sample are measured against
each other.  The layout pulls neighbours together and pushes random samples apart,
block by block, from a PCA start.  New samples walk the graph to their neighbours and
are placed among them.  Samples are rows (sample_id, vec); null ids and null vectors
take no part, a repeated id counts once (its least vector).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from . import training
from .ranking import running

SEED = 42
# Neighbours of a sample, itself not among them.
NEAR = 15
# Neighbours kept while the graph is made, as multiples of those asked for.
WIDE = 2
# Directions the graph starts from, samples compared whole along each.
DIRECTIONS, BLOCK = 3, 512
# Rounds of descent; one that shortens the graph by less than this share is the last.
ROUNDS, LEAST_GAIN = 8, 1e-3
# Centres whose neighbourhoods one task holds at a time.
CENTRES = 256
# A layout's passes over all blocks, and the steps a block takes in each.
SWEEPS, STEPS = 10, 20
LAYOUT_BLOCK = 1024
# Heaviest ties of one sample in the layout, as multiples of its neighbours.
REACH = 4
# Samples drawn from the whole cohort to push away from, per pass; of them per sample and step.
POOL, PUSHES = 2048, 16
# Samples from which a walk may start, and starts of one walk.
LANDMARKS, STARTS = 1024, 8
# Bytes of what the walks of one block may meet in a round, however little they share.
WALK_BYTES = 256 << 20
# Curve of nearness for a least distance of 0.1 and a spread of 1.
CURVE_A, CURVE_B = 1.577, 0.895
# Pushes per pull, greatest pull of one coordinate.
PUSH_RATE, GREATEST = 5.0, 4.0


def points(rows: DataFrame) -> DataFrame:
    """(sample_id, vec) once each, written: what all steps here read."""
    return cut(rows.filter("sample_id IS NOT NULL AND vec IS NOT NULL").groupBy("sample_id").agg(
        F.min(F.col("vec").cast("array<double>")).alias("vec")))


def near_graph(rows: DataFrame, k: int = NEAR, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(sample_id, near): the k nearest found, as (d, id) by squared distance, then id.

    ``rows`` are ``points``.  Approximate; a lone sample has no row.
    """
    spark, kind, wide = rows.sparkSession, rows.schema["sample_id"].dataType.simpleString(), WIDE * k
    first = rows.select(F.size("vec").alias("n")).first()
    schema = f"sample_id {kind}, near_id {kind}, d double"
    found = spark.createDataFrame([], schema)
    rng = np.random.default_rng(seed)
    for _ in range(DIRECTIONS if first else 0):
        way = rng.standard_normal(first.n)
        along = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(w)) for w in way]),
                                       lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        placed = blocks(rows, along, BLOCK)
        found = found.unionByName(placed.groupBy("_block").applyInArrow(_compare(wide), schema))
    graph = cut(_nearest(found, wide))
    total = _length(graph)
    for _ in range(rounds):
        graph = cut(_nearest(_descend(rows, graph, wide, schema).unionByName(_links(graph)), wide))
        before, total = total, _length(graph)
        if before - total <= LEAST_GAIN * before:
            break
    return graph.select("sample_id", F.slice("near", 1, k).alias("near"))


def blocks(rows: DataFrame, along: Column, size: int) -> DataFrame:
    """Number blocks of ``size`` rows by ``along``; rows that tie are spread by their ids.

    Written, since a block must not change when a task runs again.
    """
    rows = rows.withColumn("_along", along)
    low, high = rows.agg(F.min("_along"), F.max("_along")).first()
    spread = max((high or 0.0) - (low or 0.0), 1e-9)
    unit = F.pmod(F.xxhash64("sample_id"), F.lit(1 << 30)) / float(1 << 30)
    ordered = rows.select(*[c for c in rows.columns if c != "_along"], F.lit(0).alias("_all"),
                          F.lit(1).alias("_one"), (F.col("_along") + unit * (1e-6 * spread)).alias("_along"))
    return cut(running(ordered, ["_all"], "_along", ("_one",)).select(
        *[c for c in rows.columns if c != "_along"],
        F.floor((F.col("cum__one") - 1) / size).alias("_block")))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension, so that both ways agree."""
    out = np.zeros((len(x), len(x)))
    for column in x.T:
        out += (column[:, None] - column[None, :]) ** 2
    np.fill_diagonal(out, np.inf)
    return out


def _pairs(x: np.ndarray, k: int, worst: np.ndarray | None = None):
    """(row, other, d) of each row's k nearest others, those below ``worst`` only."""
    take = min(k, len(x) - 1)
    d = _squares(x)
    other = np.argsort(d, axis=1, kind="stable")[:, :max(take, 0)].ravel()
    row = np.repeat(np.arange(len(x)), max(take, 0))
    if worst is not None:
        keep = d[row, other] < worst[row]
        row, other = row[keep], other[keep]
    return row, other, d[row, other]


def _compare(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id")
        ids = table["sample_id"].combine_chunks()
        row, other, d = _pairs(_matrix(table["vec"]), k)
        return pa.table({"sample_id": ids.take(pa.array(row)), "near_id": ids.take(pa.array(other)), "d": d})
    return run


def _links(graph: DataFrame) -> DataFrame:
    return graph.select("sample_id", F.inline("near")).select(
        "sample_id", F.col("id").alias("near_id"), "d")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each sample; the limit holds before the shuffle, too."""
    order = Window.partitionBy("sample_id").orderBy("d", "near_id")
    return found.groupBy("sample_id", "near_id").agg(F.min("d").alias("d")).withColumn(
        "_r", F.row_number().over(order)).filter(F.col("_r") <= k).groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("d", F.col("near_id").alias("id")))).alias("near"))


def _length(graph: DataFrame) -> float:
    return graph.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda s, x: s + F.sqrt(x["d"])))).first()[0] or 0.0


def _descend(rows: DataFrame, graph: DataFrame, k: int, schema: str) -> DataFrame:
    """Measure the neighbours of every sample, and k it is a neighbour of, against each other."""
    links = _links(graph)
    # Of those that name a sample, k by hash: a sample that many name stays bounded.
    named = Window.partitionBy("centre").orderBy(F.xxhash64("member", "centre"), "member")
    back = links.select(F.col("near_id").alias("centre"), F.col("sample_id").alias("member")).withColumn(
        "_r", F.row_number().over(named)).filter(F.col("_r") <= k).drop("_r")
    there = links.select(F.col("sample_id").alias("centre"), F.col("near_id").alias("member"))
    itself = graph.select(F.col("sample_id").alias("centre"), F.col("sample_id").alias("member"))
    worst = graph.select(F.col("sample_id").alias("member"), F.when(
        F.size("near") >= k, F.element_at("near", -1)["d"]).otherwise(float("inf")).alias("worst"))
    known = rows.select(F.col("sample_id").alias("member"), "vec").join(worst, "member")
    buckets = max(graph.count() // CENTRES, 1)
    sets = back.unionByName(there).unionByName(itself).distinct().join(known, "member").withColumn(
        "_bucket", F.pmod(F.xxhash64("centre"), F.lit(buckets)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("centre", "ascending"), ("member", "ascending")])
        centres, ids = (table[c].combine_chunks() for c in ("centre", "member"))
        x, worst = _matrix(table["vec"]), table["worst"].to_numpy()
        code = pc.dictionary_encode(centres).indices.to_numpy()
        ends = np.flatnonzero(np.append(np.diff(code) != 0, True)) + 1
        got = []
        for start, end in zip(np.append(0, ends[:-1]), ends):
            row, other, d = _pairs(x[start:end], k, worst[start:end])
            got.append((row + start, other + start, d))
        row, other, d = (np.concatenate(c) for c in zip(*got))
        out = pa.table({"sample_id": ids.take(pa.array(row)), "near_id": ids.take(pa.array(other)), "d": d})
        return out.group_by(["sample_id", "near_id"]).aggregate([("d", "min")]).rename_columns(
            ["sample_id", "near_id", "d"])

    return sets.groupBy("_bucket").applyInArrow(run, schema)


def nearness(d: np.ndarray) -> np.ndarray:
    """Weights of padded rows of distances (infinite: none): one at the nearest that is not equal,
    falling so that a row's weights add up to the binary logarithm of their number."""
    some = np.isfinite(d)
    d = np.where(some, d, 0.0)
    first = np.where(some & (d > 0), d, np.inf).min(axis=1, initial=np.inf)
    over = np.maximum(d - np.where(np.isfinite(first), first, 0.0)[:, None], 0.0)
    goal = np.log2(np.maximum(some.sum(axis=1), 2))
    low, high = np.zeros(len(d)), np.full(len(d), max(over.max(initial=0.0), 1e-9) * 64)
    for _ in range(64):
        middle = (low + high) / 2
        much = (np.exp(-over / np.maximum(middle, 1e-300)[:, None]) * some).sum(axis=1) > goal
        low, high = np.where(much, low, middle), np.where(much, middle, high)
    least = 1e-3 * d.sum(axis=1) / np.maximum(some.sum(axis=1), 1)
    return np.exp(-over / np.maximum(np.maximum(high, least), 1e-300)[:, None]) * some


def weighted(graph: DataFrame) -> DataFrame:
    """(sample_id, near_id, w): how near each neighbour is, as its sample sees it."""
    kind = graph.schema["sample_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch["near"]
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            d = np.full((len(sizes), max(sizes.max(initial=0), 1)), np.inf)
            d[row, place] = np.sqrt(flat.field("d").to_numpy())
            yield pa.record_batch({"sample_id": batch["sample_id"].take(pa.array(row)),
                                   "near_id": flat.field("id"), "w": nearness(d)[row, place]})

    return graph.select("sample_id", "near").mapInArrow(
        run, f"sample_id {kind}, near_id {kind}, w double")


def ties(graph: DataFrame, k: int = NEAR) -> DataFrame:
    """(sample_id, near_id, w) both ways: a + b - ab of the two views; the heaviest per sample."""
    one = weighted(graph)
    other = one.select(F.col("near_id").alias("sample_id"), F.col("sample_id").alias("near_id"), "w")
    both = one.unionByName(other).groupBy("sample_id", "near_id").agg(
        (F.sum("w") - F.when(F.count("w") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("w"), "near_id")
    return cut(both.withColumn("_r", F.row_number().over(order)).filter(
        F.col("_r") <= REACH * k).drop("_r"))


def layout(rows: DataFrame, tied: DataFrame, sweeps: int = SWEEPS, seed: int = SEED) -> DataFrame:
    """(sample_id, x, y, z) of ``points`` with at least three dimensions.

    In every pass each block moves its own samples; those of other blocks stand where
    the pass before left them.  Blocks follow the three axes of the start by turns.
    """
    kind = rows.schema["sample_id"].dataType.simpleString()
    if rows.limit(2).count() < 2:
        return rows.select("sample_id", *[F.lit(0.0).alias(c) for c in "xyz"])
    ready = rows.select("sample_id", array_to_vector("vec").alias("_v"))
    at = vector_to_array("_at")
    start = cut(PCA(k=3, inputCol="_v", outputCol="_at").fit(ready).transform(ready).select(
        "sample_id", *[F.get(at, F.lit(i)).alias(c) for i, c in enumerate("xyz")]))
    middle = start.agg(*[F.avg(c) for c in "xyz"]).first()
    reach = max(start.agg(*[F.max(F.abs(F.col(c) - m)) for c, m in zip("xyz", middle)]).first()) or 1.0
    # Equal samples start a hair apart, or nothing could part them.
    hair = lambda i: (F.pmod(F.xxhash64("sample_id", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3
    now = cut(start.select("sample_id", *[
        ((F.col(c) - m) * (10.0 / reach) + hair(i)).alias(c) for i, (c, m) in enumerate(zip("xyz", middle))]))
    homes = [blocks(now, F.col(c), LAYOUT_BLOCK).select("sample_id", "_block") for c in "xyz"]
    for sweep in range(sweeps):
        pool = now.orderBy(F.xxhash64("sample_id", F.lit(seed + sweep)), "sample_id").limit(POOL)
        far = np.array([tuple(r) for r in pool.select(*"xyz").collect()])
        ends = now.select(F.col("sample_id").alias("near_id"), *"xyz")
        pulled = tied.join(ends, "near_id").groupBy("sample_id").agg(
            F.array_sort(F.collect_list(F.struct(F.col("near_id").alias("id"), "w", *"xyz"))).alias("near"))
        sets = now.join(homes[sweep % 3], "sample_id").join(pulled, "sample_id", "left")
        now = cut(sets.groupBy("_block").applyInArrow(
            _move(far, sweep, sweeps, seed), f"sample_id {kind}, x double, y double, z double"))
    return now


def _move(far: np.ndarray, sweep: int, sweeps: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id")
        ids = table["sample_id"].combine_chunks()
        own = np.stack([table[c].to_numpy() for c in "xyz"], axis=1)
        lists = table["near"].combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
        flat = lists.flatten()
        head = np.repeat(np.arange(len(ids)), sizes)
        fixed = np.stack([flat.field(c).to_numpy() for c in "xyz"], axis=1).reshape(-1, 3)
        inside = pc.fill_null(pc.index_in(flat.field("id"), ids), -1).to_numpy(zero_copy_only=False)
        here = inside >= 0
        w = flat.field("w").to_numpy()
        share = w / np.bincount(head, w, len(ids))[head]
        rng = np.random.default_rng([seed, sweep, zlib.crc32(str(ids[0].as_py()).encode())])
        for step in range(STEPS):
            rate = 0.5 * (1 - (sweep * STEPS + step) / (sweeps * STEPS))
            ends = fixed.copy()
            ends[here] = own[inside[here]]
            apart = own[head] - ends
            d = np.maximum((apart ** 2).sum(axis=1), 1e-12)
            pull = -2 * CURVE_A * CURVE_B * d ** (CURVE_B - 1) / (1 + CURVE_A * d ** CURVE_B)
            force = np.clip(pull[:, None] * apart, -GREATEST, GREATEST) * share[:, None]
            shift = np.stack([np.bincount(head, f, len(ids)) for f in force.T], axis=1)
            apart = own[:, None, :] - far[rng.integers(0, len(far), (len(ids), PUSHES))]
            d = (apart ** 2).sum(axis=2)
            push = 2 * CURVE_B / ((0.001 + d) * (1 + CURVE_A * d ** CURVE_B))
            force = np.clip(push[:, :, None] * apart, -GREATEST, GREATEST).mean(axis=1)
            own = own + rate * (shift + PUSH_RATE * force)
        return pa.table({"sample_id": ids, **{c: own[:, i] for i, c in enumerate("xyz")}})
    return run


def nearest_known(new: DataFrame, rows: DataFrame, tied: DataFrame, k: int = NEAR,
                  rounds: int = ROUNDS) -> DataFrame:
    """(sample_id, near) of ``new`` points among ``rows``: a walk along the ties.

    It starts at the nearest of ``LANDMARKS`` samples (by hash; at most that many come
    to the driver) and ends when no walk comes nearer.  Samples of near landmarks walk
    in one block, which gets every sample it meets once.  A round goes on from what the
    one before found: whatever lay farther than the k nearest stays so.
    """
    kind = rows.schema["sample_id"].dataType.simpleString()
    known = rows.orderBy(F.xxhash64("sample_id"), "sample_id").limit(LANDMARKS).collect()
    own_kind = new.schema["sample_id"].dataType.simpleString()
    if not known:
        return _nearest(new.sparkSession.createDataFrame([], f"sample_id {own_kind}, near_id {kind}, d double"), k)
    marks = np.array([r.vec for r in known])
    order = _alike(marks, np.arange(len(marks)))
    marks, names = marks[order], pa.array([known[i].sample_id for i in order])
    listed = f"near array<struct<d double, id {kind}, fresh boolean>>"

    def start(batches):
        for batch in batches:
            x = _matrix(batch["vec"])
            d = np.zeros((len(x), len(marks)))
            for a, b in zip(x.T, marks.T):
                d += (a[:, None] - b[None, :]) ** 2
            near = np.argsort(d, axis=1, kind="stable")[:, :STARTS]
            row = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.record_batch({
                "sample_id": batch["sample_id"], "vec": batch["vec"], "_mark": near[:, 0].astype(float),
                "near": _lists(row, len(x), d[row, near.ravel()], names.take(pa.array(near.ravel())),
                               np.ones(len(row), bool))})

    begun = cut(new.select("sample_id", "vec").mapInArrow(
        start, f"sample_id {own_kind}, vec array<double>, _mark double, {listed}"))
    size = max(WALK_BYTES // (8 * (marks.shape[1] + 2) * REACH * NEAR * k), 1)
    walk = blocks(begun, F.col("_mark"), size).drop("_mark")
    total, reached = None, 0
    steps = cut(tied.groupBy(F.col("sample_id").alias("near_id")).agg(F.collect_list("near_id").alias("next")))
    ends = rows.select(F.col("sample_id").alias("near_id"), F.col("vec"))
    for _ in range(rounds):
        asked = walk.select("_block", F.explode(F.filter("near", lambda n: n["fresh"])).alias("n")).select(
            "_block", F.col("n.id").alias("near_id")).distinct()
        further = cut(asked.join(steps, "near_id"))
        met = further.select("_block", F.explode("next").alias("near_id")).distinct().join(ends, "near_id")
        walk = cut(walk.unionByName(further, True).unionByName(met, True).groupBy("_block").applyInArrow(
            _walk(k), f"_block long, sample_id {own_kind}, vec array<double>, {listed}"))
        before = (total, reached)
        total, reached = _length(walk), walk.agg(F.sum(F.size("near"))).first()[0]
        if before == (total, reached):
            break
    return walk.select("sample_id", F.array_sort(F.transform(
        "near", lambda n: F.struct(n["d"].alias("d"), n["id"].alias("id")))).alias("near"))


def _alike(x: np.ndarray, own: np.ndarray) -> list[int]:
    """The rows ``own`` of x in an order that keeps near ones together: halved along the widest direction."""
    if len(own) < 3:
        return own.tolist()
    away = x[own] - x[own].mean(axis=0)
    along = own[np.argsort(away @ np.linalg.eigh(away.T @ away)[1][:, -1], kind="stable")]
    return _alike(x, along[:len(own) // 2]) + _alike(x, along[len(own) // 2:])


def _lists(row: np.ndarray, n: int, d, ids, fresh) -> pa.Array:
    """The entries of n lists, sorted by ``row``, as an Arrow column."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(d), ids, pa.array(fresh)], ["d", "id", "fresh"]))


def _walk(k: int):
    """One round of a block: rows with a sample_id walk, rows with ``next`` are the ties of what they
    found last, the others are what lies at their ends."""
    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table["sample_id"])).combine_chunks()
        lists = table.filter(pc.is_valid(table["next"])).combine_chunks()
        ends = table.filter(pc.and_(pc.is_null(table["sample_id"]), pc.is_null(table["next"]))).combine_chunks()
        near, following = own["near"].combine_chunks(), lists["next"].combine_chunks()
        flat = near.flatten()
        head = np.repeat(np.arange(len(own)), pc.list_value_length(near).to_numpy())
        place = lambda ids, among: pc.fill_null(pc.index_in(ids, among.combine_chunks()), -1).to_numpy()
        # Samples with the ties of what is new to them: each tie once, and none that is on their list.
        at = place(flat.field("id"), lists["near_id"])
        open_ = flat.field("fresh").to_numpy(zero_copy_only=False) & (at >= 0)
        sizes = pc.list_value_length(following).to_numpy()
        first, row, at = np.cumsum(sizes) - sizes, head[open_], at[open_]
        many = sizes[at]
        tie = np.arange(many.sum()) + np.repeat(first[at] - (np.cumsum(many) - many), many)
        end = place(following.flatten(), ends["near_id"])[tie]
        row, width = np.repeat(row, many), max(len(ends), 1)
        seen = place(flat.field("id"), ends["near_id"])
        pairs = np.setdiff1d((row * width + end)[end >= 0], (head * width + seen)[seen >= 0])
        row, end = pairs // width, pairs % width
        d, worst = np.zeros(len(pairs)), np.full(len(own), np.inf)
        for a, b in zip(*(np.ascontiguousarray(_matrix(t["vec"]).T) if len(t) else () for t in (own, ends))):
            d += (a[row] - b[end]) ** 2
        so_far = flat.field("d").to_numpy()
        full = np.bincount(head, minlength=len(own)) >= k
        farthest = np.full(len(own), -np.inf)
        np.maximum.at(farthest, head, so_far)
        worst[full] = farthest[full]
        some = ~(d > worst[row])
        all_ = pa.table({
            "row": np.append(head, row[some]), "d": np.append(so_far, d[some]),
            "id": pa.concat_arrays([flat.field("id"), ends["near_id"].combine_chunks().take(pa.array(end[some]))]),
            "fresh": np.append(np.zeros(len(head), bool), np.ones(some.sum(), bool))}).sort_by(
            [("row", "ascending"), ("d", "ascending"), ("id", "ascending")])
        row = all_["row"].to_numpy()
        size = np.bincount(row, minlength=len(own))
        kept = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < k
        all_ = all_.filter(pa.array(kept)).combine_chunks()
        return pa.table({"_block": own["_block"], "sample_id": own["sample_id"], "vec": own["vec"], "near": _lists(
            row[kept], len(own), all_["d"].to_numpy(), all_["id"].combine_chunks(), all_["fresh"].to_numpy())})
    return run


def place(near: DataFrame, placed: DataFrame) -> DataFrame:
    """(sample_id, x, y, z): the mean place of the neighbours, by how near they are."""
    ends = placed.select(F.col("sample_id").alias("near_id"), *"xyz")
    return weighted_among(near).join(ends, "near_id").groupBy("sample_id").agg(
        *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "xyz"])


def weighted_among(near: DataFrame) -> DataFrame:
    """As ``weighted``; samples and neighbours may have ids of different types."""
    kind = near.schema["near"].dataType.elementType["id"].dataType.simpleString()
    own = near.schema["sample_id"].dataType.simpleString()
    if kind == own:
        return weighted(near)
    text = near.select(F.col("sample_id").cast("string").alias("sample_id"), F.transform(
        "near", lambda x: F.struct(x["d"].alias("d"), x["id"].cast("string").alias("id"))).alias("near"))
    return weighted(text).select(F.col("sample_id").cast(own).alias("sample_id"),
                                 F.col("near_id").cast(kind).alias("near_id"), "w")


@dataclass
class Neighbourhoods:
    """A fitted embedding: its probes, samples, ties and places."""

    features: list[str]
    rows: DataFrame
    tied: DataFrame
    placed: DataFrame

    def project(self, m: DataFrame, wanted: DataFrame) -> DataFrame:
        """(sample_id, x, y, z) of the wanted samples that know all probes; placed ones keep their place."""
        ids = wanted.select("sample_id").distinct()
        old = self.placed.join(ids, "sample_id", "left_semi")
        new = m.join(ids.join(self.placed, "sample_id", "left_anti"), "sample_id", "left_semi")
        near = nearest_known(vectors(new, self.features), self.rows, self.tied)
        return old.unionByName(place(near, self.placed))


def vectors(m: DataFrame, features: list[str]) -> DataFrame:
    """``points`` of the samples that know all of the named probes."""
    wanted = F.array(*[F.lit(f) for f in features])
    cells = F.transform(wanted, lambda p: F.try_element_at(F.col("v"), p))
    maps = training.value_maps(m, features).withColumn("vec", cells)
    return points(maps.filter(F.forall("vec", lambda c: c.isNotNull())).select("sample_id", "vec"))


def fit_neighbourhoods(m: DataFrame, design: DataFrame, weights: DataFrame, name: str) -> Neighbourhoods:
    """Embed the samples of ``design`` on the model's probes with positive importance.

    As in ``training.fit_embedding``, probes that one of the samples lacks are left out.
    """
    listed = sorted(r[0] for r in weights.filter(
        (F.col("model") == name) & (F.col("importance") > 0)).select("probe_id").distinct().collect())
    held = m.join(design.select("sample_id").distinct(), "sample_id", "left_semi")
    features = training.complete_features(held, held, listed)
    if len(features) < 3:
        raise ValueError(f"Too few features with importance > 0 for {name}")
    rows = vectors(held, features)
    tied = ties(near_graph(rows))
    return Neighbourhoods(features, rows, tied, layout(rows, tied))
