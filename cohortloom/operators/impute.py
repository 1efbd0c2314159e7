"""Filling in missing values: probe means, and nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut
from .ranking import hash_rank

K = 5
BLOCK = 2048
PIVOTS = 64
#: Boxes of donor blocks that one task bounds at a time.
BOXES = 64
#: Blocks of targets, and of donors, that one task holds at most, and features times those blocks:
#: so many times less is shuffled, and long vectors are held by single blocks.
GROUP, GROUP_WIDTH = 16, 1024
#: Distances are rounded sums; a bound this much above the k-th is still looked at.
SLACK = 1e-6


def probe_means(m: DataFrame) -> DataFrame:
    return m.groupBy("probe_id").agg(F.avg("m_value").alias("probe_mean"))


def impute_mean(m: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Missing values become the probe's mean over the cohort."""
    means = probe_means(m if cohort is None else cohort)
    return m.join(means, "probe_id", "left").select(
        "sample_id", "probe_id", F.coalesce("m_value", "probe_mean").alias("m_value"),
        F.col("m_value").isNull().alias("imputed"))


def unique_cells(m: DataFrame, features: list[str]) -> DataFrame:
    """Known values of the named probes, one row per (sample, probe).

    A repeated measurement takes its mean.  Repeats are combined before anything
    is gathered per sample, so however often a sample was measured, what is
    gathered is never longer than the list of features.
    """
    return m.filter(F.col("probe_id").isin(features) & F.col("m_value").isNotNull()).groupBy(
        "sample_id", "probe_id").agg(F.avg("m_value").alias("m_value"))


def feature_table(m: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(probe_id, j): every probe of ``m``, or those named, numbered from 0."""
    probes = m.select("probe_id") if features is None else m.sparkSession.createDataFrame(
        [(f,) for f in features], "probe_id string")
    unit = F.pmod(F.xxhash64("probe_id"), F.lit(1 << 30)) / (1 << 30)
    return hash_rank(probes.filter("probe_id is not null").distinct(), [], unit, "probe_id").select(
        "probe_id", (F.col("rank") - 1).cast("int").alias("j"))


def sample_vectors(m: DataFrame, features: DataFrame) -> DataFrame:
    """(sample_id, js, vs): numbers of the known features, ascending, and their values.

    A repeated measurement takes its mean.  Repeats are combined before anything
    is gathered per sample, so a vector is never longer than the feature table.
    """
    cells = m.filter(F.col("m_value").isNotNull()).join(features, "probe_id").groupBy(
        "sample_id", "j").agg(F.avg("m_value").alias("v"))
    known = cells.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("j", "v"))).alias("c"))
    return m.select("sample_id").distinct().join(known, "sample_id", "left").select(
        "sample_id", F.coalesce("c.j", _none("int")).alias("js"),
        F.coalesce("c.v", _none("double")).alias("vs"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _matrix(js: pd.Series, vs: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of a dense array, not-a-number where missing."""
    out = np.full((len(js), width), np.nan)
    for row, j, v in zip(out, js, vs):
        row[np.asarray(j, dtype=int)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances over shared features, scaled to all; infinite where none is shared."""
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    a0, b0 = np.where(has_a, a, 0.0), np.where(has_b, b, 0.0)
    shared = has_a.astype(float) @ has_b.T.astype(float)
    gap = (a0 * a0) @ has_b.T + has_a @ (b0 * b0).T - 2 * a0 @ b0.T
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.sqrt(np.maximum(gap, 0.0) * a.shape[1] / shared)
    return np.round(np.where(shared > 0, dist, np.inf), 9)


def lower_bounds(a: np.ndarray, least: np.ndarray, most: np.ndarray, every: np.ndarray,
                 some: np.ndarray) -> np.ndarray:
    """What the distance of each row to any sample of a block cannot fall below.

    The block is given by each feature's least and greatest value and by whether
    every, or any, of its samples knows it.  A sample shares with the row all
    features that every sample knows and any choice of the others; the least mean
    squared gap over those choices takes the others in order of their gaps.
    """
    known = ~np.isnan(a)
    gap = np.where(known & some, np.fmax(np.fmax(least - a, a - most), 0.0), 0.0) ** 2
    sure, maybe = known & every, known & some & ~every
    first = np.where(sure, gap, 0.0).sum(axis=1, keepdims=True)
    sums = np.hstack([first, np.sort(np.where(maybe, gap, np.inf), axis=1)]).cumsum(axis=1)
    sizes = sure.sum(axis=1, keepdims=True) + np.arange(a.shape[1] + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.where(sizes > 0, sums / sizes, np.inf)
    return np.sqrt(means.min(axis=1) * a.shape[1])


def _to_pivots(pivots: np.ndarray):
    def cells(batches):
        for rows in batches:
            x = _matrix(rows["js"], rows["vs"], pivots.shape[1])
            yield rows.assign(cell=_distances(x, pivots).argmin(axis=1).astype("int32"))

    return cells


def blocks_of(vectors: DataFrame, width: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``vectors`` with a ``block`` number, near ones together; and the number of blocks.

    Samples go to the nearest of at most ``PIVOTS`` samples, those with the least
    hashes, and a pivot's samples are cut into hash slices of ``block`` or fewer on
    average.  Only the pivots and a count for each of them come to the driver.
    """
    wanted = min(PIVOTS, math.ceil(vectors.count() / block))
    placed = vectors.withColumn("cell", F.lit(0))
    if wanted > 1:
        chosen = vectors.filter(F.size("js") > 0).orderBy(
            F.xxhash64("sample_id"), "sample_id").limit(wanted).toPandas()
        if len(chosen):
            placed = cut(vectors.mapInPandas(
                _to_pivots(_matrix(chosen["js"], chosen["vs"], width)),
                T.StructType([*vectors.schema, T.StructField("cell", T.IntegerType())])))
    slices = [0] * max(1, wanted)
    for r in placed.groupBy("cell").count().collect():
        slices[r["cell"]] = math.ceil(r["count"] / block)
    starts = [sum(slices[:i]) for i in range(len(slices))]
    of_cell = lambda some: F.get(F.array(*map(F.lit, some)), F.col("cell"))
    number = of_cell(starts) + F.pmod(F.xxhash64("sample_id"), of_cell(slices))
    return placed.withColumn("block", number.cast("int")).drop("cell"), sum(slices)


def _nearest(k: int, width: int):
    def block(targets: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        """The k nearest donors in this block for each missing cell of each target."""
        out = {"sample_id": [], "j": [], "donor_id": [], "dist": [], "value": []}
        if len(targets) and len(donors):
            donors = donors.sort_values("donor_id", kind="stable")
            a = _matrix(targets["js"], targets["vs"], width)
            b = _matrix(donors["donor_js"], donors["donor_vs"], width)
            dist, has_b = _distances(a, b), ~np.isnan(b)
            names, donor_ids = targets["sample_id"].to_numpy(), donors["donor_id"].to_numpy()
            for i in range(len(a)):
                order = np.argsort(dist[i], kind="stable")
                order = order[np.isfinite(dist[i][order])]
                for j in np.flatnonzero(np.isnan(a[i])):
                    near = order[has_b[order, j]][:k]
                    out["sample_id"] += [names[i]] * len(near)
                    out["j"] += [int(j)] * len(near)
                    out["donor_id"] += list(donor_ids[near])
                    out["dist"] += list(dist[i][near])
                    out["value"] += list(b[near, j])
        ids = targets["sample_id"].dtype
        return pd.DataFrame(out).astype({"sample_id": ids, "j": "int32", "donor_id": ids,
                                         "dist": "float64", "value": "float64"})

    return lambda key, left, right: block(left, right)


def _grouped(nearest, k: int):
    def run(key, targets: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of each missing cell, block by block of both sides; no pair of blocks unasked for."""
        found = nearest(key, targets[:0], donors)
        asked = targets[["db"]].explode("db")["db"] if len(targets) else None
        parts = dict(list(donors.groupby("db2")))
        for db, rows in (asked.groupby(asked) if asked is not None else ()):
            own = targets.loc[rows.index]
            for _, some in own.groupby("tb"):
                if db in parts:
                    found = pd.concat([found, nearest(key, some, parts[db])])
            found = found.sort_values(["sample_id", "j", "dist", "donor_id"]).groupby(["sample_id", "j"]).head(k)
        return found

    return run


def _meet(left: DataFrame, right: DataFrame, width: int, k: int, keys=("tb", "db"), wrap=None) -> DataFrame:
    """Nearest donors of the targets (tb, db) among the donors (tb2, db2) of the same pair."""
    ids, nearest = left.schema["sample_id"].dataType, _nearest(k, width)
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"{c}2" for c in keys))).applyInPandas(
        wrap(nearest, k) if wrap else nearest, T.StructType([
            T.StructField("sample_id", ids), T.StructField("j", T.IntegerType()),
            T.StructField("donor_id", ids), T.StructField("dist", T.DoubleType()),
            T.StructField("value", T.DoubleType())]))


def _boxes(width: int):
    def box(key, rows):
        x = _matrix(rows["js"], rows["vs"], width)
        known = ~np.isnan(x)
        return pd.DataFrame({
            "box": pd.Series([key[0]], dtype="int32"),
            "least": [np.where(known, x, np.inf).min(axis=0)],
            "most": [np.where(known, x, -np.inf).max(axis=0)],
            "every": [known.all(axis=0)], "some": [known.any(axis=0)]})

    return box


def _survivors(width: int):
    def pairs(targets: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"sample_id": targets["sample_id"][:0], "db": []})]
        if len(targets):
            a = _matrix(targets["js"], targets["vs"], width)
            # The k-th distance so far of every missing cell; none of them for known cells.
            kth = np.where(np.isnan(a), np.inf, -np.inf)
            for row, js, ds in zip(kth, targets["kth_js"], targets["kth"]):
                row[np.asarray(js, dtype=int)] = ds
            for b in boxes.itertuples():
                some = np.asarray(b.some)
                worst = np.where(some, kth, -np.inf).max(axis=1)
                bound = lower_bounds(a, np.asarray(b.least), np.asarray(b.most),
                                     np.asarray(b.every), some)
                keep = np.isfinite(bound) & (bound - SLACK <= worst) & (
                    targets["tb"].to_numpy() != b.box)
                found.append(pd.DataFrame({"sample_id": targets["sample_id"][keep], "db": b.box}))
        return pd.concat(found).astype({"sample_id": targets["sample_id"].dtype, "db": "int32"})

    return lambda key, left, right: pairs(left, right)


def surviving_pairs(targets: DataFrame, placed: DataFrame, n_blocks: int, near: DataFrame,
                    width: int, k: int = K) -> DataFrame:
    """(sample_id, db): the other blocks that may hold a nearer donor of a target.

    ``near`` holds the nearest donors of the targets' own blocks.  A block falls away
    if for every missing cell of the target none of its samples knows the feature, or
    its least possible distance is above that of the k-th donor found.  Targets meet
    boxes of blocks, ``BOXES`` at a time, not the samples in them.
    """
    boxes = placed.groupBy("block").applyInPandas(
        _boxes(width), "box int, least array<double>, most array<double>, "
        "every array<boolean>, some array<boolean>")
    sets = F.sequence(F.lit(0), F.lit((n_blocks - 1) // BOXES))
    kth = near.groupBy("sample_id", "j").agg(
        F.count(F.lit(1)).alias("n"), F.max("dist").alias("d")).filter(F.col("n") >= k)
    kth = kth.groupBy("sample_id").agg(F.collect_list(F.struct("j", "d")).alias("f"))
    left = targets.join(kth, "sample_id", "left").select(
        "sample_id", "js", "vs", F.col("block").alias("tb"),
        F.coalesce("f.j", _none("int")).alias("kth_js"),
        F.coalesce("f.d", _none("double")).alias("kth"), F.explode(sets).alias("boxes"))
    right = boxes.select(
        "*", F.floor(F.col("box") / BOXES).cast("int").alias("boxes2"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("tb2"))
    return left.groupBy("tb", "boxes").cogroup(right.groupBy("tb2", "boxes2")).applyInPandas(
        _survivors(width), T.StructType([targets.schema["sample_id"],
                                         T.StructField("db", T.IntegerType())]))


def neighbours(targets: DataFrame, placed: DataFrame, n_blocks: int, width: int,
               k: int = K) -> DataFrame:
    """(sample_id, j, donor_id, dist, value): the k nearest donors of every missing cell.

    A target meets its own block first; what it finds there bounds which other
    blocks it has to meet.  Those are met in squares of at most ``GROUP`` blocks a side,
    so that a sample is shuffled once a square and not once a pair of blocks.
    """
    home = targets.select("sample_id", "js", "vs", F.col("block").alias("tb"),
                          F.col("block").alias("db"))
    donors = placed.select(F.col("sample_id").alias("donor_id"), F.col("js").alias("donor_js"),
                           F.col("vs").alias("donor_vs"), F.col("block").alias("db2"))
    near = _meet(home, donors.withColumn("tb2", F.col("db2")), width, k)
    if n_blocks > 1:
        near = cut(near)
        size = max(1, min(GROUP, GROUP_WIDTH // max(width, 1)))
        group = lambda c: F.floor(F.col(c) / size).cast("int")
        pairs = cut(surviving_pairs(targets, placed, n_blocks, near, width, k).groupBy(
            "sample_id", group("db").alias("dg")).agg(F.collect_set("db").alias("db")).join(
            home.select("sample_id", "tb"), "sample_id").withColumn("tg", group("tb")))
        met = pairs.select(F.col("tg").alias("tg2"), F.explode("db").alias("db2")).distinct()
        near = near.unionByName(_meet(home.drop("tb", "db").join(pairs, "sample_id"),
                                      donors.join(met, "db2").withColumn("dg2", group("db2")),
                                      width, k, ("tg", "dg"), _grouped))
    order = Window.partitionBy("sample_id", "j").orderBy("dist", "donor_id")
    return near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def impute_knn(m: DataFrame, features: list[str] | None = None, k: int = K,
               targets: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Missing values become the mean of the k nearest samples that have the probe.

    Distance is ``sqrt(P / p * sum (a - b)^2)`` over the p probes both samples
    have.  A cell without any comparable donor takes the probe's mean.

    Samples are cut into blocks of near ones (``blocks_of``).  Targets (samples
    with gaps, or those asked for) meet the donors of their own block, then those
    of the blocks that a lower bound does not rule out; a task is one pair of
    blocks and keeps the k nearest per missing cell.  The features are a table.
    """
    table = cut(feature_table(m, features))
    width = table.count()
    placed, n_blocks = blocks_of(cut(sample_vectors(m, table)), width, block)
    placed = cut(placed)
    gappy = placed.filter(F.size("js") < width)
    if targets is not None:
        gappy = gappy.join(targets, "sample_id", "left_semi")
    best = neighbours(gappy.filter(F.size("js") > 0), placed, n_blocks, width, k)
    filled_cells = best.groupBy("sample_id", "j").agg(F.avg("value").alias("m_value"))
    cells = gappy.select("sample_id", F.explode(F.array_except(
        F.sequence(F.lit(0), F.lit(width - 1)), "js")).alias("j"))
    filled = (cells.join(filled_cells, ["sample_id", "j"], "left").join(table, "j")
              .join(probe_means(m), "probe_id", "left")
              .select("sample_id", "probe_id",
                      F.coalesce("m_value", "probe_mean").alias("m_value"),
                      F.lit(True).alias("imputed")))
    observed = m.filter(F.col("m_value").isNotNull()).join(table, "probe_id", "left_semi").select(
        "sample_id", "probe_id", "m_value", F.lit(False).alias("imputed"))
    return observed.unionByName(filled)
