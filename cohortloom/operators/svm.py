"""Support vector machines of a grid, linear and with a Gaussian kernel.

A node's machines are solved exactly, in tasks by (node, fold, settings); no task holds
more than a bounded part of a kernel matrix.  Beyond a size that a caller may state,
samples are mapped to what a bounded number of landmark samples say of the kernel, and
linear machines do the rest: one for each class, in the same tasks while these hold the
mapped samples, else Spark ML's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What makes another machine of a point, with the value where the point names none.
SETTINGS = {"C": 1.0, "kernel": "linear", "gamma": "scale"}
#: Bytes of a kernel matrix beyond which landmarks stand for it; none, so that machines are exact at any
#: size.  A caller that sets a bound asks for another machine beyond it.
KERNEL_BYTES: int | None = None
#: Bytes of kernel values that a task holds at once, and samples that it works on where that is not all.
HELD_BYTES, WORKING = 64 << 20, 1024
#: Samples that stand for all others beyond ``KERNEL_BYTES``; more of them bring the kernel nearer to the exact one.
LANDMARKS = 512
#: Bytes of samples mapped to landmarks up to which one task solves a fold's machine; it holds some five times as much.
MAPPED_BYTES = 512 << 20
#: What a class is told from if not from one other class.
REST = -1
#: Violation of the optimality conditions that counts as none, and steps after which a machine gives up.
TOLERANCE, STEPS, NEWTON_STEPS = 1e-3, 1_000_000, 200


def settings_of(point: dict) -> dict:
    """What the point's machine hangs on; a linear one has no width."""
    found = {k: point.get(k, v) for k, v in SETTINGS.items()}
    return found if found["kernel"] != "linear" else {**found, "gamma": None}


def width_of(gamma, x: np.ndarray) -> float:
    """The kernel's factor of squared distances: a number, or by the number of probes
    (and, for "scale", by the variance of all values)."""
    if gamma not in ("scale", "auto"):
        return float(gamma)
    of = x.shape[1] * (x.var() if gamma == "scale" else 1.0)
    return float(1.0 / of) if of > 0 else 1.0


def kernel(a: np.ndarray, b: np.ndarray, settings: dict, width: float) -> np.ndarray:
    if settings["kernel"] == "linear":
        return a @ b.T
    if settings["kernel"] != "rbf":
        raise ValueError(f"Unsupported kernel: {settings['kernel']}")
    away = (a ** 2).sum(1)[:, None] - 2 * (a @ b.T) + (b ** 2).sum(1)
    return np.exp(-width * np.maximum(away, 0.0))


def solve(k: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float, bool]:
    """(coefficients, bias, whether it came to rest) of the machine on a kernel matrix; y is -1 or 1."""
    a, slope = np.zeros(len(y)), -np.ones(len(y))
    if not descend(k, y, c, a, slope, TOLERANCE, STEPS):
        return a * y, 0.0, False
    return a * y, middle(y, c, a, slope), True


def sides(y: np.ndarray, c: float, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which y * a may rise, and which may fall."""
    return np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)


def descend(k: np.ndarray, y: np.ndarray, c: float, a: np.ndarray, slope: np.ndarray, tolerance: float, steps: int) -> bool:
    """Move ``a``, and ``slope`` with it, to the optimum; whether it was reached.

    Two coefficients at a time are moved to their best values: the one that
    violates optimality most, and the one that promises the most with it.
    """
    diagonal = np.diag(k)
    for _ in range(steps):
        up, down = sides(y, c, a)
        pull = -y * slope
        high = np.where(up, pull, -np.inf)
        i = int(high.argmax())
        gap = high[i] - np.where(down, pull, np.inf)
        if not gap.max() > tolerance:
            return True
        curve = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.where(gap > 0, gap * gap / curve, -np.inf).argmax())
        # Along the line on which the sum of y * a stays as it is.
        most = min(c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        move = min(gap[j] / curve[j], most)
        a[i] += y[i] * move
        a[j] -= y[j] * move
        for n in (i, j):  # exact ends, whatever rounding says
            a[n] = 0.0 if a[n] < 1e-12 * c else c if a[n] > c * (1 - 1e-12) else a[n]
        slope += y * move * (k[i] - k[j])
    return False


def middle(y: np.ndarray, c: float, a: np.ndarray, slope: np.ndarray) -> float:
    """The bias of an optimum."""
    up, down = sides(y, c, a)
    pull, free = -y * slope, (a > 0) & (a < c)
    ends = [pull[up].max(initial=-np.inf), pull[down].min(initial=np.inf)]
    return float(pull[free].mean() if free.any() else sum(e for e in ends if math.isfinite(e)) / max(
        sum(map(math.isfinite, ends)), 1))


def solve_parts(x: np.ndarray, y: np.ndarray, c: float, settings: dict, width: float) -> tuple[np.ndarray, float, bool]:
    """``solve`` on rows whose kernel matrix is not held: the same optimum to the same tolerance.

    The coefficients that violate optimality most, with those that were moved before, are
    brought to their optimum among themselves; then the slopes of all follow, some rows at a time.
    """
    a, slope = np.zeros(len(y)), -np.ones(len(y))
    work = np.zeros(0, np.int64)
    rows = max(1, HELD_BYTES // (8 * WORKING))
    for _ in range(STEPS):
        up, down = sides(y, c, a)
        pull = -y * slope
        high, low = np.where(up, pull, -np.inf), np.where(down, pull, np.inf)
        gap = high.max() - low.min()
        if not gap > TOLERANCE:
            return a * y, middle(y, c, a, slope), True
        some = min(WORKING // 4, len(y))
        worst = np.unique(np.concatenate([np.argpartition(-high, some - 1)[:some], np.argpartition(low, some - 1)[:some]]))
        work = np.concatenate([worst, work[~np.isin(work, worst)][:WORKING - len(worst)]])
        own, moved = y[work], a[work]
        inner = kernel(x[work], x[work], settings, width)
        descend(inner, own, c, moved, slope[work], max(TOLERANCE / 2, gap / 10), STEPS)
        change = own * (moved - a[work])
        a[work] = moved
        still = change != 0
        for at in range(0, len(y), rows):
            slope[at:at + rows] += y[at:at + rows] * (kernel(x[at:at + rows], x[work[still]], settings, width) @ change[still])
    return a * y, 0.0, False


def solve_linear(x: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float, bool]:
    """(weights, bias, whether it came to rest) of the linear machine, by Newton steps inside its bounds.

    The matrix of each step is diagonal but for as many dimensions as there are
    probes, so a step costs rows times probes squared, and some tens of steps do.
    """
    z, ones = x * y[:, None], np.ones(len(y))
    a, low, high, b = ones * c / 2, ones.copy(), ones.copy(), 0.0  # low, high: prices of the bounds 0 and c
    for _ in range(NEWTON_STEPS):
        rest, off = z @ (z.T @ a) - 1 + y * b - low + high, float(y @ a)
        gap = float(low @ a + high @ (c - a)) / (2 * len(y))
        if gap < 1e-6 * c and np.abs(rest).max() < 1e-4 and abs(off) < 1e-6 * c:
            return z.T @ a, b, True
        aim = 0.1 * gap
        diagonal = low / a + high / (c - a)
        right = -rest + (aim / a - low) - (aim / (c - a) - high)
        thin = z / diagonal[:, None]
        inner = np.linalg.inv(np.eye(z.shape[1]) + z.T @ thin)
        turned = np.stack([right, y], axis=1)
        u, v = (turned / diagonal[:, None] - thin @ (inner @ (thin.T @ turned))).T
        db = (y @ u + off) / (y @ v)
        da = u - v * db
        dl, dh = aim / a - low - low / a * da, aim / (c - a) - high + high / (c - a) * da
        far = max(float((-da / a).max()), float((da / (c - a)).max()), 1e-30)
        dear = max(float((-dl / low).max()), float((-dh / high).max()), 1e-30)
        step = min(1.0, 0.995 / far, 0.995 / dear)
        a, low, high, b = a + step * da, low + step * dl, high + step * dh, b + step * db
    return z.T @ a, float(b), False


@dataclass
class Machine:
    """A machine for every pair of classes, on scaled probes; pairs vote.

    Where classes are told from all others (``REST``), the highest decision counts.
    """

    centre: np.ndarray
    spread: np.ndarray
    settings: dict
    width: float
    vectors: np.ndarray
    pairs: list[tuple[int, int]]
    coefficients: np.ndarray  # pairs by vectors
    biases: np.ndarray
    classes: int
    rested: bool

    def decisions(self, x: np.ndarray) -> np.ndarray:
        """One column per pair of classes, above zero for the first of them."""
        scaled = (x - self.centre) / self.spread
        rows = max(1, HELD_BYTES // (8 * max(len(self.vectors), 1)))
        return np.concatenate([
            kernel(scaled[at:at + rows], self.vectors, self.settings, self.width) @ self.coefficients.T + self.biases
            for at in range(0, max(len(x), 1), rows)])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The class with most votes, or the highest decision; of several the first."""
        if self.pairs and self.pairs[0][1] == REST:
            return self.decisions(x).argmax(axis=1)
        votes = np.zeros((len(x), self.classes))
        for (a, b), column in zip(self.pairs, self.decisions(x).T):
            votes[:, a] += column > 0
            votes[:, b] += column <= 0
        return votes.argmax(axis=1)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with ``features`` get a ``prediction``."""
        machine = self

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(machine.predict(np.array(x.tolist(), float)).astype(float))

        return rows.withColumn("prediction", F.pandas_udf(run, "double")(vector_to_array("features")))

    def row(self) -> tuple:
        return (self.centre.tolist(), self.spread.tolist(), {k: str(v) for k, v in self.settings.items()}, self.width,
               self.vectors.tolist(), [list(p) for p in self.pairs], self.coefficients.tolist(),
               self.biases.tolist(), self.classes, self.rested)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([self.row()], STORED).coalesce(1).write.mode("overwrite").parquet(path)


STORED = """centre array<double>, spread array<double>, settings map<string,string>, width double,
    vectors array<array<double>>, pairs array<array<int>>, coefficients array<array<double>>,
    biases array<double>, classes int, rested boolean"""
COLUMNS = ["centre", "spread", "settings", "width", "vectors", "pairs", "coefficients", "biases", "classes", "rested"]


def load(spark: SparkSession, path: str) -> Machine:
    r = spark.read.parquet(path).first()
    of = len(r.centre)
    return Machine(np.array(r.centre), np.array(r.spread), r.settings, r.width, np.array(r.vectors).reshape(-1, of),
                   [tuple(p) for p in r.pairs], np.array(r.coefficients).reshape(len(r.pairs), -1),
                   np.array(r.biases), r.classes, r.rested)


def fit(x: np.ndarray, y: np.ndarray, classes: int, settings: dict) -> Machine:
    """A machine per pair of classes, on probes scaled to mean 0 and population deviation 1."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    x = (x - centre) / spread
    width = width_of(settings["gamma"], x) if settings["gamma"] is not None else 0.0
    found = np.unique(y)
    pairs = [(int(a), int(b)) for n, a in enumerate(found) for b in found[n + 1:]]
    own = [np.flatnonzero((y == a) | (y == b)) for a, b in pairs]
    signs = [np.where(y[o] == a, 1.0, -1.0) for o, (a, _) in zip(own, pairs)]
    price = float(settings["C"])
    if settings["kernel"] == "linear":  # one vector per pair says it all
        solved = [solve_linear(x[o], s, price) for o, s in zip(own, signs)]
        vectors, coefficients = np.array([w for w, _, _ in solved]).reshape(len(pairs), x.shape[1]), np.eye(len(pairs))
    else:
        if len(y) * len(y) * 8 <= HELD_BYTES:
            k = kernel(x, x, settings, width)
            solved = [solve(k[np.ix_(o, o)], s, price) for o, s in zip(own, signs)]
        else:
            solved = [solve_parts(x[o], s, price, settings, width) for o, s in zip(own, signs)]
        coefficients = np.zeros((len(pairs), len(y)))
        for row, o, (found_, _, _) in zip(coefficients, own, solved):
            row[o] = found_
        used = np.abs(coefficients).max(axis=0, initial=0.0) > 0
        vectors, coefficients = x[used], coefficients[:, used]
    return Machine(centre, spread, settings, width, vectors, pairs, coefficients,
                   np.array([b for _, b, _ in solved]), classes, all(r for _, _, r in solved))


def fit_mapped(x: np.ndarray, y: np.ndarray, classes: int, settings: dict, order: np.ndarray) -> Machine:
    """A machine per class against all others (of two classes the second against the first), linear
    on the scaled probes or on what the first samples in ``order`` say of the kernel."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    x = (x - centre) / spread
    vectors, turn, width = np.eye(x.shape[1]), np.eye(x.shape[1]), 0.0
    if settings["kernel"] != "linear":
        marks = Landmarks.of(x[order[:LANDMARKS]], settings)
        vectors, turn, width = marks.vectors, marks.axes(), marks.width
        x = kernel(x, vectors, settings, width) @ turn
    pairs = [(1, 0)] if classes == 2 else [(c, REST) for c in range(classes)]
    # A class that none or all of the samples are of needs no direction.
    solved = [solve_linear(x, s, float(settings["C"])) if abs(s.sum()) < len(s) else
              (np.zeros(x.shape[1]), float(s[0]), True) for s in (np.where(y == c, 1.0, -1.0) for c, _ in pairs)]
    return Machine(centre, spread, settings, width, vectors, pairs, np.array([turn @ w for w, _, _ in solved]),
                   np.array([b for _, b, _ in solved]), classes, all(r for _, _, r in solved))


def _fitted(part: pd.DataFrame, settings: dict, mapped: bool) -> Machine:
    """The machine on rows (sample_id, label, classes, x and, if mapped, the hash of the id)."""
    x, y, classes = np.array(part["x"].tolist(), float), part["label"].to_numpy(), int(part["classes"].iat[0])
    return fit_mapped(x, y, classes, settings, part["hash"].argsort(kind="stable").to_numpy()) if mapped else \
        fit(x, y, classes, settings)


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.xxhash64("sample_id"))


def calls(rows: DataFrame, points: list[dict], k: int, mapped: bool = False) -> DataFrame:
    """(fold, point, sample_id, cancer_type, label, called) of every point on the fold's samples.

    ``rows`` as for ``forest.votes``, of one node; ``mapped``: within ``MAPPED_BYTES``, by landmarks.  Points that ask for the same machine share it.
    """
    machines = []
    for p in points:
        machines += [settings_of(p)] * (settings_of(p) not in machines)
    spread = _hashed(rows).withColumn("machine", F.explode(F.sequence(F.lit(0), F.lit(len(machines) - 1))))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_id", kind="stable")
        held = (part["fold"] == key[0]).to_numpy()
        some = part[held]
        called = _fitted(part[~held], machines[key[1]], mapped).predict(np.array(some["x"].tolist(), float)) \
            if held.any() and not held.all() else np.zeros(len(some), int)
        return pd.DataFrame({"fold": key[0], "machine": key[1], "sample_id": some["sample_id"],
                             "cancer_type": some["cancer_type"], "label": some["label"], "called": called})

    sample = rows.schema["sample_id"].dataType.simpleString()
    asked = rows.sparkSession.createDataFrame(
        [(n, machines.index(settings_of(p))) for n, p in enumerate(points)], "point int, machine int")
    return spread.repartition(len(machines) * k, "train_of", "machine").groupBy("train_of", "machine").applyInPandas(
        run, f"fold int, machine int, sample_id {sample}, cancer_type string, label int, called int").join(
        F.broadcast(asked), "machine").drop("machine")  # as many rows as points


def machine(rows: DataFrame, point: dict, path: str, mapped: bool = False) -> Machine:
    """The point's machine on ``rows`` (sample_id, label, classes, x), solved by one task."""
    settings = settings_of(point)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_id", kind="stable")
        return pd.DataFrame([_fitted(part, settings, mapped).row()], columns=COLUMNS)

    _hashed(rows).select("sample_id", "hash", "label", "classes", "x").groupBy("classes").applyInPandas(run, STORED) \
        .write.mode("overwrite").parquet(path)
    return load(rows.sparkSession, path)


@dataclass
class Landmarks:
    """Maps scaled vectors to coordinates whose inner products are near the kernel's values."""

    vectors: np.ndarray
    settings: dict
    width: float

    @classmethod
    def of(cls, x: np.ndarray, settings: dict) -> Landmarks:
        """Landmarks whose own values say the width."""
        return cls(x, settings, width_of(settings["gamma"], x))

    def axes(self) -> np.ndarray:
        """What turns kernel values into coordinates."""
        size, axes = np.linalg.eigh(kernel(self.vectors, self.vectors, self.settings, self.width))
        held = size > 1e-10 * size.max(initial=0.0)
        return axes[:, held] / np.sqrt(size[held])

    def map(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.vectors, self.settings, self.width) @ self.axes()

    def transform(self, rows: DataFrame, column: str = "scaled", out: str = "mapped") -> DataFrame:
        own = self

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(own.map(np.array(x.tolist(), float))))

        return rows.withColumn(out, array_to_vector(F.pandas_udf(run, "array<double>")(vector_to_array(column))))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.vectors.tolist(), {k: str(v) for k, v in self.settings.items()}, self.width)
        spark.createDataFrame([row], "vectors array<array<double>>, settings map<string,string>, width double") \
            .coalesce(1).write.mode("overwrite").parquet(path)


def landmarks(rows: DataFrame, settings: dict, number: int = LANDMARKS, column: str = "scaled") -> Landmarks:
    """So many of the samples, those whose ids have the least hashes, as landmarks.

    The width goes by the landmarks' values; all samples, if there are no more.
    """
    some = rows.select(vector_to_array(column).alias("x"), F.xxhash64("sample_id").alias("h"), "sample_id") \
        .orderBy("h", "sample_id").limit(number).collect()
    return Landmarks.of(np.array([r.x for r in some], float), settings)


def load_landmarks(spark: SparkSession, path: str) -> Landmarks:
    r = spark.read.parquet(path).first()
    return Landmarks(np.array(r.vectors), r.settings, r.width)


@dataclass
class Mapped:
    """A scaler, landmarks and a linear machine of Spark ML, one after the other."""

    scaling: PipelineModel
    landmarks: Landmarks
    last: PipelineModel

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.last.transform(self.landmarks.transform(self.scaling.transform(rows)))

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaling.write().overwrite().save(f"{path}/scaling")
        self.landmarks.save(spark, f"{path}/landmarks")
        self.last.write().overwrite().save(f"{path}/last")


def load_mapped(spark: SparkSession, path: str) -> Mapped:
    return Mapped(PipelineModel.load(f"{path}/scaling"), load_landmarks(spark, f"{path}/landmarks"),
                  PipelineModel.load(f"{path}/last"))
