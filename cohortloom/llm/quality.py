"""Text quality by logistic regression on hashed word n-grams, trained online."""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import Memo
from .common import free_name, keeps, map_slices, serve, slices, texts, typed

#: Weights of the model; its size is this, whatever the corpus.
BUCKETS = 1 << 18
#: Labelled rows that the model is fitted on; those whose ids have the least hashes.
SAMPLE = 8_192
#: Learning rate, its smoothing, and the two penalties of the update rule.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
#: Score from which a text counts as good.
THRESHOLD = 0.7

#: Odd multipliers that spread hash bits; any would do.
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FAMILY = (np.arange(1, 6, dtype=np.uint64) * _SPREAD[2]) >> np.uint64(7)


def shape(word: str) -> str:
    """The word's outline: runs of capitals, small letters and digits; other signs as they are."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))


def _marks(word: str) -> int:
    """Hash of the lower-cased word in the low half, of its outline in the high half."""
    return zlib.crc32(word.lower().encode()) | zlib.crc32(shape(word).encode()) << 32


_memo = Memo(_marks, limit=50_000)
keeps(__name__, _memo.drop)


def grams(text: str) -> np.ndarray:
    """Buckets of the text's words, outlines, and pairs of neighbours of either.

    A word that follows itself gives one common pair, whatever the word.
    """
    marks = np.fromiter(map(_memo.__getitem__, text.split()), np.uint64)
    word, form = marks & np.uint64(0xFFFFFFFF), marks >> np.uint64(32)
    pairs = [(word[:-1] * _SPREAD[0]) ^ (word[1:] * _SPREAD[1]),
             (form[:-1] * _SPREAD[0]) ^ (form[1:] * _SPREAD[1])]
    pairs[0][word[:-1] == word[1:]] = 0
    mixed = np.concatenate([(part ^ family) * _SPREAD[0] for part, family in zip(
        (word, form, *pairs), _FAMILY)])
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader with a rate of its own for every weight."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0,
                        -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One row: its distinct buckets, their values, and 0 or 1."""
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets, how often each occurs, and the number of words, one at least."""
    at, counts = np.unique(grams(text), return_counts=True)
    return at.astype(np.int32), counts.astype(np.int32), max(len(text.split()), 1)


def _shares(at: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares; the last bucket is the constant."""
    return np.append(at, BUCKETS), np.append(counts / words, 1.0)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares; the last bucket is the constant."""
    return _shares(*_counted(text))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether the id as text falls into the fold by its CRC-32; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", folds: int = 4, fold: int = 2) -> np.ndarray | None:
    """Weights, the constant's last; None without a labelled row.

    Labels of the held-out fold and null labels are not read; of several labels
    of one document the least counts, and of several rows with one id the least
    text.  ``SAMPLE`` labelled ids, the first by hash, bound what is gathered;
    features are made where the texts are, one task takes them in hash order.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
                          & ~held_out(F.col(id_col), folds, fold)) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")) \
        .withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(SAMPLE)
    texts_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts_of.join(F.broadcast(chosen), "id").groupBy("id", "label", "order") \
        .agg(F.min("text").alias("text"))

    def prepare(batch):
        found = [_counted(t) for t in texts(batch, "text")]
        whole = pa.list_(pa.int32())  # one Arrow batch carries the sample: half the bytes of places and shares
        return pa.record_batch([batch.column("id"), batch.column("order"),
                                pa.array([int(y > 0) for y in batch.column("label").to_pylist()]),
                                pa.array([a for a, _, _ in found], whole),
                                pa.array([n for _, n, _ in found], whole),
                                pa.array([w for _, _, w in found], pa.int32())],
                               names=["id", "order", "label", "at", "counts", "words"])

    def fit(batches):
        serve(__name__)
        model, seen = Ftrl(), 0
        for batch in slices(batches):
            for label, at, counts, words in zip(*(batch.column(c) for c in ("label", "at", "counts", "words"))):
                model.learn(*_shares(at.values.to_numpy(), counts.values.to_numpy(), words.as_py()), label.as_py())
                seen += 1
        if seen:
            weights = model.weights(slice(None)).astype(np.float32)
            yield pa.record_batch([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    made = map_slices(rows, lambda: prepare,
                      f"{typed(rows, 'id')}, order long, label long, at array<int>, "
                      "counts array<int>, words int")
    fitted = made.repartition(1).sortWithinPartitions("order", "id") \
        .mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(fitted[0].weights, np.float32) if fitted else None


def score(docs: DataFrame, weights: np.ndarray | None, name: str = "score",
          text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text as column ``name``.

    A score is between 0 and 1; null and empty texts get that of the constant.
    Without a model every score is 1.  ``docs`` must have no column ``name``.
    """
    names = docs.columns

    def step(batch):
        found = []
        for text in texts(batch, text_col):
            at = grams(text)
            words = max(len(at) // 4 + (len(at) > 0), 1)
            found.append(1.0 if weights is None else float(
                sigmoid(weights[at].sum(dtype=np.float64) / words + weights[BUCKETS])))
        return pa.record_batch([*batch.columns, pa.array(found, pa.float64())], names=[*names, name])

    return map_slices(docs, lambda: step,
                      ", ".join([*(typed(docs, c) for c in names), f"`{name}` double"]))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
             text_col: str = "text", folds: int = 4, fold: int = 2) -> DataFrame:
    """(id, held_out, score, predicted) of every document, repeated rows too."""
    weights = train(docs, labels, label_col, id_col, text_col, folds, fold)
    scored = score(docs.select(id_col, text_col), weights, text_col=text_col)
    return scored.select(id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    weights = train(docs, labels, label_col, id_col, text_col)
    name = free_name(docs.columns, "score")
    return score(docs, weights, name, text_col).where(F.col(name) >= THRESHOLD).drop(name)
