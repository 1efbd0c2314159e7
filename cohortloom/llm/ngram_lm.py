"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted
hash arrays in shared storage, memory-mapped by the workers that score texts.
"""

from __future__ import annotations

import tempfile
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import cut, scratch_path
from .bpe import Memo
from .common import slices, texts, typed
from .quality import held_out

#: Tokens that a task gathers before it sorts them into one batch of counts.
FLUSH = 1_000_000
#: Least number of shards of the arrays; beyond it, so many for every input split.
SHARDS, SPLIT_SHARDS = 4, 2
#: Kinds of whole numbers that counts are stored as.
COUNTS = (np.uint8, np.uint16, np.uint32, np.uint64)
#: Signs that no word can be, for the end of a text and the place before its start.
END, START = (xxhash.xxh64_intdigest(s) for s in (b"\n", b"\t"))

_memo = Memo(xxhash.xxh64_intdigest, limit=60_000)


class Store(NamedTuple):
    """Arrays as files under a folder that all executors share."""
    root: str

    def put(self, name: str, array: np.ndarray) -> None:
        """Write a file whole under another name, then give it its own: a task
        that is run again replaces it by the same bytes."""
        files, path = fs.FileSystem.from_uri(self.root)
        files.create_dir(path, recursive=True)
        draft = tempfile.mktemp(prefix=f"{name}.", dir="").lstrip("/")
        with files.open_output_stream(f"{path}/{draft}", compression=None) as out:
            out.write(np.ascontiguousarray(array))
        files.move(f"{path}/{draft}", f"{path}/{name}")

    def put_counts(self, name: str, counts: np.ndarray) -> None:
        """Write counts in the narrowest kind that holds them all."""
        most = int(counts.max(initial=0))
        kind = next(k for k in COUNTS if most <= np.iinfo(k).max)
        self.put(name, counts.astype(kind))

    def get_counts(self, name: str, number: int) -> np.ndarray:
        """That many counts; the size of the file tells their kind."""
        counts = self.get(name, np.uint8)
        return counts.view(next(k for k in COUNTS if np.dtype(k).itemsize * number == len(counts)))

    def get(self, name: str, dtype) -> np.ndarray:
        """The array, mapped and not read; a store without paths is copied to an
        unnamed local file first."""
        files, path = fs.FileSystem.from_uri(self.root)
        size = files.get_file_info(f"{path}/{name}").size
        if not size:
            return np.zeros(0, dtype)
        if isinstance(files, fs.LocalFileSystem):
            return np.memmap(f"{path}/{name}", dtype, "r")
        with tempfile.TemporaryFile() as copy, files.open_input_stream(f"{path}/{name}") as data:
            while piece := data.read(1 << 22):
                copy.write(piece)
            copy.flush()
            return np.memmap(copy, dtype, "r")


def shared_uri(path: str) -> str:
    """A path of the shared folder as a URI."""
    return path if urlsplit(path).scheme else f"file://{path}"


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's words, A-Z lower-cased, and of its end."""
    words = text.encode().lower().split()
    return np.fromiter((*map(_memo.__getitem__, words), END), np.uint64, len(words) + 1)


def pairs(runs: list[np.ndarray]) -> np.ndarray:
    """Bigram keys of texts: the halves of the hashes of a token's forerunner and its own."""
    found = np.concatenate(runs)
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[np.cumsum([0, *(len(r) for r in runs[:-1])])] = START
    return (before >> np.uint64(32) << np.uint64(32)) | (found >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """Bytes of numbers, those of equal weight together, so that small numbers compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpacked(data: bytes, dtype, columns: int = 1) -> np.ndarray:
    width = np.dtype(dtype).itemsize * columns
    found = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype)
    return found if columns > 1 else found.ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def shard_of(tops: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 32-bit top half; equal tops share one, in order of the tops."""
    return (tops.astype(np.uint64) * np.uint64(shards)) >> np.uint64(32)


def pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each bigram key: by all its bits, so one word's pairs spread over all shards."""
    mixed = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return shard_of((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32), shards)


class Part(NamedTuple):
    """Counts of one kind for one shard, keys as differences."""
    kind: str
    shard: int
    keys: bytes
    counts: bytes


PARTS = "kind string, shard int, keys binary, counts binary"


def parts(kind: str, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """The sorted keys and counts cut into rows, one per shard that has any."""
    if kind == "pair":
        at = pair_shard(keys, shards)
        order = np.argsort(at, kind="stable")
        keys, counts, at = keys[order], counts[order], at[order]
    else:
        at = shard_of(keys >> np.uint64(32), shards)
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(keys)]
    rows = [Part(kind, int(at[a]), packed(np.diff(keys[a:b], prepend=np.uint64(0))),
                 packed(counts[a:b].astype(np.uint64))) for a, b in zip(edges, edges[1:]) if b > a]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(
        columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=list(Part._fields))


def merged(table: pa.Table, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts, so many to a key, of all rows of one kind and shard."""
    of = np.cumsum([0, *(len(k.as_buffer()) // 8 for k in table["keys"])])
    keys = np.empty(of[-1], np.uint64)
    counts = np.empty((len(keys), columns) if columns > 1 else len(keys), np.uint64)
    # Row by row out of Arrow's own memory: only the whole arrays are held beside it.
    for a, b, k, c in zip(of, of[1:], table["keys"], table["counts"]):
        np.cumsum(unpacked(k.as_buffer(), np.uint64), dtype=np.uint64, out=keys[a:b])
        counts[a:b] = unpacked(c.as_buffer(), np.uint64, columns)
    return summed(keys, counts)


def steps_of(counts: np.ndarray) -> list[int]:
    """How many counts are one, two, three and four."""
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def discounts(steps) -> np.ndarray:
    """What modified Kneser-Ney takes from counts of one, two, and three or more."""
    n1, n2, n3, n4 = (float(n) for n in steps)
    if min(n1, n2, n3, n4) <= 0:  # too little text to estimate from
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, 0.05, [0.95, 1.95, 2.95])


class Model(NamedTuple):
    """Where the arrays are, and the numbers that hold for all of them."""
    store: Store
    shards: int
    total: int           # training tokens
    kinds: int           # distinct training tokens
    bigram: np.ndarray   # discounts of bigram counts
    follow: np.ndarray   # discounts of the numbers of forerunners
    follows: int         # distinct bigrams
    spare: float         # their share that the uniform part gets


SUMS = ("kind string, shard int, keys binary, counts binary, n long, total long, "
        "n1 long, n2 long, n3 long, n4 long")


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the texts of ``docs``, all of them, and write the model's arrays.

    Tasks count what they hold before anything is shuffled; a shard then holds a
    range of hashes of words or of whole pairs, so its size does not hang on how
    often one word occurs.  What pairs say of their forerunner and their last
    word is added up per shard first, then in shards of these words.
    """
    spark = docs.sparkSession
    shards = max(SHARDS, SPLIT_SHARDS * docs.rdd.getNumPartitions())
    store = Store(shared_uri(scratch_path(spark, "ngrams")))

    def count(batches):
        held, size = [], 0

        def flush():
            for kind, keys in (("word", np.concatenate(held)), ("pair", pairs(held))):
                yield parts(kind, *np.unique(keys, return_counts=True), shards)

        for batch in slices(batches):
            for text in texts(batch, text_col):
                held.append(tokens(text))
                size += len(held[-1])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def sums(kind, shard, counts, more=None):
        row = more or pa.record_batch([pa.array([kind]), pa.array([shard], pa.int32()), pa.array([b""]),
                                       pa.array([b""])], names=list(Part._fields))
        numbers = [len(counts), int(counts.sum()), *steps_of(counts)]
        first = [pa.array([n] + [0] * (row.num_rows - 1), pa.int64()) for n in numbers]
        return pa.Table.from_arrays([*row.columns, *first],
                                    names=[*Part._fields, "n", "total", "n1", "n2", "n3", "n4"])

    def merge(key, table):
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, counts = merged(table)
        store.put(f"{kind}-{shard}-keys", keys)
        store.put_counts(f"{kind}-{shard}-counts", counts)
        if kind == "word":
            return sums(kind, shard, counts)
        # What this shard's followers of each forerunner leave to others; other shards have more of them.
        tops = keys >> np.uint64(32) << np.uint64(32)
        first = np.flatnonzero(np.append(True, tops[1:] != tops[:-1]))
        left = np.stack([np.add.reduceat(x, first) for x in (
            counts, *((counts == n).astype(np.uint64) for n in (1, 2)), (counts > 2).astype(np.uint64))], axis=1)
        lasts, forerunners = np.unique(keys << np.uint64(32), return_counts=True)
        return sums(kind, shard, counts, pa.Table.from_batches([
            parts("first", tops[first], left, shards), parts("last", lasts, forerunners, shards)]).combine_chunks())

    def merge_ends(key, table):
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, counts = merged(table, 4 if kind == "first" else 1)
        store.put(f"{kind}-{shard}-keys", (keys >> np.uint64(32)).astype(np.uint32))
        store.put_counts(f"{kind}-{shard}-counts", counts)
        return sums(kind, shard, counts).select(["kind", "n", "total", "n1", "n2", "n3", "n4"])

    found = cut(docs.select(text_col).mapInArrow(count, PARTS).groupBy("kind", "shard")
                .applyInArrow(merge, SUMS))
    numbers = [F.sum(c).alias(c) for c in ("n", "total", "n1", "n2", "n3", "n4")]
    of = {r.was: r for r in found.withColumn("was", F.when(F.col("kind") == "word", "word")
                                             .otherwise("pair")).groupBy("was").agg(*numbers).collect()}
    last = cut(found.where("kind IN ('first', 'last')").select("kind", "shard", "keys", "counts")
               .groupBy("kind", "shard").applyInArrow(
                   merge_ends, "kind string, " + SUMS.partition("binary, counts binary, ")[2])) \
        .where("kind = 'last'").agg(*numbers).first()
    if not of or of["word"].n is None:
        return Model(store, 0, 0, 0, discounts([0] * 4), discounts([0] * 4), 0, 1.0)
    word, pair = of["word"], of["pair"]
    follow = discounts([last[f"n{i}"] for i in (1, 2, 3, 4)])
    over = last["n"] - last["n1"] - last["n2"]
    spare = float(follow @ [last["n1"], last["n2"], over]) / last["total"]
    return Model(store, shards, word.total, word.n, discounts([pair[f"n{i}"] for i in (1, 2, 3, 4)]),
                 follow, last["total"], spare)


def looked_up(model: Model, kind: str, keys: np.ndarray, tops: np.ndarray, dtype, width: int = 1) -> np.ndarray:
    """Counts of sorted keys from the mapped arrays, shard by shard; 0 where there are none."""
    out = np.zeros((len(keys), width), np.float64)
    if not model.shards or not len(keys):
        return out
    if kind == "pair":
        at = pair_shard(keys, model.shards)
        order = np.argsort(at, kind="stable")
        at = at[order]
    else:
        at, order = shard_of(tops, model.shards), None
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1), len(keys)]
    for a, b in zip(edges, edges[1:]):
        rows = slice(a, b) if order is None else order[a:b]
        wanted = keys[rows]
        try:
            known = model.store.get(f"{kind}-{int(at[a])}-keys", dtype)
        except FileNotFoundError:  # no training text has a key of this shard
            continue
        if len(known):
            values = model.store.get_counts(f"{kind}-{int(at[a])}-counts", len(known) * width).reshape(-1, width)
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            out[rows] = np.where((known[place] == wanted)[:, None], values[place], 0)
    return out


def taken(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return np.concatenate([[0.0], of])[np.minimum(counts, 3).astype(int)]


def chances(model: Model, keys: np.ndarray) -> np.ndarray:
    """log10 of each sorted bigram's probability."""
    tops, lows = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF))
    seen = looked_up(model, "pair", keys, tops, np.uint64)[:, 0]
    heads, back = np.unique(tops.astype(np.uint32), return_inverse=True)
    stats = looked_up(model, "first", heads, heads, np.uint32, 4)
    total = np.maximum(stats[:, 0], 1)
    left = np.where(stats[:, 0] > 0, stats[:, 1:] @ model.bigram / total, 1.0)[back]
    seen = (seen - taken(seen, model.bigram)) / total[back]
    ends, back = np.unique(lows.astype(np.uint32), return_inverse=True)
    forerunners = looked_up(model, "last", ends, ends, np.uint32)[:, 0]
    lower = (forerunners - taken(forerunners, model.follow)) / max(model.follows, 1) \
        + model.spare / (model.kinds + 1)
    return np.log10(seen + left * lower[back])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every whole text.

    ``score`` is the model's log10 probability, ``base_score`` that of words
    alone with one added to every count.
    """
    docs = docs.select(id_col, text_col)
    names = [id_col, "n_tokens", "n_known", "base_score", "score"]

    def scored(ids, held):
        found = np.concatenate(held)
        starts = np.cumsum([0, *(len(r) for r in held[:-1])])
        words, back = np.unique(found, return_inverse=True)
        counts = looked_up(model, "word", words, words >> np.uint64(32), np.uint64)[:, 0]
        plain = np.log10((counts + 1) / (model.total + model.kinds + 1))
        keys, of = np.unique(pairs(held), return_inverse=True)
        return pa.record_batch(
            [pa.concat_arrays(ids), pa.array([len(r) for r in held], pa.int64()),
             pa.array(np.add.reduceat((counts > 0).astype(np.int64)[back], starts)),
             pa.array(np.add.reduceat(plain[back], starts)),
             pa.array(np.add.reduceat(chances(model, keys)[of], starts))], names=names)

    def run(batches):
        ids, held, size = [], [], 0
        for batch in slices(batches):
            ids.append(batch.column(id_col))
            for text in texts(batch, text_col):
                held.append(tokens(text))
                size += len(held[-1])
            if size >= FLUSH:
                yield scored(ids, held)
                ids, held, size = [], [], 0
        if held:
            yield scored(ids, held)

    return docs.mapInArrow(run, f"{typed(docs, id_col)}, n_tokens long, n_known long, "
                                "base_score double, score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
                fold: int = 2) -> DataFrame:
    """Train on the texts outside the held-out fold and score all: (id, held_out,
    n_tokens, n_known, train_tokens, base_score, score).

    Null and empty texts have one token, their end; with no training text every
    token is equally likely.  Repeated rows count and are scored each; other
    columns are not read.
    """
    out = held_out(F.col(id_col), folds, fold)
    model = train(docs.where(~out), text_col)
    return score(docs, model, id_col, text_col).select(
        id_col, out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
