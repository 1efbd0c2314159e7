"""Byte-level BPE encoding and decoding by reduction over a tree."""

from __future__ import annotations

from array import array
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import Memo, Merger, chunks, load_ranks
from .common import keeps, map_slices, texts, typed


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.merger = Merger(self.ranks, add)
        self.memo = Memo(self._chunk)

    def piece(self, data: bytes) -> list[int]:
        """A match of the pattern: one token as a whole, else merged."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        symbols = [data[i:i + 1] for i in range(len(data))]
        return [self.ranks[t] for t in self.merger.encode(symbols)]

    def _chunk(self, part: str) -> bytes:
        ids = array("i")
        for match in self.pattern.findall(part):
            ids.extend(self.piece(match.encode()))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers: those of the chunks, concatenated."""
        return b"".join(map(self.memo.__getitem__, chunks(text, self.pattern)))

    @property
    def strings(self) -> tuple[np.ndarray, pa.Array]:
        """The ids in order, and the bytes of each."""
        ids = sorted(self.tokens)
        return np.array(ids), pa.array([self.tokens[i] for i in ids], pa.large_binary())


def concatenated(strings: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbouring strings joined into one per interval of ``ends``.

    Arrow holds the strings of an array end to end, so that the bytes of a
    whole subtree are one interval and only the borders are chosen anew.
    """
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].tobytes()), data])


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per worker process."""
    return ByteBpe(path, pattern)


keeps(__name__, coder.cache_clear)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (id, ids array<int>).

    ``path`` is a rank file that every worker can open.  Each match of
    ``pattern`` is encoded by itself; no string is special.  Null and empty
    texts give no ids; other columns are not read; repeated rows give repeated
    rows.  Nothing is shuffled.
    """
    docs = docs.select(id_col, text_col)

    def task():
        encode_one = coder(path, pattern).encode

        def step(batch):
            ids = [encode_one(t) for t in texts(batch, text_col)]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            return pa.record_batch([batch.column(id_col),
                                    pa.ListArray.from_arrays(ends.astype(np.int32), flat)],
                                   names=[id_col, "ids"])
        return step

    return map_slices(docs, task, f"{typed(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the bytes of their ids as a column ``decoded`` at the end.

    Null ids give null bytes, no ids give no bytes.  An id that the rank file
    does not have fails the job.  A column named ``decoded`` is replaced.
    """
    kept = encoded.drop("decoded")
    names = kept.columns

    def task():
        known, strings = coder(path, pattern).strings

        def step(batch):
            lists = batch.column(ids_col)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(known, flat)
            if len(flat) and (at.max() == len(known) or (known[at] != flat).any()):
                raise ValueError("an id is not in the rank file")
            ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            data = concatenated(strings.take(pa.array(at)), ends)
            data = pc.if_else(lists.is_valid(), data, None).cast(pa.binary())
            return pa.record_batch([*batch.columns, data], names=[*names, "decoded"])
        return step

    return map_slices(kept, task, ", ".join([*(typed(kept, c) for c in names), "decoded binary"]))
