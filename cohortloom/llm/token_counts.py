"""Token counts: vocabulary strings proved to be one token are counted as they are."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe import Memo, Merger, byte_letters, chunks, load_merges
from .common import keeps, map_slices, texts, typed

#: The split that the byte-level pre-tokenizer makes; a fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Counts tokens as a byte-level BPE tokenizer file gives them."""

    def __init__(self, path: str):
        spec = load_merges(path)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] \
                or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        letters = byte_letters()
        back = {letter: bytes([b]) for b, letter in enumerate(letters)}
        raw = lambda s: b"".join(back[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merger = Merger({(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)},
                             lambda a, b: (a, b))
        special = {t["content"] for t in spec["added_tokens"]}
        self.single = self.prove(raw(t) for t in model["vocab"] if t not in special)
        self.special = regex.compile("|".join(
            regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(BYTE_LEVEL)
        self.memo = Memo(self._chunk)

    def prove(self, tokens) -> frozenset[bytes]:
        """The vocabulary strings whose merges end in one token, found by merging each."""
        return frozenset(t for t in tokens if len(self.merger.encode(Merger.symbols(t))) == 1)

    def _piece(self, data: bytes) -> int:
        return 1 if data in self.single else len(self.merger.encode(Merger.symbols(data)))

    def _chunk(self, part: str) -> int:
        return sum(self._piece(m.encode()) for m in self.pattern.findall(part))

    def count(self, text: str) -> int:
        found = 0
        if self.special and self.special.search(text):
            found, parts = len(self.special.findall(text)), self.special.split(text)
        else:
            parts = (text,)
        return found + sum(sum(map(self.memo.__getitem__, chunks(p, self.pattern))) for p in parts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker process; the proof is made when it is built."""
    return Counter(path)


keeps(__name__, counter.cache_clear)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Size of every whole text: (id, n_bytes, n_tokens, over_limit).

    ``path`` is a byte-level BPE tokenizer file that every worker can open.  Its
    added tokens are one token each wherever their strings stand in a text.
    Null and empty texts have no tokens; other columns are not read; repeated
    rows give repeated rows.  Nothing is shuffled.
    """
    docs = docs.select(id_col, text_col)

    def task():
        count = counter(path).count

        def step(batch):
            rows = texts(batch, text_col)
            return pa.record_batch([batch.column(id_col),
                                    pa.array([len(t.encode()) for t in rows], pa.int64()),
                                    pa.array([count(t) for t in rows], pa.int64())],
                                   names=[id_col, "n_bytes", "n_tokens"])
        return step

    return map_slices(docs, task, f"{typed(docs, id_col)}, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
