"""Exact encoding of a merge-type piece model by backtracking, and decoding.

A sequence of pieces is the encoding of its text exactly when every two
neighbours in it are what merging their own text gives.  So the encoder walks
over the text with the longest piece at each place, checks it against the piece
before, tries shorter ones, and goes back where none fits; a place from which
no piece leads on is marked in a bitfield and never tried again.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import MEMO, Memo, Merger
from .common import keeps, map_slices, texts, typed

#: The letter that stands for a space; a fixed value of the format, as are the kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: A rank that no merge has.
_NEVER = 1 << 60
#: Characters of a run of text up to which its ids are remembered.
SHORT = 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message of a model file."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class Model:
    """The pieces of a model file, in order of their ids, and its settings."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            top = list(fields(file.read()))
        message = {n: dict(fields(v)) for n, v in top if n in (2, 3)}
        trainer, normal = message.get(2, {}), message.get(3, {})
        pieces = [dict(fields(v)) for n, v in top if n == 1]
        self.pieces = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        self.scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        self.prefix = bool(normal.get(3, 1))
        self.end = trainer.get(42, 2)
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ").decode()
        plain = trainer.get(3) == 2 and trainer.get(35) and not trainer.get(24) and not normal.get(2) \
            and not normal.get(4, 1) and normal.get(5, 1) and set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        if not plain:
            raise ValueError(f"not a merge-type model with byte fallback and plain texts: {path}")


class Runs(Memo):
    """Ids of runs; long ones are not remembered, so that the memory is bounded."""

    def __missing__(self, run):
        return super().__missing__(run) if len(run) <= SHORT else self.make(run)


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        model = Model(path)
        self.prefix, self.end = model.prefix, model.end
        found = [(i, p) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL]
        order = {s: r for r, s in enumerate(sorted({model.scores[i] for i, _ in found}, reverse=True))}
        self.merger = Merger({p: order[model.scores[i]] for i, p in found}, str.__add__)
        spelled = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.bytes = [spelled[b] for b in range(256)]
        letters = {c for _, p in found for c in p}
        # Single letters always stand; longer pieces only if merging their own text gives them.
        self.halves = {p: h for _, p in found if len(p) > 1 and (h := self.last_merge(p))}
        stand = letters | set(self.halves)
        rank = self.merger.rank
        self.rising = set(letters)  # pieces whose merges come in the order of their ranks
        for p, h in sorted(self.halves.items(), key=lambda x: len(x[0])):
            if self.rising.issuperset(h) and all(rank.get(x, -1) < rank[p] for x in h if len(x) > 1):
                self.rising.add(p)
        self.rights, self.lefts = ({c: ((c, _NEVER),) for c in letters} for _ in "rl")
        self.fits = Memo(self.apart)
        ids = dict((p, i) for i, p in found)
        self.ids = {p: array("i", [ids[p]] if p in ids else self.spell(p)).tobytes() for p in stand}
        self.longest = ahocorasick.Automaton()  # read backwards, so that a match ends where its piece starts
        for piece in stand:
            self.longest.add_word(piece[::-1], piece)
        self.longest.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in stand), None) for p in stand}
        self.runs = self._runs([p for _, p in found if len(p) > 1])
        self.memo = Runs(self._run, limit=2 * MEMO)
        self._tables(model)

    @staticmethod
    def _runs(joined: list[str]) -> re.Pattern:
        """Pattern of the runs of text that are encoded by themselves: no piece
        holds two neighbours of different runs, so that no merge joins them."""
        inner = {c for p in joined for c in p}
        classes = "".join(f"\\U{ord(c):08x}" for c in sorted(inner - {SPACE}))
        word = f"[{classes}]" if classes else r"(?!)"
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            return re.compile(f"[{classes}{SPACE}]+|.", re.DOTALL)
        return re.compile(f"{SPACE}+{word}*|{word}+|.", re.DOTALL)

    def spell(self, text: str) -> list[int]:
        """Ids of the pieces that stand for the text's bytes."""
        return [self.bytes[b] for b in text.encode()]

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging the piece's own text joins last; None if it gives other pieces."""
        parts, rank = list(piece), self.merger.rank
        while len(parts) > 2:
            ranks = [rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            if (low := min(ranks)) == _NEVER:
                return None
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _border(self, piece: str, known: dict, side: int) -> tuple:
        """What stands at one end of the piece while it is merged: each symbol, and
        the rank of the merge that takes it in."""
        found = known.get(piece)
        if found is None:
            inner = self._border(self.halves[piece][side], known, side)
            found = known[piece] = (*inner[:-1], (inner[-1][0], self.merger.rank[piece]), (piece, _NEVER))
        return found

    def apart(self, pair: tuple[str, str]) -> bool:
        """Whether the two pieces stay apart when their text is merged together.

        Where ranks rise on the way to both, only the symbols at the border are merged
        again, in the order of their ranks; of equal ones the left is first.
        """
        a, b = pair
        if not a:  # nothing stands before the first piece
            return True
        rank = self.merger.rank
        if not (a in self.rising and b in self.rising):
            return self.merger.direct(a + b) == [a, b]
        right, left, i, j = self._border(a, self.rights, 1), self._border(b, self.lefts, 0), 0, 0
        while True:
            (x, end_x), (y, end_y) = right[i], left[j]
            across = rank.get(x + y, _NEVER)
            if across < end_x and across <= end_y:
                return False
            if end_x == end_y == _NEVER:
                return True
            if end_x <= end_y:
                i += 1
            else:
                j += 1

    def walk(self, text: str) -> list[str]:
        """Pieces of a run of known letters, by backtracking."""
        apart, shorter = self.fits, self.shorter
        # Read backwards; matches that end at one place come longest first, and the first is to stay.
        longest = dict(reversed(list(self.longest.iter(text[::-1]))))
        failed: bytearray | None = None  # bits by the number of letters that are left
        out: list[str] = []
        left, last, piece = len(text), "", longest[len(text) - 1]
        while left:
            while piece is not None:
                rest = left - len(piece)
                if apart[last, piece] and not (failed and failed[rest >> 3] >> (rest & 7) & 1):
                    break
                piece = shorter[piece]
            if piece is None:
                failed = failed or bytearray(len(text) // 8 + 1)
                failed[left >> 3] |= 1 << (left & 7)
                left += len(last)
                piece = shorter[out.pop()]
                last = out[-1] if out else ""
            else:
                out.append(piece)
                left, last, piece = rest, piece, longest.get(rest - 1)
        return out

    def _run(self, run: str) -> bytes:
        if run in self.ids:
            return self.ids[run]
        if len(run) == 1:
            return array("i", self.spell(run)).tobytes()
        ids = self.ids
        return b"".join([ids[p] for p in self.walk(run)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, without begin or end."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        return b"".join(map(self.memo.__getitem__, self.runs.findall(text)))

    def _tables(self, model: Model) -> None:
        """What each id decodes to, as bytes, and the ids that need more than that."""
        shown = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"",
                 UNKNOWN: lambda p: model.unknown.encode(), NORMAL: lambda p: p.replace(SPACE, " ").encode()}
        self.shown = dict(enumerate(shown[k](p) for p, k in zip(model.pieces, model.kinds)))
        self.strings = pa.array(self.shown.values(), pa.large_binary())
        self.is_byte = [k == BYTE for k in model.kinds]
        self.hidden = {i for i, k in enumerate(model.kinds) if k == CONTROL}
        self.opens = {i for i, (p, k) in enumerate(zip(model.pieces, model.kinds))
                      if k == NORMAL and p.startswith(SPACE)}

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: a space that the first visible one starts with is the
        encoder's own; a byte that is part of no whole character is U+FFFD."""
        shown = self.shown
        try:
            if not self.hidden.isdisjoint(ids[:-1]):  # these part the bytes beside them
                raise ValueError
            text = b"".join([shown[i] for i in ids]).decode()
        except ValueError:
            text = "".join(characters(b"".join(shown[i] for i in run)) for _, run in
                           groupby(ids, self.is_byte.__getitem__))
        first = next((i for i in ids if i not in self.hidden), None)
        return text[1:] if self.prefix and first in self.opens else text

    def decode_all(self, lists: pa.Array) -> list[str | None]:
        """The texts of many lists of ids.

        Arrow puts the bytes of all ids end to end; where a list's are whole
        characters and its ids hold nothing hidden but an end, they are its text.
        """
        flat = lists.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.shown):
            raise ValueError("an id is not in the model")
        found = self.strings.take(flat)
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64)[found.offset:] if len(found) else np.zeros(1, np.int64)
        view = memoryview(data) if data is not None else b""
        ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
        hidden = np.concatenate([[0], np.cumsum(np.isin(ids, list(self.hidden)))])
        out: list[str | None] = []
        for valid, a, b in zip(lists.is_valid().to_pylist(), ends.tolist(), ends[1:].tolist()):
            text = None
            if valid and (b == a or hidden[b - 1] == hidden[a]):
                try:
                    text = str(view[at[a]:at[b]], "utf-8")
                    if b > a and self.prefix and int(ids[a]) in self.opens:
                        text = text[1:]
                except UnicodeDecodeError:
                    pass
            out.append(self.decode(ids[a:b].tolist()) if valid and text is None else text)
        return out


def characters(data: bytes) -> str:
    """Text of bytes; each byte that is part of no whole character is U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for width in (1, 2, 3, 4):
            try:
                out.append(data[at:at + width].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("\ufffd")
            width = 1
        at += width
    return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """One coder per worker process."""
    return PieceCoder(path)


keeps(__name__, coder.cache_clear)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, an end id last: (id, ids array<int>).

    ``path`` is a model file that every worker can open.  Null and empty texts
    have the end id alone; no string in a text is special; other columns are not
    read; repeated rows give repeated rows.  Nothing is shuffled.
    """
    docs = docs.select(id_col, text_col)

    def task():
        encode_one, end = coder(path).encode, array("i", [coder(path).end]).tobytes()

        def step(batch):
            ids = [encode_one(t) + end for t in texts(batch, text_col)]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            return pa.record_batch([batch.column(id_col),
                                    pa.ListArray.from_arrays(ends.astype(np.int32), flat)],
                                   names=[id_col, "ids"])
        return step

    return map_slices(docs, task, f"{typed(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the text of their ids as a column ``decoded`` at the end.

    Null ids give a null text, no ids the empty one.  An id that the model does
    not have fails the job.  A column named ``decoded`` is replaced.
    """
    kept = encoded.drop("decoded")
    names = kept.columns

    def task():
        decode_all = coder(path).decode_all

        def step(batch):
            decoded = pa.array(decode_all(batch.column(ids_col)), pa.string())
            return pa.record_batch([*batch.columns, decoded], names=[*names, "decoded"])
        return step

    return map_slices(kept, task, ", ".join([*(typed(kept, c) for c in names), "decoded string"]))
