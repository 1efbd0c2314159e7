"""Byte-pair merges as a monoid: encodings of neighbours are joined at their border.

A sequence of tokens is the encoding of its bytes exactly when every two
neighbours in it are the encoding of their own bytes.  So an encoding of a long
piece is put together from those of its halves: a window around the border is
encoded anew and grown until the tokens at its edges agree with the untouched
tokens next to them; all others are proved by their halves.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Hashable, Sequence
#: Symbols up to which a piece is merged directly, without halving.
LEAF = 48
#: Entries of each of the two generations of a memo.
MEMO = 250_000

_NONE = 1 << 60


class Merger:
    """Merges symbols by rank, lowest first, leftmost first.

    ``rank`` maps ``pair(a, b)`` to the rank of joining the two neighbours.
    """

    def __init__(self, rank: dict[Hashable, int], pair: Callable):
        self.rank, self.pair = rank, pair
        self.fits: dict = {}

    def direct(self, parts: Sequence) -> list:
        parts = list(parts)
        get, pair = self.rank.get, self.pair
        ranks = [get(pair(a, b), _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            whole = parts[i] = parts[i] + parts.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = get(pair(whole, parts[i + 1]), _NONE)
            if i:
                ranks[i - 1] = get(pair(parts[i - 1], whole), _NONE)
        return parts

    def encode(self, symbols: Sequence) -> list:
        """Tokens of a whole piece by halving it, down to leaves."""
        if len(symbols) <= LEAF:
            return self.direct(symbols)
        middle = len(symbols) // 2
        return self.join(self.encode(symbols[:middle]), self.encode(symbols[middle:]))

    def join(self, left: list, right: list) -> list:
        """The encoding of two neighbours' bytes from their encodings."""
        wide = 1
        while True:
            keep, skip = max(len(left) - wide, 0), min(wide, len(right))
            window = self.direct(s for t in left[keep:] + right[:skip] for s in self.symbols(t))
            if (not keep or self.fit(left[keep - 1], window[0])) and (
                    skip == len(right) or self.fit(window[-1], right[skip])):
                return left[:keep] + window + right[skip:]
            wide *= 2

    def fit(self, a, b) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self.direct([*self.symbols(a), *self.symbols(b)]) == [a, b]
        return known

    @staticmethod
    def symbols(token):
        """The single symbols of a token: bytes of bytes, characters of a string."""
        return [token[i:i + 1] for i in range(len(token))]


class Memo(dict):
    """A bounded cache of a function: two generations, the older one is dropped."""

    def __init__(self, make: Callable, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def drop(self) -> None:
        """Both generations go."""
        self.clear()
        self.old = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def load_merges(path: str) -> dict:
    """A tokenizer's JSON file."""
    with open(path, encoding="utf-8") as text:
        return json.load(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


#: A space whose follower is white space or the end: there a cut is not safe.
_LOOSE = re.compile(r" (?!\S)")


def chunks(text: str, pattern) -> list[str]:
    """Parts of a text that the split pattern treats independently.

    Before a space that something other than white space follows, the pattern
    always starts a match, so the text is cut there.  Texts in which some space
    has no such follower are cut into the matches themselves.
    """
    if _LOOSE.search(text):
        return pattern.findall(text)
    first, *rest = text.split(" ")
    parts = [" " + part for part in rest]
    return [first, *parts] if first else parts
