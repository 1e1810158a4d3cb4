"""Words of many texts at once, split as byte-level models split them, on the bytes of Arrow columns.

The pattern of ``tokens.WORDS`` decides by kinds of characters alone (blanks, letters, numbers, others), by the blank
before a word and by apostrophes, so that every beginning of a word is found from the bytes around it. Words up to
``LONGEST`` bytes are also held side by side, as rows of a matrix; equal ones are found by a hash and compared.
"""

from __future__ import annotations

import numpy as np
import regex

from creditmill.llm.shingles import mixed
from creditmill.llm.vocabulary import added_tokens

#: Bytes of a word in a matrix, at most.
LONGEST = 32
_U = np.uint64
_COLUMNS = LONGEST // 8
_OTHER, _BLANK, _LETTER, _NUMBER = range(4)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


class Kinds:
    """The kind of every code point, made once for each process."""

    table = np.zeros(0, np.uint8)

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if not len(cls.table):
            every = np.arange(0x110000, dtype="<u4")
            every[0xD800:0xE000] = 0  # no characters
            text, table = every.tobytes().decode("utf-32-le"), np.full(len(every), _OTHER, np.uint8)
            for kind, pattern in ((_BLANK, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
                for run in regex.finditer(pattern, text):
                    table[run.start() : run.end()] = kind
            cls.table = table
        return cls.table[points]


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of the character that each byte of UTF-8 belongs to; and bytes of the character that begins there."""
    kinds = Kinds.of(data)
    sizes = np.ones(len(data), np.uint8)
    first = np.flatnonzero(data >= 0xC0)
    if len(first):
        sizes[data >= 0x80] = 0
        bytes_ = 2 + (data[first] >= 0xE0) + (data[first] >= 0xF0)
        sizes[first] = bytes_
        for n in (2, 3, 4):
            at = first[bytes_ == n]
            point = data[at].astype(np.int64) & (0x7F >> n)
            for k in range(1, n):
                point = point << 6 | data[at + k] & 0x3F
            for k in range(n):
                kinds[at + k] = Kinds.of(point)
    return kinds, sizes


class Words:
    """The words of texts laid end to end, in their order: ``begin``, ``size``, and ``bounds``, the first word of every text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, added: regex.Pattern | None = None):
        self.data = data
        kinds, sizes = kinds_of(data)
        edges, whole = offsets, []
        if added and added.search(data):
            cuts = [(a + m.start(), a + m.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in added.finditer(data[a:b].tobytes())]
            whole = np.array(cuts, np.int64).reshape(-1, 2)
            edges = np.unique(np.concatenate([offsets, whole.ravel()]))
        edge = np.zeros(len(data) + 1, bool)
        edge[edges] = True
        blank = data == 0x20
        start = edge[:-1].copy()
        start[1:] |= (kinds[1:] != kinds[:-1]) & ~blank[:-1]  # a blank goes to the word after it
        last = np.flatnonzero((kinds == _BLANK) & (sizes > 0))
        after = last + sizes[last]
        last, after = last[~edge[after]], after[~edge[after]]
        start[last[kinds[after] != _BLANK]] = True  # the last of several blanks is apart
        self._contractions(data, kinds, edge, edges, start)
        for a, b in whole:
            start[a + 1 : b] = False
        self.begin = np.flatnonzero(start)
        self.size = np.diff(self.begin, append=len(data))
        self.bounds = np.searchsorted(self.begin, offsets)

    @staticmethod
    def _contractions(data: np.ndarray, kinds: np.ndarray, edge: np.ndarray, edges: np.ndarray, start: np.ndarray) -> None:
        """An apostrophe that begins a word takes one of s, t, m, d, re, ve, ll along, and another word begins behind it."""
        at = np.flatnonzero(data == 0x27)
        at = at[edge[at] | (kinds[at - 1] != _OTHER) & (data[at - 1] != 0x20)]
        room = edges[np.searchsorted(edges, at, "right")] - at - 1
        one, two = (np.where(room >= k, data[np.minimum(at + k, len(data) - 1)], 0) for k in (1, 2))
        single = np.isin(one, list(b"stmd"))
        double = np.isin(one.astype(np.int64) << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
        start[at[single | double] + 1] = False
        behind = np.concatenate([at[single & (room >= 2)] + 2, at[double & (room >= 3)] + 3])
        start[behind] = True

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        begin = self.begin[which]
        return [raw[a:b] for a, b in zip(begin.tolist(), (begin + self.size[which]).tolist(), strict=True)]

    def matrix(self) -> np.ndarray:
        """The bytes of every word, up to ``LONGEST``, in words of eight; zeros behind its end."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
        out = np.zeros((len(self.begin), _COLUMNS), _U)
        for k in range(_COLUMNS):
            some = np.flatnonzero(self.size > 8 * k)
            out[some, k] = eight[self.begin[some] + 8 * k] & _MASKS[np.minimum(self.size[some] - 8 * k, 8)]
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each distinct word, the number of that word for every word, and the rows of the matrix for the places."""
        rows = self.matrix()
        short = np.flatnonzero(self.size <= LONGEST)
        own = np.column_stack([rows[short], self.size[short].astype(_U)])
        name = own[:, _COLUMNS]
        for k in range(_COLUMNS):
            name = mixed(name ^ own[:, k])
        _, first, number = np.unique(name, return_index=True, return_inverse=True)
        if not np.array_equal(own[first][number], own):  # two words have one hash
            _, first, number = np.unique(own, axis=0, return_index=True, return_inverse=True)
        place, numbers = short[first], np.empty(len(self.begin), np.int64)
        numbers[short] = number.reshape(-1)
        long = np.flatnonzero(self.size > LONGEST)
        if len(long):
            known: dict[bytes, int] = {}
            numbers[long] = [known.setdefault(w, len(place) + len(known)) for w in self.bytes_of(long)]
            place = np.concatenate([place, long[np.unique(numbers[long], return_index=True)[1]]])
        return place, numbers, rows[place]


def added_pattern(path: str) -> regex.Pattern | None:
    """A pattern over bytes that finds the added tokens of a vocabulary, longest first."""
    own = sorted((t.encode() for t in added_tokens(path)), key=len, reverse=True)
    return regex.compile(b"|".join(map(regex.escape, own))) if own else None
