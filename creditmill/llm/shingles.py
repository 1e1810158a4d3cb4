"""Words and word shingles of whole texts as 64-bit hashes, computed on the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEPS = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U
)
_PLACES = np.arange(1, 65, dtype=_U) * _BASE
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text worked on at once; a worker's arrays for it take some forty times as much.
CHUNK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _STEPS[0]
    x = (x ^ (x >> _U(27))) * _STEPS[1]
    return x ^ (x >> _U(31))


def chunks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of runs of rows of ``size`` bytes (``CHUNK``); a long text makes a run alone. Null: empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (size or CHUNK), "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every row the number of words before it."""
    word = ~_IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after_blank, before_blank = np.ones(len(word), bool), np.ones(len(word), bool)
    after_blank[1:], before_blank[:-1] = ~word[:-1], ~word[1:]
    starts = np.flatnonzero(word & (after_blank | edge[:-1]))
    ends = np.flatnonzero(word & (before_blank | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, _U)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    chars = data[np.repeat(starts, lengths) + place]
    powers = np.full(int(lengths.max()), _BASE, _U)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    terms = ((_LOWER[chars] if lower else chars).astype(_U) + _U(1)) * powers[place]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(_U) * _STEPS[3])


def shingle_sets(texts: pa.Array, words: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row and its sorted distinct shingle hashes; a shorter text with words is one shingle, an empty one none."""
    for first, data, offsets in chunks(texts):
        starts, ends, rows = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        spread = [hashes * _STEPS[(j * 2 + 1) % 5] + _U(j) for j in range(words)]
        spread = [mixed(s + _PLACES[j]) for j, s in enumerate(spread)]
        n = max(0, len(hashes) - words + 1)
        runs = mixed(sum((s[j : j + n] for j, s in enumerate(spread)), np.zeros(n, _U))) if n else np.zeros(0, _U)
        for row in range(len(offsets) - 1):
            a, b = rows[row], rows[row + 1]
            if b - a >= words:
                yield first + row, np.unique(runs[a : b - words + 1])
            elif b > a:
                short = [spread[j][a + j] for j in range(b - a)] + [_PLACES[b - a] ^ _STEPS[4]]
                yield first + row, mixed(np.sum(short, keepdims=True, dtype=_U))
            else:
                yield first + row, np.zeros(0, _U)
