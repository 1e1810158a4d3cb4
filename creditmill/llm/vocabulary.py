"""A byte-level vocabulary from its file: ids, bytes, and exact merging of words."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np

#: Ids spelled out at once.
IDS = 500_000


def added_tokens(path: str) -> dict[str, int]:
    """Strings that are one token wherever they stand."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, their bytes, and the merges of a byte-level model."""

    def __init__(self, path: str):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.added = added_tokens(path)
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.first = [ids[bytes([b])] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        self.base = max(self.bytes_of) + 1
        keys = np.array([a * self.base + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order  # ranks count up in the order of the file
        self.merged = np.array([new for _, new in self.ranks.values()], np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as bytes of 32-bit integers: the pair of lowest rank merges first, the leftmost of equals."""
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_width.setdefault(-(-len(word) // 8), []).append(i)
        for width, own in by_width.items():
            if width > 8:
                for i in own:
                    out[i] = np.array(self._merge_long([self.first[b] for b in words[i]]), np.uint32).tobytes()
            elif width:
                self._merge_side_by_side([words[i] for i in own], 8 * width, own, out)
        return out

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, as many as there are merges where two do not merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], len(self.pair_keys))

    def _merge_side_by_side(self, words: list[bytes], width: int, place: list[int], out: list[bytes]) -> None:
        """All words of a width at once, one merge of each in every step."""
        none = len(self.pair_keys)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        padded = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], np.array(self.first, np.int32)[padded], -1)
        ranks = self._found(ids[:, :-1], ids[:, 1:])
        place = np.array(place)
        while len(ids):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            best = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), none)
            done = best == none
            for i, row, n in zip(place[done].tolist(), ids[done], (ids[done] >= 0).sum(1).tolist(), strict=True):
                out[i] = row[:n].tobytes()
            ids, ranks, place, at, best = (x[~done] for x in (ids, ranks, place, at, best))
            if not len(ids):
                return
            rows = np.arange(len(ids))
            ids[rows, at] = self.merged[best]
            keep = np.ones(ids.shape, bool)
            keep[rows, at + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            ranks = ranks[keep[:, 1:]].reshape(len(ids), -1)
            for shift in (-1, 0):  # the pairs on both sides of the new id
                k = at + shift
                some = rows[(k >= 0) & (k < ranks.shape[1])]
                ranks[some, k[some]] = self._found(ids[some, k[some]], ids[some, k[some] + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for one long word, with a heap of pairs and linked neighbours."""
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.ranks.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def spelling(self, of: Callable[[int], bytes]) -> Callable[[np.ndarray], bytes]:
        """A function that strings together what ``of`` says of each id."""
        said = [of(i) if i in self.bytes_of else b"" for i in range(self.base)]
        pool = np.frombuffer(b"".join(said), np.uint8)
        lengths = np.fromiter(map(len, said), np.int64, self.base)
        starts = np.cumsum(lengths) - lengths

        def spell(ids: np.ndarray) -> bytes:
            n = lengths[ids]
            ends = np.cumsum(n)
            shift = np.repeat(starts[ids] - ends + n, n)
            return pool[shift + np.arange(len(shift))].tobytes()

        return spell

    def spelled(self, of: Callable[[int], bytes] | None = None) -> Callable[[np.ndarray, np.ndarray], Iterator[bytes]]:
        """The same for many texts, whose ids are strung together: a text's spelling for every two of the bounds.

        ``of``: the bytes of an id, if not given.
        """
        spell = self.spelling(of or self.bytes_of.__getitem__)
        lengths = np.array([len(of(i) if of else self.bytes_of[i]) if i in self.bytes_of else 0 for i in range(self.base)], np.int64)

        def each(ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
            first = 0
            while first < len(bounds) - 1:  # about so many ids at once; of a longer text, piece by piece
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + IDS, "right")) - 1)
                begin, end = int(bounds[first]), int(bounds[last])
                said = b"".join(spell(ids[k : min(end, k + IDS)]) for k in range(begin, end, IDS))
                ends = np.concatenate([[0], np.cumsum(lengths[ids[begin:end]])])[bounds[first : last + 1] - begin].tolist()
                yield from (said[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
                first = last

        return each

    def decoder(self) -> Callable[[np.ndarray], str]:
        """A function from ids to text; unknown ids say nothing."""
        spell = self.spelling(self.bytes_of.__getitem__)
        return lambda ids: spell(ids).decode("utf-8", "replace")
