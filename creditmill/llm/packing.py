"""Best-fit packing of token sequences with swap-based local search.

Documents become pieces of at most ``size`` tokens. Full pieces are sequences of their own; the
rest are dealt to groups by a hash, packed best fit first, longest first, and then improved:
pieces move, or change places one for one or two for one, whenever the sum of squared fills grows,
so that sequences run empty, until no step is left or there are as few as any packing needs.
Groups hold some ten thousand pieces, so that each loses less than a sequence to the best.

Defined cases: a null or empty text is the end id alone; copies of a row are packed like any
other rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import stored
from creditmill.llm.tokens import encoder

#: Pieces that one task packs together, about.
GROUP = 20_000


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: all of them full but perhaps the first."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype(np.uint32)
                for piece, (start, length) in enumerate(pieces_of(len(ids), size)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in ``lengths``: the longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        k = bisect.bisect_left(rooms, need)
        if k < len(rooms):
            room = rooms[k]
            own = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            bins[own].append(i)
        else:
            room, own = size, len(bins)
            bins.append([i])
        left = room - need
        if not by_room[left]:
            bisect.insort(rooms, left)
        by_room[left].append(own)
    return bins


def least_bins(lengths: list[int], size: int) -> int:
    """Bins that any packing needs: by volume, and by pieces too long to share one."""
    rest = np.sort(np.array(lengths, np.int64))
    upto = np.concatenate([[0], np.cumsum(rest)])
    below = lambda n: np.searchsorted(rest, n, "right")  # noqa: E731  how many have n or less
    half = below(size // 2)
    # Pieces shorter than ``small`` are left out; those longer than size - small then fill a bin alone.
    small = np.unique(np.append(rest[:half], size // 2))
    alone = below(size - small)
    huge, large = len(rest) - alone, alone - half
    spare = large * size - (upto[alone] - upto[half])
    middle = upto[half] - upto[below(small - 1)]
    by_length = huge + large + np.maximum(0, -(-(middle - spare) // size))
    return max(-(-int(upto[-1]) // size), int(by_length.max()))


class Search:
    """Local search over the bins that are neither empty nor full.

    A step takes one or two pieces out of a bin, puts them into another and takes none, one or
    two of the other's back (two for one either way, one for one, or a move), if that fits and the sum
    of squared fills grows. What bins can give back is known by their room: ``least[k][room, x]``
    is the smallest total of x or more that a bin with this room holds, in at most one piece
    (k = 0) or in two (k = 1). The best step of a bin is thereby one look-up for every total it can
    give and every room there is. All of them are tried: a bin of ``size`` tokens has at most
    sqrt(2 size) different lengths, so at most ``size`` different totals of two.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int):
        self.len, self.size, self.bins = lengths, size, bins
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.used = sum(1 for b in bins if b)
        self.holders: dict[tuple[int, int, int], dict[int, None]] = {}
        self.there = np.zeros((2, size + 1, size + 1), bool)
        self.least = np.zeros((2, size + 1, size + 1), np.int32)
        self.stale: set[int] = set()
        self.rooms: dict[int, int] = {}
        self.totals: dict[int, tuple[dict, dict]] = {}
        for b in range(len(bins)):
            self._enter(b)

    def _open(self, b: int) -> bool:
        return 0 < self.fill[b] < self.size

    def _enter(self, b: int) -> None:
        if not self._open(b):
            return
        by_length: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by_length.setdefault(self.len[i], []).append(i)
        lengths = list(by_length)
        one = {n: by_length[n][:1] for n in lengths}
        two = {}
        for x, n in enumerate(lengths):
            for m in lengths[:x]:
                two[n + m] = [by_length[n][0], by_length[m][0]]
            if len(by_length[n]) > 1:
                two[2 * n] = by_length[n][:2]
        self.totals[b] = one, two
        room = self.size - self.fill[b]
        self.rooms[room] = self.rooms.get(room, 0) + 1
        self.stale.add(room)
        for k, totals in enumerate(({0: [], **one}, two)):
            for n in totals:
                self.holders.setdefault((k, room, n), {})[b] = None
                self.there[k, room, n] = True

    def _leave(self, b: int) -> None:
        if not self._open(b):
            return
        room = self.size - self.fill[b]
        one, two = self.totals.pop(b)
        self.rooms[room] -= 1
        if not self.rooms[room]:
            del self.rooms[room]
        self.stale.add(room)
        for k, totals in enumerate(([0, *one], two)):
            for n in totals:
                own = self.holders[k, room, n]
                del own[b]
                if not own:
                    del self.holders[k, room, n]
                    self.there[k, room, n] = False

    def _refresh(self) -> None:
        if self.stale:
            rows = np.fromiter(self.stale, np.int64)
            totals = np.where(self.there[:, rows], np.arange(self.size + 1), 2 * self.size)
            self.least[:, rows] = np.minimum.accumulate(totals[:, :, ::-1], axis=2)[:, :, ::-1]
            self.stale.clear()

    def step(self, source: int) -> int:
        """Take the step from ``source`` that adds most to the squared fills; the other bin, or -1."""
        one, two = self.totals[source]
        self._leave(source)
        self._refresh()
        rooms = np.fromiter(self.rooms, np.int64, len(self.rooms))
        ahead = self.size - self.fill[source] - rooms  # fill of the other less that of the source
        best, chosen = 0, None
        for k, outs in enumerate(({**two, **one}, one)):
            give = np.fromiter(outs, np.int64, len(outs))[:, None]
            back = self.least[k, rooms, np.maximum(0, give - rooms)] if outs and len(rooms) else np.zeros((0, 0))
            net = give - back if back.size else back
            gain = np.where((net > 0) & (net > -ahead), net * (net + ahead), 0) if back.size else back
            if gain.size and gain.max() > best:
                x, y = np.unravel_index(gain.argmax(), gain.shape)
                best, chosen = int(gain[x, y]), (outs[int(give[x, 0])], k, int(rooms[y]), int(back[x, y]))
        if chosen is None:
            self._enter(source)
            return -1
        out, k, room, total = chosen
        target = next(iter(self.holders[k, room, total]))
        back = self.totals[target][k][total] if total else []
        self._leave(target)
        for own, gone, come in ((source, out, back), (target, back, out)):
            self.bins[own] = [i for i in self.bins[own] if i not in gone] + come
            self.fill[own] += sum(self.len[i] for i in come) - sum(self.len[i] for i in gone)
            self._enter(own)
        self.used -= not self.bins[source]
        return target

    def run(self) -> list[list[int]]:
        """Bins after the last step: none is left, or no packing needs fewer."""
        least = least_bins(self.len, self.size) if self.len else 0
        todo = [(self.fill[b], b) for b in range(len(self.bins)) if self._open(b)]
        while todo:
            heapq.heapify(todo)
            waiting, tried, moved = {b for _, b in todo}, [], False
            while todo and self.used > least:
                fill, source = heapq.heappop(todo)
                if source not in waiting or fill != self.fill[source]:
                    continue
                waiting.discard(source)
                if not self._open(source):
                    continue
                target = self.step(source)
                if target < 0:
                    tried.append(source)
                    continue
                moved = True
                for b in (source, target):
                    waiting.add(b)
                    heapq.heappush(todo, (self.fill[b], b))
            # What changed may have given a step to bins that had none.
            todo = [(self.fill[b], b) for b in set(tried) if self._open(b)] if moved and self.used > least else []
        return [b for b in self.bins if b]


def pack(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in ``lengths``, as few as the search finds."""
    return Search(lengths, best_fit(lengths, size), size).run()


def packed(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    numbered = stored(pieces).withColumn("row", F.monotonically_increasing_id())
    groups = max(1, round(numbered.where(F.col("length") < size).count() / GROUP))

    def fill(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        table = table.sort_by("row")
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, own in enumerate(pack(lengths, size)):
            at = 0
            for i in own:
                sequence[i], offset[i] = group << 32 | number, at
                at += lengths[i]
        return table.drop_columns(["grp", "row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = f"{', '.join(f'{c} {t}' for c, t in pieces.dtypes)}, sequence_id long, offset long"
    short = numbered.where(F.col("length") < size).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    full = numbered.where(F.col("length") == size).select(
        *pieces.columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return short.groupBy("grp").applyInArrow(fill, schema).union(full)


def packed_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return packed(token_pieces(docs, path, size, end_id), size)
