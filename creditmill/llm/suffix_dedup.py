"""Substring de-duplication by longest-previous-factor arrays.

A byte goes if it is covered by a string of ``least`` bytes that starts in another place too.
Texts are bytes; matches never cross documents. With ``keep="first"`` the earliest of equal
strings stays (documents in order of id, then by text, then by position), with ``keep="none"``
all of them go.

*Bringing equal strings together.* Every string of ``least`` bytes is named by the smallest hash
of the ``gram`` bytes at any place in it. Equal strings have equal names, and neighbours mostly
share theirs, so a text falls into runs of starting places with one name (about a hundred and
seventy places each). Names that occur once are done with. A run's bytes are hashed; runs equal in name and
hash are one segment, whose second and later places repeat the first.

*Suffix order.* The segments of a name are put side by side in order of their first places, many
names at a time, and the suffixes at their starting places are sorted to a depth of ``least``
bytes by prefix doubling. In suffix order the previous and the next smaller place of each
suffix, with the shortest common prefix on the way, give its longest earlier match. Where that
reaches ``least``, the place is a later copy, and the place it matches is an earlier one.

*Frequent names.* A name with more than ``BUCKET`` bytes of segments does not fit one sort. Its
segments are taken as texts of their own and named again, by the hashes of almost whole strings
(``FINE`` of ``least`` bytes), which a changed byte nearly always changes, so that few places have
company. A name that is too large even then is dealt to several sorts by the hash of the segment,
and the places that none of them found a copy of meet once more by the hash of their string.

Texts cross the shuffles compressed. Rows equal in id and text have equal results.

Defined cases: a null text is empty and keeps nothing, an empty one likewise; texts shorter than
``least`` stay as they are; rows without an id count, after those with one; rows equal in id and
text are places of their own with ``keep="none"``, and one place with ``keep="first"``, where all
of them keep what the first place keeps; very long texts are worked on piece by piece; what is
left of a text may be no valid UTF-8, so it is given as bytes; an empty table gives an empty
table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.llm.common import stored
from creditmill.llm.shingles import mixed

_U = np.uint64
#: Bytes that make a name; share of a string, in eighths, that makes a fine one; places of a run at most; bytes of
#: text, and of segments, worked on at once.
GRAM, FINE, LONGEST, CHUNK, BUCKET = 50, 7, 4096, 1 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_CODES = mixed(np.arange(1, 257, dtype=_U) * _U(_BASE))
#: A document's name: its id and the hash of its text; ``base``: where in it the text at hand begins.
_DOCUMENT = ["no_id", "id", "version"]
_PLACE = [*_DOCUMENT, "base"]


class Powers:
    """Powers of the base and of its inverse, modulo 2^64, made once for each process."""

    up = down = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                powers = np.full(n, base, _U)
                powers[0] = 1
                both.append(np.multiply.accumulate(powers))
            cls.up, cls.down = both
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every place on."""
    up, down = Powers.upto(max(len(data), 1))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_CODES[data] * up, out=total[1:])
    return mixed((total[gram:] - total[:-gram]) * down[: max(0, len(data) - gram + 1)])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every place on."""
    least, reach = values, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - reach :]) if reach < width else least


class Runs:
    """Runs of starting places with one name, in texts laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int, gram: int = GRAM):
        places = max(0, len(data) - least + 1)
        ends = np.repeat(offsets[1:], np.diff(offsets))[:places]
        whole = np.arange(places) + least <= ends
        if not whole.any():
            self.row = self.start = self.n = self.times = np.zeros(0, np.int64)
            self.name = self.hash = np.zeros(0, _U)
            return
        gram = min(gram, least)
        hashes = gram_hashes(data, gram)
        names = window_minima(hashes, least - gram + 1)
        same = whole[1:] & whole[:-1] & (names[1:] == names[:-1])
        first = np.flatnonzero(whole & np.concatenate([[True], ~same]))
        n = np.flatnonzero(whole & np.concatenate([~same, [True]])) + 1 - first
        parts = -(-n // LONGEST)
        step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        #: First place, number of places, row and name of every run.
        self.start = np.repeat(first, parts) + step * LONGEST
        self.n = np.minimum(np.repeat(n, parts) - step * LONGEST, LONGEST)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.name = names[self.start]
        view = memoryview(np.ascontiguousarray(data))
        bounds = zip(self.start.tolist(), (self.start + self.n + least - 1).tolist(), strict=True)
        #: A hash of all its bytes.
        self.hash = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in bounds], _U)
        near = np.flatnonzero(hashes <= self.name.max())
        key = mixed(hashes[near] ^ mixed(np.searchsorted(offsets, near, "right").astype(_U)))
        keys, counts = np.unique(key, return_counts=True)
        own = mixed(self.name ^ mixed((self.row + 1).astype(_U)))
        #: How often the bytes that make the name occur in the row.
        self.times = counts[np.searchsorted(keys, own)]


def pieces(texts: pa.Array, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, bytes of it that came before, bytes, row offsets. Of a long text, pieces whose strings overlap."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        if last == first + 1 and end - begin > CHUNK:
            for at in range(begin, end - least + 1, CHUNK):
                part = data[at : min(end, at + CHUNK + least - 1)]
                yield first, at - begin, part, np.array([0, len(part)])
        else:
            yield first, 0, data[begin:end], offsets[first : last + 1] - begin
        first = last


def _named(docs: DataFrame, *more: F.Column) -> DataFrame:
    """``no_id, id, version, base, text`` of whole documents."""
    known = docs["doc_id"].cast("long")
    text = docs["text"].cast("string")
    name = [known.isNull().alias("no_id"), F.coalesce(known, F.lit(0)).alias("id"), F.xxhash64(text).alias("version")]
    return docs.select(*name, F.lit(0).alias("base"), *more, text.alias("text"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _runs(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """``name, hash, at, n, times`` and the text's place: the runs of every text."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, before, data, offsets in pieces(batch.column("text"), least):
                runs = Runs(data, offsets, least, gram)
                row = pa.array(first + runs.row)
                at = before + runs.start - offsets[runs.row]
                yield pa.RecordBatch.from_arrays(
                    [_signed(runs.name), _signed(runs.hash), *[batch.column(c).take(row) for c in _PLACE],
                     pa.array(at, pa.int32()), pa.array(runs.n, pa.int32()), pa.array(np.minimum(runs.times, 2), pa.int32())],
                    names=["name", "hash", *_PLACE, "at", "n", "times"],
                )

    long = texts.where(F.octet_length("text") >= least)
    return long.mapInArrow(find, "name long, hash long, no_id boolean, id long, version long, base int, at int, n int, times int")


def _compressed(docs: DataFrame, *more: str) -> DataFrame:
    """The columns of ``docs``, with ``text`` compressed in ``z`` (null: empty) and ``size``, its bytes."""

    def press(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                plain = part.column("text").cast(pa.large_binary()).fill_null(b"")
                sizes = pa.compute.binary_length(plain).cast(pa.int64())
                z = [codec.compress(t.as_buffer(), asbytes=True) if len(t.as_buffer()) else b"" for t in plain]
                columns = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(z, pa.binary()), sizes], names=[*names, "z", "size"])

    names = [*_PLACE, *more]
    kinds = [*[docs.schema[c] for c in names], T.StructField("z", T.BinaryType()), T.StructField("size", T.LongType())]
    return docs.mapInArrow(press, T.StructType(kinds))


def _plain(z: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(z, size, asbytes=True) if size else b""


def classes(data: np.ndarray, begin: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The starting places of segments, and the rank of the ``least`` bytes from each one, in byte order.

    Segment ``i`` has ``n[i]`` starting places from ``begin[i]`` on and ``least - 1`` bytes more.
    """

    def places(depth: int) -> np.ndarray:
        count = n + (least - depth)
        return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))

    depth = 1
    rank = data.astype(np.int64)
    size = 256
    while depth < least:
        # Eight bytes at first, then twice as many each time; the last step overlaps to end at the depth asked for.
        new = min(least, max(8, 2 * depth)) if depth > 1 else min(least, 7)
        at = places(new)
        if depth == 1:
            key = rank[at]
            for k in range(1, new):
                key = key * 256 + rank[at + k]
        else:
            key = rank[at] * size + rank[at + new - depth]
        found, place = np.unique(key, return_inverse=True)
        rank[at], size, depth = place, len(found), new
    at = places(least)
    return at, rank[at]


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place its longest earlier match: the length and the place matched (-1: none).

    ``order``: places in suffix order; ``common[i]``: the common prefix of the suffixes at ``i - 1``
    and ``i`` of that order. Previous and next smaller places are found by pointer jumping.
    """
    length, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    for flip in (False, True):
        places = order[::-1] if flip else order
        shared = np.concatenate([[0], common[:0:-1]]) if flip else common.copy()
        jump = np.arange(len(order)) - 1
        if len(shared):
            shared[0] = 0
        open_ = np.flatnonzero((jump >= 0) & (shared > 0))
        while len(open_):
            open_ = open_[places[jump[open_]] > places[open_]]  # everything between is later too
            over = jump[open_]
            shared[open_] = np.minimum(shared[open_], shared[over])
            jump[open_] = jump[over]
            open_ = open_[(jump[open_] >= 0) & (shared[open_] > 0)]
        found = (jump >= 0) & (shared > 0)
        better = np.flatnonzero(found)
        better = better[shared[better] > length[places[better]]]
        length[places[better]], source[places[better]] = shared[better], places[jump[better]]
    return length, source


def repeated(data: np.ndarray, begin: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starting places, which of them are later copies, which are copied later, and their ranks.

    Places are numbered in the order given: the earlier segment, then the earlier place, comes first.
    """
    at, rank = classes(data, begin, n, least)
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    common = np.where(np.concatenate([[False], ranked[1:] == ranked[:-1]]), least, 0)  # what is shorter does not count
    length, source = previous_factors(order, common)
    later = length >= least
    earlier = np.zeros(len(at), bool)
    earlier[source[later]] = True
    return at, later, earlier, rank


def _intervals(flags: np.ndarray) -> np.ndarray:
    """Begin and end of every run of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).reshape(-1, 2)


def _where() -> F.Column:
    """A starting place: places order by document, then by their distance from its beginning."""
    return F.struct(*_DOCUMENT, (F.col("base") + F.col("at")).alias("pos"), "base", "at")


def _segments(runs: DataFrame) -> DataFrame:
    """``name, hash, n, times, places, first``: runs with equal bytes, their number, and the earliest of them."""
    return runs.groupBy("name", "hash").agg(
        F.max("n").alias("n"), F.max("times").alias("times"), F.count(F.lit(1)).alias("places"), F.min(_where()).alias("first")
    )


def _to_sort(segments: DataFrame, least: int, keep: str) -> DataFrame:
    """The segments of names that only a sort can settle, with the part of the name each one goes to."""
    own = F.col("times") > 1 if keep == "first" else (F.col("times") > 1) & (F.col("places") == 1)
    sizes = segments.groupBy("name").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.col("n") + least - 1).alias("bytes"), F.max(own).alias("own"), F.min("places").alias("fewest")
    )
    several = (F.col("segments") > 1) if keep == "first" else (F.col("segments") > 1) & (F.col("fewest") == 1)
    parts = F.ceil(F.col("bytes") / BUCKET)
    # Stored, as other sides of joins are, so that the rows of a frequent name can be split.
    names = stored(sizes.where(several | F.col("own")).select("name", parts.alias("parts")))
    joined = segments.join(names, "name")
    return joined.select("name", "hash", "n", "first", F.expr("cast(pmod(hash, parts) AS int)").alias("part"), (F.col("parts") > 1).alias("split"))


def _contents(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``wanted`` with the bytes of each segment, cut from the text of its first place."""
    whole = _compressed(texts.where(F.octet_length("text") >= least)).groupBy(*_PLACE).agg(F.first("z").alias("z"), F.first("size").alias("size"))
    cut = F.struct("name", "part", "split", "hash", F.col("first.at").alias("at"), "n")
    lists = wanted.groupBy(*[F.col(f"first.{c}").alias(c) for c in _PLACE]).agg(F.collect_list(cut).alias("cuts"))

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = _plain(batch.column("z")[i].as_py(), batch.column("size")[i].as_py())
                cuts = pa.RecordBatch.from_struct_array(batch.column("cuts")[i].values)
                begin, n = cuts.column("at").to_numpy(), cuts.column("n").to_numpy()
                content = [text[a : a + k + least - 1] for a, k in zip(begin.tolist(), n.tolist(), strict=True)]
                place = [batch.column(c).take(pa.array(np.full(len(n), i))) for c in _PLACE]
                yield pa.RecordBatch.from_arrays([*cuts.columns, *place, pa.array(content, pa.binary())], names=[*cuts.schema.names, *_PLACE, "content"])

    kinds = "name long, part int, split boolean, hash long, at int, n int, no_id boolean, id long, version long, base int, content binary"
    return lists.join(whole, _PLACE).select(*_PLACE, "z", "size", "cuts").mapInArrow(take, kinds)


def _sorted_out(contents: DataFrame, least: int, keep: str) -> DataFrame:
    """``name, hash, a, b``: starting places of a segment that count as repeated, from its ``a``-th to before its ``b``-th.

    Of names dealt to several sorts also the places without an earlier copy in theirs, one by one, with ``string``,
    a hash of what starts there, and the place.
    """

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # Places in order; texts are told apart by theirs, so that no segment occurs twice.
        rows = rows.append_column("pos", pa.compute.add(rows.column("base"), rows.column("at")))
        rows = rows.sort_by([(c, "ascending") for c in (*_DOCUMENT, "pos")])
        content, n = rows.column("content").combine_chunks().cast(pa.large_binary()), rows.column("n").to_numpy()
        begin = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content)]
        data = np.frombuffer(content.buffers()[2], np.uint8)
        at, later, earlier, rank = repeated(data, begin, n, least)
        covered = later if keep == "first" else later | earlier
        bounds = np.concatenate([[0], np.cumsum(n)])
        own = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(at)) - bounds[own]
        edge = np.zeros(len(at) + 1, bool)
        edge[bounds[:-1]] = True
        start = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]])))
        stop = np.flatnonzero(covered & (edge[1:] | (np.arange(len(at)) == len(at) - 1) | ~np.concatenate([covered[1:], [False]])))
        single = np.flatnonzero(~later & rows.column("split").to_numpy()[own])
        view = memoryview(data)
        strings = [xxhash.xxh3_64_intdigest(view[p : p + least]) for p in at[single].tolist()]
        segment = pa.array(np.concatenate([own[start], own[single]]))
        a = np.concatenate([inside[start], inside[single]])
        b = np.concatenate([inside[stop], inside[single]]) + 1
        string = pa.concat_arrays([pa.nulls(len(start), pa.int64()), _signed(np.array(strings, _U))])
        taken = rows.select(["name", "hash", *_PLACE, "at"]).take(segment).combine_chunks()
        yield from pa.Table.from_arrays(
            [*taken.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32()), string], names=["name", "hash", *_PLACE, "at", "a", "b", "string"]
        ).to_batches(max_chunksize=100_000)

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            names, parts = batch.column("name").to_numpy(), batch.column("part").to_numpy()
            first = 0
            if waiting:  # up to where the last name of the rows before ends
                last = waiting[-1]
                end = (last.column("name")[-1].as_py(), last.column("part")[-1].as_py())
                other = (names != end[0]) | (parts != end[1])
                first = int(np.argmax(other)) if other.any() else len(other)
                waiting.append(batch.slice(0, first))
                waiting = [w for w in waiting if w.num_rows]
            edges = np.flatnonzero((names[1:] != names[:-1]) | (parts[1:] != parts[:-1])) + 1
            edges = [*edges[edges > first].tolist(), len(names)] if first < len(names) else []
            lengths = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column("content")).to_numpy())])
            size += int(lengths[first])
            for edge in edges:
                if size >= BUCKET:
                    yield from settle(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                waiting.append(batch.slice(first, edge - first))
                size += int(lengths[edge] - lengths[first])
                first = edge
        if waiting:
            yield from settle(pa.Table.from_batches(waiting))

    dealt = contents.repartition("name", "part").sortWithinPartitions("name", "part")
    kinds = "name long, hash long, no_id boolean, id long, version long, base int, at int, a int, b int, string long"
    return dealt.mapInArrow(sort, kinds)


def _covered(texts: DataFrame, least: int, keep: str, fine: bool = False) -> DataFrame:
    """``a``, ``b`` and a text's place: starting places from ``a`` to before ``b`` whose strings are repeated."""
    runs = _runs(texts, least, max(1, least * FINE // 8) if fine else GRAM)
    often = stored(runs.groupBy("name").agg(F.sum("times").alias("times")).where("times > 1").select("name"))
    runs = stored(runs.join(often, "name"))
    segments = stored(_segments(runs))
    contents = stored(_contents(texts, _to_sort(segments, least, keep), least))
    split = contents.where("split")
    if fine or split.isEmpty():
        found = stored(_sorted_out(contents, least, keep))
        parts = found.where("string is null").select("name", "hash", "a", "b").union(_across(found, keep))
    else:
        parts = _sorted_out(contents.where("not split"), least, keep).select("name", "hash", "a", "b")
        again = split.select(*_DOCUMENT, (F.col("base") + F.col("at")).alias("base"), F.col("content").alias("text"))
        place = [F.col(c).alias(f"own_{c}") for c in _DOCUMENT] + [(F.col("base") + F.col("at")).alias("own_base")]
        own = split.select("name", "hash", *place)
        same = [F.col(c) == F.col(f"own_{c}") for c in _PLACE]
        parts = parts.union(_covered(again, least, keep, fine=True).join(own, same).select("name", "hash", "a", "b"))
    lists = parts.groupBy("name", "hash").agg(F.collect_set(F.struct("a", "b")).alias("parts"))

    verdicts = segments.select("name", "hash", "places", "first").join(lists, ["name", "hash"], "left").where("places > 1 or parts is not null")
    joined = runs.join(stored(verdicts), ["name", "hash"])
    whole = F.col("places") > 1
    if keep == "first":
        whole = _where() != F.col("first")
    here = F.transform("parts", lambda p: F.struct((F.col("at") + p["a"]).alias("a"), (F.col("at") + p["b"]).alias("b")))
    all_of_it = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")))
    return joined.select(*_PLACE, F.inline(F.when(whole, all_of_it).otherwise(here)).alias("a", "b"))


def _across(found: DataFrame, keep: str) -> DataFrame:
    """``name, hash, a, b``: of the places that the sorts of a name left single, those whose strings meet after all."""
    single = found.where("string is not null")
    place = F.struct(*_DOCUMENT, (F.col("base") + F.col("at") + F.col("a")).alias("pos"))
    met = single.groupBy("name", "string").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("earliest")).where("copies > 1")
    across = single.withColumn("place", place).join(stored(met), ["name", "string"])
    if keep == "first":
        across = across.where("place <> earliest")
    return across.select("name", "hash", "a", "b")


def covered_spans(docs: DataFrame, least: int = 400, keep: str = "none") -> DataFrame:
    """``no_id, id, version, spans``: for every text that loses bytes, parts of it (``a`` to before ``b``) that go."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    span = F.struct("a", (F.col("b") + (least - 1)).alias("b"))
    return _covered(_named(docs), least, keep).groupBy(*_DOCUMENT).agg(F.collect_set(span).alias("spans"))


def dedup_substrings(docs: DataFrame, least: int = 400, keep: str = "none") -> DataFrame:
    """``docs`` in a struct ``row`` (without the text), with ``kept`` (bytes), ``n_bytes``, ``n_removed``, ``n_spans``."""
    spans = covered_spans(docs, least, keep)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row")
    rows = _compressed(_named(docs, row), "row")
    joined = rows.join(spans, _DOCUMENT, "left")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for z, size, parts in zip(batch.column("z"), batch.column("size").to_pylist(), batch.column("spans"), strict=True):
                text = _plain(z.as_py(), size)
                merged = []
                if parts.is_valid:
                    a, b = (parts.values.field(k).to_numpy() for k in range(2))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    merged = list(zip(a[new].tolist(), b[np.concatenate([new[1:], [True]])].tolist(), strict=True))
                edges = [0, *[e for m in merged for e in m], size]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if merged else text)
                counts.append((size, size - len(kept[-1]), len(merged)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), *columns], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    kinds = T.StructType([joined.schema["row"], T.StructField("kept", T.BinaryType()), *counts])
    return joined.select("row", "z", "size", "spans").mapInArrow(rebuild, kinds)


def substring_report(docs: DataFrame, least: int = 400, keep: str = "none") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    done = dedup_substrings(docs.select("doc_id", "text"), least, keep)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
