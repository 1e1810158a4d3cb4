"""Jaccard join on word shingles by T-occurrence search (DivideSkip).

Texts with equal shingle sets are one item. Two rounds of block-wise shuffles find, without
losing a pair, the items that can have a partner and the groups they can have it in: a round by
shingle counts in how many items each shingle occurs (an item whose shared shingles are too few
to reach the threshold is done), a round by rare shingles hangs together items that share one
of their rarest (the prefix filter). Inside a group every query merges its short inverted lists
with a heap and probes the long ones by binary search; items that reach the required overlap
link. Groups too large for a task are searched in blocks, after pivots have tied together most
of their members: a query goes to the blocks that hold a shingle of its prefix, and the queries of
a block in batches that are no larger than a block.

Shingles are 64-bit hashes. Items are told apart by two 64-bit hashes of their sets and named by
the first; sets that share the first with another one get names of their own.

Defined cases: texts without words have no shingles and link with nothing; a null text is
empty; copies of a row link with each other; a row without an id links with nothing and has no
component; rows of one id with different texts are items of their own; an empty table gives an
empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import components, in_slices, slices, stored
from creditmill.llm.shingles import mixed, shingle_sets

_U = np.uint64
#: Shingles of one group that a single task searches at once.
GROUP_SHINGLES = 60_000
#: Rounds of pivots over groups larger than that, at most.
PIVOTS = 6
#: Sets with a name of their own, at most; so many are to be expected of two million million different sets.
RENAMED = 100_000


def _set_hashes(tokens: np.ndarray) -> tuple[int, int]:
    one = mixed(tokens + _U(1)).sum(dtype=_U)
    two = mixed(tokens * _U(0x9E3779B97F4A7C15) + _U(2)).sum(dtype=_U)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _least_overlap(n: int, percent: int) -> int:
    """Shingles a set of ``n`` shares with any partner, at least."""
    return -(-percent * n // 100)


# ---- items ---------------------------------------------------------------------------------


def _items(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, version, n, item, check`` for every row; ``version`` tells the texts of an id apart."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *_set_hashes(s)) for _, s in shingle_sets(batch.column("text"), words)]
            n, item, check = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(n, pa.int64()), pa.array(item, pa.int64()), pa.array(check, pa.int64())],
                names=["doc_id", "version", "n", "item", "check"],
            )

    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return read.mapInArrow(measure, "doc_id long, version long, n long, item long, check long")


# ---- blocks: many short arrays in one row ---------------------------------------------------

_BLOCK = "part int, items binary, sizes binary, counts binary, high binary, low binary, ranks binary"
_NAMES = ["part", "items", "sizes", "counts", "high", "low", "ranks"]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in 16 bits each where all of them fit, else in 32."""
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def _blocks(parts: int, to: np.ndarray, items, sizes, owner, keys, ranks) -> pa.RecordBatch:
    """One row per part; the keys of an item stay together. ``to``: each key's part; ``owner``: its item's place."""
    order = np.argsort(to.astype(np.uint16), kind="stable") if parts <= 65536 else np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(parts + 1))
    rows: dict[str, list] = {k: [] for k in _NAMES}
    for part in np.flatnonzero(np.diff(ends)):
        own = order[ends[part] : ends[part + 1]]
        whose = owner[own]
        first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        rows["part"].append(int(part))
        rows["items"].append(items[whose[first]].tobytes())
        rows["sizes"].append(_narrow(sizes[whose[first]]))
        rows["counts"].append(_narrow(np.diff(np.append(first, len(own)))))
        rows["high"].append((keys[own] >> _U(32)).astype(np.uint32).tobytes())
        rows["low"].append(keys[own].astype(np.uint32).tobytes())
        rows["ranks"].append(ranks[own].tobytes() if ranks is not None else b"")
    types = [pa.int32()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(_NAMES, types, strict=True)], names=_NAMES)


def _read(table: pa.Table) -> tuple[np.ndarray, ...]:
    """items, sizes, counts (of keys for each entry), keys, ranks: all rows of a part as one."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    keys = join("high", np.uint32).astype(_U) << _U(32) | join("low", np.uint32).astype(_U)

    def wide(name: str) -> np.ndarray:
        cells = zip(table.column("items").to_pylist(), table.column(name).to_pylist(), strict=True)
        return np.concatenate([np.frombuffer(c, np.uint16 if 4 * len(c) == len(i) else np.uint32) for i, c in cells]).astype(np.int64)

    return join("items", np.int64), wide("sizes"), wide("counts"), keys, join("ranks", np.uint8)


def _dealt_shingles(docs: DataFrame, words: int, parts: int, names: dict[tuple[int, int], int]) -> DataFrame:
    """Every item's shingles, dealt by their upper bits; a task sends a set once. ``names``: those that differ from the first hash."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        items: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets])
            keys = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            return _blocks(parts, (keys >> _U(48)) % _U(parts), np.array(items), sizes, owner, keys, None)

        for batch in batches:
            for row, tokens in shingle_sets(batch.column("text"), words):
                hashes = _set_hashes(tokens)
                item = names.get(hashes, hashes[0])
                if not len(tokens) or item in seen or batch.column("doc_id")[row].as_py() is None:
                    continue
                seen.add(item)
                items.append(item)
                sets.append(tokens)
                held += len(tokens)
                if held > 3_000_000:
                    yield from in_slices(flush())
                    items, sets, held = [], [], 0
        if items:
            yield from in_slices(flush())

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(deal, _BLOCK)


def _count_occurrences(parts: int):
    """Of one part's shingles, those in two items or more, with a rank that grows with their number."""

    def count(table: pa.Table) -> pa.Table:
        items, sizes, counts, keys, _ = _read(table)
        _, first, place = np.unique(items, return_index=True, return_inverse=True)
        own = np.zeros(len(items), bool)
        own[first] = True  # an item that several tasks sent counts once
        owner = np.repeat(np.arange(len(items)), counts)
        keep = own[owner]
        owner, keys = owner[keep], keys[keep]
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]]) if len(order) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        often = np.zeros(len(keys), np.int64)
        often[order] = np.bincount(run)[run] if len(run) else 0
        shared = often >= 2
        owner, keys = owner[shared], keys[shared]
        ranks = np.minimum(255, np.ceil(np.log2(often[shared]) * 8)).astype(np.uint8)
        to = mixed(items.view(_U))[owner] % _U(parts)
        found = _blocks(parts, to, items, sizes, owner, keys, ranks)
        return pa.Table.from_batches(in_slices(found), found.schema)

    return count


def _survivors(percent: int):
    """Items of one part with enough shared shingles: all of those, rarest first, and how many make the prefix."""

    def choose(table: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"item": [], "n": [], "prefix": [], "tokens": []}
        cols = []
        for i in range(table.num_rows):
            items, sizes, counts, keys, ranks = _read(table.slice(i, 1))
            cols.append((np.repeat(items, counts), np.repeat(sizes, counts), keys, ranks))
        item, size, keys, ranks = (np.concatenate(c) for c in zip(*cols, strict=True))
        order = np.lexsort((keys, ranks, item))
        item, size, keys = item[order], size[order], keys[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(item)), strict=True):
            least = _least_overlap(int(size[a]), percent)
            if b - a >= least:
                rows["item"].append(int(item[a]))
                rows["n"].append(int(size[a]))
                rows["prefix"].append(int(b - a) - least + 1)
                rows["tokens"].append(keys[a:b].tobytes())
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        found = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))
        return pa.Table.from_batches(in_slices(found), found.schema)

    return choose


def _dealt_prefixes(sets: DataFrame, parts: int) -> DataFrame:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = [np.frombuffer(t, _U)[:p] for t, p in zip(batch.column("tokens").to_pylist(), batch.column("prefix").to_pylist(), strict=True)]
            keys = mixed(np.concatenate(tokens))
            owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            items = batch.column("item").to_numpy(zero_copy_only=False)
            yield from in_slices(_blocks(parts, (keys >> _U(48)) % _U(parts), items, np.zeros(len(items)), owner, keys, None))

    return sets.mapInArrow(deal, _BLOCK)


class _Sets:
    """Union-find over places 0..n-1; the smallest place is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.size = [1] * n

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        if x != y:
            self.up[y] = x
            self.size[x] += self.size[y]


_EDGES = "a long, b long"


def _edge_table(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tie(table: pa.Table) -> pa.Table:
    """Items that share a key of the part, as edges to one item of each tied set."""
    items, _, counts, keys, _ = _read(table)
    names, place = np.unique(items, return_inverse=True)
    owner = np.repeat(place, counts)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    sets = _Sets(len(names))
    for x, y in np.unique(np.stack([owner[same], owner[same + 1]], 1), axis=0).tolist() if len(same) else ():
        sets.join(x, y)
    roots = [sets.root(x) for x in range(len(names))]
    moved = [x for x, r in enumerate(roots) if x != r]
    return _edge_table(names[moved], names[[roots[x] for x in moved]])


# ---- the search ------------------------------------------------------------------------------


class InvertedLists:
    """The inverted lists of a block of sets, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], percent: int):
        self.sizes, self.percent = np.array(sizes, np.int64), percent
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keys = np.concatenate(sets) if sets else np.zeros(0, _U)
        order = np.argsort(keys, kind="stable")  # owners ascend inside a list
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.owners = owner[order]

    def partners(self, tokens: np.ndarray, n: int, skip=None) -> list[int]:
        """Places of the sets that reach the threshold with a set of ``n`` shingles, ``tokens`` the shared ones.

        ``skip(place)``: no need to look at it.
        """
        least = _least_overlap(n, self.percent)
        at = np.searchsorted(self.keys, tokens)
        inside = at < len(self.keys)
        at = at[inside]
        at = at[self.keys[at] == tokens[inside]]
        if len(at) < least:
            return []
        lengths = self.first[at + 1] - self.first[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        n_long = min(least - 1, int(least / (0.05 * np.log2(longest + 1) + 1)))
        lists = [self.owners[self.first[k] : self.first[k + 1]] for k in at]
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = heapq.merge(*(x.tolist() for x in short))
        found = [(p, c) for p, c in ((p, sum(1 for _ in run)) for p, run in groupby(merged)) if c >= least - n_long]
        found = [(p, c) for p, c in found if not (skip and skip(p))]
        if not found:
            return []
        places = np.array([p for p, _ in found])
        overlap = np.array([c for _, c in found])
        for one in long:
            overlap += one[np.minimum(np.searchsorted(one, places), len(one) - 1)] == places
        return places[100 * overlap >= self.percent * (self.sizes[places] + n - overlap)].tolist()


def linked(sets: list[np.ndarray], sizes: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of all sets: a query is left out only where none of its links could matter."""
    index, ties = InvertedLists(sets, sizes, percent), _Sets(len(sets))
    edges: list[tuple[int, int]] = []
    largest = 0  # of the largest component; what waits inside it is put off
    waiting = sorted(range(len(sets)), key=lambda i: sizes[i], reverse=True)
    while waiting:
        put_off = []
        for query in waiting:
            own = ties.root(query)
            if edges and own == ties.root(largest):
                put_off.append(query)
                continue
            for other in index.partners(sets[query], sizes[query], lambda p, own=own: ties.root(p) == own):
                if ties.root(other) != ties.root(query):
                    edges.append((query, other))
                    ties.join(query, other)
            if ties.size[ties.root(query)] > ties.size[ties.root(largest)]:
                largest = query
        waiting = put_off
        if all(ties.root(i) == ties.root(largest) for i in waiting):
            break  # those still waiting are in one component
    return edges


def _search_groups(percent: int):
    def search(table: pa.Table) -> pa.Table:
        group = table.column("component").to_numpy()
        items, sizes = table.column("item").to_numpy(), table.column("n").to_numpy()
        tokens = table.column("tokens").to_pylist()
        order = np.argsort(group, kind="stable")
        a, b = [], []
        starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        for i, j in zip(starts, np.append(starts[1:], len(order)), strict=True):
            own = order[i:j]
            for x, y in linked([np.sort(np.frombuffer(tokens[k], _U)) for k in own], [int(sizes[k]) for k in own], percent):
                a.append(items[own[x]])
                b.append(items[own[y]])
        return _edge_table(a, b)

    return search


def _search_blocks(percent: int):
    """Queries against one block of a large group."""

    def search(table: pa.Table) -> pa.Table:
        rows = table.select(["item", "n", "tokens", "query", "done"]).to_pylist()
        sets = [np.sort(np.frombuffer(r["tokens"], _U)) for r in rows]
        held = [k for k, r in enumerate(rows) if not r["query"]]
        index = InvertedLists([sets[k] for k in held], [rows[k]["n"] for k in held], percent)
        ties = _Sets(len(rows))
        place = {rows[k]["item"]: k for k in held}
        tied = [k for k in held if rows[k]["done"]]
        for k in tied:  # pivots have tied these together already
            ties.join(tied[0], k)
        a, b = [], []
        for k, r in enumerate(rows):
            if r["query"]:
                me = place.get(r["item"], k)
                own = ties.root(me)
                for p in index.partners(sets[k], r["n"], lambda p, own=own: ties.root(held[p]) == own):
                    if rows[held[p]]["item"] != r["item"] and ties.root(held[p]) != ties.root(me):
                        a.append(r["item"])
                        b.append(rows[held[p]]["item"])
                        ties.join(me, held[p])
        return _edge_table(a, b)

    return search


def _with_pivot(percent: int):
    """Whether each member reaches the threshold with its group's pivot."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for r in batch.select(["n", "tokens", "p_n", "p_tokens"]).to_pylist():
                both = len(np.intersect1d(np.frombuffer(r["tokens"], _U), np.frombuffer(r["p_tokens"], _U), assume_unique=True))
                hits.append(100 * both >= percent * (r["n"] + r["p_n"] - both))
            keep = [batch.column(c) for c in ("component", "item", "done", "asked", "pivot")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(hits, pa.bool_())], names=["component", "item", "done", "asked", "pivot", "hit"])

    return compare


def _keys(sets: DataFrame, name: str, first: Column) -> DataFrame:
    """``component, key`` and the column ``name`` for the ``first`` so many shingles of every set, repeats left in."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                ends = zip(own.column("tokens").to_pylist(), own.column("first").to_pylist(), strict=True)
                keys = [np.frombuffer(t, np.int64, e) for t, e in ends]
                times = [len(k) for k in keys]
                wide = [pa.array(np.repeat(own.column(c).to_numpy(), times)) for c in ("component", name)]
                yield pa.RecordBatch.from_arrays([*wide, pa.array(np.concatenate(keys))], names=["component", name, "key"])

    read = sets.select("component", F.col(name).cast("long").alias(name), first.cast("long").alias("first"), "tokens")
    return read.mapInArrow(spread, f"component long, {name} long, key long")


def _in_blocks(held: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """Links of ``queries`` with the members ``held`` in blocks.

    A partner holds a shingle of the query's prefix, so a query goes only to blocks that hold one. The queries of
    a block are dealt to batches by volume, and the block is sent once for each.
    """
    places = _keys(held, "block", F.octet_length("tokens") / 8).distinct()
    meets = _keys(queries, "item", F.col("prefix")).join(places, ["component", "key"]).select("component", "block", "item").distinct()
    asked = stored(queries.select("component", "item", "n", "tokens").join(stored(meets), ["component", "item"]))
    volume = asked.groupBy("component", "block").agg(F.sum(F.octet_length("tokens") / 8).alias("volume"))
    batches = stored(volume.select("component", "block", F.ceil(F.col("volume") / GROUP_SHINGLES).alias("batches")))
    row = ["component", "block", "batch", "item", "n", "tokens", "query", "done"]
    dealt = asked.join(batches, ["component", "block"]).withColumn("batch", F.pmod(F.xxhash64(F.lit("batch"), "item"), F.col("batches")))
    dealt = dealt.withColumns({"query": F.lit(True), "done": F.lit(False)}).select(row)
    sent = held.join(batches, ["component", "block"]).withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
    sent = sent.withColumn("query", F.lit(False)).select(row)
    return sent.union(dealt).groupBy("component", "block", "batch").applyInArrow(_search_blocks(percent), _EDGES)


def _large_groups(members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links that span the components of groups too large for a task. ``members``: component, blocks, item, n, prefix, tokens."""
    state = members.select("component", "item", F.lit(False).alias("done"), F.lit(False).alias("asked"))
    edges = []
    for _ in range(PIVOTS):
        open_ = state.where("not done and not asked")
        chosen = open_.groupBy("component").agg(F.min(F.struct(F.xxhash64("item").alias("h"), "item")).alias("p"))
        pivots = chosen.select("component", F.col("p.item").alias("pivot"))
        known = members.select(F.col("component"), F.col("item").alias("pivot"), F.col("n").alias("p_n"), F.col("tokens").alias("p_tokens"))
        pivots = stored(pivots.join(known, ["component", "pivot"]))
        if pivots.isEmpty():
            break
        full = members.join(state, ["component", "item"]).join(pivots, "component")
        seen = stored(full.select("component", "item", "n", "tokens", "done", "asked", "pivot", "p_n", "p_tokens").mapInArrow(
            _with_pivot(percent), "component long, item long, done boolean, asked boolean, pivot long, hit boolean"
        ))
        edges.append(seen.where("hit and item <> pivot").select(F.col("item").alias("a"), F.col("pivot").alias("b")))
        # What a pivot ties to the set that is done, or starts it with, needs no queries of its own.
        first = seen.groupBy("component").agg((F.max(F.col("done") & F.col("hit")) | ~F.max("done")).alias("joins"))
        moved = seen.join(first, "component").select(
            "component", "item", (F.col("done") | F.col("hit") & F.col("joins")).alias("done"),
            (F.col("asked") | (F.col("item") == F.col("pivot"))).alias("asked"),
        )
        rest = seen.select("component").distinct().count()
        state = stored(moved.union(state.join(seen.select("component").distinct(), "component", "left_anti")))
        if not rest or state.where("not done and not asked").isEmpty():
            break
    queries = stored(members.join(state.where("not done and not asked").select("component", "item"), ["component", "item"]))
    if not queries.isEmpty():
        open_ = members.join(state.select("component", "item", "done"), ["component", "item"])
        block = F.pmod(F.xxhash64(F.lit("block"), "item"), F.col("blocks"))
        held = open_.join(queries.select("component").distinct(), "component", "left_semi").withColumn("block", block)
        edges.append(_in_blocks(stored(held), queries, percent))
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out


def _links(docs: DataFrame, words: int, percent: int, names: dict[tuple[int, int], int]) -> DataFrame:
    """Edges ``a, b`` between items, enough to span every component."""
    parts = slices(docs.sparkSession)
    dealt = _dealt_shingles(docs, words, parts, names).groupBy("part")
    shared = dealt.applyInArrow(_count_occurrences(parts), _BLOCK)
    sets = stored(shared.groupBy("part").applyInArrow(_survivors(percent), "item long, n int, prefix int, tokens binary"))
    tied = _dealt_prefixes(sets, parts).groupBy("part").applyInArrow(_tie, _EDGES)
    groups = stored(components(tied).withColumnRenamed("id", "item"))
    members = sets.join(groups, "item")
    volume = members.groupBy("component").agg(F.sum(F.octet_length("tokens") / 8).alias("volume"))
    blocks = volume.select("component", F.ceil(F.col("volume") / GROUP_SHINGLES).alias("blocks"))
    members = stored(members.join(blocks, "component"))
    small = members.where("blocks = 1").withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(4 * parts)))
    links = small.groupBy("bucket").applyInArrow(_search_groups(percent), _EDGES)
    large = members.where("blocks > 1")
    return links if large.isEmpty() else links.union(_large_groups(large, percent, parts))


def _own_names(named: DataFrame, classes: DataFrame) -> DataFrame:
    """``item, check, name`` of the sets whose first hash another set has too; that of the least second hash keeps it."""
    shared = classes.where("check <> other").select("item", F.col("check").alias("keeps"))
    late = stored(named.select("item", "check").distinct().join(shared, "item").where("check <> keeps").drop("keeps"))
    turn = 0
    while True:
        given = stored(late.withColumn("name", F.xxhash64("item", "check", F.lit(turn))))
        taken = given.join(classes.select(F.col("item").alias("name")), "name", "left_semi")
        if taken.isEmpty() and given.groupBy("name").count().where("count > 1").isEmpty():
            return given
        turn += 1


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's item; every item and the smallest id that has it; the ``component`` of items that link with others."""
    items = stored(_items(docs, words))
    named = items.where("n > 0 and doc_id is not null")
    least = [F.min("doc_id").alias("first"), F.min("check").alias("check"), F.max("check").alias("other")]
    classes = stored(named.groupBy("item").agg(*least))
    names: dict[tuple[int, int], int] = {}
    if not classes.where("check <> other").isEmpty():
        given = _own_names(named, classes)
        rows = given.limit(RENAMED + 1).collect()
        if len(rows) > RENAMED:
            raise ValueError(f"more than {RENAMED} shingle sets share their first hash with another one")
        names = {(r["item"], r["check"]): r["name"] for r in rows}
        items = items.join(given, ["item", "check"], "left")
        items = stored(items.select("doc_id", "version", "n", F.coalesce("name", "item").alias("item"), "check"))
        classes = stored(items.where("n > 0 and doc_id is not null").groupBy("item").agg(*least))
    return items, classes, stored(components(_links(docs, words, percent, names)).withColumnRenamed("id", "item"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``."""
    items, classes, tied = _grouped(docs, words, percent)
    named = items.where("n > 0 and doc_id is not null")
    least = classes.join(tied, "item").groupBy("component").agg(F.min("first").alias("least"))
    grouped = tied.join(least, "component").select("item", "least")
    # Stored, so that both sides of the join are shuffled for it and a frequent text's rows can be split.
    ids = stored(classes.join(grouped, "item", "left").select("item", F.coalesce("least", "first").alias("component_id")))
    rows = named.join(ids, "item").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = items.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.union(rest)


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component: of its smallest id, and of that one text, one copy."""
    items, classes, tied = _grouped(docs, words, percent)
    # Stored, as above: counted once per text of an id first, so that copies of a row are few rows here.
    groups = stored(classes.join(tied, "item", "left").select("item", F.coalesce("component", "item").alias("component")))
    texts = stored(items.where("n > 0 and doc_id is not null").groupBy("item", "doc_id", "version").agg(F.count(F.lit(1)).alias("copies")))
    own = F.struct("doc_id", "item", "version")
    members = stored(texts.join(groups, "item").select("component", own.alias("own"), "copies"))
    chosen = stored(members.groupBy("component").agg(F.min("own").alias("chosen")))
    marked = members.join(chosen, "component").where((F.col("own") != F.col("chosen")) | (F.col("copies") > 1))
    marked = stored(marked.select(
        F.col("own.doc_id").alias("__id"), F.col("own.version").alias("__version"), (F.col("own") == F.col("chosen")).alias("__stays")
    ))
    version = F.xxhash64(docs["text"].cast("string"))
    same = lambda named: (docs["doc_id"].cast("long") == named["__id"]) & (version == named["__version"])
    alone = docs.join(marked, same(marked), "left_anti")
    stays = marked.where(marked["__stays"])
    if stays.isEmpty():
        return alone
    # Of equal texts of one id any copy will do; partial sums leave one per task before the shuffle.
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    copied = docs.join(stays, same(stays), "left_semi").groupBy(docs["doc_id"].cast("long"), version).agg(F.first(row).alias("row"))
    return alone.union(copied.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
