"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned to their principal axes and sorted by the grid cells of the leading
ones, cells as wide as the largest distance of a link. Ranges of this sequence are cut into
blocks of bounded volume. Which blocks may hold a link (their first cells are neighbours and their
boxes are not too far apart) is found from their boxes alone; then every such pair of blocks is a
task, so that B blocks make at most B (B + 1) / 2 tasks and a block is sent B times at most, not
once for each pair of small blocks. A task halves both intervals again and again, leaving out those
whose boxes are provably too distant. Small ones are compared vector by vector: on the leading axes first,
where most pairs are too far apart already, and what is left in double precision on all components.
Axes and boxes only decide what is skipped: no link is lost.

Equal vectors are one entry with a count. Of the links inside a pair of blocks only their
number per vector and a spanning forest leave the task.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do rows without an id; vectors of different lengths never link; copies of a
row count one by one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import components, stored

#: Leading axes whose cells order the vectors; vectors of a block at most, about, and of an interval that is not halved.
AXES, BLOCK, LEAF = 6, 32_768, 512
#: Bytes of a block's vectors, about; blocks of tables smaller than that many full ones; blocks that meet under a key.
VOLUME, FEWEST, KEYED = 16 << 20, 8, 512
#: Axes on which vectors are compared first, in single precision, and more than that can be wrong by.
LEAD, SLACK = 24, 1e-5


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that can link."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.where("vec_id is not null and embedding is not null").where(~F.exists("embedding", bad) & some)


def principal_axes(entries: DataFrame, dim: int) -> np.ndarray:
    """Axes of the most spread first, from the moments of all vectors of ``dim`` components."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("embedding"), dim))
                total += x.T @ x
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": total.ravel()})

    parts = entries.where(F.size("embedding") == dim).select("embedding").mapInArrow(moments, "i int, j int, v double")
    matrix = np.zeros((dim, dim))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dim x dim numbers
        matrix[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1].copy()


def block_rows(count: int, dim: int) -> int:
    """Vectors of a block: a share of a small table, a bounded volume of a large one."""
    return min(BLOCK, max(LEAF, VOLUME // (8 * dim)), max(LEAF, -(-count // FEWEST)))


def _blocks(entries: DataFrame, axes: dict[int, np.ndarray], eps: float, count: int, size: int) -> DataFrame:
    """Blocks of the sequence: ``dim, low_cell, high_cell, low, high, ids, counts, vectors``."""

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _unit(_matrix(part.column("embedding"), dim))
                lead = x @ axes[dim][:, :AXES] if dim in axes else x[:, :AXES]
                grid = np.zeros((len(x), AXES), np.int32)
                grid[:, : lead.shape[1]] = np.floor(lead / eps)
                names = [*part.schema.names, "dim", *(f"c{k}" for k in range(AXES))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(x), dim, np.int32)), *(pa.array(grid[:, k]) for k in range(AXES))], names=names
                )

    order = ["dim", *(f"c{k}" for k in range(AXES))]
    kinds = ", ".join(f"{c} int" for c in order)
    placed = entries.select("id", "n", "embedding").mapInArrow(cells, f"id long, n long, embedding array<double>, {kinds}")
    # The id ends the order, so that equal cells are split as well.
    sequence = placed.repartitionByRange(max(1, -(-count // size)), *order, "id").sortWithinPartitions(*order, "id")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            dim = rows.column("dim")[0].as_py()
            x = _matrix(rows.column("embedding").combine_chunks(), dim)
            turned = _unit(x) @ axes[dim] if dim in axes else _unit(x)
            cell = rows.column("c0").to_numpy()
            ids, counts = rows.column("id").to_numpy(), rows.column("n").to_numpy()
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()),
                "low_cell": pa.array([int(cell.min())], pa.int32()), "high_cell": pa.array([int(cell.max())], pa.int32()),
                "low": [turned.min(0).tolist()], "high": [turned.max(0).tolist()],
                "ids": [ids.tobytes()], "counts": [counts.tobytes()], "vectors": [x.tobytes()],
            })

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * size:
                rows = pa.Table.from_batches(held)
                for dim_rows in _same_dim(rows.slice(0, size)):
                    yield block(dim_rows)
                held = rows.slice(size).to_batches()
        if held:  # fewer than two blocks' rows, in even shares
            rows = pa.Table.from_batches(held)
            share = -(-rows.num_rows // max(1, round(rows.num_rows / size)))
            for at in range(0, rows.num_rows, share):
                for dim_rows in _same_dim(rows.slice(at, share)):
                    yield block(dim_rows)

    kinds = "dim int, low_cell int, high_cell int, low array<double>, high array<double>, ids binary, counts binary, vectors binary"
    return sequence.mapInArrow(cut, kinds)


def _same_dim(rows: pa.Table) -> Iterator[pa.Table]:
    dims = rows.column("dim").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield rows.slice(a, b - a)


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs of blocks ``a <= b`` that may hold a link, from their boxes.

    First cells meet in an equi-join on neighbouring cells. Most blocks may share a first cell, so that
    blocks are dealt to shares of some ``KEYED`` and a key is a cell, a share of the left and one of the right.
    """
    meta = blocks.select("block", "dim", "low_cell", "high_cell", "low", "high")
    shares = max(1, -(-meta.count() // KEYED))
    share, every = F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    left = meta.withColumn("l_share", share).select(
        *[F.col(c).alias(f"l_{c}") for c in meta.columns], "l_share", F.explode(F.sequence(F.col("low_cell") - 1, F.col("high_cell") + 1)).alias("cell")
    ).withColumn("r_share", every)
    right = meta.withColumn("r_share", share).select(
        *[F.col(c).alias(f"r_{c}") for c in meta.columns], "r_share", F.explode(F.sequence("low_cell", "high_cell")).alias("cell")
    ).withColumn("l_share", every)
    first = F.col("cell") == F.greatest(F.col("l_low_cell") - 1, F.col("r_low_cell"))  # a pair meets once
    sides = F.zip_with(
        F.zip_with("l_low", "r_high", lambda x, y: x - y), F.zip_with("r_low", "l_high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    gap = F.aggregate(sides, F.lit(0.0), lambda s, d: s + d * d)
    met = left.withColumn("dim", F.col("l_dim")).join(right.withColumn("dim", F.col("r_dim")), ["dim", "cell", "l_share", "r_share"])
    near = met.where((F.col("l_block") <= F.col("r_block")) & first & (gap <= eps * eps))
    return near.select(F.col("l_block").alias("a"), F.col("r_block").alias("b"))


class IntervalJoin:
    """The recursion over two intervals of the sequence."""

    def __init__(self, x: np.ndarray, tx: np.ndarray, y: np.ndarray, ty: np.ndarray, cosine: float, eps: float, same: bool, take):
        """``take(a, c, hits)`` gets the links of the vectors from ``a`` and from ``c`` on."""
        self.x, self.tx, self.y, self.ty = x, tx, y, ty
        self.cosine, self.eps2, self.same, self.take = cosine, eps * eps, same, take
        # Rows whose product is the squared distance on the leading axes.
        p, q = tx[:, :LEAD], ty[:, :LEAD]
        norm = lambda m: (m * m).sum(1, keepdims=True)
        self.p = np.hstack([-2 * p, norm(p), np.ones((len(p), 1))]).astype(np.float32)
        self.q = np.hstack([q, np.ones((len(q), 1)), norm(q)]).astype(np.float32)

    def _distant(self, a: int, b: int, c: int, d: int) -> bool:
        p, q = self.tx[a:b], self.ty[c:d]
        side = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        return float((side * side).sum()) > self.eps2

    def run(self, a: int, b: int, c: int, d: int) -> None:
        if a >= b or c >= d or self.same and c + (d - c) <= a or self._distant(a, b, c, d):
            return
        if b - a <= LEAF and d - c <= LEAF:
            if self.same and d <= a:
                return
            apart = self.p[a:b] @ self.q[c:d].T
            if apart.min() > self.eps2 + SLACK:
                return
            near = apart <= self.eps2 + SLACK
            rows, cols = near.any(1), near.any(0)
            hits = np.zeros(near.shape, bool)
            hits[np.ix_(rows, cols)] = self.x[a:b][rows] @ self.y[c:d][cols].T >= self.cosine
            if self.same:  # each pair once
                hits &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            if hits.any():
                self.take(a, c, hits)
            return
        if b - a >= d - c:
            middle = (a + b) // 2
            self.run(a, middle, c, d)
            self.run(middle, b, c, d)
        else:
            middle = (c + d) // 2
            self.run(a, b, c, middle)
            self.run(a, b, middle, d)


def _labels(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of rows and columns of a table of links (rows first); a label is the least place in it."""
    n, m = hits.shape
    rows, cols = np.arange(n), np.arange(n, n + m)
    while True:
        new_cols = np.minimum(cols, np.where(hits, rows[:, None], n + m).min(0))
        new_rows = np.minimum(rows, np.where(hits, new_cols[None, :], n + m).min(1))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def _join_pairs(axes: dict[int, np.ndarray], cosine: float, eps: float):
    """For each pair of blocks: ``id, links, other`` for vectors with links (``other``: a vector of their component)."""

    def side(table: pa.Table, k: int) -> tuple:
        dim = table.column("dim")[k].as_py()
        cell = lambda name, kind: np.frombuffer(table.column(name)[k].as_buffer(), kind)
        x = _unit(cell("vectors", np.float64).reshape(-1, dim))
        return cell("ids", np.int64), cell("counts", np.int64), x, x @ axes[dim] if dim in axes else x

    def join(table: pa.Table) -> pa.Table:
        same = table.num_rows == 1
        ids, counts, x, tx = side(table, 0)
        jds, jcounts, y, ty = (ids, counts, x, tx) if same else side(table, 1)
        shift = 0 if same else len(ids)
        every = ids if same else np.concatenate([ids, jds])
        links, up = np.zeros(len(every), np.int64), np.arange(len(every))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def take(a: int, c: int, hits: np.ndarray) -> None:
            p, q = hits.shape
            links[a : a + p] += hits @ jcounts[c : c + q]
            links[shift + c : shift + c + q] += hits.T @ counts[a : a + p]
            rows, cols = _labels(hits)
            whole = np.concatenate([np.arange(a, a + p), np.arange(shift + c, shift + c + q)])
            label = np.concatenate([rows, cols])
            for i in np.flatnonzero(label != np.arange(p + q)):
                u, v = sorted((root(whole[i]), root(whole[label[i]])))
                up[v] = u

        IntervalJoin(x, tx, y, ty, cosine, eps, same, take).run(0, len(ids), 0, len(jds))
        linked = np.flatnonzero(links)
        other = every[[root(i) for i in linked]]
        return pa.table({"id": pa.array(every[linked]), "links": pa.array(links[linked]), "other": pa.array(other, pa.int64())})

    return join


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``."""
    eps = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    hashed = lambda df: df.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit("second"), "embedding"))
    rows = hashed(valid(vectors))
    entries = stored(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")))
    sizes = entries.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not sizes:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = sizes[0]["dim"]
    axes = {dim: principal_axes(entries, dim)}
    count, longest = entries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    numbered = _blocks(entries, axes, eps, count, block_rows(count, longest)).withColumn("block", F.monotonically_increasing_id())
    blocks = stored(numbered)
    pairs = stored(_pairs(blocks, eps))
    both = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    data = blocks.select("block", "dim", "ids", "counts", "vectors")
    met = data.join(both, "block").drop("block")
    found = stored(met.groupBy("a", "b").applyInArrow(_join_pairs(axes, cosine, eps), "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = entries.select("h1", "h2", "id", "n").join(links, "id", "left").join(tied, "id", "left")
    known = stored(classes.select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    ))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    can = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    rest = whole.where(~F.coalesce(can, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
