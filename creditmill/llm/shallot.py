"""Exact k-means over integer vectors by Shallot search.

Every vector remembers its nearest and its second nearest centroid, an upper bound of its
distance to the first and a lower bound of its distance to all others. When centroids move, the
bounds move with them, and a vector whose bounds still prove its centroid is left alone. For the
rest the distances to both remembered centroids are computed, and the search starts from the
closer one: the others are visited by their distance from it, and only as far as the ball
reaches in which one of the best two can lie. The ball shrinks with every better centroid found.
Bounds are doubles with a margin and only decide what is skipped; survivors are compared by
their squared distances in 64-bit integers, ties going to the smaller number.

A round is a narrow pass over the rows of the round before, which Spark keeps in its caches: a
lost executor repeats at most ``rounds`` narrow passes over its own share. Sums leave a task as
one row per centroid; only the centroids (``k`` rows) pass through the driver.

Defined cases: vectors that are null, have another number of components, or a component that is
null, not finite, or beyond 2^27 once scaled (its distances would not fit 64 bits) are left out;
rows without an id are clustered, but never start a centroid; with fewer rows than ``k`` there
are as many centroids as rows; equal starting vectors leave the later centroid empty, and it
stays where it is; copies of a row count one by one; no row gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import stored

#: Factor and limit of components; relative margin of the bounds.
SCALE, LIMIT, MARGIN = 1024, 1 << 27, 1e-9
#: Vectors that a step works on at once.
CHUNK = 1 << 16
_STATE = "vec_id long, v binary, a int, b int, upper double, lower double"


def integer_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``vec_id, v``: components as 32-bit integers, one after the other in the bytes of ``v``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | ~F.abs(F.floor(c * SCALE).cast("double")).between(0, LIMIT)
    rows = rows.where((F.size("x") == dim) & ~F.exists("x", bad))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(x * SCALE).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _binary(whole, batch.num_rows, 4 * dim)], names=["vec_id", "v"])

    return rows.mapInArrow(pack, "vec_id long, v binary")


def _binary(data: bytes, n: int, width: int) -> pa.Array:
    ends = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(data)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view(np.int32).reshape(-1, dim).astype(np.int64)


class Centroids:
    """Centroids with what a search needs of them: distances, neighbours in order, how far each moved."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None):
        self.places = places
        k = len(places)
        self.gaps = np.sqrt(((places[:, None] - places[None]) ** 2).sum(2).astype(float))
        self.neighbours = np.argsort(self.gaps, axis=1, kind="stable")
        apart = self.gaps + np.diag(np.full(k, np.inf))
        #: Half the distance of each centroid to the one next to it.
        self.half = apart.min(1) / 2
        moved = np.zeros(k) if before is None else np.sqrt(((places - before) ** 2).sum(1).astype(float))
        self.moved = moved
        #: The farthest move of any other centroid.
        self.others = np.array([np.delete(moved, j).max(initial=0) for j in range(k)])

    def squares(self, x: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        gap = x - self.places[j]
        return np.einsum("ij,ij->i", gap, gap)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second nearest centroid of every vector, and their squared distances, by a full scan."""
        best = Best(len(x))
        for j in range(len(self.places)):
            best.offer(np.arange(len(x)), self.squares(x, j), j)
        return best.a, best.b, best.da, best.db

    def search(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, da: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same from the two centroids that each vector remembers; ``da``: squared distances to the first."""
        best = Best(len(x))
        everyone = np.arange(len(x))
        best.offer(everyone, da, a)
        best.offer(everyone, self.squares(x, b), b)
        center, radius = best.a.copy(), np.sqrt(best.da.astype(float))
        known = np.where(center == a, b, a)
        left = everyone
        for step in range(len(self.places)):
            if not len(left):
                break
            candidate = self.neighbours[center[left], step]
            ball = (radius[left] + np.sqrt(best.db[left].astype(float))) * (1 + MARGIN)
            inside = self.gaps[center[left], candidate] <= ball
            left, candidate = left[inside], candidate[inside]  # the rest of the neighbours are farther still
            new = (candidate != center[left]) & (candidate != known[left])
            who = left[new]
            best.offer(who, self.squares(x[who], candidate[new]), candidate[new])
        return best.a, best.b, best.da, best.db


class Best:
    """The two best centroids so far of every vector: by squared distance, then by number."""

    FAR = np.iinfo(np.int64).max

    def __init__(self, n: int):
        self.a, self.b = np.full(n, -1), np.full(n, -1)
        self.da, self.db = np.full(n, self.FAR), np.full(n, self.FAR)

    def offer(self, who: np.ndarray, square: np.ndarray, j: np.ndarray | int) -> None:
        j = np.broadcast_to(j, len(who))
        nearer = (square < self.da[who]) | ((square == self.da[who]) & (j < self.a[who]))
        second = ~nearer & ((square < self.db[who]) | ((square == self.db[who]) & (j < self.b[who])))
        one, two = who[nearer], who[second]
        self.b[one], self.db[one] = self.a[one], self.da[one]
        self.a[one], self.da[one] = j[nearer], square[nearer]
        self.b[two], self.db[two] = j[second], square[second]


def step(x: np.ndarray, centroids: Centroids, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """One round for vectors ``x`` with what they remember: the new ``a, b, upper, lower`` and which were searched."""
    if len(centroids.places) == 1:
        return a, b, upper, lower, np.zeros(len(x), bool)
    upper = (upper + centroids.moved[a]) * (1 + MARGIN)
    lower = np.maximum(0, (lower - centroids.others[a]) * (1 - MARGIN))
    proven = np.maximum(lower, centroids.half[a] * (1 - MARGIN))
    open_ = np.flatnonzero(upper >= proven)
    square = centroids.squares(x[open_], a[open_])
    upper[open_] = np.sqrt(square.astype(float)) * (1 + MARGIN)
    still = upper[open_] >= proven[open_]
    who, square = open_[still], square[still]
    a, b = a.copy(), b.copy()
    a[who], b[who], da, db = centroids.search(x[who], a[who], b[who], square)
    upper[who] = np.sqrt(da.astype(float)) * (1 + MARGIN)
    lower[who] = np.sqrt(db.astype(float)) * (1 - MARGIN)
    searched = np.zeros(len(x), bool)
    searched[who] = True
    return a, b, upper, lower, searched


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def _state(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    new = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(upper), pa.array(lower)]
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *new], names=["vec_id", "v", "a", "b", "upper", "lower"])


def _begun(rows: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            a, b, da, db = centroids.first(_matrix(batch.column("v"), dim))
            yield _state(batch, a, b, np.sqrt(da.astype(float)) * (1 + MARGIN), np.sqrt(db.astype(float)) * (1 - MARGIN))

    return rows.mapInArrow(scan, _STATE)


def _moved(state: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x = _matrix(batch.column("v"), dim)
            known = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "upper", "lower")]
            a, b, upper, lower, _ = step(x, centroids, *known)
            yield _state(batch, a, b, upper, lower)

    return state.mapInArrow(move, _STATE)


def _distances(state: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            a = batch.column("a").to_numpy(zero_copy_only=False)
            square = centroids.squares(_matrix(batch.column("v"), dim), a)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("a"), pa.array(square)], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "a").mapInArrow(measure, "vec_id long, cluster int, distance long")


def _sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors and sums of components of every cluster: at most ``k`` rows of a task meet."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in _parts(batches):
            a = batch.column("a").to_numpy(zero_copy_only=False)
            np.add.at(total, a, _matrix(batch.column("v"), dim))
            count += np.bincount(a, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
            names=["a", "n", "sums"],
        )

    parts = state.select("a", "v").mapInArrow(add, "a int, n long, sums array<long>")
    flat = parts.select("a", "n", F.posexplode("sums").alias("i", "part"))
    wide = flat.groupBy("a", "i").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    count, total = np.zeros(k, np.int64), [[0] * dim for _ in range(k)]
    for r in wide.collect():  # k x dim numbers
        count[r["a"]] = r["n"]
        total[r["a"]][r["i"]] = int(r["total"])
    return count, total


def starts(rows: DataFrame, k: int, dim: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose ids, salted, have the smallest hashes; ties by the vector."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.where("vec_id is not null").orderBy(name, "v").limit(k).select("v").collect()  # k rows
    return np.array([np.frombuffer(bytes(r["v"]), np.int32) for r in chosen], np.int64).reshape(-1, dim)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) for every vector kept, as a stored table, and the centroids.

    Starts: ``starts``. A round assigns every vector to the nearest centroid, then moves every
    centroid that has vectors to the floor of their means; a last assignment follows.
    """
    rows = stored(integer_vectors(vectors, dim))
    places = starts(rows, k, dim, salt)
    if not len(places):
        return stored(rows.where("false").selectExpr("vec_id", "0 AS cluster", "0L AS distance")), places
    centroids = Centroids(places)
    cached = [_begun(rows, centroids, dim).persist(StorageLevel.MEMORY_AND_DISK)]
    for _ in range(rounds):
        count, total = _sums(cached[-1], len(places), dim)  # fills the cache from the one before
        while len(cached) > 1:
            cached.pop(0).unpersist()
        new = np.array([[t // int(n) for t in row] if n else old for n, row, old in zip(count, total, places.tolist(), strict=True)], np.int64)
        centroids, places = Centroids(new, places), new
        cached.append(_moved(cached[-1], centroids, dim).persist(StorageLevel.MEMORY_AND_DISK))
    done = stored(_distances(cached[-1], centroids, dim))
    for state in cached:
        state.unpersist()
    return done, places


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3") -> DataFrame:
    """One row per vector kept: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    assigned, places = clusters(vectors, k, rounds, dim, salt)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    own = {r["cluster"]: int(r["s"]) for r in sums}
    name = lambda j: hashlib.sha256(",".join(map(str, places[j].tolist())).encode()).hexdigest()
    facts = [(j, s, sum(own.values()), name(j)) for j, s in own.items()]
    totals = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row for each centroid: k rows, whatever the size of the table.
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
