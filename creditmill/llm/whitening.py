"""Whitening of vectors by MLlib's distributed block matrices.

Components become whole numbers, sums are exact, and every row gets a number and is centred
before anything is multiplied. The centred rows go into a ``BlockMatrix`` of row blocks. Its
transpose times itself is the scatter matrix, computed in as many slices of the rows as there
are groups of ``GROUP`` blocks and added up; that matrix (columns by columns) is decomposed on
the driver. A second block product, with the whitening matrix, projects the rows, and a third,
of the projected rows with themselves, measures how far their covariance is from the identity.
Everything but those small matrices and MLlib's list of block numbers stays on the executors.

Defined cases: vectors that are null, or hold a component that is null, not finite, or beyond
2^40 are left out; if lengths differ, so are vectors of another than the commonest length (of
equally common ones the longest), and empty vectors; copies of a row and rows without an id
count one by one; a component without variance (fewer vectors than components, equal vectors)
has null in ``whitened`` and does not count for ``identity_error``; with no variance at all
``explained`` is 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import stored

#: Factor and shift that make components whole numbers, and their limit.
SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 40)
#: Rows of a block at least and at most, blocks aimed at, and blocks that one slice of a product takes.
LEAST, MOST, BLOCKS, GROUP = 1024, 65_536, 8192, 8
_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` (longs) of the rows that count, numbered from 0 in ``at``, as a stored table."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    bad = lambda c: c.isNull() | F.isnan(c) | ~(F.abs(c) <= LIMIT)
    rows = rows.where("c is not null").where(~F.exists("c", bad) & (F.size("c") > 0))
    whole = F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    place = F.monotonically_increasing_id()
    numbers = F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("seq")
    kept = stored(rows.select("vec_id", whole.alias("x"), *numbers))
    lengths = kept.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(2).collect()
    if len(lengths) > 1:  # numbered again without the others
        kept = stored(kept.where(F.size("x") == lengths[0]["dim"]).select("vec_id", "x", *numbers))
    before, facts = 0, []
    for r in kept.groupBy("part").count().orderBy("part").collect():  # a row for each task that wrote the table
        facts.append((r["part"], before))
        before += r["count"]
    offsets = kept.sparkSession.createDataFrame(facts, "part long, before long")
    return kept.join(F.broadcast(offsets), "part").select("vec_id", "x", (F.col("before") + F.col("seq")).alias("at"))


def _whole_array(values: list[int]) -> F.Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<decimal(38,0)>")


def deviations(n: int, sums: list[int], low: int, high: int) -> F.Column:
    """The sum over components of (n x - S)^2, exactly, or null beyond 38 digits; ``low``, ``high``: the range of all x."""
    fits = n * max(abs(low), abs(high)) < 1 << 62 and len(sums) * (n * (high - low)) ** 2 < 1 << 62
    kind = "long" if fits else "decimal(38,0)"
    total = _whole_array(sums).cast(f"array<{kind}>")
    gap = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast(kind), x.cast(kind)), s).cast(kind))
    square = lambda acc, g: F.try_add(acc, F.try_multiply(g, g).cast(kind)).cast(kind)
    return F.aggregate(gap, F.lit(0).cast(kind), square).cast("decimal(38,0)")


def times(left: BlockMatrix, right: BlockMatrix, blocks: int) -> BlockMatrix:
    """``left`` x ``right``; the inner dimension, of ``blocks`` blocks, is cut so that no task holds them all."""
    inner = max(1, -(-blocks // GROUP))
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, inner)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def block_matrix(rows: DataFrame, n: int, dim: int) -> tuple[BlockMatrix, int]:
    """``at, vector`` (array of doubles) as a matrix of row blocks, and how many blocks it has."""
    tall = min(MOST, max(LEAST, -(-n // BLOCKS)))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("at", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dim).toBlockMatrix(tall, dim), -(-n // tall)


def whitened(vectors: DataFrame, components: int = 8) -> DataFrame:
    """For every vector kept and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors)
    per_place = kept.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    places = per_place.orderBy("i").collect()  # a row for each component of a vector
    if not places:
        return spark.createDataFrame([], _RESULT)
    n, dim, sums = places[0]["n"], len(places), [int(r["s"]) for r in places]
    low, high = min(r["low"] for r in places), max(r["high"] for r in places)

    # n x - S is exact before it is divided, so that large common parts cost no digits.
    mean = _whole_array(sums)
    centred = F.zip_with("x", mean, lambda x, s: ((x.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)")) - s).cast("double") / F.lit(float(n)))
    matrix, blocks = block_matrix(kept.select("at", centred.alias("vector")), n, dim)
    scatter = times(matrix.transpose(), matrix, blocks).toLocalMatrix().toArray()
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    count = min(components, dim)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    trace = float(np.trace(scatter)) / n
    some = values > max(1e-12 * trace, 0.0)
    whiten = np.where(some, axes / np.sqrt(np.where(some, values, 1.0)), 0.0)

    weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dim, count, whiten.ravel(order="F").tolist()))], 1), dim, count)
    projected = times(matrix, weights, 1)
    moments = times(projected.transpose(), projected, blocks).toLocalMatrix().toArray()[:count, :count] / n
    errors = np.abs(moments - np.eye(count))[np.ix_(some, some)]
    error = float(errors.max()) if errors.size else 0.0

    found = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    found = found.select(F.col("index").alias("at"), vector_to_array("vector").alias("w"))
    share = [float(v / trace) if trace > 0 else 0.0 for v in np.maximum(values, 0.0)]
    facts = F.array(*[F.struct(F.lit(j + 1).alias("component"), F.lit(bool(some[j])).alias("some"), F.lit(share[j]).alias("explained")) for j in range(count)])
    rows = kept.select("vec_id", "at", deviations(n, sums, low, high).alias("deviation")).join(found, "at")
    flat = rows.select("vec_id", "deviation", F.inline(F.arrays_zip(F.col("w"), facts.alias("f"))).alias("w", "f"))
    return flat.select(
        "vec_id", "f.component", F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("f.some"), F.col("w")).alias("whitened"),
        "f.explained", F.lit(error).alias("identity_error"),
    )


def whitening_report(vectors: DataFrame, components: int = 8) -> DataFrame:
    """``whitened`` with ``deviation`` as a long (null where it does not fit one)."""
    return whitened(vectors, components).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
