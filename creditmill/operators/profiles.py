"""Profiles that merge: sketches of a table's columns, stored per version, and what has changed between two.

A profile has one row per column: exact numbers of rows and NULLs, lowest and highest value, a
sketch of the distinct values and, for numbers, a sketch of the quantiles. Profiles of parts of a
table (days, files, versions of a part) merge into that of the whole, without reading it again.

Bounds: estimates of distinct values are within ``DISTINCT_ERROR`` and ranks of quantiles within
``RANK_ERROR`` of the truth, each with a probability above 99 %. Beyond that nothing is approximate.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.operators.bitfilters import dense_array

#: Sizes of the sketches, and what they guarantee.
DISTINCT_BITS, DISTINCT_ERROR = 14, 0.03
RANK_K, RANK_ERROR = 400, 0.01
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Steps of the grid of quantiles by which two profiles are compared.
STEPS = 100
#: Cells into which a search for exact percentiles divides what is left of a column's range; rows counted by value.
CELLS, REST = 1 << 12, 1 << 16
#: Cells and rows of a count-min sketch.
WIDTH, DEPTH = 1 << 14, 4


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``column, rows, nulls, low, high`` (as text), ``distinct_sketch, rank_sketch``; one pass.

    NaN counts as NULL in the quantiles. ``low`` and ``high`` are NULL for a column without values.
    """
    columns = list(columns or df.columns)
    facts = []
    for i, name in enumerate(columns):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        number = F.nullif(c.cast("double"), F.lit(float("nan"))) if _numeric(kind) else F.lit(None).cast("double")
        facts += [
            F.count(F.lit(1)).alias(f"rows_{i}"),
            F.count_if(c.isNull()).alias(f"nulls_{i}"),
            F.min(c).cast("string").alias(f"low_{i}"),
            F.max(c).cast("string").alias(f"high_{i}"),
            F.hll_sketch_agg(c.cast("string"), F.lit(DISTINCT_BITS)).alias(f"distinct_{i}"),
            F.kll_sketch_agg_double(number, F.lit(RANK_K)).alias(f"ranks_{i}"),
        ]
    parts = ("rows", "nulls", "low", "high", "distinct", "ranks")
    names = ("rows", "nulls", "low", "high", "distinct_sketch", "rank_sketch")
    found = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(_numeric(df.schema[column].dataType)).alias("numeric"),
            *[F.col(f"{p}_{i}").alias(n) for p, n in zip(parts, names, strict=True)],
        )
        for i, column in enumerate(columns)
    ]
    return df.agg(*facts).select(F.inline(F.array(*found)))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all parts together. A column that some parts lack counts where it is."""
    every = reduce(DataFrame.unionByName, profiles)
    number = lambda c: F.when(F.col("numeric"), F.col(c).try_cast("double"))

    def edge(c: str, pick) -> Column:
        """The lowest or highest value: by number for numbers, by text otherwise."""
        chosen = F.max_by if pick is F.max else F.min_by
        return F.coalesce(chosen(F.col(c), number(c)), pick(F.when(~F.col("numeric"), F.col(c))))

    return every.groupBy("column").agg(
        F.max("numeric").alias("numeric"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        edge("low", F.min).alias("low"),
        edge("high", F.max).alias("high"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("rank_sketch", F.lit(RANK_K)).alias("rank_sketch"),
    )


def profile_report(profiles: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``column, rows, nulls, low, high, distinct_values`` (an estimate) and the ``quantiles`` of numbers, by share."""
    held = F.col("numeric") & (F.kll_sketch_get_n_double("rank_sketch") > 0)
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    found = F.when(held, F.kll_sketch_get_quantile_double("rank_sketch", at))
    return profiles.select(
        "column", "rows", "nulls", "low", "high", F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
        F.when(held, F.map_from_arrays(at, found)).alias("quantiles"),
    )


def _cell(value: Column, low: float, high: float, cells: int) -> Column:
    """The number of the cell that a value from ``low`` to ``high`` is in; the two are never in the same one."""
    low_, high_ = max(low, -sys.float_info.max), min(high, sys.float_info.max)
    width = high_ / 2 - low_ / 2
    if width == 0:
        return (value > low).cast("long")
    share = F.least(F.greatest((value / 2 - low_ / 2) / width, F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(share * cells), F.lit(cells - 1).cast("long"))


def exact_percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], cells: int = CELLS, rest: int = REST) -> dict[str, list[float | None]]:
    """Percentiles of number columns as ``percentile`` gives them, where its map of all values does not fit one task.

    A place in a column's order is sought between the lowest and the highest value: a pass counts the rows of
    ``cells`` cells between them, and the cell that holds the place is divided next, all columns at once. When it has
    ``rest`` rows or fewer, they are counted by value; values that are spread take two or three passes, and
    the widest range of doubles fewer than two hundred. No task gets more than the counts of cells or of such a rest.
    NULL and NaN do not count; a column without values has none.
    """
    number = lambda c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    values = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = values.agg(*[f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(len(columns)) for f in (F.count, F.min, F.max)]).first()
    at = {(i, q): (ends[f"count{i}"] - 1) * q for i in range(len(columns)) for q in shares if ends[f"count{i}"]}
    # Where the value at a place is: from, to, rows before that, rows there.
    held = {(i, p): (ends[f"min{i}"], ends[f"max{i}"], 0, ends[f"count{i}"]) for (i, _), x in at.items() for p in (math.floor(x), math.ceil(x))}
    while True:
        ranges = sorted({(i, *h) for (i, _), h in held.items() if h[0] < h[1]})
        if not ranges:
            break
        inside = [F.col(f"c{i}").between(low, high) for i, low, high, _, _ in ranges]
        parts = [
            F.when(here, F.struct(F.lit(k).alias("range"), (F.col(f"c{i}") if n <= rest else _cell(F.col(f"c{i}"), low, high, cells)).cast("double").alias("cell"), F.col(f"c{i}").alias("value")))
            for k, (here, (i, low, high, _, n)) in enumerate(zip(inside, ranges, strict=True))
        ]
        rows = values.where(reduce(Column.__or__, inside)).select(F.inline(F.array_compact(F.array(*parts))))
        counts = rows.groupBy("range", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("range").orderBy("cell")))
        sought = {key: (ranges.index((key[0], *h)), key[1] - h[2]) for key, h in held.items() if h[0] < h[1]}
        hit = [(F.col("range") == k) & (F.col("upto") > p) & (F.col("upto") - F.col("n") <= p) for k, p in set(sought.values())]
        found = upto.where(reduce(Column.__or__, hit)).collect()  # a row for each place sought, at most
        for key, (k, p) in sought.items():
            r = next(r for r in found if r["range"] == k and r["upto"] - r["n"] <= p < r["upto"])
            held[key] = (r["low"], r["high"], held[key][2] + r["upto"] - r["n"], r["n"])

    def value(i: int, q: float) -> float | None:
        if (i, q) not in at:
            return None
        x = at[i, q]
        low, high = held[i, math.floor(x)][0], held[i, math.ceil(x)][0]
        return low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high

    return {c: [value(i, q) for q in shares] for i, c in enumerate(columns)}


def _farthest(one: Column, other: Column) -> Column:
    """The farthest that a value of one grid of quantiles is from its share in the other grid.

    Ties widen a value's place there: from the share of smaller values to that of values up to it.
    """

    def apart(value: Column, i: Column) -> Column:
        below = F.size(F.filter(other, lambda x: x < value))
        upto = F.size(F.filter(other, lambda x: x <= value))
        return F.greatest(F.lit(0), below - i, i - upto)

    return F.array_max(F.transform(one, apart)) / STEPS


def drift_report(old: DataFrame, new: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """What has changed from one profile to another, a row per column.

    ``nulls_by``: change of the share of NULLs; ``distinct_by``: relative change of distinct values;
    ``ranks_by``: the farthest that a quantile of one profile is from its rank in the other; ``state``:
    ``added``, ``removed``, ``changed`` (a change beyond ``tolerance`` and the sketches' errors) or ``same``.
    """
    share = lambda p: F.col(f"{p}.nulls") / F.nullif(F.col(f"{p}.rows"), F.lit(0))
    distinct = lambda p: F.hll_sketch_estimate(F.col(f"{p}.distinct_sketch"))
    both = F.col("o.column").isNotNull() & F.col("n.column").isNotNull()
    held = both & F.col("o.numeric") & F.col("n.numeric")
    held = held & (F.kll_sketch_get_n_double("o.rank_sketch") > 0) & (F.kll_sketch_get_n_double("n.rank_sketch") > 0)
    at = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    grids = [F.kll_sketch_get_quantile_double(f"{p}.rank_sketch", at) for p in "on"]
    moved = F.greatest(_farthest(*grids), _farthest(*reversed(grids)))
    joined = old.alias("o").join(new.alias("n"), F.col("o.column") == F.col("n.column"), "full")
    facts = joined.select(
        F.coalesce("o.column", "n.column").alias("column"),
        F.when(F.col("o.column").isNull(), "added").when(F.col("n.column").isNull(), "removed").alias("_gone"),
        F.when(both, share("n") - share("o")).alias("nulls_by"),
        F.when(both, distinct("n") / F.nullif(distinct("o"), F.lit(0)) - 1).alias("distinct_by"),
        F.when(held, moved).alias("ranks_by"),
    )
    beyond = [F.abs("nulls_by") > tolerance, F.abs("distinct_by") > tolerance + 2 * DISTINCT_ERROR, F.col("ranks_by") > tolerance + 2 * RANK_ERROR + 2 / STEPS]
    changed = reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for b in beyond])
    state = F.coalesce("_gone", F.when(changed, "changed").otherwise("same"))
    return facts.select("column", "nulls_by", "distinct_by", "ranks_by", state.alias("state"))


# --- frequent values -----------------------------------------------------------------
def _cells(column: Column, width: int, depth: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), column.isNull(), column), F.lit(width).cast("long")) for i in range(depth)]


def count_min(df: DataFrame, column: str, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """A count-min sketch of a column: ``cell, n``, at most ``width`` x ``depth`` rows however many values there are.

    Sketches merge by adding up (``merge_counts``). The smallest count among a value's cells is
    never below the value's own, and above it by more than e / ``width`` of all rows with a
    probability of at most exp(-``depth``).
    """
    cells = F.array(*[c + i * width for i, c in enumerate(_cells(F.col(f"`{column}`"), width, depth))])
    return df.select(F.explode(cells).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*sketches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sketches).groupBy("cell").agg(F.sum("n").alias("n"))


def top_values(df: DataFrame, column: str, k: int, width: int = WIDTH, depth: int = DEPTH, sketch: DataFrame | None = None) -> DataFrame:
    """The ``k`` most frequent values and how often they occur, exactly; ties by value, NULL is a value.

    For columns of very many values, whose plain counts would all be shuffled. The values in the
    fullest cells of a count-min sketch are counted exactly; their ``k``-th count is a bound that
    every value of the result reaches. Then all values that can reach it by the sketch are counted:
    the result, and values whose estimate is too high by what the sketch allows. ``sketch`` is a
    stored one of the same ``width`` and ``depth``.
    """
    spark = df.sparkSession
    sketch = count_min(df, column, width, depth) if sketch is None else sketch
    value = F.col(f"`{column}`")
    cells = _cells(value, width, depth)
    counted = lambda rows: rows.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("total"))
    fullest = sketch.filter(F.col("cell") < width).orderBy(F.desc("n"), "cell").limit(4 * k)
    listed = [r["cell"] for r in fullest.collect()]  # 4 k numbers
    first = counted(df.filter(cells[0].isin(listed))) if listed else counted(df)
    bound = [r["total"] for r in first.orderBy(F.desc("total")).limit(k).collect()]  # k numbers
    least = bound[-1] if len(bound) == k else 0
    counts = dense_array(sketch.select(F.col("cell").alias("word"), F.col("n").alias("bits")), width * depth)
    estimate = F.array_min(F.array(*[F.get(counts, (c + i * width).cast("int")) for i, c in enumerate(cells)]))
    found = counted(df.filter(estimate >= least))
    return found.orderBy(F.desc("total"), F.asc(column)).limit(k)
