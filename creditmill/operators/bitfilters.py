"""Filters of bits that keep rows out of a shuffle, and the operators that use them.

A filter is an array of 64-bit words, of a fixed size whatever the tables hold. It is made and
merged by Spark's own aggregates, reaches the tasks as the value of a scalar subquery, and is
tested inside generated code. A filter may let a row through that it need not: what passes takes
the exact way, so results never depend on it. A filter that is too full for its size lets nearly
everything through; the operators are then as good as those without one, plus a pass over the keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a membership filter and bits set for each key; words of a counting filter, and of a row of one.
WORDS, HASHES = 1 << 16, 3
CELL_WORDS, ROW_WORDS = 1 << 18, 1 << 12


def _bits(keys: Sequence[Column], words: int, hashes: int) -> list[Column]:
    """Numbers of the bits that stand for a key."""
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(64 * words).cast("long")) for i in range(hashes)]


def dense_array(found: DataFrame, words: int) -> Column:
    """``word, bits`` rows as one array of ``words`` words, for use in expressions."""
    every = found.sparkSession.range(words).withColumnRenamed("id", "word")
    filled = every.join(found, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    one = filled.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return one.select(F.transform("all", lambda w: w["bits"])).scalar()


def _is_set(array: Column, bit: Column) -> Column:
    word = F.get(array, F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftright", word, bit.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def might_contain(listed: DataFrame, key: str, words: int = WORDS, hashes: int = HASHES):
    """A test for key columns: false only for keys that ``listed`` does not hold."""
    bits = listed.select(F.explode(F.array(*_bits([F.col(key)], words, hashes))).alias("bit"))
    set_ = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    found = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(set_).alias("bits"))
    array = dense_array(found, words)

    def test(column: Column) -> Column:
        hit = [_is_set(array, b) for b in _bits([column], words, hashes)]
        out = hit[0]
        for more in hit[1:]:
            out = out & more
        return out

    return test


def exclude_keys_filtered(
    df: DataFrame, listed: DataFrame, key: str, null_aware: bool = True, words: int = WORDS, hashes: int = HASHES
) -> DataFrame:
    """``exclude_keys`` for lists too long to broadcast: rows the filter rules out skip the shuffle.

    SQL's rules for NULL are those of ``exclude_keys``. Rows whose key is surely not in the list
    are kept as they are read; the rest, about the rows that go, take the exact anti join. ``df``
    is read twice for that, so it should come from files or end in a shuffle.
    """
    listed = listed.select(F.col(key).cast(df.schema[key].dataType).alias("_listed"))
    known = listed.filter(F.col("_listed").isNotNull())
    if not null_aware:
        listed = known
    size = listed.agg(F.count(F.lit(1))).scalar()
    nulls = listed.agg(F.count_if(F.col("_listed").isNull())).scalar()
    allowed = df.filter((size == 0) | ((nulls == 0) & F.col(key).isNotNull()))
    maybe = might_contain(known, "_listed", words, hashes)(F.col(key))
    exact = allowed.filter(maybe).join(known.distinct(), F.col(key) == F.col("_listed"), "left_anti")
    return allowed.filter(~maybe).union(exact)


def _counted(cells: int):
    """Per task: which cells its keys fall into at least once, and at least twice."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells, bool), np.zeros(cells, bool)
        for batch in batches:
            found, n = np.unique(batch.column("cell").to_numpy(), return_counts=True)
            twice[found[(n > 1) | once[found]]] = True
            once[found] = True
        rows = [np.packbits(b, bitorder="little").view(np.int64).reshape(-1, ROW_WORDS) for b in (once, twice)]
        for k in np.flatnonzero(rows[0].any(1)).tolist():
            data = [pa.array([r[k].tobytes()], pa.binary()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *data], names=["row", "once", "twice"])

    return count


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one number, which follow each other, as one: the words that have a bit for keys met twice."""

    def words(row: int, twice: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(twice)
        return pa.RecordBatch.from_arrays([pa.array(row * len(twice) + some, pa.int64()), pa.array(twice[some])], names=["word", "bits"])

    row, once, twice = -1, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for k, a, b in zip(batch.column("row").to_pylist(), batch.column("once"), batch.column("twice"), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.int64) for x in (a, b))
            if k != row:
                if row >= 0:
                    yield words(row, twice)
                row, once, twice = k, a, b
            else:
                twice = twice | b | (once & a)
                once = once | a
    if row >= 0:
        yield words(row, twice)


def duplicate_candidates(df: DataFrame, *keys: str, words: int = CELL_WORDS) -> DataFrame:
    """The rows whose key may occur more than once: all those that do, and few others.

    Keys fall into 64 x ``words`` cells. A task notes in two bits whether a cell has one key or
    more; these notes, a fixed number of bytes per task, are all that is shuffled to find the cells
    that matter. With a tenth as many keys as cells about one single key in ten stays.
    """
    return df.filter(_met_twice(df, [F.col(k) for k in keys], words))


def _met_twice(df: DataFrame, keys: Sequence[Column], words: int) -> Column:
    """Whether a row's key falls into a cell that several rows do."""
    words = max(ROW_WORDS, words)
    cell = F.pmod(F.xxhash64(*keys), F.lit(64 * words).cast("long"))
    notes = df.select(cell.alias("cell")).mapInArrow(_counted(64 * words), "row int, once binary, twice binary")
    found = notes.repartition("row").sortWithinPartitions("row").mapInArrow(_merged, "word long, bits long")
    return _is_set(dense_array(found, words), cell)


def duplicate_keys_filtered(df: DataFrame, *keys: str, words: int = CELL_WORDS) -> DataFrame:
    """``duplicate_keys``, counting only the keys that may be repeated. NULL counts as a key."""
    counted = duplicate_candidates(df, *keys, words=words).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter("_n > 1").select(*keys)


def drop_exact_duplicates_filtered(df: DataFrame, words: int = CELL_WORDS) -> DataFrame:
    """``drop_exact_duplicates`` that shuffles only rows which may have a copy; the others stay where they are read."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    test = _met_twice(df, [nulls, *columns], words)
    return df.filter(~test).union(df.filter(test).distinct())


# functions that run in tasks travel by value, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
