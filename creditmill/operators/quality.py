"""Profiles, duplicate keys and the exclusion of quarantined keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile_counts(df: DataFrame, checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Row count, non-NULL count per column and count of rows per named check, in one pass.

    One row: ``row_count``, ``<column>_count`` for every column, and one column per check.
    """
    counts = [F.count(F.lit(1)).alias("row_count")]
    counts += [F.count(c).alias(f"{c}_count") for c in df.columns]
    counts += [F.count_if(check).alias(name) for name, check in (checks or {}).items()]
    return df.agg(*counts)


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Values and how often they occur, most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), F.asc(column))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, NULL included."""
    return df.select(column).distinct()


def rows_with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts with ``prefix``; a literal prefix reaches the file scan."""
    return df.filter(F.col(column).startswith(prefix))


def preview(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in the given order, found per partition before they are merged."""
    return df.orderBy(*order).limit(n)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; NULL counts as a key.

    Rows are counted per key before the shuffle, so a frequent key costs no more than a rare one.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)


def union_distinct_keys(*frames: DataFrame) -> DataFrame:
    """Set union of frames of keys."""
    return reduce(DataFrame.unionByName, frames).distinct()


def exclude_keys(df: DataFrame, listed: DataFrame, key: str, null_aware: bool = True) -> DataFrame:
    """Rows whose key is ``NOT IN`` the list.

    SQL's rules hold: an empty list keeps every row, a list with a NULL keeps none,
    otherwise rows with a NULL key go. ``null_aware=False`` ignores NULLs in the list.

    Spark plans a literal ``NOT IN`` as a broadcast of the list whatever its size. Here
    the rules that concern NULL are two scalar subqueries and the rest is a plain anti
    join, broadcast only if Spark finds the list small enough and shuffled otherwise.
    """
    listed = listed.select(F.col(key).alias("_listed"))
    known = listed.filter(F.col("_listed").isNotNull())
    if not null_aware:
        listed = known
    size = listed.agg(F.count(F.lit(1))).scalar()
    nulls = listed.agg(F.count_if(F.col("_listed").isNull())).scalar()
    allowed = (size == 0) | ((nulls == 0) & F.col(key).isNotNull())
    return df.filter(allowed).join(known.distinct(), F.col(key) == F.col("_listed"), "left_anti")


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """The frame itself, if its column names and types are the expected ones."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in expected]
    if found != wanted:
        raise ValueError(f"schema differs\n  expected {wanted}\n  found    {found}")
    return df


def columns_from(df: DataFrame, expected: T.StructType) -> DataFrame:
    """The expected columns, in order, checked for type."""
    return assert_schema(df.select(*expected.fieldNames()), expected)
