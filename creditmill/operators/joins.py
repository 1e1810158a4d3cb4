"""Equi-join for tables in which one key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 1_000_000
BUCKETS = 65_536


def hot_keys(df: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Keys with more rows than one slice should hold: ``_hot_key`` and its number of ``_slices``.

    A slice is ``rows_per_slice`` rows, or four times an average bucket if that is more, so
    fewer than ``BUCKETS / 4`` keys can exceed it: few enough to broadcast whatever the size
    of ``df``.

    Rows are first counted per bucket of keys, which shuffles next to nothing, and then per
    key in the buckets that are too full to hold rare keys only. Without frequent keys there
    is no such bucket and the second count has no input.
    """
    keyed = df.select(F.col(key).alias("_hot_key")).filter(F.col("_hot_key").isNotNull())
    bucket = F.pmod(F.xxhash64("_hot_key"), F.lit(BUCKETS))
    per_bucket = keyed.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    total = per_bucket.agg(F.sum("_n")).scalar()
    slice_rows = F.greatest(F.lit(rows_per_slice).cast("double"), total * 4.0 / BUCKETS)
    full = F.broadcast(per_bucket.filter(F.col("_n") > slice_rows).select("_bucket"))
    return (
        keyed.join(full, bucket == F.col("_bucket"), "left_semi")
        .groupBy("_hot_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > slice_rows)
        .select("_hot_key", F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices"))
    )


def skew_join(
    spread: DataFrame,
    other: DataFrame,
    key: str,
    keep: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
    counted: DataFrame | None = None,
    hot: DataFrame | None = None,
    deal_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join on ``key`` that spreads the frequent keys of ``spread`` over many tasks.

    Rows of a frequent key in ``spread`` are dealt to slices, and the rows of that key in
    ``other`` are repeated once per slice; every other key is joined as usual. The result
    is that of the plain join: ``keep`` is ``inner``, ``spread`` (its unmatched rows stay)
    or ``other`` (likewise). ``key`` comes first and once; other column names must differ.

    The slice of a row depends on its content and input partition only, so a repeated task
    deals it alike, and identical rows from many partitions still spread. ``deal_by`` names
    the columns that stand for the content, so that others need not be read for it.

    ``counted`` is a cheaper frame to look for frequent keys in, where ``spread`` is the
    result of other joins. With ``keep="other"`` all its keys must occur in ``spread``.
    ``hot`` is the list of ``hot_keys`` where it is stored already: nothing is counted then,
    and with an empty list this is the plain join.
    """
    how = {"inner": "inner", "spread": "left", "other": "right"}[keep]
    if hot is not None and hot.isEmpty():
        joined = spread.join(other, key, how)
        return joined.select(key, *[c for c in (*spread.columns, *other.columns) if c != key])
    hot = F.broadcast(hot_keys(spread if counted is None else counted, key, rows_per_slice) if hot is None else hot)
    dealt = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in deal_by or spread.columns])
    # rows with a NULL key match nothing: any slice will do
    null_slice = F.pmod(dealt, F.lit(1024)).cast("int")
    left = spread.join(hot, F.col(key) == F.col("_hot_key"), "left").select(
        F.col(key).alias("_left_key"),
        *[c for c in spread.columns if c != key],
        F.when(F.col(key).isNull(), null_slice)
        .when(F.col("_slices").isNotNull(), F.pmod(dealt, F.col("_slices")).cast("int"))
        .otherwise(0)
        .alias("_left_slice"),
    )
    null_slice = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in other.columns]), F.lit(1024))
    right = (
        other.join(hot, F.col(key) == F.col("_hot_key"), "left")
        .select(
            F.col(key).alias("_right_key"),
            *[c for c in other.columns if c != key],
            F.col("_slices").isNotNull().alias("_repeated"),
            F.when(F.col(key).isNull(), F.array(null_slice.cast("int")))
            .when(F.col("_slices").isNotNull(), F.sequence(F.lit(0), F.col("_slices") - 1))
            .otherwise(F.array(F.lit(0)))
            .alias("_right_slices"),
        )
        .withColumn("_right_slice", F.explode("_right_slices"))
    )
    joined = left.join(
        right,
        (F.col("_left_key") == F.col("_right_key")) & (F.col("_left_slice") == F.col("_right_slice")),
        how,
    )
    if keep == "other":
        # a repeated row has a match in some slice; the slices without one are no result
        joined = joined.filter(~F.col("_repeated") | F.col("_left_key").isNotNull())
    kept_key: Column = F.col("_right_key") if keep == "other" else F.col("_left_key")
    return joined.select(
        kept_key.alias(key),
        *[c for c in spread.columns if c != key],
        *[c for c in other.columns if c != key],
    )


def hot_grid(
    left: DataFrame,
    right: DataFrame,
    key: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    hot_left: DataFrame | None = None,
    hot_right: DataFrame | None = None,
) -> DataFrame:
    """Keys that are frequent on either side: ``_hot_key``, ``_rows``, ``_columns``.

    ``_rows`` is the number of slices of the key's rows in ``left``, ``_columns`` of those in
    ``right``; 1 where the key is not frequent there. Fewer than ``BUCKETS / 2`` keys, so that
    the list may be broadcast. ``hot_left`` and ``hot_right`` are stored lists of ``hot_keys``.
    """
    by_left = hot_keys(left, key, rows_per_slice) if hot_left is None else hot_left
    by_right = hot_keys(right, key, rows_per_slice) if hot_right is None else hot_right
    rows = by_left.select("_hot_key", F.col("_slices").alias("_rows"), F.lit(1).alias("_columns"))
    columns = by_right.select("_hot_key", F.lit(1).alias("_rows"), F.col("_slices").alias("_columns"))
    return rows.unionByName(columns).groupBy("_hot_key").agg(F.max("_rows").alias("_rows"), F.max("_columns").alias("_columns"))


def grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
    counted_left: DataFrame | None = None,
    counted_right: DataFrame | None = None,
    hot_left: DataFrame | None = None,
    hot_right: DataFrame | None = None,
    deal_left: Sequence[str] | None = None,
    deal_right: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join on ``key`` for a key that may be frequent on both sides.

    The pairs of a frequent key form a grid: its rows in ``left`` are dealt to row slices, its
    rows in ``right`` to column slices, and every cell of the grid is joined by itself. A row of
    ``left`` is repeated once per column slice and a row of ``right`` once per row slice, so a
    task holds about one slice of either side, where copying one side whole would hand all
    frequent rows of that side to each task. A key that is frequent on one side only has a grid
    of one row or one column; every other key is joined as usual.

    The result is that of the plain join; ``how`` is ``inner``, ``left``, ``right`` or ``full``.
    ``key`` comes first and once; other column names must differ. Other arguments are as in
    ``skew_join``, for each side. A key in a given list must occur on that side if rows without
    a match are kept on the other one.
    """
    lists = [h for h in (hot_left, hot_right) if h is not None]
    if len(lists) == 2 and all(h.isEmpty() for h in lists):
        joined = left.join(right, key, how)
        return joined.select(key, *[c for c in (*left.columns, *right.columns) if c != key])
    grid = F.broadcast(
        hot_grid(
            left if counted_left is None else counted_left,
            right if counted_right is None else counted_right,
            key,
            rows_per_slice,
            hot_left,
            hot_right,
        )
    )

    def dealt(df: DataFrame, side: str, own: str, other: str, deal_by: Sequence[str] | None) -> DataFrame:
        """The side's rows, each in its own slice and in every slice of the other side."""
        place = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in deal_by or df.columns])
        # rows with a NULL key match nothing: any slice will do
        slice_ = F.when(F.col(key).isNull(), F.pmod(place, F.lit(1024))).otherwise(F.pmod(place, F.coalesce(own, F.lit(1))))
        copies = F.coalesce(F.when(F.col(key).isNotNull(), F.col(other)), F.lit(1))
        return df.join(grid, F.col(key) == F.col("_hot_key"), "left").select(
            F.col(key).alias(f"_{side}_key"),
            *[c for c in df.columns if c != key],
            slice_.cast("int").alias(f"_{side}{own}"),
            (copies > 1).alias(f"_{side}_repeated"),
            F.explode(F.sequence(F.lit(0), copies - 1)).alias(f"_{side}{other}"),
        )

    one = dealt(left, "left", "_rows", "_columns", deal_left)
    two = dealt(right, "right", "_columns", "_rows", deal_right)
    same = [F.col(f"_left{c}") == F.col(f"_right{c}") for c in ("_key", "_rows", "_columns")]
    joined = one.join(two, same, how)
    # a repeated row has a match in some cell; the cells without one are no result
    if how in ("left", "full"):
        joined = joined.filter(F.coalesce(~F.col("_left_repeated"), F.lit(True)) | F.col("_right_key").isNotNull())
    if how in ("right", "full"):
        joined = joined.filter(F.coalesce(~F.col("_right_repeated"), F.lit(True)) | F.col("_left_key").isNotNull())
    kept_key = F.coalesce("_left_key", "_right_key")
    return joined.select(
        kept_key.alias(key),
        *[c for c in left.columns if c != key],
        *[c for c in right.columns if c != key],
    )
