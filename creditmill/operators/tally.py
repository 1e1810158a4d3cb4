"""Frames that hold each distinct row once, with the number of times it occurs.

A join of many rows with many rows of one key yields their product. When only few
distinct rows exist per key, counting them first keeps the join small and the result
complete: the counts multiply instead of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_COUNT = "row_count"
# counts are 64-bit; the product of two may not fit
PRODUCT_TYPE = "decimal(38,0)"


def is_tallied(df: DataFrame) -> bool:
    return ROW_COUNT in df.columns


def tally_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows (of ``columns``, or all) with their ``row_count``.

    Counts partially before the shuffle. A frame that carries counts already has them summed.
    """
    columns = [c for c in (columns or df.columns) if c != ROW_COUNT]
    total = F.sum(ROW_COUNT) if is_tallied(df) else F.count(F.lit(1))
    return df.groupBy(*columns).agg(total.alias(ROW_COUNT))


def times(left: Column, right: Column) -> Column:
    """Product of two row counts."""
    return (left.cast(PRODUCT_TYPE) * right.cast(PRODUCT_TYPE)).cast(PRODUCT_TYPE)


def repeat_rows(df: DataFrame, block: int = 10_000) -> DataFrame:
    """Each row as often as its count says: the inverse of ``tally_rows``.

    Output grows with the counts, so use it only where single rows are wanted. Rows are
    produced block by block, which keeps the arrays behind them short.
    """
    whole = F.col(ROW_COUNT).cast(PRODUCT_TYPE)
    too_many = F.raise_error(F.concat(F.lit("more copies of a row than 64 bits can count: "), whole.cast("string")))
    count = F.when(whole > 2**63 - 1, too_many.cast("bigint")).otherwise(whole.try_cast("bigint"))
    plain = [c for c in df.columns if c != ROW_COUNT]
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((count - 1) / block))
    within = F.least(count - F.col("_block") * block, F.lit(block).cast("bigint"))
    return (
        df.filter(count > 0)
        .withColumn("_block", F.explode(blocks))
        .withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), within)))
        .select(*plain)
    )
