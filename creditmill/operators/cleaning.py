"""Cleaning operators. All but the whole-row distinct and the mean are narrow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.functions import cleaning as C
from creditmill.params import LOAN_PURPOSES, MONTH_YEAR, OTHER_PURPOSE, PLAIN_NUMBER, TERM_UNIT, ZERO_SENTINEL


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; names the frame does not have are skipped."""
    return df.withColumnsRenamed(dict(names))


def stamp_ingest(df: DataFrame, at: str | Column | None = None, column: str = "ingest_date") -> DataFrame:
    """Add the ingest time: the time of the query, or a fixed one for reproducible runs."""
    stamp = F.current_timestamp() if at is None else (F.lit(at) if isinstance(at, str) else at).cast("timestamp")
    return df.withColumn(column, stamp)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each group of identical rows. Copies collapse before the shuffle."""
    return df.distinct()


def validated_numeric(
    df: DataFrame,
    columns: Sequence[str],
    pattern: str = PLAIN_NUMBER,
    text_to: str = "double",
    legacy_float_text: bool = False,
) -> DataFrame:
    """Keep plain non-negative numbers, put NULL in place of everything else.

    Text columns are matched against ``pattern`` before the cast to ``text_to``. Columns
    that are numbers already keep their type and must be finite and not negative.
    ``legacy_float_text`` matches the text form of the number as well, which also rejects
    values that print with an exponent (ten million and above, or below a thousandth).
    """
    kinds = df.schema

    def checked(name: str) -> Column:
        if isinstance(kinds[name].dataType, T.StringType):
            number = C.number_from_text(F.col(name), pattern, text_to)
            return F.when(number.cast("string").rlike(pattern), number) if legacy_float_text else number
        if legacy_float_text:
            return F.when(F.col(name).cast("string").rlike(pattern), F.col(name))
        return C.plain_number(F.col(name))

    return df.withColumns({name: checked(name) for name in columns})


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any of the columns."""
    return df.na.drop(subset=list(columns))


def digits_to_int(df: DataFrame, column: str) -> DataFrame:
    """``10+ years`` -> 10, ``< 1 year`` -> 1, text without digits -> NULL."""
    return df.withColumn(column, C.digits_as_int(F.col(column)))


def impute_floor_mean(df: DataFrame, column: str) -> DataFrame:
    """Fill NULLs with the floored mean of the column.

    The mean is a scalar subquery: one value, computed with partial sums. Where
    ``df`` ends in a shuffle, both branches read the same one. If every value is
    NULL there is no mean and the NULLs stay.
    """
    kind = df.schema[column].dataType
    mean = df.agg(F.floor(F.avg(column)).cast(kind)).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), mean))


def clamp_code_length(df: DataFrame, column: str, max_len: int = 2, other: str = "NA") -> DataFrame:
    """Replace codes that are too long; shorter codes and NULL stay."""
    return df.withColumn(column, C.shortened_code(F.col(column), max_len, other))


def term_to_years(df: DataFrame, source: str, target: str, unit: str = TERM_UNIT) -> DataFrame:
    """Turn ``36 months`` into 3 and rename the column, keeping its place."""
    return df.withColumn(source, C.term_in_years(F.col(source), unit)).withColumnRenamed(source, target)


def canonicalize(
    df: DataFrame, column: str, vocabulary: Sequence[str] = LOAN_PURPOSES, default: str = OTHER_PURPOSE
) -> DataFrame:
    """Map NULL and values outside the vocabulary to ``default``."""
    return df.withColumn(column, C.in_vocabulary(F.col(column), vocabulary, default))


def repair_total(df: DataFrame, total: str, principal: str, *more_parts: str) -> DataFrame:
    """Rebuild a total that is zero although principal was received."""
    parts = [F.col(c) for c in (principal, *more_parts)]
    # sums of decimals have a wider type than the total; one that does not fit it is NULL
    return df.withColumn(total, C.repaired_total(F.col(total), *parts).try_cast(df.schema[total].dataType))


def drop_zero(df: DataFrame, column: str) -> DataFrame:
    """Keep rows whose value is known and not zero."""
    return df.filter(F.col(column) != 0.0)


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: str = ZERO_SENTINEL) -> DataFrame:
    """Put NULL in place of a text that stands for "no value"."""
    return df.withColumns({c: C.without_sentinel(F.col(c), sentinel) for c in columns})


def require_pattern_or_null(df: DataFrame, column: str, pattern: str = MONTH_YEAR) -> DataFrame:
    """Keep rows whose text matches the pattern or is missing."""
    return df.filter(F.col(column).isNull() | F.col(column).rlike(pattern))


def int_or_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cut numbers to ints, with zero for NULL."""
    return df.withColumns({c: C.whole_or_zero(F.col(c)) for c in columns})
