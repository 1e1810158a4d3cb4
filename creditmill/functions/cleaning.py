"""Column expressions used by the cleaning operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditmill.params import PLAIN_NUMBER, TERM_UNIT


def number_from_text(text: Column, pattern: str = PLAIN_NUMBER, to: str = "double") -> Column:
    """The number a text holds, or NULL where the text does not match ``pattern``."""
    return F.when(text.rlike(pattern), text.try_cast(to))


def plain_number(value: Column) -> Column:
    """A numeric value if it is finite and has no minus sign, else NULL."""
    as_double = value.cast("double")
    plain = (as_double >= 0) & ~F.isnan(as_double) & (as_double < float("inf"))
    return F.when(plain & ~as_double.cast("string").startswith("-"), value)


def digits_as_int(text: Column) -> Column:
    """The digits of a text as an int; NULL if it has none."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits != "", digits.try_cast("int"))


def shortened_code(code: Column, max_len: int, other: str) -> Column:
    """``other`` for codes longer than ``max_len``; shorter ones and NULL are kept."""
    return F.when(F.length(code) > max_len, F.lit(other)).otherwise(code)


def term_in_years(term: Column, unit: str = TERM_UNIT) -> Column:
    """Whole years of a text such as ``36 months``; NULL if it is malformed."""
    months = F.regexp_replace(term, unit, "").try_cast("int")
    return (months / 12).cast("int")


def in_vocabulary(value: Column, vocabulary: Sequence[str], other: str) -> Column:
    """``other`` for NULL and for values outside ``vocabulary``."""
    return F.when(value.isin(*vocabulary), value).otherwise(F.lit(other))


def repaired_total(total: Column, principal: Column, *more_parts: Column) -> Column:
    """The sum of the parts where a total of zero contradicts a non-zero principal."""
    parts = principal
    for part in more_parts:
        parts = parts + part
    return F.when((principal != 0.0) & (total == 0.0), parts).otherwise(total)


def without_sentinel(text: Column, sentinel: str) -> Column:
    """NULL in place of ``sentinel``."""
    return F.when(text != sentinel, text)


def whole_or_zero(value: Column) -> Column:
    """A number cut to an int, zero where it is missing or no number; beyond the range of ints, the end of it."""
    as_double = value.try_cast("double")
    beyond = F.when(~F.isnan(as_double) & (as_double >= 2**31), 2**31 - 1).when(as_double <= -(2**31), -(2**31))
    return F.coalesce(value.try_cast("int"), beyond.cast("int"), F.lit(0))
