"""Members whose key is ambiguous, and the tables without them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame

from creditmill.operators.quality import duplicate_keys, exclude_keys, union_distinct_keys

KEY = "member_id"


class Quarantine(NamedTuple):
    """Duplicate keys per table, and their union."""

    per_table: dict[str, DataFrame]
    members: DataFrame


def find_quarantined(tables: Mapping[str, DataFrame], key: str = KEY) -> Quarantine:
    """Keys that occur more than once in any one of the tables."""
    per_table = {name: duplicate_keys(df, key) for name, df in tables.items()}
    return Quarantine(per_table, union_distinct_keys(*per_table.values()))


def without_quarantined(
    tables: Mapping[str, DataFrame], members: DataFrame, key: str = KEY, null_aware: bool = True
) -> dict[str, DataFrame]:
    """The tables without the quarantined keys. Each key left occurs once per table."""
    return {name: exclude_keys(df, members, key, null_aware) for name, df in tables.items()}
