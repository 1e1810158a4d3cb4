"""Zones: directories of columnar files, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_FORMAT = "parquet"


def read_zone(
    spark: SparkSession, path: str, fmt: str = DEFAULT_FORMAT, schema: T.StructType | None = None
) -> DataFrame:
    """The zone at ``path``. A declared schema spares Spark the job that reads file footers."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def write_zone(df: DataFrame, path: str, fmt: str = DEFAULT_FORMAT, compact: bool = False) -> None:
    """Replace the zone at ``path``.

    ``compact`` writes as few files as the data needs: a short list becomes one file, a
    long one several of the advisory partition size, so no task ever takes it all.
    """
    out = df.hint("rebalance") if compact else df
    out.write.format(fmt).mode("overwrite").save(path)
