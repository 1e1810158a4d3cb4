"""Catalog entries over zones."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from creditmill.sources.zones import DEFAULT_FORMAT


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")


def register_external(
    spark: SparkSession, table: str, schema: T.StructType, path: str, fmt: str = DEFAULT_FORMAT
) -> None:
    """Declare a table over the zone at ``path``.

    An external table of that name which has another place, format or schema is declared
    anew (its files stay where they are); a table that owns its files is an error.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    if spark.catalog.tableExists(table):
        known = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        if known.get("Type") != "EXTERNAL":
            raise ValueError(f"{table} exists and is not an external table")
        declared = [(f.name, f.dataType) for f in spark.table(table).schema]
        same = declared == [(f.name, f.dataType) for f in schema] and known.get("Provider", "").lower() == fmt.lower()
        if not same or _qualified(spark, known["Location"]) != _qualified(spark, path):
            spark.sql(f"DROP TABLE {table}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {fmt} LOCATION '{path}'")
    # a zone may have been rewritten since the table was last read
    spark.catalog.refreshTable(table)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, without a slash at the end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(place).toString().rstrip("/")


def register_view(spark: SparkSession, view: str, query: str) -> None:
    """Create or replace a persistent view."""
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS {query}")
