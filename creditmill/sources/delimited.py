"""Delimited text files: comma, double quote, backslash escape, header row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The file format. Blanks around a value belong to the value.
FORMAT = {"sep": ",", "quote": '"', "escape": "\\", "header": True}
KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def files_with_breaks(spark: SparkSession, path: str) -> list[str]:
    """The files at ``path`` of which a line may end inside quotes.

    Every line is looked at by itself, so that many tasks share a file. A line from which escaped
    characters and then all whole quoted values (from a separator or the line's beginning to the
    next quote, before a separator or the line's end) are taken away has no quote left if and only if
    its first quote opens a value, the next one closes it, and so on: such a line ends
    outside quotes if it begins outside. If all lines of a file are like that, no value of it
    holds a line break. Other files may be harmless too, but only a reader of the whole file can tell.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    plain = F.regexp_replace("value", r"\\.", "")
    left = F.regexp_replace(plain, r'(^|,)"[^"]*"(?=,|$)', "$1")
    quoted = lines.filter(F.col("value").contains('"') & F.contains(left, F.lit('"')))
    names = {r["file"] for r in quoted.select("file").distinct().collect()}  # at most one row per file
    return [place for file, place in _listed(spark, path) if file in names]


def _listed(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The files at ``path``: as scans name them, and as readers take them."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path")
    return sorted((r["file"], r["path"]) for r in files.collect())


def _read(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool | None) -> DataFrame:
    """The files at ``path``; ``multi_line``: whether a task reads whole files, or None to find out per file."""
    reader = spark.read.options(**FORMAT, **KEEP_BLANKS, enforceSchema=True).schema(schema)
    if multi_line is not None:
        return reader.option("multiLine", multi_line).csv(path)
    whole = files_with_breaks(spark, path)
    if not whole:
        return reader.option("multiLine", False).csv(path)
    rest = sorted({place for _, place in _listed(spark, path)} - set(whole))
    frame = reader.option("multiLine", True).csv(whole)
    return reader.option("multiLine", False).csv(rest).union(frame) if rest else frame


def read_declared_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool | None = None
) -> DataFrame:
    """Read with a declared schema. Columns bind by position; a value that does not fit is NULL.

    Quoted values may hold line breaks. A file that has any is read by one task; other files are
    shared by many. Which are which is found in a pass over the lines beforehand; ``multi_line=True``
    (every file by one task) or ``False`` (no such values) saves that pass.
    """
    return _read(spark, path, schema, multi_line)


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read with types inferred from all the data. Reads the files twice: for exploration only."""
    return spark.read.options(**FORMAT, **KEEP_BLANKS).option("inferSchema", True).csv(path)


def read_text_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read every column as text, named by the header. ``multi_line`` as in ``read_declared_csv``."""
    header = spark.read.options(**FORMAT, **KEEP_BLANKS).option("multiLine", multi_line is not False).csv(path)
    return _read(spark, path, header.schema, multi_line)


def write_quoted_csv(df: DataFrame, path: str) -> None:
    """Replace ``path`` with the frame as text, every value quoted. NULL becomes an empty value."""
    df.write.options(**FORMAT, **KEEP_BLANKS).option("quoteAll", True).mode("overwrite").csv(path)
