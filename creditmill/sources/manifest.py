"""Copy of the raw files a manifest lists into the bronze zone."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from creditmill.sources.delimited import read_text_csv, write_quoted_csv

MANIFEST_SCHEMA = "folderName string, fileName string"


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All records of the manifest, one per file to copy.

    The default reads a JSON array or one object, however it is laid out; pass
    ``multi_line=False`` for one object per line.
    """
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", multi_line).json(path)


def listed_paths(manifest: DataFrame) -> Iterator[str]:
    """``folder/file`` of each record, fetched one partition at a time."""
    for row in manifest.select("folderName", "fileName").toLocalIterator():
        yield f"{row.folderName.strip('/')}/{row.fileName}"


def ingest_manifest(
    spark: SparkSession,
    manifest: DataFrame,
    raw_root: str,
    bronze_root: str,
    at_once: int = 16,
    multi_line: bool | None = None,
) -> list[str]:
    """Copy each listed file to the same place below ``bronze_root``; returns the places in order.

    One distributed read and write per file, ``at_once`` of them side by side; no more than
    twice as many are waiting. Values stay as they are, line breaks in quotes included, all
    quoted, below the header. ``multi_line`` as in ``read_declared_csv``: a large file without
    line breaks in values is read and written by many tasks.
    """

    def copy(place: str) -> str:
        write_quoted_csv(read_text_csv(spark, f"{raw_root}/{place}", multi_line), f"{bronze_root}/{place}")
        return place

    copied, running = [], deque()
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for place in listed_paths(manifest):
            running.append(pool.submit(inheritable_thread_target(spark)(copy), place))
            if len(running) >= 2 * at_once:
                copied.append(running.popleft().result())
        copied += [job.result() for job in running]
    return copied
