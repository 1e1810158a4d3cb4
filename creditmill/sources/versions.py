"""Published versions: which folder each table of a lake is read from.

Writers put every table into a folder of its own and then publish, in one step, a small numbered
file that names the folder of every table. Readers take the file with the highest number. So a
run that fails publishes nothing and readers keep what they had, all tables change together, and
two runs that began from the same version cannot both publish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Folder of the numbered files, below a lake's root.
LOG = "_versions"


class Conflict(RuntimeError):
    """Another run has published since this one began."""


@dataclass(frozen=True)
class Snapshot:
    """The tables of one version: ``number`` (0: nothing published yet) and the folder of each, below the root."""

    number: int = 0
    places: Mapping[str, str] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    """The path as Hadoop's, and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, in order."""
    log, files = _files(spark, f"{root}/{LOG}")
    if not files.exists(log):
        return []
    names = [status.getPath().getName() for status in files.listStatus(log)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.removesuffix(".json").isdigit())


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """A published version: the latest, or the one with that number."""
    known = numbers(spark, root)
    if number is None:
        number = known[-1] if known else 0
    if number == 0:
        return Snapshot()
    if number not in known:
        raise ValueError(f"{root} has no version {number}")
    place, files = _files(spark, f"{root}/{LOG}/{number:010d}.json")
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot(number, json.loads(text))


def publish(spark: SparkSession, root: str, base: Snapshot, places: Mapping[str, str]) -> Snapshot:
    """Make ``places``, over those of ``base``, the next version; ``Conflict`` if ``base`` is not the latest."""
    new = Snapshot(base.number + 1, {**base.places, **places})
    draft, files = _files(spark, f"{root}/{LOG}/.{uuid.uuid4().hex}")
    final, _ = _files(spark, f"{root}/{LOG}/{new.number:010d}.json")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(new.places, indent=1, sort_keys=True).encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), no_options)  # never over a file that exists
    except Py4JJavaError as error:
        files.delete(draft, False)
        if files.exists(final):
            raise Conflict(f"version {new.number} of {root} was published by another run") from error
        raise
    return new


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` versions and the folders that only they name; returns these folders.

    Folders of runs that never published are unknown here and stay.
    """
    if keep < 1:
        raise ValueError("at least one version stays")
    known = numbers(spark, root)
    old, kept = known[:-keep], known[-keep:]
    needed = {place for n in kept for place in snapshot(spark, root, n).places.values()}
    unused = sorted({place for n in old for place in snapshot(spark, root, n).places.values()} - needed)
    for n in old:  # first, so that no reader is sent to a folder that is gone
        place, files = _files(spark, f"{root}/{LOG}/{n:010d}.json")
        files.delete(place, False)
    for name in filter(None, unused):
        place, files = _files(spark, f"{root}/{name}")
        files.delete(place, True)
    return [name for name in unused if name]
