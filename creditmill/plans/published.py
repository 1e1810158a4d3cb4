"""A lake whose tables change together, when a run has succeeded."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from creditmill.plans.batch import Lake
from creditmill.sources.versions import Snapshot, publish, snapshot
from creditmill.sources.zones import write_zone


@dataclass(frozen=True)
class PublishedLake(Lake):
    """A lake read through its published versions.

    ``opened`` pins the latest version, or an earlier one; all reads then see that version, whatever
    is published meanwhile. ``begin`` starts a run on top of the latest version: its tables go to
    folders of their own, its stages read what it has written and the version below for the rest,
    and ``commit`` publishes it. A run that fails, or is never committed, changes nothing for readers.
    """

    version: Snapshot = field(default_factory=Snapshot)
    run: str = ""
    written: dict[str, str] = field(default_factory=dict)

    def opened(self, spark: SparkSession, number: int | None = None) -> PublishedLake:
        return replace(self, version=snapshot(spark, self.root, number), run="", written={})

    def begin(self, spark: SparkSession) -> PublishedLake:
        return replace(self, version=snapshot(spark, self.root), run=uuid.uuid4().hex, written={})

    def place(self, zone: str, name: str) -> str:
        """A table's folder, below the root."""
        table = f"{zone}/{name}"
        place = self.written.get(table) or self.version.places.get(table)
        if place is None:
            raise ValueError(f"{table} is in no version published below {self.root}, nor written by this run")
        return place

    def path(self, zone: str, name: str) -> str:
        return super().path(zone, name) if zone == "catalog" else f"{self.root}/{self.place(zone, name)}"

    def bronze(self) -> str:
        self._writable()
        return f"{self.root}/bronze/{self.run}"

    def write(self, df: DataFrame, zone: str, name: str, compact: bool = False) -> None:
        self._writable()
        # each attempt has a folder of its own: what a stage reads is never overwritten, not even by itself
        place = f"{zone}/{name}/{self.run}-{uuid.uuid4().hex[:8]}"
        write_zone(df, f"{self.root}/{place}", self.fmt, compact)
        self.written[f"{zone}/{name}"] = place

    def commit(self, spark: SparkSession) -> PublishedLake:
        """Publish what the run wrote; ``Conflict`` if another run has published since ``begin``."""
        self._writable()
        return replace(self, version=publish(spark, self.root, self.version, self.written), run="", written={})

    def _writable(self) -> None:
        if not self.run:
            raise ValueError("a version is read-only: begin a run to write")
