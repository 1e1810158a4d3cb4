"""The batch from raw files to scores, stage by stage.

Stages exchange data through written zones only, so a stage never recomputes another and a
lost executor costs no more than the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from creditmill import schemas
from creditmill.operators.joins import hot_keys
from creditmill.operators.quality import columns_from
from creditmill.params import DEFAULT_SCORE, ScoreParams
from creditmill.plans import quarantine, score, silver
from creditmill.plans.wide import wide_view_sql
from creditmill.sources.catalog import create_database, register_external, register_view
from creditmill.sources.delimited import read_declared_csv
from creditmill.sources.manifest import ingest_manifest, read_manifest
from creditmill.sources.zones import DEFAULT_FORMAT, read_zone, write_zone

# Silver tables whose keys must be unique, and which have a cleaned copy in gold.
KEYED_TABLES = ("customers", "delinquent_members", "record_enquiry_detail")


@dataclass(frozen=True)
class Options:
    """Choices of the batch; the README lists what they mean."""

    validate_loans: bool = False
    legacy_float_text: bool = False
    include_clean: bool = False
    null_aware: bool = True
    params: ScoreParams = DEFAULT_SCORE
    multi_line_files: bool | None = None


@dataclass(frozen=True)
class Lake:
    """Where the zones are and how they are written."""

    root: str
    fmt: str = DEFAULT_FORMAT
    number: str = "double"
    silver_db: str = "lending_silver"
    gold_db: str = "lending_gold"

    def path(self, zone: str, name: str) -> str:
        return f"{self.root}/{zone}/{name}"

    def schema(self, zone: str, name: str) -> T.StructType | None:
        """Columns of a table; those of the scores depend on the grain and are left to the files."""
        if zone == "staging":
            return schemas.raw_schema(name, self.number)
        if zone == "quarantine":
            return schemas.silver_schema("record_enquiry_members")
        return schemas.silver_schema(name, self.number) if name in schemas.SILVER_ENTITIES else None

    def read(self, spark: SparkSession, zone: str, name: str) -> DataFrame:
        # some formats know their schema and take none
        schema = self.schema(zone, name) if self.fmt in ("parquet", "orc", "json") else None
        return read_zone(spark, self.path(zone, name), self.fmt, schema)

    def write(self, df: DataFrame, zone: str, name: str, compact: bool = False) -> None:
        write_zone(df, self.path(zone, name), self.fmt, compact)

    def bronze(self) -> str:
        """Where copies of the raw files go."""
        return f"{self.root}/bronze"

    def commit(self, spark: SparkSession) -> Lake:
        """The lake with all that a run has written: here, tables are in place as soon as they are written."""
        return self

    def write_all(self, tables: Mapping[str, DataFrame], zone: str, compact: bool = False) -> None:
        """Write tables that do not depend on each other at the same time, so that the tail of
        one job does not leave the cluster idle."""
        with ThreadPoolExecutor(max_workers=len(tables)) as pool:
            jobs = [
                pool.submit(inheritable_thread_target(df.sparkSession)(self.write), df, zone, name, compact)
                for name, df in tables.items()
            ]
        for job in jobs:
            job.result()


def read_bronze(
    spark: SparkSession, lake: Lake, files: Mapping[str, str], multi_line: bool | None = None
) -> dict[str, DataFrame]:
    """The bronze files with their declared schemas; ``files`` maps entity to path."""
    return {
        e: read_declared_csv(spark, path, schemas.raw_schema(e, lake.number), multi_line) for e, path in files.items()
    }


def build_silver(
    spark: SparkSession,
    lake: Lake,
    raw: Mapping[str, DataFrame],
    at: str | None = None,
    options: Options = Options(),
) -> None:
    """Clean the raw frames, one per entity, into the silver zone.

    Three tables come from the defaulters, so these are parsed once into a staging zone.
    """
    lake.write(raw["defaulters"], "staging", "defaulters")
    defaulters = lake.read(spark, "staging", "defaulters")
    tables = {
        "customers": silver.customers_silver(raw["customers"], at, options.legacy_float_text, lake.number),
        "loans": silver.loans_silver(raw["loans"], at, options.validate_loans),
        "repayments": silver.repayments_silver(raw["repayments"], at),
        "delinquent_members": silver.delinquent_members(defaulters),
        "record_enquiry_members": silver.record_or_enquiry_members(defaulters),
        "record_enquiry_detail": silver.record_enquiry_detail(defaulters),
    }
    checked = {n: columns_from(df, schemas.silver_schema(n, lake.number)) for n, df in tables.items()}
    lake.write_all(checked, "silver")
    find_hot_keys(spark, lake)


# Frequent keys that later joins spread: list, silver table and key.
HOT_KEYS = {
    "hot_loans": ("repayments", "loan_id"),
    "hot_members": ("loans", "member_id"),
    "hot_customers": ("customers", "member_id"),
}


def find_hot_keys(spark: SparkSession, lake: Lake) -> None:
    """Count the keys of the silver tables once for all joins; the lists are short."""
    lists = {name: hot_keys(lake.read(spark, "silver", table), key) for name, (table, key) in HOT_KEYS.items()}
    lake.write_all(lists, "hot", compact=True)


def publish_silver(spark: SparkSession, lake: Lake) -> None:
    """Register the silver tables and the wide view over them."""
    create_database(spark, lake.silver_db, lake.path("catalog", lake.silver_db))
    names = ("customers", "loans", "repayments", "delinquent_members", "record_enquiry_detail")
    for name in names:
        register_external(
            spark,
            f"{lake.silver_db}.{name}",
            schemas.silver_schema(name, lake.number),
            lake.path("silver", name),
            lake.fmt,
        )
    register_view(
        spark, f"{lake.silver_db}.customers_loans", wide_view_sql(*(f"{lake.silver_db}.{n}" for n in names))
    )


def build_quarantine(spark: SparkSession, lake: Lake) -> None:
    """Write the lists of ambiguous members: one per table, and their union."""
    tables = {name: lake.read(spark, "silver", name) for name in KEYED_TABLES}
    lake.write_all(quarantine.find_quarantined(tables).per_table, "quarantine", compact=True)
    lists = [lake.read(spark, "quarantine", name) for name in KEYED_TABLES]
    lake.write(quarantine.union_distinct_keys(*lists), "quarantine", "members", compact=True)


def build_gold(spark: SparkSession, lake: Lake, null_aware: bool = True) -> None:
    """Write the keyed tables without the quarantined members."""
    members = lake.read(spark, "quarantine", "members")
    tables = {name: lake.read(spark, "silver", name) for name in KEYED_TABLES}
    lake.write_all(quarantine.without_quarantined(tables, members, null_aware=null_aware), "gold")


def publish_gold(spark: SparkSession, lake: Lake) -> None:
    """Register the cleaned member tables."""
    create_database(spark, lake.gold_db, lake.path("catalog", lake.gold_db))
    for name in KEYED_TABLES:
        register_external(
            spark,
            f"{lake.gold_db}.{name}",
            schemas.silver_schema(name, lake.number),
            lake.path("gold", name),
            lake.fmt,
        )


def scores(
    spark: SparkSession,
    lake: Lake,
    grain: str = "member",
    params: ScoreParams = DEFAULT_SCORE,
    include_clean: bool = False,
) -> DataFrame:
    """Scores from the gold member tables and the silver loans and repayments."""
    by_grain = {"member": score.score_members, "loan": score.score_by_loan}
    return by_grain[grain](
        lake.read(spark, "gold", "customers"),
        lake.read(spark, "silver", "loans"),
        lake.read(spark, "silver", "repayments"),
        lake.read(spark, "gold", "delinquent_members"),
        lake.read(spark, "gold", "record_enquiry_detail"),
        params=params,
        include_clean=include_clean,
        hot_loans=lake.read(spark, "hot", "hot_loans"),
        hot_members=lake.read(spark, "hot", "hot_members"),
    )


def run(
    spark: SparkSession,
    raw_root: str,
    manifest_path: str,
    files: Mapping[str, str],
    lake: Lake,
    at: str | None = None,
    grain: str = "member",
    multi_line_manifest: bool = True,
    options: Options = Options(),
) -> DataFrame:
    """Raw files to scores. ``files`` maps each entity to its ``folder/file`` in the manifest.

    A run that fails may leave a stage half written: run it again, from the stage that failed
    or from the start. Every stage replaces its tables, and reads those of earlier stages only.
    With a ``PublishedLake`` (pass a run that has begun) a run that fails leaves all as it was.
    Catalog entries are made last, over the tables of the whole run.
    """
    bronze, lines = lake.bronze(), options.multi_line_files
    manifest = read_manifest(spark, manifest_path, multi_line_manifest)
    copied = ingest_manifest(spark, manifest, raw_root, bronze, multi_line=lines)
    missing = sorted(set(files.values()) - set(copied))
    if missing:
        raise ValueError(f"files not in the manifest: {', '.join(missing)}")
    raw = read_bronze(spark, lake, {e: f"{bronze}/{place}" for e, place in files.items()}, lines)
    build_silver(spark, lake, raw, at, options)
    build_quarantine(spark, lake)
    build_gold(spark, lake, options.null_aware)
    lake.write(scores(spark, lake, grain, options.params, options.include_clean), "gold", "loan_score")
    lake = lake.commit(spark)
    publish_silver(spark, lake)
    publish_gold(spark, lake)
    return lake.read(spark, "gold", "loan_score")
