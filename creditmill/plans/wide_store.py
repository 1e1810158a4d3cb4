"""The wide view as a stored table that follows its sources, member by member.

The table is kept in buckets of members, each bucket in a folder of its own that a published
version names. A refresh compares the source tables with those the table was built from, finds the
members whose rows would differ, recomputes these members only, and rewrites the buckets they are
in; all other buckets stay where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill import schemas
from creditmill.operators.joins import ROWS_PER_SLICE
from creditmill.plans.published import PublishedLake
from creditmill.plans.wide import WIDE_COLUMNS, wide_view
from creditmill.sources.zones import read_zone

BUCKETS = 256
_BUCKET = "member_bucket"
#: Source tables, in the order ``wide_view`` takes them, and the key by which changes are found.
SOURCES = {
    "customers": "member_id",
    "loans": "member_id",
    "repayments": "loan_id",
    "delinquent_members": "member_id",
    "record_enquiry_detail": "member_id",
}
MEMBER_TABLES = ("customers", "delinquent_members", "record_enquiry_detail")


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys (NULL among them) whose rows are not the same in both frames, copies counted.

    Rows are compared by sums of two 64-bit hashes per key, which are added up before the
    shuffle: what crosses it is a few numbers per key, however wide the rows are.
    """
    columns = sorted(set(old.columns) | set(new.columns))
    if set(old.columns) != set(new.columns):
        raise ValueError("frames with different columns cannot be compared")
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    facts = [F.xxhash64(F.lit(salt), nulls, *[F.col(c) for c in columns]).cast("decimal(38,0)") for salt in (1, 2)]

    def sums(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.col(key).alias("_key"), F.lit(sign).alias("_n"), *[(f * sign).cast("decimal(38,0)").alias(f"_h{i}") for i, f in enumerate(facts)])

    total = sums(old, -1).union(sums(new, 1)).groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("_n", "_h0", "_h1")])
    return total.filter("_n <> 0 or _h0 <> 0 or _h1 <> 0").select(F.col("_key").alias(key))


def touched_members(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> DataFrame:
    """``member_id`` of all members whose rows of the wide view may differ between two sets of source tables."""
    own = [changed_keys(old[name], new[name], key) for name, key in SOURCES.items() if key == "member_id"]
    paid = changed_keys(old["repayments"], new["repayments"], "loan_id").filter(F.col("loan_id").isNotNull())
    for tables in (old, new):
        loans = tables["loans"].select("member_id", F.col("loan_id").try_cast("bigint").alias("loan_id"))
        own.append(loans.join(paid, "loan_id", "left_semi").select("member_id"))
    return reduce(DataFrame.union, own).distinct()


def only_members(tables: Mapping[str, DataFrame], members: DataFrame) -> dict[str, DataFrame]:
    """The rows of the source tables that the members' part of the wide view is made of."""
    listed = members.select(F.col("member_id").alias("_member"))
    kept = {
        name: df.join(listed, df["member_id"].eqNullSafe(listed["_member"]), "left_semi")
        for name, df in tables.items()
        if SOURCES[name] == "member_id"
    }
    loans = kept["loans"].select(F.col("loan_id").try_cast("bigint").alias("_loan"))
    kept["repayments"] = tables["repayments"].join(loans, F.col("loan_id") == F.col("_loan"), "left_semi")
    return {name: kept[name] for name in SOURCES}


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("member_id")), F.lit(buckets)).cast("int")


class WideStore:
    """The stored wide view of a published lake; ``zone`` is where its member tables come from."""

    def __init__(self, zone: str = "silver", buckets: int = BUCKETS, rows_per_slice: int = ROWS_PER_SLICE):
        self.zone, self.buckets, self.rows_per_slice = zone, buckets, rows_per_slice
        self.name = f"wide_{zone}"

    def schema(self, lake: PublishedLake) -> T.StructType:
        kinds: dict[str, T.DataType] = {}
        for name in SOURCES:
            for field in schemas.silver_schema(name, lake.number):
                kinds.setdefault(field.name, field.dataType)
        return T.StructType([T.StructField(c, kinds[c]) for c in WIDE_COLUMNS])

    def _zone_of(self, table: str) -> str:
        return self.zone if table in MEMBER_TABLES else "silver"

    def sources(self, spark: SparkSession, lake: PublishedLake) -> dict[str, DataFrame]:
        """The source tables as the lake has them now."""
        return {name: lake.read(spark, self._zone_of(name), name).drop("ingest_date") for name in SOURCES}

    def _known(self, lake: PublishedLake) -> dict[str, str]:
        """Places of this table's buckets and of the sources it was built from."""
        prefix = f"{self.name}/"
        every = {**lake.version.places, **lake.written}
        return {k.removeprefix(prefix): place for k, place in every.items() if k.startswith(prefix)}

    def _built_from(self, spark: SparkSession, lake: PublishedLake) -> dict[str, DataFrame]:
        known, found = self._known(lake), {}
        for name in SOURCES:
            schema = lake.schema(self._zone_of(name), name) if lake.fmt in ("parquet", "orc", "json") else None
            found[name] = read_zone(spark, f"{lake.root}/{known[f'source/{name}']}", lake.fmt, schema).drop("ingest_date")
        return found

    def _folders(self, lake: PublishedLake) -> dict[int, str]:
        return {int(k): place for k, place in self._known(lake).items() if k.isdigit() and place}

    def read(self, spark: SparkSession, lake: PublishedLake, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        paths = [f"{lake.root}/{place}" for b, place in sorted(self._folders(lake).items()) if buckets is None or b in buckets]
        if not paths:
            return spark.createDataFrame([], self.schema(lake))
        return spark.read.format(lake.fmt).schema(self.schema(lake)).load(paths)

    def _write(self, spark: SparkSession, run: PublishedLake, rows: DataFrame, buckets: list[int]) -> None:
        """``rows`` as the new content of ``buckets``, one folder for each bucket that has any."""
        folder = f"{self.name}/{run.run}-{uuid.uuid4().hex[:8]}"
        parts = rows.withColumn(_BUCKET, _bucket(self.buckets)).hint("rebalance", F.col(_BUCKET))
        parts.write.format(run.fmt).partitionBy(_BUCKET).save(f"{run.root}/{folder}")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{run.root}/{folder}")
        listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
        full = {name for name in (status.getPath().getName() for status in listed) if name.startswith(_BUCKET)}
        for b in buckets:
            part = f"{_BUCKET}={b}"
            run.written[f"{self.name}/{b}"] = f"{folder}/{part}" if part in full else ""
        for name in SOURCES:
            run.written[f"{self.name}/source/{name}"] = run.place(self._zone_of(name), name)

    def build(self, spark: SparkSession, run: PublishedLake) -> None:
        """Write the whole table."""
        rows = wide_view(*self.sources(spark, run).values(), rows_per_slice=self.rows_per_slice)
        self._write(spark, run, rows, list(range(self.buckets)))

    def refresh(self, spark: SparkSession, run: PublishedLake) -> list[int]:
        """Bring the table up to the run's source tables; returns the buckets written anew.

        A table that was never built is built. Its number of buckets stays as it was built.
        """
        known = self._known(run)
        if not known:
            self.build(spark, run)
            return list(range(self.buckets))
        if sum(k.isdigit() for k in known) != self.buckets:
            raise ValueError(f"{self.name} has another number of buckets: build it anew")
        new = self.sources(spark, run)
        run.write(touched_members(self._built_from(spark, run), new), self.name, "touched", compact=True)
        members = read_zone(spark, run.path(self.name, "touched"), run.fmt)
        buckets = sorted(r[0] for r in members.select(_bucket(self.buckets)).distinct().collect())  # no more than there are buckets
        if buckets:
            stored = self.read(spark, run, buckets)
            kept = stored.join(members.withColumnRenamed("member_id", "_member"), F.col("member_id").eqNullSafe(F.col("_member")), "left_anti")
            again = wide_view(*only_members(new, members).values(), rows_per_slice=self.rows_per_slice)
            self._write(spark, run, kept.unionByName(again), buckets)
        return buckets

    def register(self, spark: SparkSession, lake: PublishedLake, table: str) -> None:
        """Declare ``table`` over the published buckets: one partition each, at the place the version names."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema(lake))
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(
            f"CREATE TABLE {table} ({columns}, {_BUCKET} INT) USING {lake.fmt} "
            f"PARTITIONED BY ({_BUCKET}) LOCATION '{lake.root}/{self.name}/_declared'"
        )
        parts = [f"PARTITION ({_BUCKET}={b}) LOCATION '{lake.root}/{place}'" for b, place in sorted(self._folders(lake).items())]
        for at in range(0, len(parts), 100):
            spark.sql(f"ALTER TABLE {table} ADD {' '.join(parts[at : at + 100])}")
        spark.catalog.refreshTable(table)
