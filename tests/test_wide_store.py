"""The stored wide view after changes is what a full build gives."""

import random

import pytest
from pyspark.sql import functions as F

from checks.fixtures import BY_ENTITY, fixture
from creditmill.plans import batch
from creditmill.plans.published import PublishedLake
from creditmill.plans.wide import wide_view
from creditmill.plans.wide_store import SOURCES, WideStore, changed_keys, only_members, touched_members
from tests.conftest import rows


def test_changed_keys(spark):
    frame = lambda values: spark.createDataFrame(values, "k string, a int, b double")
    old = frame([("same", 1, 1.0), ("same", 2, None), ("copy", 1, 1.0), ("gone", 1, 1.0), ("value", 1, 1.0), (None, 1, 1.0), ("null", None, 1.0)])
    new = frame([("same", 2, None), ("same", 1, 1.0), ("copy", 1, 1.0), ("copy", 1, 1.0), ("new", 1, 1.0), ("value", 1, 2.0), (None, 2, 1.0), ("null", 1, None)])
    assert rows(changed_keys(old, new, "k")) == sorted([("copy",), ("gone",), ("new",), ("value",), (None,), ("null",)], key=repr)
    assert rows(changed_keys(old, old, "k")) == []
    assert rows(changed_keys(old.limit(0), frame([("x", 1, 1.0)]), "k")) == [("x",)]
    with pytest.raises(ValueError):
        changed_keys(old, new.drop("b"), "k")


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    lake = batch.Lake(str(tmp_path_factory.mktemp("plain")))
    batch.build_silver(spark, lake, {e: fixture(spark, sf_dir, e) for e in BY_ENTITY}, "2024-01-01")
    return {name: lake.read(spark, "silver", name) for name in SOURCES}


def changed(tables, seed):
    """Some rows deleted, some copied, some with other values, some moved to other members or loans."""
    rng = random.Random(seed)
    out = {}
    for name, df in tables.items():
        key = SOURCES[name]
        pick = F.pmod(F.xxhash64(F.lit(rng.randint(0, 1 << 30)), key, df.columns[1]), F.lit(60))
        other = {"loans": "funded_amount", "repayments": "total_principal_received", "customers": "emp_title"}.get(name, df.columns[1])
        kept = df.filter(pick != 0)
        moved = F.when(pick == 1, F.lit("7" if key == "member_id" else 33).cast(df.schema[key].dataType)).otherwise(F.col(key))
        value = F.when(pick == 2, F.lit(5).cast(df.schema[other].dataType)).otherwise(F.col(other))
        out[name] = kept.withColumn(other, value).withColumn(key, moved).union(df.filter(pick == 3)).select(*df.columns)
    nobody = tables["customers"].limit(2).withColumn("member_id", F.lit(None).cast("string"))
    out["customers"] = out["customers"].union(nobody.select(*tables["customers"].columns))
    return out


def put(spark, run, tables):
    for name, df in tables.items():
        run.write(df, "silver", name)


def full(tables):
    return rows(wide_view(*[tables[name].drop("ingest_date") for name in SOURCES]))


def test_refreshed_table_is_a_full_build(spark, tables, tmp_path):
    lake, store = PublishedLake(f"{tmp_path}/lake"), WideStore(buckets=16)
    run = lake.begin(spark)
    put(spark, run, tables)
    assert store.refresh(spark, run) == list(range(16))  # never built: all of it
    run.commit(spark)
    assert rows(store.read(spark, lake.opened(spark))) == full(tables)
    now = tables
    for seed in (1, 2):
        before = lake.opened(spark)
        now = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in changed(now, seed).items()}
        run = lake.begin(spark)
        put(spark, run, now)
        assert store.refresh(spark, run)
        run.commit(spark)
        assert rows(store.read(spark, lake.opened(spark))) == full(now)
        assert store.read(spark, before).count() > 0  # the version before is whole


def test_only_touched_buckets_are_written(spark, tables, tmp_path):
    lake, store = PublishedLake(f"{tmp_path}/lake"), WideStore(buckets=64)
    run = lake.begin(spark)
    put(spark, run, tables)
    store.build(spark, run)
    first = run.commit(spark)
    member = tables["loans"].filter("member_id is not null").first()["member_id"]
    run = lake.begin(spark)
    run.write(tables["loans"].withColumn("loan_amount", F.when(F.col("member_id") == member, -1.0).otherwise(F.col("loan_amount"))), "silver", "loans")
    assert len(store.refresh(spark, run)) == 1
    second = run.commit(spark)
    places = lambda v: {k: p for k, p in v.version.places.items() if k.startswith("wide_silver/") and k.split("/")[1].isdigit()}
    assert sum(places(first)[k] != places(second)[k] for k in places(first)) == 1
    assert store.read(spark, second).filter("loan_amount = -1").select("member_id").distinct().count() == 1
    run = lake.begin(spark)
    assert store.refresh(spark, run) == []  # nothing has changed since


def test_members_that_vanish_leave_an_empty_bucket(spark, tables, tmp_path):
    lake, store = PublishedLake(f"{tmp_path}/lake"), WideStore(buckets=4)
    few = {n: df.filter(F.col("member_id").isin("1", "2")) if "member_id" in df.columns else df for n, df in tables.items()}
    run = lake.begin(spark)
    put(spark, run, few)
    store.build(spark, run)
    run.commit(spark)
    run = lake.begin(spark)
    run.write(few["customers"].limit(0), "silver", "customers")
    store.refresh(spark, run)
    assert rows(store.read(spark, run.commit(spark))) == []
    with pytest.raises(ValueError, match="buckets"):
        WideStore(buckets=5).refresh(spark, lake.begin(spark))


def test_catalog_table_follows_the_versions(spark, tables, tmp_path):
    lake, store = PublishedLake(f"{tmp_path}/lake"), WideStore(buckets=8)
    spark.sql("CREATE DATABASE IF NOT EXISTS wide_store_test")
    now = tables
    for _ in range(2):
        run = lake.begin(spark)
        put(spark, run, now)
        store.refresh(spark, run)
        store.register(spark, run.commit(spark), "wide_store_test.wide")
        assert rows(spark.table("wide_store_test.wide").drop("member_bucket")) == full(now)
        now = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in changed(now, 5).items()}


def test_touched_members_and_their_rows(spark, tables):
    assert rows(touched_members(tables, tables)) == []
    paid = tables["repayments"].filter("loan_id is not null").limit(1)
    loan = paid.first()["loan_id"]
    new = {**tables, "repayments": tables["repayments"].filter(F.col("loan_id") != loan)}
    owners = {r[0] for r in tables["loans"].filter(F.col("loan_id").try_cast("bigint") == loan).select("member_id").collect()}
    members = touched_members(tables, new)
    assert {r[0] for r in members.collect()} == owners
    part = wide_view(*[only_members(new, members)[name] for name in SOURCES])
    whole = wide_view(*[new[name] for name in SOURCES]).filter(F.col("member_id").isin(*owners))
    assert rows(part) == rows(whole)
