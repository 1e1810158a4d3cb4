"""Published versions: what readers see while runs succeed, fail and race."""

import pytest

from checks.fixtures import BY_ENTITY, fixture
from creditmill.plans import batch
from creditmill.plans.published import PublishedLake
from creditmill.sources.versions import Conflict, expire, numbers, publish, snapshot
from tests.conftest import rows


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def value(spark, lake, name="t"):
    return [r[0] for r in rows(lake.opened(spark).read(spark, "zone", name))]


@pytest.fixture()
def lake(tmp_path):
    return PublishedLake(f"{tmp_path}/lake")


def put(spark, lake, **tables):
    run = lake.begin(spark)
    for name, v in tables.items():
        run.write(frame(spark, v), "zone", name)
    return run.commit(spark)


def test_tables_change_together_and_stay_otherwise(spark, lake):
    put(spark, lake, t=1, u=1)
    put(spark, lake, t=2)
    assert (value(spark, lake), value(spark, lake, "u")) == ([2], [1])
    assert lake.opened(spark).version.number == 2
    assert [r[0] for r in rows(lake.opened(spark, 1).read(spark, "zone", "t"))] == [1]


def test_a_run_sees_its_own_tables_and_readers_do_not(spark, lake):
    put(spark, lake, t=1, u=5)
    reader, run = lake.opened(spark), lake.begin(spark)
    run.write(frame(spark, 2), "zone", "t")
    assert rows(run.read(spark, "zone", "t")) == [(2,)] and rows(run.read(spark, "zone", "u")) == [(5,)]
    run.write(run.read(spark, "zone", "t").selectExpr("v + 1 AS v"), "zone", "t")  # over itself
    assert rows(run.read(spark, "zone", "t")) == [(3,)]
    assert value(spark, lake) == [1] and rows(reader.read(spark, "zone", "t")) == [(1,)]
    run.commit(spark)
    assert value(spark, lake) == [3] and rows(reader.read(spark, "zone", "t")) == [(1,)]  # pinned


def test_a_failing_stage_leaves_the_published_tables_whole(spark, lake, sf_dir):
    raw = {e: fixture(spark, sf_dir, e) for e in BY_ENTITY}
    run = lake.begin(spark)
    batch.build_silver(spark, run, raw, "2024-01-01")
    run.commit(spark)
    before = {n: rows(lake.opened(spark).read(spark, "silver", n)) for n in ("customers", "loans")}
    broken = {**raw, "repayments": raw["repayments"].withColumn("loan_id", raw["repayments"].loan_id + _failing(spark))}
    changed = {**broken, "loans": raw["loans"].limit(5)}
    with pytest.raises(Exception, match="no such payment"):
        batch.build_silver(spark, lake.begin(spark), changed, "2024-01-01")
    assert {n: rows(lake.opened(spark).read(spark, "silver", n)) for n in before} == before
    assert numbers(spark, lake.root) == [1]


def _failing(spark):
    from pyspark.sql import functions as F

    return F.raise_error(F.lit("no such payment")).cast("bigint")


def test_two_runs_cannot_both_publish(spark, lake):
    put(spark, lake, t=1)
    one, two = lake.begin(spark), lake.begin(spark)
    one.write(frame(spark, 2), "zone", "t")
    two.write(frame(spark, 3), "zone", "t")
    one.commit(spark)
    with pytest.raises(Conflict):
        two.commit(spark)
    assert value(spark, lake) == [2] and numbers(spark, lake.root) == [1, 2]


def test_nothing_published_and_unknown_versions(spark, lake):
    assert snapshot(spark, lake.root).number == 0 and numbers(spark, lake.root) == []
    with pytest.raises(ValueError, match="no version published"):
        lake.opened(spark).read(spark, "zone", "t")
    with pytest.raises(ValueError, match="no version 7"):
        lake.opened(spark, 7)
    with pytest.raises(ValueError, match="read-only"):
        lake.opened(spark).write(frame(spark, 1), "zone", "t")
    with pytest.raises(ValueError, match="read-only"):
        lake.commit(spark)


def test_old_versions_expire(spark, lake, tmp_path):
    for v in range(4):
        put(spark, lake, t=v, **({"u": 9} if v == 0 else {}))
    gone = expire(spark, lake.root, keep=2)
    assert len(gone) == 2 and all(g.startswith("zone/t/") for g in gone)
    assert numbers(spark, lake.root) == [3, 4]
    assert value(spark, lake) == [3] and value(spark, lake, "u") == [9]
    assert not any((tmp_path / "lake" / g).exists() for g in gone)
    assert expire(spark, lake.root, keep=2) == []
    put(spark, lake, t=7)
    assert lake.opened(spark).version.number == 5


def test_publishing_writes_what_is_read(spark, tmp_path):
    new = publish(spark, f"{tmp_path}/l", snapshot(spark, f"{tmp_path}/l"), {"zone/ü name": "zone/ü name/1"})
    assert snapshot(spark, f"{tmp_path}/l") == new
