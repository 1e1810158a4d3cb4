"""The skew join must give the plain join's rows whatever the slices are."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditmill.operators.joins import grid_join, hot_grid, hot_keys, skew_join
from tests.conftest import rows

HOW = {"inner": "inner", "spread": "left", "other": "right"}


def plain(spread, other, keep):
    joined = spread.alias("s").join(other.alias("o"), spread["k"] == other["k"], HOW[keep])
    key = "o.k" if keep == "other" else "s.k"
    return joined.selectExpr(f"{key} as k", "s.a", "o.b")


@pytest.fixture(scope="module")
def frames(spark):
    many = [("hot", i) for i in range(500)] + [("hot", 7)] * 300 + [("warm", i) for i in range(40)]
    many += [("once", 1), ("alone", 1), (None, 1), (None, 2)]
    few = [("hot", "x"), ("hot", "y"), ("warm", "z"), ("once", "u"), ("missing", "v"), (None, "w"), (None, "w")]
    return (
        spark.createDataFrame(many, "k string, a int").repartition(5),
        spark.createDataFrame(few, "k string, b string"),
    )


@pytest.mark.parametrize("keep", HOW)
@pytest.mark.parametrize("rows_per_slice", [1, 10, 100, 1_000_000])
def test_same_rows_as_the_plain_join(frames, keep, rows_per_slice):
    spread, other = frames
    got = skew_join(spread, other, "k", keep, rows_per_slice)
    assert got.columns == ["k", "a", "b"]
    assert rows(got) == rows(plain(spread, other, keep))


def test_hot_keys_and_their_slices(frames):
    spread, _ = frames
    assert rows(hot_keys(spread, "k", 100)) == [("hot", 8)]
    assert rows(hot_keys(spread, "k", 39)) == [("hot", 21), ("warm", 2)]
    assert rows(hot_keys(spread, "k", 1_000_000)) == []


def test_a_hot_key_spreads_over_tasks(spark, frames):
    """No task of the join receives more than a small part of the hot key."""
    spread, other = frames
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = skew_join(spread, other, "k", "inner", 10).filter("k = 'hot'")
        sizes = got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert sum(sizes) == 1600
        assert max(sizes) < 1600 / 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_both_sides_hot(spark):
    spread = spark.createDataFrame([("h", i) for i in range(60)], "k string, a int")
    other = spark.createDataFrame([("h", str(i)) for i in range(30)], "k string, b string")
    assert skew_join(spread, other, "k", "inner", 7).distinct().count() == 60 * 30


def test_frequent_keys_counted_elsewhere(frames):
    spread, other = frames
    counted = spread.select("k").union(spread.select("k"))
    assert hot_keys(counted, "k", 100).count() == 1
    for keep in HOW:
        assert rows(skew_join(spread, other, "k", keep, 100, counted)) == rows(plain(spread, other, keep))


def test_empty_sides(spark, frames):
    spread, other = frames
    for keep in HOW:
        assert rows(skew_join(spread.limit(0), other, "k", keep, 1)) == rows(plain(spread.limit(0), other, keep))
        assert rows(skew_join(spread, other.limit(0), "k", keep, 1)) == rows(plain(spread, other.limit(0), keep))


some_keys = st.sampled_from(["a", "b", "c", None])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(some_keys, st.integers(0, 3)), max_size=25),
    st.lists(st.tuples(some_keys, st.sampled_from("xyz")), max_size=8),
    st.integers(1, 6),
    st.sampled_from(list(HOW)),
)
def test_any_frames(spark, left, right, rows_per_slice, keep):
    spread = spark.createDataFrame(left, "k string, a int")
    other = spark.createDataFrame(right, "k string, b string")
    assert rows(skew_join(spread, other, "k", keep, rows_per_slice)) == rows(plain(spread, other, keep))


@pytest.mark.parametrize("keep", ["inner", "spread", "other"])
@pytest.mark.parametrize("rows_per_slice", [20, 1_000_000])
def test_stored_lists_of_frequent_keys(frames, tmp_path, spark, keep, rows_per_slice):
    spread, other = frames
    hot_keys(spread, "k", rows_per_slice).write.parquet(f"{tmp_path}/hot")
    stored = spark.read.parquet(f"{tmp_path}/hot")
    got = skew_join(spread, other, "k", keep, rows_per_slice, hot=stored, deal_by=("k", spread.columns[1]))
    assert rows(got) == rows(plain(spread, other, keep))


def test_stored_list_reads_the_large_side_once_and_selected_columns_only(spark, tmp_path):
    large = spark.range(3000).selectExpr("if(id < 2000, 1, id) AS k", "id AS v", "cast(id AS string) AS unused")
    large.write.parquet(f"{tmp_path}/large")
    large = spark.read.parquet(f"{tmp_path}/large")
    hot_keys(large, "k", 100).write.parquet(f"{tmp_path}/hot")
    other = spark.createDataFrame([(1, "a"), (2500, "b")], "k bigint, w string")
    hot = spark.read.parquet(f"{tmp_path}/hot")
    joined = skew_join(large, other, "k", "inner", 100, hot=hot, deal_by=("k", "v")).select("k", "v", "w")
    assert joined.count() == 2001
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # folder names are cut where they are long: scans are known by their columns
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("v#" in line for line in scans) == 1 and not any("unused" in line for line in scans)


# --- keys that are frequent on both sides ------------------------------------------
JOINS = ["inner", "left", "right", "full"]


def plain_grid(left, right, how):
    joined = left.join(right.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"), how)
    return joined.selectExpr("coalesce(k, k2) as k", "a", "b")


@pytest.fixture(scope="module")
def sides(spark):
    left = [("hot", i) for i in range(120)] + [("hot", 7)] * 60 + [("left", i) for i in range(50)] + [("one", 1), ("alone", 1)]
    right = [("hot", str(i)) for i in range(70)] + [("right", str(i)) for i in range(40)] + [("left", "x"), ("one", "y"), ("lost", "z")]
    left += [("right", 1), ("right", 2), (None, 1), (None, 2), (None, 2)]
    right += [(None, "n"), (None, "n")]
    return (
        spark.createDataFrame(left, "k string, a int").repartition(4),
        spark.createDataFrame(right, "k string, b string").repartition(3),
    )


@pytest.mark.parametrize("how", JOINS)
@pytest.mark.parametrize("rows_per_slice", [1, 12, 45, 1_000_000])
def test_grid_gives_the_rows_of_the_plain_join(sides, how, rows_per_slice):
    left, right = sides
    got = grid_join(left, right, "k", how, rows_per_slice)
    assert got.columns == ["k", "a", "b"]
    assert rows(got) == rows(plain_grid(left, right, how))


@pytest.mark.parametrize("how", JOINS)
def test_grid_with_empty_sides(sides, how):
    left, right = sides
    assert rows(grid_join(left.limit(0), right, "k", how, 10)) == rows(plain_grid(left.limit(0), right, how))
    assert rows(grid_join(left, right.limit(0), "k", how, 10)) == rows(plain_grid(left, right.limit(0), how))


def test_cells_of_the_grid(sides):
    left, right = sides
    assert rows(hot_grid(left, right, "k", 25)) == [("hot", 8, 3), ("left", 2, 1), ("right", 1, 2)]
    assert rows(hot_grid(left, right, "k", 1000)) == []


@pytest.mark.parametrize("rows_per_slice", [20, 1_000_000])
@pytest.mark.parametrize("how", JOINS)
def test_grid_with_stored_lists(spark, sides, tmp_path, how, rows_per_slice):
    left, right = sides
    stored = []
    for name, side in (("left", left), ("right", right)):
        hot_keys(side, "k", rows_per_slice).write.parquet(f"{tmp_path}/{name}")
        stored.append(spark.read.parquet(f"{tmp_path}/{name}"))
    got = grid_join(left, right, "k", how, rows_per_slice, hot_left=stored[0], hot_right=stored[1], deal_left=("a",), deal_right=("b",))
    assert rows(got) == rows(plain_grid(left, right, how))
    if rows_per_slice > 1000:  # nothing frequent: no more than the plain join
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and plan.count("Join") == 1


def test_no_task_holds_a_key_that_is_frequent_on_both_sides(spark):
    """Each task sees a slice of either side: neither all 2,000 rows of one nor all 900 of the other."""
    left = spark.range(2000).selectExpr("'h' AS k", "id AS a").repartition(6)
    right = spark.range(900).selectExpr("'h' AS k", "id AS b").repartition(6)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        pairs = grid_join(left, right, "k", "inner", 100)
        seen = pairs.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")
        ).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r.n for r in seen) == 2000 * 900
    assert max(r.n for r in seen) < 2000 * 900 / 12
    assert max(r.a for r in seen) < 2000 and max(r.b for r in seen) < 900


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(some_keys, st.integers(0, 3)), max_size=20),
    st.lists(st.tuples(some_keys, st.sampled_from("xyz")), max_size=20),
    st.integers(1, 5),
    st.sampled_from(JOINS),
)
def test_grid_over_any_frames(spark, left, right, rows_per_slice, how):
    left, right = spark.createDataFrame(left, "k string, a int"), spark.createDataFrame(right, "k string, b string")
    assert rows(grid_join(left, right, "k", how, rows_per_slice)) == rows(plain_grid(left, right, how))
