"""Shape of the physical plans: what must not appear in them, and what must."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES, shared_lake
from creditmill.operators import quality
from creditmill.plans import score


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Queries whose feature is a limit: the first rows in an order, the most frequent values.
TOP_ROWS = ("preview_loans", "top_parts", "top_members")


@pytest.fixture
def no_broadcast(spark):
    """As with tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_no_python_no_limit_in_any_plan(spark, sf_dir, no_broadcast, name):
    if name in ("run_from_files", "member_scores"):  # made of the stages checked here
        return
    plan = physical(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    assert not re.search(r"Python|Pandas|ArrowEval", plan)
    assert name in TOP_ROWS or not re.search(r"Limit|TakeOrdered|Sample", plan)


def test_exclusion_is_not_a_forced_broadcast(spark, sf_dir, no_broadcast):
    lake = shared_lake(spark, sf_dir)
    rows, bad = lake.read(spark, "silver", "customers"), lake.read(spark, "quarantine", "members")
    ours = physical(quality.exclude_keys(rows, bad, "member_id"))
    assert "SortMergeJoin" in ours and "BroadcastHashJoin" not in ours
    literal = spark.sql("select * from {r} where member_id not in (select member_id from {b})", r=rows, b=bad)
    assert "BroadcastHashJoin" in physical(literal)


def test_only_bounded_frames_are_broadcast(spark, sf_dir, no_broadcast):
    """With Spark's own broadcasts off, only the search for frequent keys still uses one."""
    lake = shared_lake(spark, sf_dir)
    scored = score.score_members(
        lake.read(spark, "gold", "customers"),
        lake.read(spark, "silver", "loans"),
        lake.read(spark, "silver", "repayments"),
        lake.read(spark, "gold", "delinquent_members"),
        lake.read(spark, "gold", "record_enquiry_detail"),
    )
    joins = [line for line in physical(scored).splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("_hot_key" in line or "_bucket" in line for line in joins)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    lake = shared_lake(spark, sf_dir)
    loans = lake.read(spark, "silver", "loans")
    plan = physical(quality.rows_with_prefix(loans, "member_id", "10").select("loan_id"))
    assert "StringStartsWith(member_id,10)" in plan
    assert "ReadSchema: struct<loan_id:string,member_id:string>" in plan
    payments = score.payment_points(lake.read(spark, "silver", "repayments"), loans)
    assert "loan_title" not in physical(payments)


def test_income_test_runs_before_the_distinct(spark, sf_dir):
    plan = physical(QUERIES["customers_silver"](spark, sf_dir))
    exchange = plan.index("Exchange hashpartitioning")
    assert "atleastnnonnulls" in plan[exchange:]
    assert "atleastnnonnulls" not in plan[:exchange]


def test_mean_reads_the_shuffle_of_the_distinct(spark, sf_dir):
    """One write of the customers table costs one shuffle of its rows, the mean included."""
    df = QUERIES["customers_silver"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in physical(df)


def test_profiles_take_one_pass(spark, sf_dir):
    df = QUERIES["profile_repayments"](spark, sf_dir)
    assert physical(df).count("FileScan") == 1


def test_counts_are_partial_before_the_shuffle(spark, sf_dir):
    df = quality.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")
    plan = physical(df)
    assert "partial_count" in plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1


def test_skew_join_keeps_literal_columns_only(spark):
    df = score.payment_points(
        spark.createDataFrame([(1, 1.0, 1.0)], "loan_id bigint, last_payment_amount double, total_payment_received double"),
        spark.createDataFrame(
            [("1", "m", 1.0, 1.0)],
            "loan_id string, member_id string, monthly_installment double, funded_amount double",
        ),
        with_loan=("loan_id",),
    )
    assert df.columns == ["member_id", "loan_id", "last_payment_pts", "total_payment_pts"]
    assert df.filter(F.col("loan_id") == "1").count() == 1
