"""Profiles within their stated errors, however the rows are cut, and what counts as drift."""

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from creditmill.operators.bitfilters import drop_exact_duplicates_filtered
from creditmill.operators.profiles import (
    DISTINCT_ERROR, QUANTILES, RANK_ERROR, count_min, drift_report, exact_percentiles, merge_counts, merge_profiles, profile, profile_report, top_values,
)
from creditmill.operators.quality import value_frequencies
from tests.conftest import rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(30_000).selectExpr(
        "id", "cast(if(id % 10 = 0, null, pow(id % 5000, 1.5)) as double) AS amount", "concat('c', id % 900) AS code",
        "if(id % 4 = 0, null, id % 3) AS few", "cast(null as double) AS nothing",
    ).repartition(6).cache()


def report(profiles):
    return {r["column"]: r for r in profile_report(profiles).collect()}


def check(found, table):
    n = table.count()
    for name in table.columns:
        exact = table.agg(F.count_if(F.col(name).isNull()), F.countDistinct(name), F.min(name).cast("string"), F.max(name).cast("string")).first()
        r = found[name]
        assert (r.rows, r.nulls, r.low, r.high) == (n, exact[0], exact[2], exact[3])
        assert abs(r.distinct_values - exact[1]) <= DISTINCT_ERROR * exact[1]
    for name in ("id", "amount", "few"):
        known = n - found[name].nulls
        for share, value in found[name].quantiles.items():
            below, upto = table.agg(F.count_if(F.col(name) < value), F.count_if(F.col(name) <= value)).first()
            assert below / known - RANK_ERROR <= share <= upto / known + RANK_ERROR
    assert found["nothing"].quantiles is None and found["code"].quantiles is None and len(found["id"].quantiles) == len(QUANTILES)


def test_profile_within_its_errors(table):
    check(report(profile(table)), table)


def test_parts_merge_into_the_whole(table):
    parts = [profile(table.filter(F.col("id") % 3 == k)) for k in range(3)]
    check(report(merge_profiles(*parts)), table)
    again = merge_profiles(merge_profiles(*parts[:2]), parts[2])
    check(report(again), table)


@pytest.mark.parametrize("cells, rest", [(8, 2000), (4096, 1 << 16)])
def test_exact_percentiles_equal_percentile(spark, cells, rest):
    columns = {
        "plain": "cast(id * 7919 % 10007 as int)", "skewed": "exp(id % 30)", "few": "if(id % 4 = 0, null, id % 3)", "one": "5.5D", "none": "cast(null as double)",
        "not_numbers": "if(id % 5 = 0, double('nan'), -id * 0.1)", "ends": "case id % 7 when 0 then double('-inf') when 1 then double('inf') when 2 then 1.7e308 when 3 then -1.7e308 else id end",
        "tiny": "if(id % 2 = 0, 4.9e-324D, 1e-323D)", "a.b": "-id", "wide": "9007199254740993 + id",
    }
    df = spark.range(3001).selectExpr(*[f"{x} AS `{c}`" for c, x in columns.items()]).repartition(5)
    shares = (0.0, 0.1, 0.3337, 0.49, 0.51, 1.0)
    found = exact_percentiles(df, list(columns), shares, cells, rest)
    number = lambda c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    want = df.agg(*[F.percentile(number(c), F.array(*map(F.lit, shares))) for c in columns]).first()
    assert found == {c: list(w) if w else [None] * len(shares) for c, w in zip(columns, want, strict=True)}
    some = ["plain", "few", "tiny", "wide"]
    assert exact_percentiles(df, some, shares, 64, 0) == {c: found[c] for c in some}
    assert exact_percentiles(df.limit(0), ["plain"], (0.5,)) == {"plain": [None]}


def test_merged_profile_holds_no_values_of_a_column_in_one_task(spark, sf_dir):
    plan = QUERIES["merged_profile"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


def test_profiles_are_stored_and_merged_later(spark, table, tmp_path):
    for k in range(2):
        profile(table.filter(F.col("id") % 2 == k)).write.parquet(f"{tmp_path}/{k}")
    check(report(merge_profiles(*[spark.read.parquet(f"{tmp_path}/{k}") for k in range(2)])), table)


def test_empty_table(table):
    r = report(profile(table.limit(0)))
    assert {(x.rows, x.nulls, x.low, x.distinct_values, x.quantiles) for x in r.values()} == {(0, 0, None, 0, None)}
    assert report(merge_profiles(profile(table.limit(0)), profile(table)))["id"].rows == 30_000


def test_drift(table):
    old = profile(table)
    new = table.withColumn("amount", F.col("amount") * 2).withColumn("code", F.concat("code", F.lit("-"), F.col("few").cast("string")))
    new = new.withColumn("few", F.when(F.col("id") % 2 == 0, F.col("few"))).drop("nothing").withColumn("more", F.lit(1))
    found = {r["column"]: r for r in drift_report(old, profile(new)).collect()}
    states = {c: r.state for c, r in found.items()}
    assert states == {"id": "same", "amount": "changed", "code": "changed", "few": "changed", "nothing": "removed", "more": "added"}
    assert found["amount"].ranks_by > 0.1 and found["few"].nulls_by > 0.2 and abs(found["code"].distinct_by + 0.25) < DISTINCT_ERROR
    assert {r.state for r in drift_report(old, old).collect()} == {"same"}
    assert {r.state for r in drift_report(old, profile(table.filter("id % 2 = 1 or id % 10 in (0, 4, 8)"))).collect()} - {"same", "changed"} == set()


@pytest.mark.parametrize("k", [1, 5, 40, 10_000])
@pytest.mark.parametrize("width, depth", [(64, 1), (256, 3), (1 << 12, 4)])
def test_top_values_are_exact(spark, k, width, depth):
    df = spark.range(20_000).selectExpr("if(id % 17 = 0, null, concat('v', cast(pow(id % 4000, 0.5) as int) * (id % 7))) AS v")
    plain = [tuple(r) for r in value_frequencies(df, "v").limit(k).collect()]
    assert [tuple(r) for r in top_values(df, "v", k, width, depth).collect()] == plain


def test_top_values_of_many_single_ones_count_few(spark):
    df = spark.range(200_000).selectExpr("if(id % 5 = 0, id % 8, id) AS v")
    found = top_values(df, "v", 8)
    assert rows(found) == rows(value_frequencies(df, "v").limit(8))
    assert top_values(df.limit(0), "v", 3).collect() == []


def test_sketches_merge(spark):
    df = spark.range(5000).selectExpr("id % 70 AS v")
    parts = [count_min(df.filter(F.col("v") % 3 == k), "v", 128, 2) for k in range(3)]
    merged = merge_counts(*parts)
    assert rows(merged) == rows(count_min(df, "v", 128, 2))
    assert rows(top_values(df, "v", 9, 128, 2, merged)) == rows(value_frequencies(df, "v").limit(9))


def test_distinct_rows_behind_a_filter(spark):
    values = [(i % 40, None if i % 5 else "x") for i in range(100)] + [(500, "y"), (None, None), (None, None)]
    df = spark.createDataFrame(values, "`a.b` int, c string").repartition(3)
    assert rows(drop_exact_duplicates_filtered(df)) == rows(df.distinct())
    assert rows(drop_exact_duplicates_filtered(df.limit(0))) == []
