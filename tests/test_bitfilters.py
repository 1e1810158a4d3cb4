"""Filters never change a result, and keep most rows out of the exact way."""

import pytest
from pyspark.sql import functions as F

from creditmill.operators import bitfilters
from creditmill.operators.bitfilters import duplicate_candidates, duplicate_keys_filtered, exclude_keys_filtered, might_contain
from creditmill.operators.quality import duplicate_keys, exclude_keys
from tests.conftest import rows


@pytest.mark.parametrize("words, hashes", [(1, 1), (1, 3), (64, 2), (4096, 3)])
@pytest.mark.parametrize("listed", [["a", "b", "7"], ["a", None], [], [None], ["zz"] * 5])
@pytest.mark.parametrize("null_aware", [True, False])
def test_exclusion_with_a_filter_is_exclusion(spark, words, hashes, listed, null_aware):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(["a", "b", None, "c", "a", *map(str, range(30))])], "k string, v int")
    keys = spark.createDataFrame([(v,) for v in listed], "k string")
    got = exclude_keys_filtered(df, keys, "k", null_aware, words, hashes)
    assert got.columns == df.columns
    assert rows(got) == rows(exclude_keys(df, keys, "k", null_aware))


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(0, 20_000).selectExpr("id * 3 AS k")
    test = might_contain(listed, "k", words=4096)  # 262,144 bits
    found = spark.range(0, 60_000).select((F.col("id") % 3 == 0).alias("listed"), test(F.col("id")).alias("maybe"))
    counts = {(r.listed, r.maybe): r["count"] for r in found.groupBy("listed", "maybe").count().collect()}
    assert (True, False) not in counts and counts[True, True] == 20_000
    assert counts[False, True] < 40_000 * 0.02


def test_rows_that_the_filter_rules_out_are_not_shuffled(spark, tmp_path):
    spark.range(100_000).selectExpr("id AS k", "repeat('x', 50) AS wide").repartition(4).write.parquet(f"{tmp_path}/rows")
    spark.range(0, 100_000, 50).selectExpr("id AS k").write.parquet(f"{tmp_path}/listed")
    df, listed = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/listed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = exclude_keys_filtered(df, listed, "k")
        assert done.count() == 98_000
        plan = done._jdf.queryExecution().executedPlan()
        assert plan.toString().count("LeftAnti") >= 1
        maybe = df.filter(might_contain(listed, "k")(F.col("k"))).count()  # what reaches the exchange of the anti join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 2_000 <= maybe < 2_100


@pytest.mark.parametrize("parts", [1, 7])
def test_duplicates_with_a_filter_are_duplicates(spark, monkeypatch, parts):
    monkeypatch.setattr(bitfilters, "ROW_WORDS", 8)
    values = [(i % 700, str(i % 3)) for i in range(1500)] + [(None, "x"), (None, "x"), (None, None), (5000, "1")]
    df = spark.createDataFrame(values, "a int, b string").repartition(parts)
    for words in (8, 64, 1024):
        assert rows(duplicate_keys_filtered(df, "a", "b", words=words)) == rows(duplicate_keys(df, "a", "b"))
        assert rows(duplicate_keys_filtered(df, "b", words=words)) == rows(duplicate_keys(df, "b"))
    assert rows(duplicate_keys_filtered(df.limit(0), "a")) == []
    single = spark.range(50).repartition(parts)
    assert rows(duplicate_keys_filtered(single, "id")) == []


def test_single_keys_stay_out_of_the_count(spark):
    df = spark.range(60_000).selectExpr("concat('key ', if(id < 59000, id, id - 59000)) AS k").repartition(8)
    kept = duplicate_candidates(df, "k", words=1 << 14)  # 1,048,576 cells
    assert kept.select("k").distinct().count() < 1_000 + 59_000 * 0.1
    assert rows(duplicate_keys_filtered(df, "k", words=1 << 14)) == rows(duplicate_keys(df, "k"))
    assert duplicate_keys_filtered(df, "k").count() == 1_000
