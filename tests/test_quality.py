import pytest
from pyspark.sql import functions as F

from creditmill.operators import quality as q
from creditmill.plans.quarantine import find_quarantined, without_quarantined
from tests.conftest import rows


@pytest.fixture
def left(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, v int")


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


@pytest.mark.parametrize(
    "listed, kept",
    [
        ((), [("a", 1), ("b", 2), ("b", 3), (None, 4)]),
        (("b",), [("a", 1)]),
        (("b", "b", "zz"), [("a", 1)]),
        (("b", None), []),
        ((None,), []),
    ],
)
def test_exclude_follows_not_in(spark, left, listed, kept):
    bad = keys(spark, *listed)
    expected = sorted(kept, key=repr)
    assert rows(q.exclude_keys(left, bad, "k")) == expected
    literal = spark.sql("select * from {l} where k not in (select k from {b})", l=left, b=bad)
    assert rows(literal) == expected


def test_exclude_without_null_awareness_ignores_nulls_in_the_list(spark, left):
    assert rows(q.exclude_keys(left, keys(spark, "b", None), "k", null_aware=False)) == [("a", 1)]
    assert len(rows(q.exclude_keys(left, keys(spark, None), "k", null_aware=False))) == 4


def test_exclude_when_the_list_comes_from_the_same_frame(spark, left):
    assert rows(q.exclude_keys(left, q.duplicate_keys(left, "k"), "k")) == [("a", 1)]


def test_duplicate_keys_counts_null_as_a_key(spark):
    df = keys(spark, "a", "b", "b", None, None)
    assert rows(q.duplicate_keys(df, "k")) == [("b",), (None,)]


def test_union_distinct_keys(spark):
    assert rows(q.union_distinct_keys(keys(spark, "a", "b"), keys(spark, "b"), keys(spark, None, None))) == [
        ("a",),
        ("b",),
        (None,),
    ]


def test_quarantine_leaves_unique_keys(spark):
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "member_id string, v int")
    two = spark.createDataFrame([("b", 1), ("b", 2), ("c", 1), ("d", 1)], "member_id string, w int")
    found = find_quarantined({"one": one, "two": two})
    assert rows(found.per_table["one"]) == [("a",)]
    assert rows(found.members) == [("a",), ("b",)]
    clean = without_quarantined({"one": one, "two": two}, found.members)
    assert rows(clean["one"]) == [("c", 1)]
    assert rows(clean["two"]) == [("c", 1), ("d", 1)]
    assert all(q.duplicate_keys(df, "member_id").count() == 0 for df in clean.values())


def test_profile_counts(spark, left):
    got = q.profile_counts(left, {"big": F.col("v") > 2, "no_key": F.col("k").isNull()}).first().asDict()
    assert got == {"row_count": 4, "k_count": 3, "v_count": 4, "big": 2, "no_key": 1}


def test_value_frequencies_break_ties_by_value(spark):
    df = keys(spark, "b", "a", "c", "c", None)
    assert [tuple(r) for r in q.value_frequencies(df, "k").collect()] == [
        ("c", 2),
        (None, 1),
        ("a", 1),
        ("b", 1),
    ]


def test_distinct_values(spark, left):
    assert rows(q.distinct_values(left, "k")) == [("a",), ("b",), (None,)]


def test_prefix_is_literal(spark):
    df = keys(spark, "e4c1", "e4%1", "xe4c")
    assert rows(q.rows_with_prefix(df, "k", "e4c")) == [("e4c1",)]
    assert rows(q.rows_with_prefix(df, "k", "e4%")) == [("e4%1",)]


def test_preview(spark, left):
    assert [r.v for r in q.preview(left, 2, F.desc("v")).collect()] == [4, 3]
