from decimal import Decimal

from pyspark.sql import functions as F

from creditmill.operators.tally import ROW_COUNT, repeat_rows, tally_rows, times
from tests.conftest import rows


def test_tally_counts_rows_null_included(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, None), (None, None), ("b", 1)], "k string, v int")
    assert rows(tally_rows(df)) == [("a", 1, 2), ("b", 1, 1), (None, None, 2)]


def test_tally_of_a_tally_adds_up(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, v int")
    assert rows(tally_rows(tally_rows(df), ["k"])) == [("a", 3)]


def test_repeat_is_the_inverse(spark):
    df = spark.createDataFrame([("a", 1)] * 25 + [("b", 2)] * 3 + [("c", None)], "k string, v int")
    for block in (1, 4, 25, 10_000):
        assert rows(repeat_rows(tally_rows(df), block)) == rows(df)


def test_products_may_exceed_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**11,)], "n bigint")
    assert df.select(times(F.col("n"), F.col("n")).alias(ROW_COUNT)).first()[0] == Decimal(9 * 10**22)
