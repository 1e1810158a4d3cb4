"""One row per branch of every column expression."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditmill.functions import cleaning as C
from creditmill.functions import points as P
from creditmill.params import LOAN_PURPOSES, ScoreParams


def evaluate(spark, ddl, cases, expression):
    """The expression's value for each input row, in order."""
    df = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], f"_i int, {ddl}")
    value = expression(*[F.col(c) for c in df.columns[1:]])
    return [r.value for r in df.select("_i", value.alias("value")).orderBy("_i").collect()]


def check(spark, ddl, expression, table):
    got = evaluate(spark, ddl, [case for case, _ in table], expression)
    assert got == [want for _, want in table]


def test_number_from_text(spark):
    check(
        spark,
        "x string",
        C.number_from_text,
        [
            (("10",), 10.0),
            (("10.25",), 10.25),
            (("12000000",), 12000000.0),
            (("0.0001",), 0.0001),
            (("-5",), None),
            (("+5",), None),
            (("1e5",), None),
            (("5.",), None),
            ((" 5",), None),
            (("unknown",), None),
            (("",), None),
            ((None,), None),
        ],
    )


def test_plain_number(spark):
    check(
        spark,
        "x double",
        C.plain_number,
        [
            ((1.5,), 1.5),
            ((0.0,), 0.0),
            ((2.5e7,), 2.5e7),
            ((-0.5,), None),
            ((float("nan"),), None),
            ((float("inf"),), None),
            ((None,), None),
        ],
    )


def test_digits_as_int(spark):
    check(
        spark,
        "x string",
        C.digits_as_int,
        [
            (("10+ years",), 10),
            (("< 1 year",), 1),
            (("3 years",), 3),
            (("n/a",), None),
            (("",), None),
            ((None,), None),
            (("99999999999",), None),
        ],
    )


def test_shortened_code(spark):
    check(
        spark,
        "x string",
        lambda x: C.shortened_code(x, 2, "NA"),
        [(("CA",), "CA"), (("N",), "N"), (("California",), "NA"), (("",), ""), ((None,), None)],
    )


def test_term_in_years(spark):
    check(
        spark,
        "x string",
        C.term_in_years,
        [
            ((" 36 months",), 3),
            (("60 months",), 5),
            (("30 months",), 2),
            (("long",), None),
            (("36 weeks",), None),
            ((None,), None),
        ],
    )


def test_in_vocabulary(spark):
    check(
        spark,
        "x string",
        lambda x: C.in_vocabulary(x, LOAN_PURPOSES, "other"),
        [(("car",), "car"), (("yacht",), "other"), (("Car",), "other"), ((None,), "other"), (("other",), "other")],
    )


def test_repaired_total(spark):
    check(
        spark,
        "t double, p double, i double, f double",
        C.repaired_total,
        [
            ((0.0, 10.0, 2.0, 1.0), 13.0),
            ((0.0, 0.0, 2.0, 1.0), 0.0),
            ((5.0, 10.0, 2.0, 1.0), 5.0),
            ((0.0, 10.0, None, 1.0), None),
            ((0.0, None, 2.0, 1.0), 0.0),
            ((None, 10.0, 2.0, 1.0), None),
        ],
    )


def test_without_sentinel(spark):
    check(
        spark,
        "x string",
        lambda x: C.without_sentinel(x, "0.0"),
        [(("0.0",), None), ((None,), None), (("Jan-2019",), "Jan-2019"), (("0",), "0")],
    )


def test_whole_or_zero(spark):
    check(
        spark,
        "x double",
        C.whole_or_zero,
        [((2.9,), 2), ((-2.9,), -2), ((None,), 0), ((float("nan"),), 0), ((1e300,), 2**31 - 1), ((3e9,), 2**31 - 1), ((-3e9,), -(2**31)), ((-(2.0**31),), -(2**31))],
    )


def test_last_payment_points(spark):
    check(
        spark,
        "x double, y double",
        P.last_payment_points,
        [
            ((10.0, 100.0), 100),
            ((50.0, 100.0), 100),
            ((99.0, 100.0), 100),
            ((100.0, 100.0), 500),
            ((101.0, 100.0), 650),
            ((150.0, 100.0), 650),
            ((150.5, 100.0), 800),
            ((None, 100.0), 0),
            ((100.0, None), 0),
        ],
    )


def test_payment_bands_below_an_instalment_are_parameters(spark):
    params = ScoreParams(partial_payment=250)
    check(
        spark,
        "x double, y double",
        lambda x, y: P.last_payment_points(x, y, params),
        [((10.0, 100.0), 100), ((50.0, 100.0), 250), ((99.0, 100.0), 250), ((100.0, 100.0), 500)],
    )


def test_total_payment_points(spark):
    check(
        spark,
        "x double, y double",
        P.total_payment_points,
        [
            ((50.0, 100.0), 650),
            ((49.0, 100.0), 500),
            ((0.0, 100.0), 0),
            ((None, 100.0), 0),
            ((0.0, None), 0),
            ((10.0, None), None),
            ((-1.0, 100.0), None),
        ],
    )


@pytest.mark.parametrize("unknown", [0, 100])
def test_count_band_points(spark, unknown):
    check(
        spark,
        "x int",
        lambda x: P.count_band_points(x, unknown),
        [
            ((0,), 800),
            ((1,), 250),
            ((2,), 250),
            ((3,), 100),
            ((5,), 100),
            ((6,), unknown),
            ((None,), unknown),
            ((-1,), None),
        ],
    )


def test_loan_status_points(spark):
    check(
        spark,
        "x string",
        P.loan_status_points,
        [
            (("Fully Paid",), 800),
            (("Does not meet the credit policy. Status:Fully Paid",), 800),
            (("CURRENT",), 500),
            (("In Grace Period",), 250),
            (("Late (16-30 days)",), 100),
            (("Late (31-120 days)",), 100),
            (("Charged Off",), 0),
            (("Default",), 0),
            ((None,), 0),
        ],
    )


def test_home_points(spark):
    check(
        spark,
        "x string",
        P.home_points,
        [
            (("OWN",), 800),
            (("rent",), 500),
            (("MORTGAGE",), 250),
            (("any",), 100),
            ((None,), 100),
            (("OTHER",), None),
            (("OWN ",), None),
        ],
    )


def test_credit_limit_points(spark):
    check(
        spark,
        "x double, y double",
        P.credit_limit_points,
        [
            ((10.0, 100.0), 800),
            ((20.0, 100.0), 650),
            ((30.0, 100.0), 500),
            ((50.0, 100.0), 250),
            ((70.0, 100.0), 100),
            ((70.5, 100.0), 0),
            ((None, 100.0), 0),
            ((10.0, None), 0),
        ],
    )


def test_grade_points(spark):
    bases = {"A": 800, "B": 650, "C": 500, "D": 250, "E": 100}
    steps = {1: "1", 2: "0.95", 3: "0.9", 4: "0.85", 5: "0.8"}
    table = [((g, f"{g}{n}"), b * Decimal(s)) for g, b in bases.items() for n, s in steps.items()]
    table += [
        (("F", "F1"), Decimal(0)),
        (("G", None), Decimal(0)),
        (("A", "B1"), None),
        (("A", "A6"), None),
        (("A", "A10"), None),
        ((None, "A1"), None),
        (("A", None), None),
    ]
    check(spark, "x string, y string", P.grade_points, table)


def test_final_grade(spark):
    cut = Decimal
    check(
        spark,
        "x decimal(16,3)",
        P.final_grade,
        [
            ((cut("2500.001"),), "A"),
            ((cut("2500"),), "B"),
            ((cut("2000"),), "C"),
            ((cut("1500"),), "D"),
            ((cut("1000"),), "E"),
            ((cut("750"),), "F"),
            ((cut("0"),), "F"),
            ((None,), None),
        ],
    )
