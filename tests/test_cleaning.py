import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import fixture
from creditmill import schemas
from creditmill.operators import cleaning as ops
from creditmill.operators.quality import assert_schema, columns_from
from creditmill.params import LOAN_PURPOSES
from creditmill.plans import silver
from tests.conftest import rows


def test_rename_skips_absent_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert ops.rename_columns(df, {"a": "x", "zzz": "y"}).columns == ["x", "b"]


def test_stamp_is_the_same_for_all_rows_so_copies_stay_copies(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    stamped = ops.stamp_ingest(df)
    assert isinstance(stamped.schema["ingest_date"].dataType, T.TimestampType)
    assert ops.drop_exact_duplicates(stamped).count() == 2


def test_stamp_with_fixed_time(spark):
    df = ops.stamp_ingest(spark.createDataFrame([(1,)], "a int"), "2024-03-01 12:00:00")
    assert df.select(F.col("ingest_date").cast("string")).first()[0] == "2024-03-01 12:00:00"


def test_validated_numeric_of_text_and_numbers(spark):
    df = spark.createDataFrame([("7", 2.5e7), ("-7", 5e-4), ("x", -1.0)], "t string, d double")
    assert rows(ops.validated_numeric(df, ["t", "d"])) == rows(
        spark.createDataFrame([(7.0, 2.5e7), (None, 5e-4), (None, None)], "t double, d double")
    )


def test_legacy_text_form_rejects_large_and_tiny_numbers(spark):
    df = spark.createDataFrame([(2.5e7,), (5e-4,), (12.5,), (-1.0,)], "d double")
    assert rows(ops.validated_numeric(df, ["d"], legacy_float_text=True)) == [(12.5,), (None,), (None,), (None,)]


def test_impute_floor_mean(spark):
    df = spark.createDataFrame([(1,), (None,), (4,), (4,)], "a int")
    filled = ops.impute_floor_mean(df, "a")
    assert rows(filled) == [(1,), (3,), (4,), (4,)]
    assert filled.schema["a"].dataType == T.IntegerType()


def test_impute_without_any_value_leaves_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "a int")
    assert rows(ops.impute_floor_mean(df, "a")) == [(None,), (None,)]


def test_impute_of_an_empty_frame(spark):
    assert rows(ops.impute_floor_mean(spark.createDataFrame([], "a int"), "a")) == []


def test_term_keeps_its_place(spark):
    df = spark.createDataFrame([("a", " 36 months", "b")], "x string, term string, y string")
    assert ops.term_to_years(df, "term", "years").columns == ["x", "years", "y"]


def test_pattern_or_null(spark):
    df = spark.createDataFrame([("Jan-2019",), ("jan-2019",), ("2019-01",), ("Jan-19",), (None,)], "d string")
    assert rows(ops.require_pattern_or_null(df, "d")) == [("Jan-2019",), (None,)]


def test_drop_zero_drops_unknown_too(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (None,), (2.0,)], "d double")
    assert rows(ops.drop_zero(df, "d")) == [(2.0,)]


def test_malformed_text_never_fails_the_job(spark):
    df = spark.createDataFrame([("many months", "ten")], "term string, n string")
    out = ops.int_or_zero(ops.term_to_years(df, "term", "years"), ["n"])
    assert rows(out) == [(None, 0)]


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    assert_schema(df, T.StructType.fromDDL("a int, b string"))
    assert columns_from(df, T.StructType.fromDDL("b string, a int")).columns == ["b", "a"]
    with pytest.raises(ValueError, match="schema differs"):
        assert_schema(df, T.StructType.fromDDL("a bigint, b string"))


def test_number_type_of_schemas():
    assert schemas.raw_schema("loans", "float")["loan_amount"].dataType == T.FloatType()
    assert schemas.silver_schema("loans", "decimal(18,2)")["loan_amount"].dataType == T.DecimalType(18, 2)
    assert schemas.raw_schema("repayments")["loan_id"].dataType == T.LongType()


@pytest.mark.parametrize("entity", ["customers", "loans", "repayments", "defaulters"])
def test_fixture_has_the_raw_columns(spark, sf_dir, entity):
    assert fixture(spark, sf_dir, entity).columns == schemas.raw_schema(entity).fieldNames()


# --- invariants of the silver tables ---------------------------------------------
def test_customers_silver_invariants(spark, sf_dir):
    raw = fixture(spark, sf_dir, "customers")
    out = silver.customers_silver(raw, "2024-01-01")
    assert out.count() <= raw.distinct().count()
    assert out.filter("annual_income is null or emp_length is null or length(address_state) > 2").count() == 0
    assert out.count() == out.distinct().count()
    assert_schema(out, schemas.silver_schema("customers"))


def test_customers_that_differ_in_a_rejected_number_stay_apart(spark):
    """Copies are judged before validation: rows that differ only in a value it rejects are two rows."""
    schema = schemas.raw_schema("customers")
    one = ("1", "t", "3 years", "OWN", 10.0, "CA", "z", "c", "A", "A1", "v", -1.0, "i", None, None)
    two = (*one[:11], -2.0, *one[12:])
    assert silver.customers_silver(spark.createDataFrame([one, two, one], schema), "2024-01-01").count() == 2


def test_income_of_ten_million_is_kept_unless_legacy(spark):
    schema = schemas.raw_schema("customers")
    row = ("1", "t", "3 years", "OWN", 1.5e7, "CA", "z", "c", "A", "A1", "v", 9.0, "i", None, None)
    df = spark.createDataFrame([row], schema)
    assert silver.customers_silver(df, "2024-01-01").count() == 1
    assert silver.customers_silver(df, "2024-01-01", legacy_float_text=True).count() == 0


def test_loans_silver_invariants(spark, sf_dir):
    out = silver.loans_silver(fixture(spark, sf_dir, "loans"), "2024-01-01")
    assert {r[0] for r in out.select("loan_purpose").distinct().collect()} <= set(LOAN_PURPOSES)
    assert {r[0] for r in out.select("loan_term_years").distinct().collect()} == {3, 5}
    assert_schema(out, schemas.silver_schema("loans"))


def test_repayments_silver_invariants(spark, sf_dir):
    out = silver.repayments_silver(fixture(spark, sf_dir, "repayments"), "2024-01-01")
    assert out.filter("total_payment_received = 0").count() == 0
    assert out.filter("last_payment_date = '0.0' or next_payment_date = '0.0'").count() == 0
    assert_schema(out, schemas.silver_schema("repayments"))


def test_repayments_cleaning_is_idempotent(spark, sf_dir):
    once = silver.repayments_silver(fixture(spark, sf_dir, "repayments"), "2024-01-01")
    assert rows(silver.repayments_silver(once.drop("ingest_date"), "2024-01-01")) == rows(once)


def test_defaulter_tables(spark):
    schema = schemas.raw_schema("defaulters")
    df = spark.createDataFrame(
        [
            ("none", None, 1.0, 0.0, 0.0, 0.0, 0.0, None, None),
            ("two", 2.0, 1.0, 0.0, 0.0, 1.0, 0.0, None, None),
            ("months", 0.0, 1.0, 3.7, None, 0.0, 0.0, 7.9, None),
            ("half", 0.5, 1.0, 0.0, 1.0, None, 0.0, 0.0, None),
        ],
        schema,
    )
    assert rows(silver.delinquent_members(df)) == [("months", 0, 1.0, 7), ("two", 2, 1.0, None)]
    assert rows(silver.record_or_enquiry_members(df)) == [("half",), ("months",), ("two",)]
    assert rows(silver.record_enquiry_detail(df)) == [
        ("half", 0, 1, 0),
        ("months", 3, 0, 0),
        ("none", 0, 0, 0),
        ("two", 0, 0, 1),
    ]


texts = st.one_of(st.none(), st.text(alphabet="0123456789.-+ eyrsn<", max_size=12))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts, min_size=1, max_size=30))
def test_text_rules_accept_any_text(spark, values):
    df = spark.createDataFrame([(v, v) for v in values], "n string, d string")
    out = ops.digits_to_int(ops.validated_numeric(df, ["n"]), "d")
    got = out.collect()
    assert len(got) == len(values)
    assert all(r.n is None or r.n >= 0 for r in got)
    assert all(r.d is None or r.d >= 0 for r in got)


def test_repaired_total_that_does_not_fit_is_null(spark):
    kinds = "total decimal(4,2), principal decimal(4,2), interest decimal(4,2)"
    df = spark.sql("SELECT cast(t AS decimal(4,2)) AS total, cast(p AS decimal(4,2)) AS principal, cast(i AS decimal(4,2)) AS interest "
                   "FROM VALUES (0, 60.5, 50.5), (0, 20.25, 30.5), (7, 1, 1), (null, 1, 1) AS v(t, p, i)")  # fmt: skip
    got = ops.repair_total(df, "total", "principal", "interest")
    assert got.schema.simpleString() == T.StructType.fromDDL(kinds).simpleString()
    assert [str(r.total) for r in got.collect()] == ["None", "50.75", "7.00", "None"]
