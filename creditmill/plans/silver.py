"""Silver tables: cleaned customers, loans, repayments and defaulter tables.

Each function takes the raw frame and an optional fixed ingest time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.functions.cleaning import whole_or_zero
from creditmill.operators import cleaning as ops
from creditmill.params import LOAN_REQUIRED, REPAYMENT_REQUIRED, UNKNOWN_STATE
from creditmill.schemas import CUSTOMER_RENAMES

CUSTOMER_NUMBERS = ("annual_income", "total_high_credit_limit", "joint_annual_income")
LOAN_NUMBERS = ("loan_amount", "funded_amount", "interest_rate", "monthly_installment")


def customers_silver(
    raw: DataFrame, at: str | None = None, legacy_float_text: bool = False, number: str = "double"
) -> DataFrame:
    """Distinct customers with a valid income, tenure in years and a state code.

    Shuffles once, for the whole-row distinct; the test for a valid income is narrow and
    runs before it. The mean tenure reads the same shuffle.
    """
    renamed = ops.rename_columns(raw, CUSTOMER_RENAMES)
    numbers = [c for c in CUSTOMER_NUMBERS if c in renamed.columns]
    known = (
        ops.stamp_ingest(renamed, at)
        .transform(ops.drop_exact_duplicates)
        .transform(ops.validated_numeric, numbers, text_to=number, legacy_float_text=legacy_float_text)
        .transform(ops.require_not_null, ["annual_income"])
        .transform(ops.digits_to_int, "emp_length")
    )
    return known.transform(ops.impute_floor_mean, "emp_length").transform(
        ops.clamp_code_length, "address_state", 2, UNKNOWN_STATE
    )


def loans_silver(raw: DataFrame, at: str | None = None, validate: bool = False) -> DataFrame:
    """Complete loans with the term in years and a known purpose. Narrow throughout.

    ``validate`` also rejects negative and non-finite amounts, which are kept otherwise.
    """
    stamped = ops.stamp_ingest(raw, at)
    if validate:
        stamped = ops.validated_numeric(stamped, LOAN_NUMBERS)
    return (
        stamped.transform(ops.require_not_null, LOAN_REQUIRED)
        .transform(ops.term_to_years, "loan_term_months", "loan_term_years")
        .transform(ops.canonicalize, "loan_purpose")
    )


def repayments_silver(raw: DataFrame, at: str | None = None) -> DataFrame:
    """Complete repayments with consistent totals and clean payment dates. Narrow throughout."""
    return (
        ops.stamp_ingest(raw, at)
        .transform(ops.require_not_null, REPAYMENT_REQUIRED)
        .transform(
            ops.repair_total,
            "total_payment_received",
            "total_principal_received",
            "total_interest_received",
            "total_late_fee_received",
        )
        .transform(ops.drop_zero, "total_payment_received")
        .transform(ops.sentinel_to_null, ["last_payment_date", "next_payment_date"])
        .transform(ops.require_pattern_or_null, "next_payment_date")
    )


def delinquent_members(defaulters: DataFrame) -> DataFrame:
    """Members with a delinquency on record."""
    return (
        ops.int_or_zero(defaulters, ["delinq_2yrs"])
        .filter((F.col("delinq_2yrs") > 0) | (F.col("mths_since_last_delinq") > 0))
        .select(
            "member_id",
            "delinq_2yrs",
            "delinq_amnt",
            F.col("mths_since_last_delinq").try_cast("int").alias("mths_since_last_delinq"),
        )
    )


def record_or_enquiry_members(defaulters: DataFrame) -> DataFrame:
    """Members with a public record, a bankruptcy or a recent enquiry."""
    return defaulters.filter(
        (F.col("pub_rec") > 0.0) | (F.col("pub_rec_bankruptcies") > 0.0) | (F.col("inq_last_6mths") > 0.0)
    ).select("member_id")


def record_enquiry_detail(defaulters: DataFrame) -> DataFrame:
    """The three record and enquiry counters of every member."""
    counters = ("pub_rec", "pub_rec_bankruptcies", "inq_last_6mths")
    return defaulters.select("member_id", *[whole_or_zero(F.col(c)).alias(c) for c in counters])
