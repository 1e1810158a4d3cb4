"""Wide view: customers with their loans, repayments and defaulter records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.operators.joins import ROWS_PER_SLICE, grid_join, skew_join

# The view's columns, in order, by the table they come from.
CUSTOMER_COLUMNS = (
    "emp_title",
    "emp_length",
    "home_ownership",
    "annual_income",
    "address_state",
    "address_zipcode",
    "address_country",
    "grade",
    "sub_grade",
    "verification_status",
    "total_high_credit_limit",
    "application_type",
    "joint_annual_income",
    "verification_status_joint",
)
LOAN_COLUMNS = (
    "loan_amount",
    "funded_amount",
    "loan_term_years",
    "interest_rate",
    "monthly_installment",
    "issue_date",
    "loan_status",
    "loan_purpose",
)
REPAYMENT_COLUMNS = (
    "total_principal_received",
    "total_interest_received",
    "total_late_fee_received",
    "last_payment_date",
    "next_payment_date",
)
DELINQUENCY_COLUMNS = ("delinq_2yrs", "delinq_amnt", "mths_since_last_delinq")
RECORD_COLUMNS = ("pub_rec", "pub_rec_bankruptcies", "inq_last_6mths")
WIDE_COLUMNS = (
    "loan_id",
    "member_id",
    *CUSTOMER_COLUMNS,
    *LOAN_COLUMNS,
    *REPAYMENT_COLUMNS,
    *DELINQUENCY_COLUMNS,
    *RECORD_COLUMNS,
)


def wide_view(
    customers: DataFrame,
    loans: DataFrame,
    repayments: DataFrame,
    delinquent: DataFrame,
    detail: DataFrame,
    rows_per_slice: int = ROWS_PER_SLICE,
    hot_loans: DataFrame | None = None,
    hot_members: DataFrame | None = None,
    hot_customers: DataFrame | None = None,
) -> DataFrame:
    """Every customer, left-joined to loans, their repayments and the two defaulter tables.

    Loans meet their repayments first and the member tables each other, so that only two
    wide rows are shuffled: once by loan and once by member. A key repeated on several
    sides yields every combination, as in any left join; over the quarantined tables each
    customer has one row per loan and repayment. A member repeated often among the customers
    is spread before the member tables multiply its rows, and again, on a grid with its loans,
    where the two sides meet. The stored lists of frequent loan
    ids (of repayments) and members (of loans, of customers) save looking for them.
    """
    people = customers.select("member_id", *CUSTOMER_COLUMNS)
    members, by_member = people, ("member_id", "emp_title")
    for table, columns in ((delinquent, DELINQUENCY_COLUMNS), (detail, RECORD_COLUMNS)):
        one = table.select("member_id", *columns)
        members = skew_join(members, one, "member_id", "spread", rows_per_slice, people, hot_customers, by_member)
    keyed = loans.filter(F.col("member_id").isNotNull()).select(
        F.col("loan_id").try_cast("bigint").alias("_loan"), "loan_id", "member_id", *LOAN_COLUMNS
    )
    paid = repayments.filter(F.col("loan_id").isNotNull()).select(
        F.col("loan_id").alias("_loan"), *REPAYMENT_COLUMNS
    )
    by_payment = ("_loan", "total_principal_received", "last_payment_date")
    loans_paid = skew_join(paid, keyed, "_loan", "other", rows_per_slice, hot=hot_loans, deal_by=by_payment).drop("_loan")
    by_loan = ("member_id", "loan_id", "total_principal_received", "last_payment_date")
    joined = grid_join(
        loans_paid, members, "member_id", "right", rows_per_slice, keyed, people, hot_members, hot_customers, by_loan, by_member
    )
    return joined.select(*WIDE_COLUMNS)


def wide_view_sql(customers: str, loans: str, repayments: str, delinquent: str, detail: str) -> str:
    """The same view as a query over catalog tables, for ``CREATE VIEW``."""
    columns = ["l.loan_id", "c.member_id"]
    for alias, names in (
        ("c", CUSTOMER_COLUMNS),
        ("l", LOAN_COLUMNS),
        ("r", REPAYMENT_COLUMNS),
        ("d", DELINQUENCY_COLUMNS),
        ("e", RECORD_COLUMNS),
    ):
        columns += [f"{alias}.{name}" for name in names]
    return (
        f"SELECT {', '.join(columns)} FROM {customers} c "
        f"LEFT JOIN {delinquent} d ON d.member_id = c.member_id "
        f"LEFT JOIN {detail} e ON e.member_id = c.member_id "
        f"LEFT JOIN ({loans} l LEFT JOIN {repayments} r ON r.loan_id = try_cast(l.loan_id AS BIGINT)) "
        "ON l.member_id = c.member_id"
    )
