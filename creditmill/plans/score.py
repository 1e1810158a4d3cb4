"""Loan score: payment history, default history and financial health.

Two grains. ``score_by_loan`` scores each loan on its own payments. ``score_members``
combines every payment of a member with every loan of that member; since points take few
values, it counts the distinct combinations of each side first and multiplies the counts,
so its cost follows the number of loans and not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.functions import points as P
from creditmill.operators.joins import ROWS_PER_SLICE, skew_join
from creditmill.operators.quality import exclude_keys
from creditmill.operators.tally import ROW_COUNT, is_tallied, tally_rows, times
from creditmill.params import DEFAULT_SCORE, ScoreParams

PAYMENT_POINTS = ("last_payment_pts", "total_payment_pts")
DEFAULT_POINTS = ("delinq_pts", "public_records_pts", "public_bankruptcies_pts", "enq_pts")
HEALTH_POINTS = ("loan_status_pts", "home_pts", "credit_limit_pts", "grade_pts")
PARTS = ("payment_history_pts", "defaulters_history_pts", "financial_health_pts")


def payment_points(
    repayments: DataFrame,
    loans: DataFrame,
    quarantined: DataFrame | None = None,
    params: ScoreParams = DEFAULT_SCORE,
    with_loan: tuple[str, ...] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    hot_loans: DataFrame | None = None,
) -> DataFrame:
    """Points of each repayment against its loan: one row per matching pair.

    A loan id that is no number matches nothing. ``with_loan`` names loan columns to keep.
    The row counts of tallied loans are passed on. ``hot_loans`` is the stored list of frequent
    loan ids of the repayments, if there is one.
    """
    with_loan = (*with_loan, *_count_of(loans))
    if quarantined is not None:
        loans = exclude_keys(loans, quarantined, "member_id")
    owed = loans.select(
        F.col("loan_id").try_cast("bigint").alias("_loan"),
        "member_id",
        "monthly_installment",
        F.col("funded_amount").alias("_funded"),
        *with_loan,
    )
    paid = repayments.select(F.col("loan_id").alias("_loan"), "last_payment_amount", "total_payment_received")
    dealt = ("_loan", "last_payment_amount", "total_payment_received")
    return skew_join(paid, owed, "_loan", "inner", rows_per_slice, hot=hot_loans, deal_by=dealt).select(
        "member_id",
        *with_loan,
        P.last_payment_points(F.col("last_payment_amount"), F.col("monthly_installment"), params).alias(
            "last_payment_pts"
        ),
        P.total_payment_points(F.col("total_payment_received"), F.col("_funded"), params).alias("total_payment_pts"),
    )


def member_default_points(
    detail: DataFrame, delinquent: DataFrame, params: ScoreParams = DEFAULT_SCORE, include_clean: bool = False
) -> DataFrame:
    """Points of the four default counters per member.

    Members without a delinquency are left out, unless ``include_clean`` takes them in with
    a count of zero.
    """
    both = detail.join(
        delinquent.select("member_id", "delinq_2yrs", F.lit(True).alias("_delinquent")),
        "member_id",
        "left" if include_clean else "inner",
    )
    delinquencies = F.when(F.col("_delinquent").isNull(), 0).otherwise(F.col("delinq_2yrs"))
    return both.select(
        "member_id",
        P.count_band_points(delinquencies, params.unknown_delinquencies, params).alias("delinq_pts"),
        P.count_band_points(F.col("pub_rec"), params.unknown_public_records, params).alias("public_records_pts"),
        P.count_band_points(F.col("pub_rec_bankruptcies"), params.unknown_bankruptcies, params).alias(
            "public_bankruptcies_pts"
        ),
        P.count_band_points(F.col("inq_last_6mths"), params.unknown_enquiries, params).alias("enq_pts"),
    )


def default_points(
    payments: DataFrame,
    detail: DataFrame,
    delinquent: DataFrame,
    quarantined: DataFrame | None = None,
    params: ScoreParams = DEFAULT_SCORE,
    include_clean: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    counted: DataFrame | None = None,
    hot_members: DataFrame | None = None,
) -> DataFrame:
    """Payment points (single rows or tallied) with the default points of their member.

    ``counted`` is where to look for frequent members (see ``skew_join``): the loans, say;
    ``hot_members`` is the stored list of them, if there is one.
    """
    if quarantined is not None:
        detail = exclude_keys(detail, quarantined, "member_id")
    members = member_default_points(detail, delinquent, params, include_clean)
    if is_tallied(payments):
        joined = payments.join(members, "member_id")
    else:
        joined = skew_join(payments, members, "member_id", "inner", rows_per_slice, counted, hot_members)
    return joined.select(*[c for c in payments.columns if c != ROW_COUNT], *DEFAULT_POINTS, *_count_of(payments))


def _customer_points(customers: DataFrame, params: ScoreParams) -> DataFrame:
    """Points that belong to the customer alone, and the credit limit."""
    return customers.select(
        "member_id",
        P.home_points(F.col("home_ownership"), params).alias("home_pts"),
        P.grade_points(F.col("grade"), F.col("sub_grade"), params).alias("grade_pts"),
        "total_high_credit_limit",
    )


def _health_columns(params: ScoreParams) -> list[Column]:
    """Points of one loan (status, funded amount) joined to its customer's points and limit."""
    return [
        P.loan_status_points(F.col("loan_status"), params).alias("loan_status_pts"),
        F.col("home_pts"),
        P.credit_limit_points(F.col("funded_amount"), F.col("total_high_credit_limit"), params).alias(
            "credit_limit_pts"
        ),
        F.col("grade_pts"),
    ]


def member_loan_points(
    loans: DataFrame,
    customers: DataFrame,
    params: ScoreParams = DEFAULT_SCORE,
    rows_per_slice: int = ROWS_PER_SLICE,
    hot_members: DataFrame | None = None,
) -> DataFrame:
    """Financial-health points of each loan with its customer: one row per loan."""
    rated = _loan_points(loans, _customer_points(customers, params), rows_per_slice, params, hot_members)
    return rated.select("member_id", *HEALTH_POINTS)


def _loan_points(
    loans: DataFrame,
    members: DataFrame,
    rows_per_slice: int,
    params: ScoreParams,
    hot_members: DataFrame | None = None,
) -> DataFrame:
    """The points of ``members`` with those of each of their loans: one row per loan."""
    own = [c for c in members.columns if c in DEFAULT_POINTS]
    rated = loans.select("member_id", "loan_status", "funded_amount")
    return skew_join(rated, members, "member_id", "inner", rows_per_slice, hot=hot_members).select(
        "member_id", *own, *_health_columns(params)
    )


def _member_points(
    customers: DataFrame,
    delinquent: DataFrame,
    detail: DataFrame,
    quarantined: DataFrame | None,
    params: ScoreParams,
    include_clean: bool,
) -> DataFrame:
    """All that a member's score needs besides loans and payments: one row per member."""
    if quarantined is not None:
        detail = exclude_keys(detail, quarantined, "member_id")
    return member_default_points(detail, delinquent, params, include_clean).join(
        _customer_points(customers, params), "member_id"
    )


def health_points(
    defaults: DataFrame,
    loans: DataFrame,
    customers: DataFrame,
    quarantined: DataFrame | None = None,
    params: ScoreParams = DEFAULT_SCORE,
    rows_per_slice: int = ROWS_PER_SLICE,
    hot_members: DataFrame | None = None,
) -> DataFrame:
    """All points of a member's payments combined with all of the member's loans, tallied.

    Each distinct combination appears once; ``row_count`` says how many pairs of a payment
    and a loan have it. ``hot_members`` is the stored list of frequent members of the loans.
    """
    if quarantined is not None:
        customers = exclude_keys(customers, quarantined, "member_id")
    rated = member_loan_points(loans, customers, params, rows_per_slice, hot_members)
    return _paired(tally_rows(defaults), tally_rows(rated)).select("member_id", *PAYMENT_POINTS, *DEFAULT_POINTS, *HEALTH_POINTS, ROW_COUNT)


def _paired(payments: DataFrame, loans: DataFrame) -> DataFrame:
    """Tallied payments with the tallied loans of the same member; the counts multiply."""
    other = loans.withColumnRenamed(ROW_COUNT, "_loans")
    return (
        payments.join(other, "member_id")
        .withColumn(ROW_COUNT, times(F.col(ROW_COUNT), F.col("_loans")))
        .drop("_loans")
    )


def _count_of(df: DataFrame) -> tuple[str, ...]:
    return (ROW_COUNT,) if is_tallied(df) else ()


def _total(columns: tuple[str, ...]) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0]))


def weighted_score(df: DataFrame, params: ScoreParams = DEFAULT_SCORE) -> DataFrame:
    """The three weighted parts and their sum; NULL points make a NULL score.

    Tallied points give tallied scores: rows that differ in points only are merged.
    """
    plain = [c for c in df.columns if c not in (*PAYMENT_POINTS, *DEFAULT_POINTS, *HEALTH_POINTS, ROW_COUNT)]
    weighted = df.select(
        *plain,
        (_total(PAYMENT_POINTS) * F.lit(params.payment_weight)).alias(PARTS[0]),
        (_total(DEFAULT_POINTS) * F.lit(params.default_weight)).alias(PARTS[1]),
        (_total(HEALTH_POINTS) * F.lit(params.health_weight)).alias(PARTS[2]),
        *_count_of(df),
    )
    if is_tallied(df):
        weighted = tally_rows(weighted)
    return weighted.select(*plain, *PARTS, _total(PARTS).alias("loan_score"), *_count_of(df))


def with_final_grade(df: DataFrame, params: ScoreParams = DEFAULT_SCORE) -> DataFrame:
    """Scores with their letter."""
    plain = [c for c in df.columns if c != ROW_COUNT]
    return df.select(
        *plain, P.final_grade(F.col("loan_score"), params).alias("loan_final_grade"), *_count_of(df)
    )


def score_members(
    customers: DataFrame,
    loans: DataFrame,
    repayments: DataFrame,
    delinquent: DataFrame,
    detail: DataFrame,
    quarantined: DataFrame | None = None,
    params: ScoreParams = DEFAULT_SCORE,
    include_clean: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    hot_loans: DataFrame | None = None,
    hot_members: DataFrame | None = None,
) -> DataFrame:
    """Score and grade of every payment of a member with every loan of that member, tallied.

    ``quarantined`` is needed only if the member tables still hold quarantined keys. It is
    then taken out of the smallest of them: the inner joins carry that to the rest. The stored
    lists of frequent loan ids (of repayments) and members (of loans) save looking for them.
    """
    # copies of a loan collapse before they meet its repayments
    owed = tally_rows(
        loans.select(
            F.col("loan_id").try_cast("bigint").alias("loan_id"), "member_id", "monthly_installment", "funded_amount"
        ).filter(F.col("loan_id").isNotNull() & F.col("member_id").isNotNull())
    )
    payments = tally_rows(payment_points(repayments, owed, None, params, (), rows_per_slice, hot_loans))
    members = _member_points(customers, delinquent, detail, quarantined, params, include_clean)
    rated = tally_rows(_loan_points(loans, members, rows_per_slice, params, hot_members))
    return with_final_grade(weighted_score(_paired(payments, rated), params), params)


def score_by_loan(
    customers: DataFrame,
    loans: DataFrame,
    repayments: DataFrame,
    delinquent: DataFrame,
    detail: DataFrame,
    quarantined: DataFrame | None = None,
    params: ScoreParams = DEFAULT_SCORE,
    include_clean: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    hot_loans: DataFrame | None = None,
    hot_members: DataFrame | None = None,
) -> DataFrame:
    """Score and grade of every loan on its own payments: one row per loan and repayment."""
    kept = ("loan_id", "loan_status", "funded_amount")
    payments = payment_points(repayments, loans, None, params, kept, rows_per_slice, hot_loans)
    members = _member_points(customers, delinquent, detail, quarantined, params, include_clean)
    counted = loans.select("member_id")
    points = skew_join(
        payments, members, "member_id", "inner", rows_per_slice, counted, hot_members, ("member_id", "loan_id", *PAYMENT_POINTS)
    ).select("member_id", "loan_id", *PAYMENT_POINTS, *DEFAULT_POINTS, *_health_columns(params))
    return with_final_grade(weighted_score(points, params), params)


def grade_report(scores: DataFrame, *grades: str) -> DataFrame:
    """The scores that got one of the grades."""
    return scores.filter(F.col("loan_final_grade").isin(*grades))


def grade_counts(scores: DataFrame) -> DataFrame:
    """Number of scored rows per final grade."""
    rows = F.sum(ROW_COUNT) if is_tallied(scores) else F.count(F.lit(1))
    return scores.groupBy("loan_final_grade").agg(rows.cast("decimal(38,0)").alias("total"))
