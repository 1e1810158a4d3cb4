"""Parameters of the cleaning and scoring rules."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# --- Fixed values: text patterns -------------------------------------------------
PLAIN_NUMBER = r"^[0-9]+(\.[0-9]+)?$"
MONTH_YEAR = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\d{4}$"
TERM_UNIT = " months"
ZERO_SENTINEL = "0.0"

# --- Fixed values: loan purposes -------------------------------------------------
LOAN_PURPOSES = (
    "debt_consolidation",
    "credit_card",
    "home_improvement",
    "other",
    "major_purchase",
    "medical",
    "small_business",
    "car",
    "vacation",
    "moving",
    "house",
    "wedding",
    "renewable_energy",
    "educational",
)
OTHER_PURPOSE = "other"
UNKNOWN_STATE = "NA"

# --- Fixed values: columns that must be present ----------------------------------
LOAN_REQUIRED = (
    "loan_amount",
    "funded_amount",
    "loan_term_months",
    "interest_rate",
    "monthly_installment",
    "issue_date",
    "loan_status",
    "loan_purpose",
)
REPAYMENT_REQUIRED = (
    "total_principal_received",
    "total_interest_received",
    "total_late_fee_received",
    "total_payment_received",
    "last_payment_amount",
)


# --- Fixed values: rating points, grade cut-offs and weights ---------------------
@dataclass(frozen=True)
class ScoreParams:
    """Points, cut-offs and weights of the loan score.

    ``short_payment`` and ``partial_payment`` are the two bands below a full
    instalment; both carry the same points unless changed here.
    """

    unacceptable: int = 0
    very_bad: int = 100
    bad: int = 250
    good: int = 500
    very_good: int = 650
    excellent: int = 800

    short_payment: int = 100
    partial_payment: int = 100

    # points of an unknown count, or of one above the last band
    unknown_delinquencies: int = 0
    unknown_public_records: int = 100
    unknown_bankruptcies: int = 100
    unknown_enquiries: int = 0

    grade_f_to: int = 750
    grade_e_to: int = 1000
    grade_d_to: int = 1500
    grade_c_to: int = 2000
    grade_b_to: int = 2500

    payment_weight: Decimal = Decimal("0.20")
    default_weight: Decimal = Decimal("0.45")
    health_weight: Decimal = Decimal("0.35")


DEFAULT_SCORE = ScoreParams()
