"""Declared columns of every entity, by zone.

Numbers are 64-bit (``double``) unless the caller asks for another Spark type,
for example ``float`` or ``decimal(18,2)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order per entity; "number" is the caller's numeric type. Raw numbers of
# customers are text, which is validated before it is cast.
_RAW = {
    "customers": (
        "member_id string, emp_title string, emp_length string, home_ownership string, annual_inc string, "
        "addr_state string, zip_code string, country string, grade string, sub_grade string, "
        "verification_status string, tot_hi_cred_lim string, application_type string, annual_inc_joint string, "
        "verification_status_joint string"
    ),
    "loans": (
        "loan_id string, member_id string, loan_amount number, funded_amount number, loan_term_months string, "
        "interest_rate number, monthly_installment number, issue_date string, loan_status string, "
        "loan_purpose string, loan_title string"
    ),
    "repayments": (
        "loan_id bigint, total_principal_received number, total_interest_received number, "
        "total_late_fee_received number, total_payment_received number, last_payment_amount number, "
        "last_payment_date string, next_payment_date string"
    ),
    "defaulters": (
        "member_id string, delinq_2yrs number, delinq_amnt number, pub_rec number, pub_rec_bankruptcies number, "
        "inq_last_6mths number, total_rec_late_fee number, mths_since_last_delinq number, "
        "mths_since_last_record number"
    ),
}

_SILVER = {
    "customers": (
        "member_id string, emp_title string, emp_length int, home_ownership string, annual_income number, "
        "address_state string, address_zipcode string, address_country string, grade string, sub_grade string, "
        "verification_status string, total_high_credit_limit number, application_type string, "
        "joint_annual_income number, verification_status_joint string, ingest_date timestamp"
    ),
    "loans": (
        "loan_id string, member_id string, loan_amount number, funded_amount number, loan_term_years int, "
        "interest_rate number, monthly_installment number, issue_date string, loan_status string, "
        "loan_purpose string, loan_title string, ingest_date timestamp"
    ),
    "repayments": (
        "loan_id bigint, total_principal_received number, total_interest_received number, "
        "total_late_fee_received number, total_payment_received number, last_payment_amount number, "
        "last_payment_date string, next_payment_date string, ingest_date timestamp"
    ),
    "delinquent_members": "member_id string, delinq_2yrs int, delinq_amnt number, mths_since_last_delinq int",
    "record_enquiry_detail": "member_id string, pub_rec int, pub_rec_bankruptcies int, inq_last_6mths int",
    "record_enquiry_members": "member_id string",
}

CUSTOMER_RENAMES = {
    "annual_inc": "annual_income",
    "addr_state": "address_state",
    "zip_code": "address_zipcode",
    "country": "address_country",
    "tot_hi_cred_lim": "total_high_credit_limit",
    "annual_inc_joint": "joint_annual_income",
}


def _declare(columns: str, number: str) -> T.StructType:
    return T.StructType.fromDDL(columns.replace(" number", f" {number}"))


def raw_schema(entity: str, number: str = "double") -> T.StructType:
    """Schema of a raw or bronze file, in file order."""
    return _declare(_RAW[entity], number)


def silver_schema(entity: str, number: str = "double") -> T.StructType:
    """Schema of a silver (and, where one exists, gold) table."""
    return _declare(_SILVER[entity], number)


RAW_ENTITIES = tuple(_RAW)
SILVER_ENTITIES = tuple(_SILVER)
