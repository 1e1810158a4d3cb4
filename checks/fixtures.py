"""Lending-shaped tables derived from the customer and orders tables.

One SQL text per table, read alike by Spark and DuckDB: no clock, no randomness, DOUBLE
numbers. They hold the dirt the cleaning rules are about: NULLs, text in numeric columns,
sentinels, unknown vocabulary, exact copies and repeated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BORROWER_COLUMNS = (
    "member_id, emp_title{suffix}, emp_length, home_ownership, annual_inc, addr_state, zip_code, country, grade, "
    "sub_grade, verification_status, tot_hi_cred_lim, application_type, annual_inc_joint, verification_status_joint"
)
_PLAIN = _BORROWER_COLUMNS.format(suffix="")
_RETITLED = _BORROWER_COLUMNS.replace("emp_title{suffix}", "concat(emp_title, '-dup') AS emp_title")

BORROWERS = f"""
WITH b AS (SELECT c_custkey AS k,
  CAST(c_custkey AS STRING) AS member_id, c_name AS emp_title,
  CASE c_custkey % 6 WHEN 0 THEN '10+ years' WHEN 1 THEN '< 1 year' WHEN 2 THEN '3 years' WHEN 3 THEN 'n/a'
    WHEN 5 THEN '7 years' END AS emp_length,
  CASE c_custkey % 8 WHEN 0 THEN 'OWN' WHEN 1 THEN 'RENT' WHEN 2 THEN 'MORTGAGE' WHEN 3 THEN 'ANY' WHEN 4 THEN NULL
    WHEN 5 THEN 'OTHER' ELSE 'OWN' END AS home_ownership,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'unknown'
    WHEN c_custkey % 97 = 1 THEN '1e5' WHEN c_custkey % 97 = 2 THEN '+7' WHEN c_custkey % 97 = 3 THEN '-0.0'
    WHEN c_custkey % 97 = 4 THEN 'NaN' WHEN c_custkey % 97 = 5 THEN '12500000' WHEN c_custkey % 97 = 6 THEN ' 5 '
    ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) END AS annual_inc,
  CASE c_custkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'California' WHEN 3 THEN 'N' END AS addr_state,
  concat(CAST(100 + c_custkey % 900 AS STRING), 'xx') AS zip_code, 'USA' AS country,
  substr('ABCDEFG', CAST(c_nationkey % 7 AS INT) + 1, 1) AS grade,
  concat(substr('ABCDEFG', CAST(c_nationkey % 7 AS INT) + 1, 1), CAST(c_custkey % 5 + 1 AS STRING)) AS sub_grade,
  CASE c_custkey % 3 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Source Verified' ELSE 'Not Verified' END AS verification_status,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(50000 + 2000 * (c_custkey % 1000) AS DOUBLE) END AS tot_hi_cred_lim,
  CASE WHEN c_custkey % 10 = 0 THEN 'Joint App' ELSE 'Individual' END AS application_type,
  CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 7 - 1 AS DOUBLE) END AS annual_inc_joint,
  CASE WHEN c_custkey % 20 = 0 THEN 'Verified' END AS verification_status_joint
  FROM {{customer}})
SELECT {_PLAIN} FROM b
UNION ALL SELECT {_PLAIN} FROM b WHERE k % 40 = 1
UNION ALL SELECT {_RETITLED} FROM b WHERE k % 50 = 2
"""

LOANS = """
SELECT CAST(o_orderkey AS STRING) AS loan_id, CAST(o_custkey AS STRING) AS member_id,
  o_totalprice AS loan_amount, CASE WHEN o_orderkey % 29 <> 0 THEN o_totalprice END AS funded_amount,
  CASE WHEN o_orderkey % 2 = 0 THEN ' 36 months' ELSE ' 60 months' END AS loan_term_months,
  CAST(5 + o_orderkey % 20 AS DOUBLE) AS interest_rate,
  CAST(floor(o_totalprice / 36) AS DOUBLE) AS monthly_installment,
  concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) AS INT) * 3 - 2, 3), '-',
    CAST(year(o_orderdate) AS STRING)) AS issue_date,
  CASE o_orderkey % 8 WHEN 0 THEN 'Fully Paid' WHEN 1 THEN 'Current' WHEN 2 THEN 'In Grace Period'
    WHEN 3 THEN 'Late (16-30 days)' WHEN 4 THEN 'Late (31-120 days)' WHEN 5 THEN 'Charged Off' WHEN 6 THEN 'Default'
    ELSE 'Does not meet the credit policy. Status:Fully Paid' END AS loan_status,
  CASE o_orderkey % 6 WHEN 0 THEN 'car' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'medical' WHEN 3 THEN 'yacht'
    WHEN 4 THEN NULL ELSE 'other' END AS loan_purpose,
  concat('Loan, "', o_orderpriority, '"') AS loan_title
FROM {orders}
"""

REPAYMENTS = """
SELECT o_orderkey AS loan_id,
  CASE WHEN o_orderkey % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(floor(o_totalprice / 4) AS DOUBLE) END
    AS total_principal_received,
  CASE WHEN o_orderkey % 31 <> 0 THEN CAST(floor(o_totalprice / 10) AS DOUBLE) END AS total_interest_received,
  CAST(o_orderkey % 3 AS DOUBLE) AS total_late_fee_received,
  CASE WHEN o_orderkey % 6 = 0 THEN CAST(0 AS DOUBLE)
    ELSE CAST(floor(o_totalprice * (o_orderkey % 10) / 8) AS DOUBLE) END AS total_payment_received,
  CAST(floor(o_totalprice / 36) * CASE o_orderkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 WHEN 2 THEN 1 WHEN 3 THEN 1.25
    ELSE 2 END AS DOUBLE) AS last_payment_amount,
  CASE o_orderkey % 4 WHEN 0 THEN 'Jan-2019' WHEN 1 THEN '0.0' WHEN 2 THEN NULL ELSE '2019-02' END AS last_payment_date,
  CASE o_orderkey % 7 WHEN 0 THEN '0.0' WHEN 1 THEN NULL WHEN 2 THEN '2019-03' ELSE 'Mar-2019' END AS next_payment_date
FROM {orders}
"""

_DEFAULTER_REST = (
    "pub_rec, pub_rec_bankruptcies, inq_last_6mths, total_rec_late_fee, "
    "CAST(mths_since_last_delinq AS DOUBLE) AS mths_since_last_delinq, mths_since_last_record"
)

DEFAULTERS = f"""
WITH d AS (SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS member_id,
  CASE WHEN c_custkey % 9 <> 8 THEN CAST(c_custkey % 9 AS DOUBLE) END AS delinq_2yrs,
  CAST(10 * (c_custkey % 30) AS DOUBLE) AS delinq_amnt,
  CASE WHEN c_custkey % 19 <> 0 THEN CAST(c_nationkey % 7 AS DOUBLE) END AS pub_rec,
  CAST(c_custkey % 4 AS DOUBLE) AS pub_rec_bankruptcies,
  CAST(c_custkey % 7 AS DOUBLE) AS inq_last_6mths,
  CAST(c_custkey % 2 AS DOUBLE) AS total_rec_late_fee,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 + 0.5 END AS mths_since_last_delinq,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 100 AS DOUBLE) END AS mths_since_last_record
  FROM {{customer}})
SELECT member_id, delinq_2yrs, delinq_amnt, {_DEFAULTER_REST} FROM d
UNION ALL SELECT member_id, delinq_2yrs, delinq_amnt + 1 AS delinq_amnt, {_DEFAULTER_REST} FROM d WHERE k % 60 = 3
"""

BY_ENTITY = {"customers": BORROWERS, "loans": LOANS, "repayments": REPAYMENTS, "defaulters": DEFAULTERS}


def fixture(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """A raw entity as a DataFrame over the parquet tables."""
    base = "customer" if entity in ("customers", "defaulters") else "orders"
    return spark.sql(BY_ENTITY[entity], **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def fixture_sql(entity: str) -> str:
    """The same entity as SQL over views named like the tables."""
    return BY_ENTITY[entity].format(customer="customer", orders="orders")
