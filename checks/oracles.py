"""DuckDB SQL for the registered queries, written independently of the Spark code."""

from __future__ import annotations

import re

from checks.fixtures import fixture_sql

_NUMBER = r"'^[0-9]+(\.[0-9]+)?$'"
_PURPOSES = (
    "'debt_consolidation', 'credit_card', 'home_improvement', 'other', 'major_purchase', 'medical', 'small_business', "
    "'car', 'vacation', 'moving', 'house', 'wedding', 'renewable_energy', 'educational'"
)
_LOAN_COMPLETE = (
    "loan_amount IS NOT NULL AND funded_amount IS NOT NULL AND loan_term_months IS NOT NULL "
    "AND interest_rate IS NOT NULL AND monthly_installment IS NOT NULL AND issue_date IS NOT NULL "
    "AND loan_status IS NOT NULL AND loan_purpose IS NOT NULL"
)
_PAYMENT_COMPLETE = (
    "total_principal_received IS NOT NULL AND total_interest_received IS NOT NULL "
    "AND total_late_fee_received IS NOT NULL AND total_payment_received IS NOT NULL "
    "AND last_payment_amount IS NOT NULL"
)


# Counters from, to, points.
_BANDS = "(VALUES (0, 0, 800), (1, 2, 250), (3, 5, 100)) AS band(low, high, points)"


def _band(column: str, unknown: int) -> str:
    """Points of the band a counter lies in; ``unknown`` above the bands and for NULL."""
    found = f"(SELECT band.points FROM {_BANDS} WHERE {column} BETWEEN band.low AND band.high)"
    return f"CASE WHEN {column} <= 5 THEN {found} ELSE {unknown} END"


def _whole(column: str) -> str:
    return f"CAST(coalesce(trunc({column}), 0) AS INTEGER)"


# Payment as a share of the instalment above, up to, points; a payment of the whole has its own.
_LAST = (
    "coalesce(CASE WHEN r.last_payment_amount IS NULL OR l.monthly_installment IS NULL THEN 0 "
    "WHEN r.last_payment_amount = l.monthly_installment THEN 500 ELSE "
    "(SELECT share.points FROM (VALUES (NULL, 1.0, 100), (1.0, 1.5, 650), (1.5, NULL, 800)) "
    "AS share(low, high, points) WHERE (share.low IS NULL OR r.last_payment_amount > share.low * l.monthly_installment) "
    "AND (share.high IS NULL OR r.last_payment_amount <= share.high * l.monthly_installment)) END, 0)"
)
_TOTAL = (
    "CASE WHEN coalesce(r.total_payment_received, 0) = 0 THEN 0 WHEN l.funded_amount IS NULL THEN NULL "
    "WHEN 2 * r.total_payment_received < l.funded_amount THEN 500 ELSE 650 END"
)
# Order, phrase, points.
_STATUS = (
    "coalesce((SELECT arg_min(phrase.points, phrase.place) FROM (VALUES (1, 'fully paid', 800), (2, 'current', 500), "
    "(3, 'in grace period', 250), (4, 'late (16-30 days)', 100), (5, 'late (31-120 days)', 100)) "
    "AS phrase(place, words, points) WHERE contains(lower({c}), phrase.words)), 0)"
)
_HOME = (
    "CASE regexp_extract(lower(coalesce({c}, 'any')), '(own|rent|mortgage|any)$') "
    "WHEN 'own' THEN 800 WHEN 'rent' THEN 500 WHEN 'mortgage' THEN 250 WHEN 'any' THEN 100 END"
)
# Funded amount as a share of the limit above, up to, points.
_LIMIT = (
    "coalesce((SELECT min(share.points) FROM (VALUES (NULL, 0.10, 800), (0.10, 0.20, 650), (0.20, 0.30, 500), "
    "(0.30, 0.50, 250), (0.50, 0.70, 100)) AS share(low, high, points) "
    "WHERE (share.low IS NULL OR {f} > {t} * share.low) AND {f} <= {t} * share.high), 0)"
)
_GRADE = (
    "CAST(CASE WHEN grade IN ('F', 'G') THEN 0 WHEN left(sub_grade, 1) = grade THEN "
    "(CASE grade WHEN 'A' THEN 800 WHEN 'B' THEN 650 WHEN 'C' THEN 500 WHEN 'D' THEN 250 WHEN 'E' THEN 100 END) * "
    "(CASE substr(sub_grade, 2) WHEN '1' THEN 1.00 WHEN '2' THEN 0.95 WHEN '3' THEN 0.90 WHEN '4' THEN 0.85 "
    "WHEN '5' THEN 0.80 END) END AS DECIMAL(11,1))"
)
_PARTS = (
    "CAST((last_payment_pts + total_payment_pts) * 0.20 AS DECIMAL(13,2)) AS payment_history_pts, "
    "CAST((delinq_pts + public_records_pts + public_bankruptcies_pts + enq_pts) * 0.45 AS DECIMAL(13,2)) "
    "AS defaulters_history_pts, "
    "CAST((loan_status_pts + home_pts + credit_limit_pts + grade_pts) * 0.35 AS DECIMAL(15,3)) AS financial_health_pts"
)
_SCORE = (
    "CAST(payment_history_pts + defaulters_history_pts + financial_health_pts AS DECIMAL(16,3)) AS loan_score"
)
_LETTER = (
    "CASE WHEN loan_score > 2500 THEN 'A' WHEN loan_score > 2000 THEN 'B' WHEN loan_score > 1500 THEN 'C' "
    "WHEN loan_score > 1000 THEN 'D' WHEN loan_score > 750 THEN 'E' WHEN loan_score <= 750 THEN 'F' END "
    "AS loan_final_grade"
)
_COUNT = "CAST(count(*) AS DECIMAL(38,0)) AS row_count"
_NEAT_PARTS = "payment_history_pts, defaulters_history_pts, financial_health_pts"


def _health(condition: str) -> str:
    return (
        f"{_STATUS.format(c='l.loan_status')} AS loan_status_pts, {_HOME.format(c='a.home_ownership')} AS home_pts, "
        f"{_LIMIT.format(f='l.funded_amount', t='a.total_high_credit_limit')} AS credit_limit_pts, "
        f"{_GRADE.replace('sub_grade', 'a.sub_grade').replace(' grade ', ' a.grade ').replace('= grade', '= a.grade')} "
        f"AS grade_pts {condition}"
    )


_DEFAULT_POINTS = (
    f"{_band('d.delinq_2yrs', 0)} AS delinq_pts, {_band('e.pub_rec', 100)} AS public_records_pts, "
    f"{_band('e.pub_rec_bankruptcies', 100)} AS public_bankruptcies_pts, {_band('e.inq_last_6mths', 0)} AS enq_pts"
)

# Named steps; a query gets those it mentions, directly or through another step.
STEPS = {
    "fx_borrowers": fixture_sql("customers"),
    "fx_loans": fixture_sql("loans"),
    "fx_repayments": fixture_sql("repayments"),
    "fx_defaulters": fixture_sql("defaulters"),
    "customers_typed": f"""
        SELECT member_id, emp_title,
          TRY_CAST(nullif(regexp_replace(emp_length, '\\D', '', 'g'), '') AS INTEGER) AS emp_length, home_ownership,
          CASE WHEN regexp_matches(annual_inc, {_NUMBER}) THEN CAST(annual_inc AS DOUBLE) END AS annual_income,
          CASE WHEN length(addr_state) > 2 THEN 'NA' ELSE addr_state END AS address_state,
          zip_code AS address_zipcode, country AS address_country, grade, sub_grade, verification_status,
          CASE WHEN tot_hi_cred_lim >= 0 THEN tot_hi_cred_lim END AS total_high_credit_limit, application_type,
          CASE WHEN annual_inc_joint >= 0 THEN annual_inc_joint END AS joint_annual_income, verification_status_joint
        FROM (SELECT DISTINCT * FROM fx_borrowers)
        WHERE regexp_matches(annual_inc, {_NUMBER})""",
    "customers_data": """
        SELECT * REPLACE (coalesce(emp_length, CAST((SELECT floor(avg(emp_length)) FROM customers_typed) AS INTEGER))
          AS emp_length) FROM customers_typed""",
    "loans_data": f"""
        SELECT loan_id, member_id, loan_amount, funded_amount,
          CAST(trunc(CAST(trim(replace(loan_term_months, ' months', '')) AS INTEGER) / 12.0) AS INTEGER)
            AS loan_term_years,
          interest_rate, monthly_installment, issue_date, loan_status,
          CASE WHEN loan_purpose IN ({_PURPOSES}) THEN loan_purpose ELSE 'other' END AS loan_purpose, loan_title
        FROM fx_loans WHERE {_LOAN_COMPLETE}""",
    "repaired": """
        SELECT * REPLACE (CASE WHEN total_principal_received <> 0 AND total_payment_received = 0
          THEN total_principal_received + total_interest_received + total_late_fee_received
          ELSE total_payment_received END AS total_payment_received) FROM fx_repayments""",
    "repayment_data": f"""
        SELECT * FROM (SELECT * REPLACE (nullif(last_payment_date, '0.0') AS last_payment_date,
          nullif(next_payment_date, '0.0') AS next_payment_date) FROM repaired
          WHERE {_PAYMENT_COMPLETE} AND total_payment_received <> 0)
        WHERE next_payment_date IS NULL OR regexp_matches(next_payment_date,
          '^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\\d{{4}}$')""",
    "delinq_data": f"""
        SELECT member_id, {_whole('delinq_2yrs')} AS delinq_2yrs, delinq_amnt,
          CAST(trunc(mths_since_last_delinq) AS INTEGER) AS mths_since_last_delinq
        FROM fx_defaulters WHERE {_whole('delinq_2yrs')} > 0 OR mths_since_last_delinq > 0""",
    "detail_data": f"""
        SELECT member_id, {_whole('pub_rec')} AS pub_rec, {_whole('pub_rec_bankruptcies')} AS pub_rec_bankruptcies,
          {_whole('inq_last_6mths')} AS inq_last_6mths FROM fx_defaulters""",
    "bad_members": """
        SELECT member_id FROM customers_data GROUP BY member_id HAVING count(*) > 1
        UNION SELECT member_id FROM delinq_data GROUP BY member_id HAVING count(*) > 1
        UNION SELECT member_id FROM detail_data GROUP BY member_id HAVING count(*) > 1""",
    "customers_gold": "SELECT * FROM customers_data WHERE member_id NOT IN (SELECT member_id FROM bad_members)",
    "delinq_gold": "SELECT * FROM delinq_data WHERE member_id NOT IN (SELECT member_id FROM bad_members)",
    "detail_gold": "SELECT * FROM detail_data WHERE member_id NOT IN (SELECT member_id FROM bad_members)",
    "ph": f"""
        SELECT l.member_id, {_LAST} AS last_payment_pts, {_TOTAL} AS total_payment_pts
        FROM repayment_data r JOIN loans_data l ON CAST(l.loan_id AS BIGINT) = r.loan_id
        WHERE l.member_id NOT IN (SELECT member_id FROM bad_members)""",
    "ldh": f"""
        SELECT p.*, {_DEFAULT_POINTS}
        FROM detail_gold e JOIN delinq_gold d ON d.member_id = e.member_id JOIN ph p ON p.member_id = e.member_id""",
    "fh": f"""
        SELECT h.*, {_health('')}
        FROM ldh h JOIN loans_data l ON l.member_id = h.member_id
        JOIN customers_gold a ON a.member_id = h.member_id""",
    "weighed": f"SELECT member_id, {_PARTS} FROM fh",
    "scored": f"SELECT *, {_SCORE} FROM weighed",
    "graded": f"SELECT *, {_LETTER} FROM scored",
    "loan_points": f"""
        SELECT l.member_id, l.loan_id, {_LAST} AS last_payment_pts, {_TOTAL} AS total_payment_pts,
          {_DEFAULT_POINTS}, {_health('')}
        FROM repayment_data r JOIN loans_data l ON CAST(l.loan_id AS BIGINT) = r.loan_id
        JOIN detail_gold e ON e.member_id = l.member_id JOIN delinq_gold d ON d.member_id = l.member_id
        JOIN customers_gold a ON a.member_id = l.member_id""",
    "delinq_or_none": """
        SELECT e.member_id, CASE WHEN d.member_id IS NULL THEN 0 ELSE d.delinq_2yrs END AS delinq_2yrs
        FROM detail_gold e LEFT JOIN delinq_gold d ON d.member_id = e.member_id""",
    "all_loan_points": f"""
        SELECT l.member_id, l.loan_id, {_LAST} AS last_payment_pts, {_TOTAL} AS total_payment_pts,
          {_DEFAULT_POINTS}, {_health('')}
        FROM repayment_data r JOIN loans_data l ON CAST(l.loan_id AS BIGINT) = r.loan_id
        JOIN detail_gold e ON e.member_id = l.member_id JOIN delinq_or_none d ON d.member_id = l.member_id
        JOIN customers_gold a ON a.member_id = l.member_id""",
}

_WIDE = """
SELECT c.*, l.loan_id, l.* EXCLUDE (loan_id, member_id, loan_title),
  r.* EXCLUDE (loan_id, total_payment_received, last_payment_amount), d.* EXCLUDE (member_id), e.* EXCLUDE (member_id)
FROM {c} c LEFT JOIN {e} e USING (member_id) LEFT JOIN {d} d USING (member_id)
LEFT JOIN loans_data l ON l.member_id = c.member_id
LEFT JOIN repayment_data r ON r.loan_id = TRY_CAST(l.loan_id AS BIGINT)
"""


def _profile(source: str, columns: str, checks: dict[str, str]) -> str:
    counts = ["count(*) AS row_count"]
    counts += [f"count({c}) AS {c}_count" for c in columns.split(", ")]
    counts += [f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in checks.items()]
    return f"SELECT {', '.join(counts)} FROM {source}"


def _frequencies(column: str, source: str) -> str:
    return f"SELECT {column}, count(*) AS total FROM {source} GROUP BY {column} ORDER BY total DESC, {column}"


def _loan_scores(points: str) -> str:
    return (
        f"SELECT *, {_LETTER} FROM (SELECT *, {_SCORE} FROM (SELECT member_id, loan_id, {_PARTS} FROM {points}) w) s"
    )


def _tally(columns: str, source: str) -> str:
    return f"SELECT {columns}, {_COUNT} FROM {source} GROUP BY {columns}"


_CUSTOMER_RAW = (
    "member_id, emp_title, emp_length, home_ownership, annual_inc, addr_state, zip_code, country, grade, sub_grade, "
    "verification_status, tot_hi_cred_lim, application_type, annual_inc_joint, verification_status_joint"
)
_LOAN_RAW = (
    "loan_id, member_id, loan_amount, funded_amount, loan_term_months, interest_rate, monthly_installment, "
    "issue_date, loan_status, loan_purpose, loan_title"
)
_REPAYMENT_RAW = (
    "loan_id, total_principal_received, total_interest_received, total_late_fee_received, total_payment_received, "
    "last_payment_amount, last_payment_date, next_payment_date"
)
_DEFAULTER_RAW = (
    "member_id, delinq_2yrs, delinq_amnt, pub_rec, pub_rec_bankruptcies, inq_last_6mths, total_rec_late_fee, "
    "mths_since_last_delinq, mths_since_last_record"
)
_STATES = "SELECT member_id, addr_state FROM fx_borrowers WHERE addr_state NOT IN "
_DUPLICATES = "SELECT member_id FROM {} GROUP BY member_id HAVING count(*) > 1"
_DISTINCT_BORROWERS = "(SELECT DISTINCT * FROM fx_borrowers)"
_BOTH_DUPLICATES = (
    f"{_DUPLICATES.format(_DISTINCT_BORROWERS)} UNION {_DUPLICATES.format('fx_defaulters')}"
)
_ALL_POINTS = (
    "member_id, last_payment_pts, total_payment_pts, delinq_pts, public_records_pts, public_bankruptcies_pts, enq_pts, "
    "loan_status_pts, home_pts, credit_limit_pts, grade_pts"
)
_INCOME = f"""SELECT member_id, emp_title,
  CASE WHEN regexp_matches(annual_inc, {_NUMBER}) THEN CAST(annual_inc AS DOUBLE) END AS annual_inc,
  CASE WHEN annual_inc_joint >= 0 THEN annual_inc_joint END AS annual_inc_joint FROM fx_borrowers"""
_TENURE = (
    "SELECT member_id, emp_title, "
    "TRY_CAST(nullif(regexp_replace(emp_length, '\\D', '', 'g'), '') AS INTEGER) AS emp_length FROM fx_borrowers"
)

_TEXT_COLUMNS = {
    "customers": "member_id emp_title emp_length home_ownership annual_inc addr_state zip_code country grade sub_grade "
    "verification_status tot_hi_cred_lim application_type annual_inc_joint verification_status_joint",
    "loans": "loan_id member_id loan_term_months issue_date loan_status loan_purpose loan_title",
    "repayments": "last_payment_date next_payment_date",
    "defaulters": "member_id",
}
_TEXT_COPIES = " UNION ALL ".join(
    f"SELECT '{entity}' AS entity, concat_ws('|', "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns.split())
    + f") AS line FROM fx_{'borrowers' if entity == 'customers' else entity}"
    for entity, columns in _TEXT_COLUMNS.items()
)

_SUPPLIER_PAIRS = """SELECT k, count(*) AS pairs, count(DISTINCT (l_orderkey, l_linenumber)) FILTER (l_orderkey IS NOT NULL) AS lines,
  CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(c_custkey) AS BIGINT) AS customers
FROM (SELECT l_suppkey AS k, l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 7) l
{how} JOIN (SELECT c_custkey % 50 AS k, c_custkey FROM customer) c USING (k) GROUP BY k"""

_FINAL = {
    "rename_columns": "SELECT * RENAME (annual_inc AS annual_income, addr_state AS address_state, "
    "zip_code AS address_zipcode, country AS address_country, tot_hi_cred_lim AS total_high_credit_limit, "
    "annual_inc_joint AS joint_annual_income) FROM fx_borrowers",
    "stamp_ingest": "SELECT loan_id, '2024-01-01 00:00:00' AS ingested FROM fx_loans",
    "validated_income": _INCOME,
    "require_income": f"SELECT * FROM ({_INCOME}) WHERE annual_inc IS NOT NULL",
    "digits_to_int": _TENURE,
    "impute_floor_mean": f"SELECT member_id, emp_title, coalesce(emp_length, CAST((SELECT floor(avg(emp_length)) "
    f"FROM ({_TENURE})) AS INTEGER)) AS emp_length FROM ({_TENURE})",
    "clamp_state": "SELECT member_id, emp_title, CASE WHEN length(addr_state) > 2 THEN 'NA' ELSE addr_state END "
    "AS addr_state FROM fx_borrowers",
    "drop_exact_duplicates": "SELECT DISTINCT * FROM fx_borrowers",
    "customers_silver": "SELECT * FROM customers_data",
    "drop_incomplete_loans": f"SELECT * FROM fx_loans WHERE {_LOAN_COMPLETE}",
    "term_to_years": "SELECT loan_id, CAST(trunc(CAST(regexp_extract(loan_term_months, '[0-9]+') AS INTEGER) / 12.0) "
    "AS INTEGER) AS loan_term_years FROM fx_loans",
    "canonical_purpose": f"SELECT loan_id, CASE WHEN loan_purpose IN ({_PURPOSES}) THEN loan_purpose ELSE 'other' END "
    "AS loan_purpose FROM fx_loans",
    "loans_silver": "SELECT * FROM loans_data",
    "loans_silver_validated": "SELECT * FROM loans_data WHERE interest_rate <= 20",
    "drop_incomplete_repayments": f"SELECT * FROM fx_repayments WHERE {_PAYMENT_COMPLETE}",
    "repair_total": "SELECT * FROM repaired",
    "drop_zero": "SELECT * FROM repaired WHERE total_payment_received <> 0",
    "sentinel_to_null": "SELECT loan_id, nullif(last_payment_date, '0.0') AS last_payment_date, "
    "nullif(next_payment_date, '0.0') AS next_payment_date FROM fx_repayments",
    "pattern_or_null": "SELECT loan_id, nullif(last_payment_date, '0.0') AS last_payment_date, "
    "nullif(next_payment_date, '0.0') AS next_payment_date FROM fx_repayments WHERE next_payment_date IS NULL "
    "OR next_payment_date = '0.0' OR regexp_matches(next_payment_date, "
    "'^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\\d{4}$')",
    "repayments_silver": "SELECT * FROM repayment_data",
    "int_or_zero": f"SELECT * REPLACE ({_whole('delinq_2yrs')} AS delinq_2yrs, {_whole('pub_rec')} AS pub_rec, "
    f"{_whole('pub_rec_bankruptcies')} AS pub_rec_bankruptcies, {_whole('inq_last_6mths')} AS inq_last_6mths) "
    "FROM fx_defaulters",
    "delinquent_members": "SELECT * FROM delinq_data",
    "record_or_enquiry_members": "SELECT member_id FROM fx_defaulters "
    "WHERE pub_rec > 0 OR pub_rec_bankruptcies > 0 OR inq_last_6mths > 0",
    "record_enquiry_detail": "SELECT * FROM detail_data",
    "profile_customers": _profile(
        "fx_borrowers",
        _CUSTOMER_RAW,
        {
            "income_missing": "annual_inc IS NULL",
            "state_too_long": "length(addr_state) > 2",
            "tenure_missing": "emp_length IS NULL",
        },
    ),
    "profile_loans": _profile("fx_loans", _LOAN_RAW, {"amount_missing": "loan_amount IS NULL"}),
    "profile_repayments": _profile(
        "fx_repayments",
        _REPAYMENT_RAW,
        {
            "principal_missing": "total_principal_received IS NULL",
            "total_zero": "total_payment_received = 0",
            "total_contradicted": "total_payment_received = 0 AND total_principal_received <> 0",
            "last_date_sentinel": "last_payment_date = '0.0'",
            "next_date_sentinel": "next_payment_date = '0.0'",
        },
    ),
    "profile_defaulters": _profile(
        "fx_defaulters", _DEFAULTER_RAW, {"delinquencies_missing": "delinq_2yrs IS NULL"}
    ),
    "purpose_frequencies": _frequencies("loan_purpose", "fx_loans"),
    "cleaned_purpose_frequencies": _frequencies("loan_purpose", "loans_data"),
    "delinquency_frequencies": _frequencies(
        "delinq_2yrs", f"(SELECT {_whole('delinq_2yrs')} AS delinq_2yrs FROM fx_defaulters)"
    ),
    "payment_date_frequencies": _frequencies("next_payment_date", "repaired WHERE total_payment_received <> 0"),
    "member_frequencies": _frequencies("member_id", "fx_borrowers"),
    "event_type_frequencies": _frequencies("event_type", "events"),
    "language_frequencies": _frequencies("lang", "documents"),
    "distinct_states": "SELECT DISTINCT addr_state FROM fx_borrowers",
    "distinct_purposes": "SELECT DISTINCT loan_purpose FROM fx_loans",
    "rows_for_key_prefix": "SELECT * FROM fx_borrowers WHERE member_id LIKE '10%'",
    "contradicted_totals": "SELECT * FROM fx_repayments WHERE total_payment_received = 0 "
    "AND total_principal_received <> 0",
    "preview_loans": "SELECT * FROM fx_loans ORDER BY loan_amount DESC, loan_id LIMIT 20",
    "merged_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, true AS distinct_within, "
        f"{'NULL' if c == 'o_orderpriority' else 'true'} AS median_within FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    ),
    "profile_drift": "SELECT * FROM (VALUES ('loan_id', 'same'), ('loan_amount', 'same'), ('interest_rate', 'changed'), "
    "('loan_purpose', 'changed'), ('loan_title', 'removed'), ('loan_grade', 'added')) AS t(\"column\", state)",
    "top_parts": "SELECT l_partkey, count(*) AS total FROM lineitem GROUP BY ALL ORDER BY total DESC, l_partkey LIMIT 25",
    "top_members": "SELECT member_id, count(*) AS total FROM fx_loans GROUP BY ALL ORDER BY total DESC, member_id LIMIT 40",
    "drop_exact_duplicates_filtered": "SELECT DISTINCT * FROM fx_borrowers",
    "duplicate_keys": _DUPLICATES.format(_DISTINCT_BORROWERS),
    "duplicate_defaulters": _DUPLICATES.format("fx_defaulters"),
    "duplicate_lines": "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "duplicate_keys_filtered": _DUPLICATES.format(_DISTINCT_BORROWERS),
    "duplicate_lines_filtered": "SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "exclude_keys_filtered": f"SELECT * FROM fx_borrowers WHERE member_id NOT IN ({_BOTH_DUPLICATES})",
    "exclude_lines_filtered": "SELECT l_orderkey, l_linenumber FROM lineitem "
    "WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)",
    "union_distinct_keys": _BOTH_DUPLICATES,
    "exclude_keys": f"SELECT * FROM fx_borrowers WHERE member_id NOT IN ({_BOTH_DUPLICATES})",
    "exclude_keys_null_on_left": f"{_STATES} (SELECT addr_state FROM fx_borrowers WHERE length(addr_state) > 2)",
    "exclude_keys_null_in_list": f"{_STATES} (SELECT addr_state FROM fx_borrowers WHERE addr_state = 'TX' "
    "OR addr_state IS NULL)",
    "exclude_keys_null_ignored": f"{_STATES} (SELECT addr_state FROM fx_borrowers WHERE addr_state = 'TX')",
    "exclude_keys_empty_list": f"{_STATES} (SELECT addr_state FROM fx_borrowers WHERE addr_state = 'none')",
    "quarantined_members": "SELECT member_id FROM bad_members",
    "customers_cleaned": "SELECT * FROM customers_gold",
    "delinquent_members_cleaned": "SELECT * FROM delinq_gold",
    "record_enquiry_detail_cleaned": "SELECT * FROM detail_gold",
    "wide_view_silver": _WIDE.format(c="customers_data", d="delinq_data", e="detail_data"),
    "wide_view_cleaned": _WIDE.format(c="customers_gold", d="delinq_gold", e="detail_gold"),
    "wide_view_small_slices": _WIDE.format(c="customers_data", d="delinq_data", e="detail_data"),
    "wide_view_refreshed": _WIDE.format(c="customers_data", d="delinq_data", e="detail_data"),
    "grid_join_inner": _SUPPLIER_PAIRS.format(how="INNER"),
    "grid_join_full": _SUPPLIER_PAIRS.format(how="FULL"),
    "wide_catalog_view": _WIDE.format(c="customers_data", d="delinq_data", e="detail_data"),
    "last_payment_points": f"SELECT l.loan_id, {_LAST} AS last_payment_pts FROM fx_repayments r "
    "JOIN fx_loans l ON CAST(l.loan_id AS BIGINT) = r.loan_id",
    "total_payment_points": f"SELECT l.loan_id, {_TOTAL} AS total_payment_pts FROM fx_repayments r "
    "JOIN fx_loans l ON CAST(l.loan_id AS BIGINT) = r.loan_id",
    "count_band_points": "SELECT member_id, delinq_amnt, "
    + ", ".join(
        f"{_band(f'CAST(trunc({c}) AS INTEGER)', unknown)} AS {name}"
        for c, unknown, name in (
            ("delinq_2yrs", 0, "delinq_pts"),
            ("pub_rec", 100, "public_records_pts"),
            ("pub_rec_bankruptcies", 100, "public_bankruptcies_pts"),
            ("inq_last_6mths", 0, "enq_pts"),
        )
    )
    + " FROM fx_defaulters",
    "loan_status_points": f"SELECT loan_id, {_STATUS.format(c='loan_status')} AS loan_status_pts FROM fx_loans",
    "home_points": f"SELECT member_id, emp_title, {_HOME.format(c='home_ownership')} AS home_pts FROM fx_borrowers",
    "credit_limit_points": "SELECT l.loan_id, "
    f"{_LIMIT.format(f='l.funded_amount', t='b.tot_hi_cred_lim')} AS credit_limit_pts FROM fx_loans l "
    "JOIN (SELECT DISTINCT member_id, tot_hi_cred_lim FROM fx_borrowers) b ON b.member_id = l.member_id",
    "grade_points": f"SELECT member_id, emp_title, {_GRADE} AS grade_pts FROM fx_borrowers",
    "payment_points": "SELECT * FROM ph",
    "default_points": "SELECT * FROM ldh",
    "health_points": _tally(_ALL_POINTS, "fh"),
    "weighted_score": _tally(f"member_id, {_NEAT_PARTS}, loan_score", "scored"),
    "final_grade": f"SELECT member_id, loan_score, {_LETTER}, row_count FROM "
    f"({_tally(f'member_id, {_NEAT_PARTS}, loan_score', 'scored')})",
    "member_scores": _tally(f"member_id, {_NEAT_PARTS}, loan_score, loan_final_grade", "graded"),
    "score_by_loan": _loan_scores("loan_points"),
    "score_with_clean_members": _loan_scores("all_loan_points"),
    "grade_report": _tally(
        f"member_id, {_NEAT_PARTS}, loan_score, loan_final_grade", "(SELECT * FROM graded WHERE loan_final_grade = 'C')"
    ),
    "grade_counts": "SELECT loan_final_grade, CAST(count(*) AS DECIMAL(38,0)) AS total FROM graded "
    "GROUP BY loan_final_grade",
    "declared_csv_scan": "SELECT * FROM fx_loans",
    "inferred_csv_scan": "SELECT * FROM fx_repayments",
    "mixed_csv_scan": "SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents",
    "published_versions": "SELECT stage, loan_id, loan_amount FROM loans_data, (VALUES ('first'), ('failed'), ('second')) AS s(stage) "
    "WHERE stage = 'second' OR loan_term_years = 3",
    "run_from_files_published": _loan_scores("loan_points"),
    "manifest_ingest": _TEXT_COPIES,
    "external_table_roundtrip": "SELECT * FROM loans_data",
    "external_table_repointed": "SELECT * FROM loans_data",
    "run_from_files": _loan_scores("loan_points"),
    "run_from_files_decimal": _loan_scores("loan_points"),
    "customers_legacy_text": "SELECT member_id, emp_title, annual_income, total_high_credit_limit FROM customers_typed "
    "WHERE annual_income < 1e7 AND (annual_income = 0 OR annual_income >= 1e-3)",
}


def _with_steps(query: str) -> str:
    needed: set[str] = set()
    waiting = [query]
    while waiting:
        text = waiting.pop()
        for name in STEPS.keys() - needed:
            if re.search(rf"\b{name}\b", text):
                needed.add(name)
                waiting.append(STEPS[name])
    steps = [f"{name} AS ({sql.strip()})" for name, sql in STEPS.items() if name in needed]
    return f"WITH {', '.join(steps)} {query.strip()}" if steps else query.strip()


_SCORES = ("payment_history_pts", "defaulters_history_pts", "financial_health_pts", "loan_score")
# Columns that are decimals in the rules and doubles in the result.
_DECIMALS = {
    "grade_points": ("grade_pts",),
    "health_points": ("grade_pts", "row_count"),
    "weighted_score": (*_SCORES, "row_count"),
    "final_grade": ("loan_score", "row_count"),
    "member_scores": (*_SCORES, "row_count"),
    "grade_report": (*_SCORES, "row_count"),
    "grade_counts": ("total",),
    "score_by_loan": _SCORES,
    "score_with_clean_members": _SCORES,
    "run_from_files": _SCORES,
    "run_from_files_decimal": _SCORES,
    "run_from_files_published": _SCORES,
}


def _as_doubles(name: str, query: str) -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _DECIMALS.get(name, ()))
    return f"SELECT * REPLACE ({casts}) FROM ({query})" if casts else query


ORACLES = {name: _with_steps(_as_doubles(name, query)) for name, query in _FINAL.items()}
