"""Scores against the joins spelled out row by row, and on members with very many loans."""

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.fixtures import BY_ENTITY, fixture
from creditmill.operators.tally import ROW_COUNT, repeat_rows, tally_rows
from creditmill.params import DEFAULT_SCORE, ScoreParams
from creditmill.plans import quarantine, score, silver
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("score")
    raw = {e: fixture(spark, sf_dir, e) for e in BY_ENTITY}
    cleaned = {
        "customers": silver.customers_silver(raw["customers"], "2024-01-01"),
        "loans": silver.loans_silver(raw["loans"], "2024-01-01"),
        "repayments": silver.repayments_silver(raw["repayments"], "2024-01-01"),
        "delinquent": silver.delinquent_members(raw["defaulters"]),
        "detail": silver.record_enquiry_detail(raw["defaulters"]),
    }
    for name, df in cleaned.items():
        df.write.parquet(f"{base}/{name}")
    return {name: spark.read.parquet(f"{base}/{name}") for name in cleaned}


@pytest.fixture(scope="module")
def quarantined(spark, tables, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('quarantine')}/members"
    keyed = {n: tables[n] for n in ("customers", "delinquent", "detail")}
    quarantine.find_quarantined(keyed).members.write.parquet(path)
    return spark.read.parquet(path)


def literal_points(tables, quarantined):
    """Every payment of a member with every loan of that member, one row per pair."""
    bad = [r.member_id for r in quarantined.collect()]
    payments = score.payment_points(tables["repayments"], tables["loans"])
    members = score.member_default_points(tables["detail"], tables["delinquent"])
    health = score.member_loan_points(tables["loans"], tables["customers"])
    return (
        payments.join(members, "member_id").join(health, "member_id").filter(~F.col("member_id").isin(bad))
    )


def test_tallied_member_scores_are_the_literal_rows(tables, quarantined):
    literal = score.with_final_grade(score.weighted_score(literal_points(tables, quarantined)))
    tallied = score.score_members(**tables, quarantined=quarantined)
    assert literal.count() > tallied.count() > 0
    assert rows(repeat_rows(tallied)) == rows(literal)
    assert rows(tallied) == rows(tally_rows(literal))


def test_slices_do_not_change_scores(tables, quarantined):
    for scored in (score.score_members, score.score_by_loan):
        usual = rows(scored(**tables, quarantined=quarantined))
        assert rows(scored(**tables, quarantined=quarantined, rows_per_slice=2)) == usual


def test_types_of_the_score(tables):
    kinds = dict(score.score_members(**tables).dtypes)
    assert kinds == {
        "member_id": "string",
        "payment_history_pts": "decimal(13,2)",
        "defaulters_history_pts": "decimal(13,2)",
        "financial_health_pts": "decimal(15,3)",
        "loan_score": "decimal(16,3)",
        "loan_final_grade": "string",
        "row_count": "decimal(38,0)",
    }


def test_score_is_the_sum_of_its_parts(tables, quarantined):
    scored = score.score_by_loan(**tables, quarantined=quarantined)
    wrong = scored.filter(
        "loan_score <> payment_history_pts + defaulters_history_pts + financial_health_pts "
        "or (loan_score is null) <> (loan_final_grade is null)"
    )
    assert wrong.count() == 0


def test_excluding_the_small_table_excludes_everywhere(tables, quarantined):
    bad = {r.member_id for r in quarantined.collect()}
    assert bad
    scored = {r.member_id for r in score.score_by_loan(**tables, quarantined=quarantined).collect()}
    assert not scored & bad
    keyed = {n: tables[n] for n in ("customers", "delinquent", "detail")}
    gold = {**tables, **quarantine.without_quarantined(keyed, quarantined)}
    assert rows(score.score_by_loan(**gold)) == rows(score.score_by_loan(**tables, quarantined=quarantined))


def test_a_null_in_the_quarantine_list_excludes_all(spark, tables):
    listed = spark.createDataFrame([(None,)], "member_id string")
    assert score.score_members(**tables, quarantined=listed).count() == 0
    assert score.payment_points(tables["repayments"], tables["loans"], listed).count() == 0


def test_clean_members_are_scored_on_request(tables, quarantined):
    usual = score.score_by_loan(**tables, quarantined=quarantined)
    more = score.score_by_loan(**tables, quarantined=quarantined, include_clean=True)
    added = more.join(usual.select("member_id").distinct(), "member_id", "left_anti")
    delinquent = tables["delinquent"].select("member_id")
    assert added.count() > 0
    assert added.join(delinquent, "member_id").count() == 0
    assert rows(more.join(delinquent.distinct(), "member_id", "left_semi")) == rows(usual)


def test_malformed_loan_ids_match_nothing(spark):
    loans = spark.createDataFrame(
        [("1", "m", 100.0, 1000.0), ("x1", "m", 100.0, 1000.0), (None, "m", 100.0, 1000.0)],
        "loan_id string, member_id string, monthly_installment double, funded_amount double",
    )
    repayments = spark.createDataFrame(
        [(1, 100.0, 600.0), (2, 1.0, 1.0), (None, 1.0, 1.0)],
        "loan_id bigint, last_payment_amount double, total_payment_received double",
    )
    assert rows(score.payment_points(repayments, loans)) == [("m", 500, 650)]


def test_weights_and_points_are_parameters(tables, quarantined):
    double = replace(DEFAULT_SCORE, payment_weight=Decimal("0.40"))
    before = score.score_by_loan(**tables, quarantined=quarantined)
    after = score.score_by_loan(**tables, quarantined=quarantined, params=double)
    pairs = zip(rows(before.select("loan_id", "payment_history_pts")), rows(after.select("loan_id", "payment_history_pts")))
    assert all(a[0] == b[0] and (a[1] is None or b[1] == 2 * a[1]) for a, b in pairs)
    assert ScoreParams().excellent == 800


def member_tables(spark, members):
    """Member tables in which every member scores alike."""
    base = spark.createDataFrame([(m,) for m in members], "member_id string")
    return {
        "customers": base.select(
            "member_id",
            F.lit("OWN").alias("home_ownership"),
            F.lit("A").alias("grade"),
            F.lit("A1").alias("sub_grade"),
            F.lit(100000.0).alias("total_high_credit_limit"),
        ),
        "delinquent": base.select("member_id", F.lit(1).alias("delinq_2yrs")),
        "detail": base.select(
            "member_id",
            F.lit(0).alias("pub_rec"),
            F.lit(0).alias("pub_rec_bankruptcies"),
            F.lit(0).alias("inq_last_6mths"),
        ),
    }


def test_a_member_with_very_many_loans(spark):
    """400,000 loans of one member make 160,000,000,000 pairs: all counted, none produced."""
    n = 400_000
    ids = spark.range(n)
    loans = ids.select(
        F.col("id").cast("string").alias("loan_id"),
        F.when(F.col("id") < n - 10, "hot").otherwise(F.concat(F.lit("m"), F.col("id"))).alias("member_id"),
        F.lit(100.0).alias("monthly_installment"),
        F.lit(1000.0).alias("funded_amount"),
        F.when(F.col("id") % 2 == 0, "Current").otherwise("Fully Paid").alias("loan_status"),
    )
    repayments = ids.select(
        F.col("id").alias("loan_id"),
        F.when(F.col("id") % 4 == 0, 100.0).otherwise(200.0).alias("last_payment_amount"),
        F.lit(600.0).alias("total_payment_received"),
    )
    tables = member_tables(spark, ["hot"] + [f"m{i}" for i in range(n - 10, n)])
    scored = score.score_members(loans=loans, repayments=repayments, **tables, rows_per_slice=10_000)
    got = {r.payment_history_pts: r["sum(row_count)"] for r in (
        scored.filter("member_id = 'hot'").groupBy("payment_history_pts").sum(ROW_COUNT).collect()
    )}
    hot = n - 10
    some = (hot + 3) // 4
    assert got == {Decimal("230.00"): some * hot, Decimal("290.00"): (hot - some) * hot}
    assert scored.filter("member_id <> 'hot'").agg(F.sum(ROW_COUNT)).first()[0] == 10
    assert scored.count() <= 4 + 10


def test_a_loan_with_very_many_repayments(spark):
    n = 100_000
    loans = spark.createDataFrame(
        [("1", "m1", 100.0, 1000.0, "Current"), ("2", "m2", 100.0, 1000.0, "Current")],
        "loan_id string, member_id string, monthly_installment double, funded_amount double, loan_status string",
    )
    repayments = spark.range(n).select(
        F.when(F.col("id") == 0, 2).otherwise(1).cast("bigint").alias("loan_id"),
        F.lit(100.0).alias("last_payment_amount"),
        F.lit(600.0).alias("total_payment_received"),
    )
    tables = member_tables(spark, ["m1", "m2"])
    scored = score.score_members(loans=loans, repayments=repayments, **tables, rows_per_slice=1000)
    assert {r.member_id: int(r.row_count) for r in scored.collect()} == {"m1": n - 1, "m2": 1}
    by_loan = score.score_by_loan(loans=loans, repayments=repayments, **tables, rows_per_slice=1000)
    assert by_loan.count() == n


def test_grade_report(tables, quarantined):
    scored = score.score_members(**tables, quarantined=quarantined)
    counts = {r.loan_final_grade: r.total for r in score.grade_counts(scored).collect()}
    total = scored.agg(F.sum(ROW_COUNT)).first()[0]
    assert sum(counts.values()) == total
    assert {r.loan_final_grade for r in score.grade_report(scored, "C").collect()} == {"C"}
    by_loan = score.score_by_loan(**tables, quarantined=quarantined)
    assert sum(r.total for r in score.grade_counts(by_loan).collect()) == by_loan.count()
