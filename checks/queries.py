"""Registered queries: every operator over the tables in a scale-factor folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import BY_ENTITY, fixture
from checks.workdir import work_dir
from creditmill import schemas
from creditmill.functions import points as P
from creditmill.operators import bitfilters
from creditmill.operators import cleaning as ops
from creditmill.operators import profiles, quality
from creditmill.operators.joins import grid_join, skew_join
from creditmill.params import DEFAULT_SCORE, LOAN_REQUIRED, REPAYMENT_REQUIRED
from creditmill.plans import batch, score, silver
from creditmill.plans.published import PublishedLake
from creditmill.plans.wide import WIDE_COLUMNS, wide_view
from creditmill.plans.wide_store import SOURCES, WideStore
from creditmill.sources import catalog, delimited, manifest, zones

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

INGESTED_AT = "2024-01-01 00:00:00"


def decimals_as_doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles: clients differ in the Python type they give a decimal."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: decimals_as_doubles(fn(spark, sf_dir))
    return fn


# --- inputs ----------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


customers = partial(fixture, entity="customers")
loans = partial(fixture, entity="loans")
repayments = partial(fixture, entity="repayments")
defaulters = partial(fixture, entity="defaulters")

_LAKES: dict[tuple[str, str], batch.Lake] = {}


def build_lake(spark: SparkSession, sf_dir: str) -> batch.Lake:
    """Silver, quarantine and gold zones of the derived tables, in a new folder."""
    lake = batch.Lake(work_dir(spark))
    batch.build_silver(spark, lake, {e: fixture(spark, sf_dir, e) for e in BY_ENTITY}, INGESTED_AT)
    batch.build_quarantine(spark, lake)
    batch.build_gold(spark, lake)
    return lake


def shared_lake(spark: SparkSession, sf_dir: str) -> batch.Lake:
    """The same zones, built once per application for all queries that start from them."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _LAKES:
        _LAKES[at] = build_lake(spark, sf_dir)
    return _LAKES[at]


# --- cleaning: customers ---------------------------------------------------------
@query
def rename_columns(spark, sf_dir):
    return ops.rename_columns(customers(spark, sf_dir), {**schemas.CUSTOMER_RENAMES, "no_such_column": "x"})


@query
def stamp_ingest(spark, sf_dir):
    stamped = ops.stamp_ingest(loans(spark, sf_dir), INGESTED_AT)
    return stamped.select("loan_id", F.date_format("ingest_date", "yyyy-MM-dd HH:mm:ss").alias("ingested"))


@query
def validated_income(spark, sf_dir):
    checked = ops.validated_numeric(customers(spark, sf_dir), ["annual_inc", "annual_inc_joint"])
    return checked.select("member_id", "emp_title", "annual_inc", "annual_inc_joint")


@query
def require_income(spark, sf_dir):
    return ops.require_not_null(validated_income(spark, sf_dir), ["annual_inc"])


@query
def digits_to_int(spark, sf_dir):
    return ops.digits_to_int(customers(spark, sf_dir), "emp_length").select("member_id", "emp_title", "emp_length")


@query
def impute_floor_mean(spark, sf_dir):
    return ops.impute_floor_mean(digits_to_int(spark, sf_dir), "emp_length")


@query
def clamp_state(spark, sf_dir):
    return ops.clamp_code_length(customers(spark, sf_dir).select("member_id", "emp_title", "addr_state"), "addr_state")


@query
def drop_exact_duplicates(spark, sf_dir):
    return ops.drop_exact_duplicates(customers(spark, sf_dir))


@query
def customers_silver(spark, sf_dir):
    return silver.customers_silver(customers(spark, sf_dir), INGESTED_AT).drop("ingest_date")


# --- cleaning: loans -------------------------------------------------------------
@query
def drop_incomplete_loans(spark, sf_dir):
    return ops.require_not_null(loans(spark, sf_dir), LOAN_REQUIRED)


@query
def term_to_years(spark, sf_dir):
    return ops.term_to_years(
        loans(spark, sf_dir).select("loan_id", "loan_term_months"), "loan_term_months", "loan_term_years"
    )


@query
def canonical_purpose(spark, sf_dir):
    return ops.canonicalize(loans(spark, sf_dir).select("loan_id", "loan_purpose"), "loan_purpose")


@query
def loans_silver(spark, sf_dir):
    return silver.loans_silver(loans(spark, sf_dir), INGESTED_AT).drop("ingest_date")


@query
def loans_silver_validated(spark, sf_dir):
    raw = loans(spark, sf_dir).withColumn(
        "interest_rate", F.when(F.col("interest_rate") > 20, -F.col("interest_rate")).otherwise(F.col("interest_rate"))
    )
    return silver.loans_silver(raw, INGESTED_AT, validate=True).drop("ingest_date")


# --- cleaning: repayments --------------------------------------------------------
@query
def drop_incomplete_repayments(spark, sf_dir):
    return ops.require_not_null(repayments(spark, sf_dir), REPAYMENT_REQUIRED)


@query
def repair_total(spark, sf_dir):
    return ops.repair_total(
        repayments(spark, sf_dir),
        "total_payment_received",
        "total_principal_received",
        "total_interest_received",
        "total_late_fee_received",
    )


@query
def drop_zero(spark, sf_dir):
    return ops.drop_zero(repair_total(spark, sf_dir), "total_payment_received")


@query
def sentinel_to_null(spark, sf_dir):
    return ops.sentinel_to_null(
        repayments(spark, sf_dir).select("loan_id", "last_payment_date", "next_payment_date"),
        ["last_payment_date", "next_payment_date"],
    )


@query
def pattern_or_null(spark, sf_dir):
    return ops.require_pattern_or_null(sentinel_to_null(spark, sf_dir), "next_payment_date")


@query
def repayments_silver(spark, sf_dir):
    return silver.repayments_silver(repayments(spark, sf_dir), INGESTED_AT).drop("ingest_date")


# --- cleaning: defaulters --------------------------------------------------------
@query
def int_or_zero(spark, sf_dir):
    return ops.int_or_zero(
        defaulters(spark, sf_dir), ["delinq_2yrs", "pub_rec", "pub_rec_bankruptcies", "inq_last_6mths"]
    )


@query
def delinquent_members(spark, sf_dir):
    return silver.delinquent_members(defaulters(spark, sf_dir))


@query
def record_or_enquiry_members(spark, sf_dir):
    return silver.record_or_enquiry_members(defaulters(spark, sf_dir))


@query
def record_enquiry_detail(spark, sf_dir):
    return silver.record_enquiry_detail(defaulters(spark, sf_dir))


# --- profiles --------------------------------------------------------------------
@query
def profile_customers(spark, sf_dir):
    df = customers(spark, sf_dir)
    return quality.profile_counts(
        df,
        {
            "income_missing": F.col("annual_inc").isNull(),
            "state_too_long": F.length("addr_state") > 2,
            "tenure_missing": F.col("emp_length").isNull(),
        },
    )


@query
def profile_loans(spark, sf_dir):
    return quality.profile_counts(loans(spark, sf_dir), {"amount_missing": F.col("loan_amount").isNull()})


@query
def profile_repayments(spark, sf_dir):
    df = repayments(spark, sf_dir)
    return quality.profile_counts(
        df,
        {
            "principal_missing": F.col("total_principal_received").isNull(),
            "total_zero": F.col("total_payment_received") == 0.0,
            "total_contradicted": (F.col("total_payment_received") == 0.0)
            & (F.col("total_principal_received") != 0.0),
            "last_date_sentinel": F.col("last_payment_date") == "0.0",
            "next_date_sentinel": F.col("next_payment_date") == "0.0",
        },
    )


@query
def profile_defaulters(spark, sf_dir):
    return quality.profile_counts(
        defaulters(spark, sf_dir), {"delinquencies_missing": F.col("delinq_2yrs").isNull()}
    )


@query
def purpose_frequencies(spark, sf_dir):
    return quality.value_frequencies(loans(spark, sf_dir), "loan_purpose")


@query
def cleaned_purpose_frequencies(spark, sf_dir):
    return quality.value_frequencies(loans_silver(spark, sf_dir), "loan_purpose")


@query
def delinquency_frequencies(spark, sf_dir):
    return quality.value_frequencies(ops.int_or_zero(defaulters(spark, sf_dir), ["delinq_2yrs"]), "delinq_2yrs")


@query
def payment_date_frequencies(spark, sf_dir):
    return quality.value_frequencies(drop_zero(spark, sf_dir), "next_payment_date")


@query
def member_frequencies(spark, sf_dir):
    return quality.value_frequencies(customers(spark, sf_dir), "member_id")


@query
def event_type_frequencies(spark, sf_dir):
    return quality.value_frequencies(table(spark, sf_dir, "events"), "event_type")


@query
def language_frequencies(spark, sf_dir):
    return quality.value_frequencies(table(spark, sf_dir, "documents"), "lang")


@query
def distinct_states(spark, sf_dir):
    return quality.distinct_values(customers(spark, sf_dir), "addr_state")


@query
def distinct_purposes(spark, sf_dir):
    return quality.distinct_values(loans(spark, sf_dir), "loan_purpose")


@query
def rows_for_key_prefix(spark, sf_dir):
    return quality.rows_with_prefix(customers(spark, sf_dir), "member_id", "10")


@query
def contradicted_totals(spark, sf_dir):
    return repayments(spark, sf_dir).filter("total_payment_received = 0.0 and total_principal_received != 0.0")


@query
def preview_loans(spark, sf_dir):
    return quality.preview(loans(spark, sf_dir), 20, F.desc("loan_amount"), "loan_id")


@query
def merged_profile(spark, sf_dir):
    """The profile of orders, merged from those of five parts, and whether its estimates are within their bounds."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    parts = [profiles.profile(df.filter(F.pmod("o_orderkey", F.lit(5)) == k)) for k in range(5)]
    report = profiles.profile_report(profiles.merge_profiles(*parts), (0.5,))
    middle = profiles.exact_percentiles(df, [c for c in df.columns if c != "o_orderpriority"], (0.5 - profiles.RANK_ERROR, 0.5 + profiles.RANK_ERROR))
    exact = []
    for c in df.columns:
        a, b = [F.lit(x).cast("double") for x in middle.get(c, (None, None))]
        exact.append(df.agg(F.countDistinct(c).alias("n")).select("n", a.alias("a"), b.alias("b"), F.lit(c).alias("name")))
    both = report.join(reduce(DataFrame.union, exact), F.col("column") == F.col("name"))
    median = F.element_at("quantiles", F.lit(0.5))
    return both.select(
        "column", "rows", "nulls",
        (F.abs(F.col("distinct_values") - F.col("n")) <= profiles.DISTINCT_ERROR * F.col("n")).alias("distinct_within"),
        F.when(F.col("column") != "o_orderpriority", median.between(F.floor("a"), F.ceil("b"))).alias("median_within"),
    )


@query
def profile_drift(spark, sf_dir):
    """Columns of loans whose values drift from one version of the table to the next."""
    old = loans(spark, sf_dir).select("loan_id", "loan_amount", "interest_rate", "loan_purpose", "loan_title")
    new = old.withColumn("interest_rate", F.col("interest_rate") + 4).withColumn("loan_purpose", F.when(F.col("loan_amount") > 150000, F.col("loan_purpose")))
    new = new.drop("loan_title").withColumn("loan_grade", F.lit("A"))
    return profiles.drift_report(profiles.profile(old), profiles.profile(new)).select("column", "state")


@query
def top_parts(spark, sf_dir):
    return profiles.top_values(table(spark, sf_dir, "lineitem"), "l_partkey", 25)


@query
def top_members(spark, sf_dir):
    return profiles.top_values(loans(spark, sf_dir), "member_id", 40)


@query
def drop_exact_duplicates_filtered(spark, sf_dir):
    return bitfilters.drop_exact_duplicates_filtered(customers(spark, sf_dir))


# --- quarantine ------------------------------------------------------------------
@query
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(ops.drop_exact_duplicates(customers(spark, sf_dir)), "member_id")


@query
def duplicate_defaulters(spark, sf_dir):
    return quality.duplicate_keys(defaulters(spark, sf_dir), "member_id")


@query
def duplicate_lines(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query
def union_distinct_keys(spark, sf_dir):
    return quality.union_distinct_keys(duplicate_keys(spark, sf_dir), duplicate_defaulters(spark, sf_dir))


@query
def exclude_keys(spark, sf_dir):
    return quality.exclude_keys(customers(spark, sf_dir), union_distinct_keys(spark, sf_dir), "member_id")


@query
def exclude_keys_filtered(spark, sf_dir):
    return bitfilters.exclude_keys_filtered(customers(spark, sf_dir), union_distinct_keys(spark, sf_dir), "member_id")


@query
def exclude_lines_filtered(spark, sf_dir):
    """Line items of orders that no large order is: most rows never meet the list."""
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return bitfilters.exclude_keys_filtered(table(spark, sf_dir, "lineitem"), large, "l_orderkey").select("l_orderkey", "l_linenumber")


@query
def duplicate_keys_filtered(spark, sf_dir):
    return bitfilters.duplicate_keys_filtered(ops.drop_exact_duplicates(customers(spark, sf_dir)), "member_id")


@query
def duplicate_lines_filtered(spark, sf_dir):
    return bitfilters.duplicate_keys_filtered(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def _null_states(spark, sf_dir):
    """Keys of which some are NULL: state codes of members with and without a long code."""
    return customers(spark, sf_dir).select("member_id", "addr_state")


@query
def exclude_keys_null_on_left(spark, sf_dir):
    rows = _null_states(spark, sf_dir)
    return quality.exclude_keys(rows, rows.filter(F.length("addr_state") > 2).select("addr_state"), "addr_state")


@query
def exclude_keys_null_in_list(spark, sf_dir):
    rows = _null_states(spark, sf_dir)
    listed = rows.filter("addr_state = 'TX' or addr_state is null").select("addr_state")
    return quality.exclude_keys(rows, listed, "addr_state")


@query
def exclude_keys_null_ignored(spark, sf_dir):
    rows = _null_states(spark, sf_dir)
    listed = rows.filter("addr_state = 'TX' or addr_state is null").select("addr_state")
    return quality.exclude_keys(rows, listed, "addr_state", null_aware=False)


@query
def exclude_keys_empty_list(spark, sf_dir):
    rows = _null_states(spark, sf_dir)
    return quality.exclude_keys(rows, rows.filter("addr_state = 'none'").select("addr_state"), "addr_state")


@query
def quarantined_members(spark, sf_dir):
    return shared_lake(spark, sf_dir).read(spark, "quarantine", "members")


@query
def customers_cleaned(spark, sf_dir):
    return shared_lake(spark, sf_dir).read(spark, "gold", "customers").drop("ingest_date")


@query
def delinquent_members_cleaned(spark, sf_dir):
    return shared_lake(spark, sf_dir).read(spark, "gold", "delinquent_members")


@query
def record_enquiry_detail_cleaned(spark, sf_dir):
    return shared_lake(spark, sf_dir).read(spark, "gold", "record_enquiry_detail")


# --- wide view -------------------------------------------------------------------
def _wide(spark, sf_dir, zone):
    lake = shared_lake(spark, sf_dir)
    return wide_view(
        lake.read(spark, zone, "customers"),
        lake.read(spark, "silver", "loans"),
        lake.read(spark, "silver", "repayments"),
        lake.read(spark, zone, "delinquent_members"),
        lake.read(spark, zone, "record_enquiry_detail"),
        **{name: lake.read(spark, "hot", name) for name in batch.HOT_KEYS},
    )


@query
def wide_view_silver(spark, sf_dir):
    return _wide(spark, sf_dir, "silver")


@query
def wide_view_cleaned(spark, sf_dir):
    return _wide(spark, sf_dir, "gold")


@query
def wide_view_small_slices(spark, sf_dir):
    """The same view with slices of three rows, so that most members are frequent on both sides."""
    lake = shared_lake(spark, sf_dir)
    names = ("customers", "loans", "repayments", "delinquent_members", "record_enquiry_detail")
    return wide_view(*[lake.read(spark, "silver", name) for name in names], rows_per_slice=3)


def _supplier_join(spark, sf_dir, how):
    """Line items by supplier against the suppliers' and the nations' customers: suppliers are frequent on both sides."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber").filter("l_linenumber = 7")
    people = table(spark, sf_dir, "customer").select(F.expr("c_custkey % 50").alias("k"), "c_custkey")
    pairs = grid_join(lines, people, "k", how, rows_per_slice=20)
    return pairs.groupBy("k").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.countDistinct("l_orderkey", "l_linenumber").alias("lines"),
        F.sum("l_orderkey").alias("orders"),
        F.sum("c_custkey").alias("customers"),
    )


@query
def grid_join_inner(spark, sf_dir):
    return _supplier_join(spark, sf_dir, "inner")


@query
def grid_join_full(spark, sf_dir):
    return _supplier_join(spark, sf_dir, "full")


# --- points ----------------------------------------------------------------------
def _raw_payment_points(spark, sf_dir):
    """Points over the uncleaned tables, where every arm of the rules occurs."""
    return score.payment_points(repayments(spark, sf_dir), loans(spark, sf_dir), with_loan=("loan_id",))


@query
def last_payment_points(spark, sf_dir):
    return _raw_payment_points(spark, sf_dir).select("loan_id", "last_payment_pts")


@query
def total_payment_points(spark, sf_dir):
    return _raw_payment_points(spark, sf_dir).select("loan_id", "total_payment_pts")


@query
def count_band_points(spark, sf_dir):
    d, p = defaulters(spark, sf_dir), DEFAULT_SCORE
    return d.select(
        "member_id",
        "delinq_amnt",
        P.count_band_points(F.col("delinq_2yrs").try_cast("int"), p.unknown_delinquencies).alias("delinq_pts"),
        P.count_band_points(F.col("pub_rec").try_cast("int"), p.unknown_public_records).alias("public_records_pts"),
        P.count_band_points(F.col("pub_rec_bankruptcies").try_cast("int"), p.unknown_bankruptcies).alias(
            "public_bankruptcies_pts"
        ),
        P.count_band_points(F.col("inq_last_6mths").try_cast("int"), p.unknown_enquiries).alias("enq_pts"),
    )


@query
def loan_status_points(spark, sf_dir):
    return loans(spark, sf_dir).select(
        "loan_id", P.loan_status_points(F.col("loan_status")).alias("loan_status_pts")
    )


@query
def home_points(spark, sf_dir):
    return customers(spark, sf_dir).select(
        "member_id", "emp_title", P.home_points(F.col("home_ownership")).alias("home_pts")
    )


@query
def credit_limit_points(spark, sf_dir):
    # the fixture repeats some customers: one limit per member here
    limits = customers(spark, sf_dir).select("member_id", "tot_hi_cred_lim").distinct()
    rated = skew_join(loans(spark, sf_dir).select("member_id", "loan_id", "funded_amount"), limits, "member_id")
    return rated.select(
        "loan_id", P.credit_limit_points(F.col("funded_amount"), F.col("tot_hi_cred_lim")).alias("credit_limit_pts")
    )


@query
def grade_points(spark, sf_dir):
    return customers(spark, sf_dir).select(
        "member_id", "emp_title", P.grade_points(F.col("grade"), F.col("sub_grade")).alias("grade_pts")
    )


@query
def payment_points(spark, sf_dir):
    lake = shared_lake(spark, sf_dir)
    return score.payment_points(
        lake.read(spark, "silver", "repayments"),
        lake.read(spark, "silver", "loans"),
        lake.read(spark, "quarantine", "members"),
        hot_loans=lake.read(spark, "hot", "hot_loans"),
    )


@query
def default_points(spark, sf_dir):
    lake = shared_lake(spark, sf_dir)
    return score.default_points(
        payment_points(spark, sf_dir),
        lake.read(spark, "gold", "record_enquiry_detail"),
        lake.read(spark, "gold", "delinquent_members"),
        hot_members=lake.read(spark, "hot", "hot_members"),
    )


@query
def health_points(spark, sf_dir):
    lake = shared_lake(spark, sf_dir)
    payments = score.tally_rows(payment_points(spark, sf_dir))
    defaults = score.default_points(
        payments,
        lake.read(spark, "gold", "record_enquiry_detail"),
        lake.read(spark, "gold", "delinquent_members"),
    )
    return score.health_points(
        defaults,
        lake.read(spark, "silver", "loans"),
        lake.read(spark, "gold", "customers"),
        hot_members=lake.read(spark, "hot", "hot_members"),
    )


# --- scores ----------------------------------------------------------------------
@query
def weighted_score(spark, sf_dir):
    return score.weighted_score(health_points(spark, sf_dir))


@query
def final_grade(spark, sf_dir):
    return score.with_final_grade(weighted_score(spark, sf_dir)).select(
        "member_id", "loan_score", "loan_final_grade", "row_count"
    )


@query
def member_scores(spark, sf_dir):
    """The whole batch: raw tables to silver, quarantine, gold and scores."""
    return batch.scores(spark, build_lake(spark, sf_dir))


@query
def score_by_loan(spark, sf_dir):
    return batch.scores(spark, shared_lake(spark, sf_dir), grain="loan")


@query
def score_with_clean_members(spark, sf_dir):
    lake = shared_lake(spark, sf_dir)
    return score.score_by_loan(
        lake.read(spark, "gold", "customers"),
        lake.read(spark, "silver", "loans"),
        lake.read(spark, "silver", "repayments"),
        lake.read(spark, "gold", "delinquent_members"),
        lake.read(spark, "gold", "record_enquiry_detail"),
        include_clean=True,
    )


@query
def grade_report(spark, sf_dir):
    return score.grade_report(batch.scores(spark, shared_lake(spark, sf_dir)), "C")


@query
def grade_counts(spark, sf_dir):
    return score.grade_counts(batch.scores(spark, shared_lake(spark, sf_dir)))


# --- sources and sinks -----------------------------------------------------------
@query
def declared_csv_scan(spark, sf_dir):
    path = f"{work_dir(spark)}/loans.csv"
    delimited.write_quoted_csv(loans(spark, sf_dir), path)
    return delimited.read_declared_csv(spark, path, schemas.raw_schema("loans"))


@query
def inferred_csv_scan(spark, sf_dir):
    path = f"{work_dir(spark)}/repayments.csv"
    delimited.write_quoted_csv(repayments(spark, sf_dir), path)
    inferred = delimited.read_inferred_csv(spark, path)
    return inferred.withColumn("loan_id", F.col("loan_id").cast("bigint"))


@query
def mixed_csv_scan(spark, sf_dir):
    """Texts with line breaks in some files and without in others: each file has the reader it needs."""
    path = f"{work_dir(spark)}/texts.csv"
    texts = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    breaks = F.coalesce(F.col("text").contains("\n"), F.lit(False))
    for part, rows in (("plain", texts.filter(~breaks)), ("broken", texts.filter(breaks))):
        delimited.write_quoted_csv(rows, f"{path}/{part}")
    found = delimited.read_declared_csv(spark, f"{path}/*", T.StructType.fromDDL("doc_id bigint, lang string, source string, text string"))
    return found.withColumn("text", F.coalesce("text", F.lit("")))


@query
def published_versions(spark, sf_dir):
    """Loans as readers see them: published, after a run that fails half-way, and published again."""
    lake = PublishedLake(work_dir(spark))
    cleaned = silver.loans_silver(loans(spark, sf_dir), INGESTED_AT).drop("ingest_date")
    seen = []
    for stage, rows in (("first", cleaned.filter("loan_term_years = 3")), ("failed", cleaned.limit(0)), ("second", cleaned)):
        run = lake.begin(spark)
        run.write(rows, "silver", "plain_loans")
        if stage != "failed":
            run.commit(spark)
        seen.append(lake.opened(spark).read(spark, "silver", "plain_loans").select(F.lit(stage).alias("stage"), "loan_id", "loan_amount"))
    return reduce(DataFrame.union, seen)


@query
def run_from_files_published(spark, sf_dir):
    """The batch over a published lake, run twice: the second run's version is read."""
    root, tag = work_dir(spark), uuid.uuid4().hex
    places, listed = _write_raw(spark, sf_dir, root)
    lake = PublishedLake(f"{root}/lake", silver_db=f"silver_{tag}", gold_db=f"gold_{tag}")
    for _ in range(2):
        batch.run(spark, f"{root}/raw", listed, places, lake.begin(spark), INGESTED_AT, grain="loan", multi_line_manifest=False)
    return lake.opened(spark, 2).read(spark, "gold", "loan_score")


@query
def wide_view_refreshed(spark, sf_dir):
    """The stored wide view, built over a part of the tables and then brought up to all of them."""
    tables, lake, store = shared_lake(spark, sf_dir), PublishedLake(work_dir(spark)), WideStore(buckets=32)
    parts = {"customers": "member_id not like '1%'", "loans": "loan_term_years = 3", "repayments": "total_late_fee_received > 0"}
    for step in ("part", "all"):
        run = lake.begin(spark)
        for name in SOURCES:
            rows = tables.read(spark, "silver", name)
            run.write(rows.filter(parts.get(name, "true")) if step == "part" else rows, "silver", name)
        store.refresh(spark, run)
        run.commit(spark)
    return store.read(spark, lake.opened(spark))


def _write_raw(spark, sf_dir, root):
    """Raw files and their manifest; returns each entity's place and the manifest's path."""
    places = {entity: f"{entity}_data/{entity}.csv" for entity in BY_ENTITY}
    for entity, place in places.items():
        delimited.write_quoted_csv(fixture(spark, sf_dir, entity), f"{root}/raw/{place}")
    records = spark.createDataFrame([tuple(p.split("/")) for p in places.values()], manifest.MANIFEST_SCHEMA)
    records.write.json(f"{root}/manifest")
    return places, f"{root}/manifest"


@query
def manifest_ingest(spark, sf_dir):
    root = work_dir(spark)
    places, listed = _write_raw(spark, sf_dir, root)
    manifest.ingest_manifest(
        spark, manifest.read_manifest(spark, listed, multi_line=False), f"{root}/raw", f"{root}/bronze"
    )
    copies = [
        delimited.read_text_csv(spark, f"{root}/bronze/{place}").select(
            F.lit(name).alias("entity"), F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns]).alias("line")
        )
        for name, place in places.items()
        for columns in [[f.name for f in schemas.raw_schema(name) if f.dataType.simpleString() == "string"]]
    ]
    return reduce(DataFrame.union, copies)


@query
def external_table_roundtrip(spark, sf_dir):
    root, database = work_dir(spark), f"roundtrip_{uuid.uuid4().hex}"
    zones.write_zone(silver.loans_silver(loans(spark, sf_dir), INGESTED_AT), f"{root}/silver/loans")
    catalog.create_database(spark, database, f"{root}/catalog")
    for _ in range(2):  # registering again changes nothing
        catalog.register_external(
            spark, f"{database}.loans", schemas.silver_schema("loans"), f"{root}/silver/loans"
        )
    return spark.table(f"{database}.loans").drop("ingest_date")


@query
def external_table_repointed(spark, sf_dir):
    root, table = work_dir(spark), f"repointed_{uuid.uuid4().hex}"
    catalog.create_database(spark, table, f"{root}/catalog")
    cleaned = silver.loans_silver(loans(spark, sf_dir), INGESTED_AT)
    for place, rows in (("first", cleaned.filter("loan_term_years = 3")), ("second", cleaned)):
        zones.write_zone(rows, f"{root}/{place}")
        catalog.register_external(spark, f"{table}.loans", schemas.silver_schema("loans"), f"{root}/{place}")
    return spark.table(f"{table}.loans").drop("ingest_date")


@query
def wide_catalog_view(spark, sf_dir):
    lake = shared_lake(spark, sf_dir)
    named = batch.Lake(lake.root, silver_db=f"silver_{uuid.uuid4().hex}")
    batch.publish_silver(spark, named)
    return spark.table(f"{named.silver_db}.customers_loans").select(*WIDE_COLUMNS)


def _run(spark, sf_dir, number="double"):
    root, tag = work_dir(spark), uuid.uuid4().hex
    places, listed = _write_raw(spark, sf_dir, root)
    lake = batch.Lake(f"{root}/lake", number=number, silver_db=f"silver_{tag}", gold_db=f"gold_{tag}")
    return batch.run(
        spark, f"{root}/raw", listed, places, lake, INGESTED_AT, grain="loan", multi_line_manifest=False
    )


@query
def run_from_files(spark, sf_dir):
    return _run(spark, sf_dir)


@query
def run_from_files_decimal(spark, sf_dir):
    return _run(spark, sf_dir, "decimal(18,2)")


@query
def customers_legacy_text(spark, sf_dir):
    cleaned = silver.customers_silver(customers(spark, sf_dir), INGESTED_AT, legacy_float_text=True)
    return cleaned.select("member_id", "emp_title", "annual_income", "total_high_credit_limit")
