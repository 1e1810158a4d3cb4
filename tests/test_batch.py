"""From delimited files to scores, through written zones and the catalog."""

import json
from dataclasses import replace

import pytest

from checks.fixtures import BY_ENTITY, fixture
from creditmill import schemas
from creditmill.operators.quality import assert_schema, value_frequencies
from creditmill.operators.tally import ROW_COUNT
from creditmill.params import DEFAULT_SCORE
from creditmill.plans import batch
from creditmill.plans.wide import WIDE_COLUMNS, wide_view
from creditmill.sources.delimited import write_quoted_csv
from tests.conftest import rows

FILES = {e: f"{e}_data/{e}.csv" for e in BY_ENTITY}


@pytest.fixture(scope="module")
def raw_root(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for entity, place in FILES.items():
        write_quoted_csv(fixture(spark, sf_dir, entity), f"{root}/files/{place}")
    records = [dict(zip(("folderName", "fileName"), place.split("/"))) for place in FILES.values()]
    (root / "manifest.json").write_text(json.dumps(records))
    return root


@pytest.fixture(scope="module")
def lake(spark, raw_root, tmp_path_factory):
    lake = batch.Lake(str(tmp_path_factory.mktemp("lake")), silver_db="run_silver", gold_db="run_gold")
    batch.run(spark, f"{raw_root}/files", f"{raw_root}/manifest.json", FILES, lake, "2024-01-01")
    return lake


def test_stages_may_be_repeated(spark, lake):
    before = rows(spark.table("run_gold.customers"))
    batch.publish_silver(spark, lake)
    batch.build_quarantine(spark, lake)
    batch.build_gold(spark, lake)
    batch.publish_gold(spark, lake)
    assert rows(spark.table("run_gold.customers")) == before


def test_scores_were_written(spark, lake):
    scored = lake.read(spark, "gold", "loan_score")
    assert scored.count() > 0
    assert scored.columns[-1] == ROW_COUNT


def test_zones_have_the_declared_schemas(spark, lake):
    for name in ("customers", "loans", "repayments", *batch.KEYED_TABLES[1:], "record_enquiry_members"):
        assert_schema(lake.read(spark, "silver", name), schemas.silver_schema(name))
    for name in batch.KEYED_TABLES:
        assert_schema(spark.table(f"run_gold.{name}"), schemas.silver_schema(name))


def test_gold_keys_are_unique_and_not_quarantined(spark, lake):
    bad = lake.read(spark, "quarantine", "members")
    assert bad.count() > 0
    for name in batch.KEYED_TABLES:
        gold = spark.table(f"run_gold.{name}")
        assert value_frequencies(gold, "member_id").first().total == 1
        assert gold.join(bad, "member_id", "left_semi").count() == 0


def test_wide_view_in_the_catalog_is_the_wide_view(spark, lake):
    t = {n: lake.read(spark, "silver", n) for n in ("customers", "loans", "repayments", *batch.KEYED_TABLES[1:])}
    built = wide_view(*t.values())
    assert built.columns == list(WIDE_COLUMNS) and len(WIDE_COLUMNS) == 35
    assert rows(spark.table("run_silver.customers_loans")) == rows(built)
    assert rows(wide_view(*t.values(), rows_per_slice=2)) == rows(built)


def test_wide_view_over_clean_tables_has_a_row_per_loan(spark, lake):
    gold = {n: lake.read(spark, "gold", n) for n in batch.KEYED_TABLES}
    loans = lake.read(spark, "silver", "loans")
    wide = wide_view(
        gold["customers"],
        loans,
        lake.read(spark, "silver", "repayments"),
        gold["delinquent_members"],
        gold["record_enquiry_detail"],
    )
    with_loan = loans.join(gold["customers"].select("member_id"), "member_id").count()
    without = gold["customers"].join(loans, "member_id", "left_anti").count()
    assert wide.count() == with_loan + without


def test_float_numbers_run_too(spark, raw_root, tmp_path):
    lake = batch.Lake(str(tmp_path), number="float", silver_db="float_silver", gold_db="float_gold")
    scored = batch.run(
        spark, f"{raw_root}/files", f"{raw_root}/manifest.json", FILES, lake, "2024-01-01", grain="loan"
    )
    assert scored.count() > 0
    assert dict(lake.read(spark, "silver", "loans").dtypes)["loan_amount"] == "float"


def test_an_unlisted_file_is_an_error(spark, raw_root, tmp_path):
    files = {**FILES, "loans": "elsewhere/loans.csv"}
    with pytest.raises(ValueError, match="elsewhere/loans.csv"):
        batch.run(spark, f"{raw_root}/files", f"{raw_root}/manifest.json", files, batch.Lake(str(tmp_path)))


def test_a_failing_write_fails_the_stage(spark, tmp_path):
    lake = batch.Lake(str(tmp_path))
    bad = spark.range(3).selectExpr("raise_error('no such value') as v")
    with pytest.raises(Exception, match="no such value"):
        lake.write_all({"good": spark.range(3).selectExpr("id as v"), "bad": bad}, "silver")


def options_lake(tmp_path, tag, **lake):
    return batch.Lake(f"{tmp_path}/{tag}", silver_db=f"{tag}_silver", gold_db=f"{tag}_gold", **lake)


def test_decimal_numbers_give_the_same_scores(spark, raw_root, lake, tmp_path):
    exact = options_lake(tmp_path, "exact", number="decimal(18,2)")
    scored = batch.run(spark, f"{raw_root}/files", f"{raw_root}/manifest.json", FILES, exact, "2024-01-01")
    assert rows(scored) == rows(lake.read(spark, "gold", "loan_score")) and scored.count()


def test_options_reach_the_tables(spark, raw_root, lake, tmp_path):
    made = options_lake(tmp_path, "opted")
    params = replace(DEFAULT_SCORE, excellent=801)
    options = batch.Options(validate_loans=True, legacy_float_text=True, include_clean=True, null_aware=False, params=params)
    scored = batch.run(
        spark, f"{raw_root}/files", f"{raw_root}/manifest.json", FILES, made, "2024-01-01", options=options
    )
    plain = lake.read(spark, "silver", "customers")
    assert plain.filter("annual_income >= 1e7").count() > 0
    assert made.read(spark, "silver", "customers").filter("annual_income >= 1e7").count() == 0
    assert scored.select("member_id").distinct().count() > lake.read(spark, "gold", "loan_score").select("member_id").distinct().count()


def test_null_aware_reaches_the_gold_tables(spark, lake, tmp_path):
    made = options_lake(tmp_path, "nulls")
    for name in batch.KEYED_TABLES:
        made.write(lake.read(spark, "silver", name), "silver", name)
    made.write(lake.read(spark, "quarantine", "members").union(spark.createDataFrame([(None,)], "member_id string")), "quarantine", "members")
    batch.build_gold(spark, made, null_aware=True)
    assert made.read(spark, "gold", "customers").count() == 0
    batch.build_gold(spark, made, null_aware=False)
    assert rows(made.read(spark, "gold", "customers")) == rows(lake.read(spark, "gold", "customers"))


def test_two_lakes_under_the_same_names(spark, raw_root, lake, tmp_path):
    other = batch.Lake(str(tmp_path / "other"), silver_db=lake.silver_db, gold_db=lake.gold_db)
    for name in ("customers", "loans", "repayments", *batch.KEYED_TABLES[1:]):
        other.write(lake.read(spark, "silver", name).limit(3), "silver", name)
    batch.publish_silver(spark, other)
    assert spark.table(f"{lake.silver_db}.customers").count() == 3
    batch.publish_silver(spark, lake)
    assert spark.table(f"{lake.silver_db}.customers").count() == lake.read(spark, "silver", "customers").count()
