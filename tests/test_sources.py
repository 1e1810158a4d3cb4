import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill import schemas
from creditmill.sources import catalog, delimited, manifest, zones
from tests.conftest import rows


def test_quoted_csv_keeps_every_value(spark, tmp_path):
    values = [(" 36 months ", 'say "hi"'), ("a,b", "back\\slash"), ("tab\there", "'single'"), ("-", None)]
    df = spark.createDataFrame(values, "a string, b string")
    delimited.write_quoted_csv(df, f"{tmp_path}/x.csv")
    assert rows(delimited.read_text_csv(spark, f"{tmp_path}/x.csv")) == rows(df)


def test_every_value_is_quoted_below_a_header(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "x")], "a string, b string, c string")
    delimited.write_quoted_csv(df.coalesce(1), f"{tmp_path}/x.csv")
    (part,) = (tmp_path / "x.csv").glob("part-*")
    assert part.read_text().splitlines() == ['"a","b","c"', '"1","","x"']


def test_declared_columns_bind_by_position(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,amnt,term\n1,10.5, 36 months\nx,abc,\n")
    df = delimited.read_declared_csv(
        spark, f"{tmp_path}/f.csv", T.StructType.fromDDL("loan_id bigint, amount double, term string")
    )
    assert rows(df) == [(1, 10.5, " 36 months"), (None, None, None)]


def test_inferred_types(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c\n1,1.5,x\n2,2,y\n")
    assert dict(delimited.read_inferred_csv(spark, f"{tmp_path}/f.csv").dtypes) == {
        "a": "int",
        "b": "double",
        "c": "string",
    }


RECORDS = [{"folderName": "customers_data", "fileName": "c.csv"}, {"folderName": "loans/2024", "fileName": "l.csv"}]


@pytest.mark.parametrize(
    "text, multi_line",
    [
        (json.dumps(RECORDS), True),
        (json.dumps(RECORDS, indent=2), True),
        ("\n".join(json.dumps(r) for r in RECORDS), False),
    ],
)
def test_manifest_layouts(spark, tmp_path, text, multi_line):
    (tmp_path / "m.json").write_text(text)
    listed = manifest.read_manifest(spark, f"{tmp_path}/m.json", multi_line)
    assert list(manifest.listed_paths(listed)) == ["customers_data/c.csv", "loans/2024/l.csv"]


def test_ingest_copies_each_listed_file(spark, tmp_path):
    raw, bronze = tmp_path / "raw", tmp_path / "bronze"
    for folder, text in (("customers_data", 'id,name\n1,"a, b"\n2,\n'), ("loans/2024", "x\n true\n"), ("other", "z\n1\n")):
        (raw / folder).mkdir(parents=True)
        (raw / folder / f"{folder[0]}.csv").write_text(text)
    (tmp_path / "m.json").write_text(json.dumps(RECORDS))
    for _ in range(2):  # a second run replaces the first
        copied = manifest.ingest_manifest(
            spark, manifest.read_manifest(spark, f"{tmp_path}/m.json"), str(raw), str(bronze)
        )
        assert copied == ["customers_data/c.csv", "loans/2024/l.csv"]
    assert rows(delimited.read_text_csv(spark, f"{bronze}/customers_data/c.csv")) == [("1", "a, b"), ("2", None)]
    assert rows(delimited.read_text_csv(spark, f"{bronze}/loans/2024/l.csv")) == [(" true",)]
    assert not (bronze / "other").exists()


def test_zone_overwrite_replaces_everything(spark, tmp_path):
    path = f"{tmp_path}/zone"
    zones.write_zone(spark.range(100), path)
    zones.write_zone(spark.range(3), path)
    assert zones.read_zone(spark, path).count() == 3


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_zone_formats(spark, tmp_path, fmt):
    zones.write_zone(spark.range(5), f"{tmp_path}/z", fmt)
    assert zones.read_zone(spark, f"{tmp_path}/z", fmt).count() == 5


def test_compact_zone_is_one_file_when_short_and_more_when_long(spark, tmp_path):
    short, long = f"{tmp_path}/short", f"{tmp_path}/long"
    zones.write_zone(spark.range(1000).repartition(8), short, compact=True)
    assert len(list((tmp_path / "short").glob("part-*"))) == 1
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        zones.write_zone(spark.range(500_000), long, compact=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "long").glob("part-*"))) > 1
    assert zones.read_zone(spark, long).count() == 500_000


def test_external_table_and_view(spark, tmp_path):
    path = f"{tmp_path}/members"
    schema = schemas.silver_schema("record_enquiry_detail")
    df = spark.createDataFrame([("a", 1, 0, None)], schema)
    zones.write_zone(df, path)
    for _ in range(2):
        catalog.create_database(spark, "reg_test", f"{tmp_path}/db")
        catalog.register_external(spark, "reg_test.members", schema, path)
        catalog.register_view(spark, "reg_test.names", "SELECT member_id FROM reg_test.members")
    assert spark.table("reg_test.members").schema == schema
    assert rows(spark.table("reg_test.names")) == [("a",)]
    zones.write_zone(df.union(df), path)
    catalog.register_external(spark, "reg_test.members", schema, path)
    assert spark.table("reg_test.members").count() == 2
    spark.sql("DROP DATABASE reg_test CASCADE")
    assert zones.read_zone(spark, path).count() == 2  # an external table leaves its files


def test_missing_file_is_an_error(spark, tmp_path):
    listed = spark.createDataFrame([("no", "such.csv")], manifest.MANIFEST_SCHEMA)
    with pytest.raises(AnalysisException):
        manifest.ingest_manifest(spark, listed, f"{tmp_path}/raw", f"{tmp_path}/bronze")


def test_default_number_type_reads_what_float_would_round(spark, tmp_path):
    (tmp_path / "f.csv").write_text("\n".join(["h" + ",h" * 7, "1,16777217,0,0,0,0,,"]) + "\n")
    as_double = delimited.read_declared_csv(spark, f"{tmp_path}/f.csv", schemas.raw_schema("repayments"))
    as_float = delimited.read_declared_csv(spark, f"{tmp_path}/f.csv", schemas.raw_schema("repayments", "float"))
    column = F.col("total_principal_received").cast("bigint")
    assert as_double.select(column).first()[0] == 16777217
    assert as_float.select(column).first()[0] == 16777216


def test_a_table_follows_its_lake(spark, tmp_path):
    schema = T.StructType.fromDDL("k int")
    for n in (1, 2):
        zones.write_zone(spark.range(n).select(F.col("id").cast("int").alias("k")), f"{tmp_path}/{n}")
    catalog.create_database(spark, "moving", f"{tmp_path}/catalog")
    for n in (1, 2, 1):
        catalog.register_external(spark, "moving.rows", schema, f"{tmp_path}/{n}")
        assert spark.table("moving.rows").count() == n
    wider = T.StructType.fromDDL("k int, extra string")
    catalog.register_external(spark, "moving.rows", wider, f"{tmp_path}/1")
    assert spark.table("moving.rows").columns == ["k", "extra"]
    assert spark.read.parquet(f"{tmp_path}/2").count() == 2  # files of the other lake stay
    spark.range(1).write.saveAsTable("moving.own")
    with pytest.raises(ValueError):
        catalog.register_external(spark, "moving.own", schema, f"{tmp_path}/1")


def test_copies_keep_line_breaks_and_the_order_of_the_manifest(spark, tmp_path):
    places = [("folder", f"file{i}.csv") for i in range(50)]
    (tmp_path / "raw/folder").mkdir(parents=True)
    for i, (_, name) in enumerate(places):
        (tmp_path / "raw/folder" / name).write_text(f'a,b\n{i},"one\ntwo"\n{i},plain\n')
    listed = spark.createDataFrame(places, manifest.MANIFEST_SCHEMA)
    copied = manifest.ingest_manifest(spark, listed, f"{tmp_path}/raw", f"{tmp_path}/bronze", at_once=4)
    assert copied == [f"folder/{name}" for _, name in places]
    for i in (0, 49):
        back = delimited.read_declared_csv(spark, f"{tmp_path}/bronze/{copied[i]}", T.StructType.fromDDL("a int, b string"))
        assert rows(back) == [(i, "one\ntwo"), (i, "plain")]


# --- files with and without line breaks in values ----------------------------------
def opened_by_lines(spark, tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return [f.rsplit("/", 1)[1] for f in delimited.files_with_breaks(spark, f"{tmp_path}/{name}")] == [name]


@pytest.mark.parametrize(
    "text, broken",
    [
        ('a,b\n1,2\n', False),
        ('"a","b"\n"1","2"\n"x, y",""\n', False),
        ('"a","b"\n"say \\"hi\\"","back\\\\"\n', False),
        ('a,b\n"one\ntwo",3\n', True),
        ('a,b\n1,"one\n\ntwo"\n', True),
        ('a,b\nab"c,"one\ntwo"\n', True),  # an even number of quotes, the last one open
        ('a,b\n"x\\",y\nz",3\n', True),
        ('a,b\n"x\\\\",y\n', False),
        ('a,b\n1,"open', True),
        ("", False),
        ('a,b\n5\" pipe,2\n', True),  # harmless, but only a reader of the whole file can tell
    ],
)
def test_line_breaks_in_values_are_found(spark, tmp_path, text, broken):
    assert opened_by_lines(spark, tmp_path, "f.csv", text) == broken


VALUES = ["plain", "a,b", 'say "hi"', "back\\slash", "two\nlines", 'odd " quote\nand, more', " blanks ", "ü"]


def test_any_values_read_the_same_either_way(spark, tmp_path):
    for k, some in enumerate([VALUES[:4], VALUES, VALUES[4:6] * 3, [v for v in VALUES if "\n" not in v] * 2]):
        df = spark.createDataFrame([(v, w) for v in some for w in some], "a string, b string").repartition(3)
        delimited.write_quoted_csv(df, f"{tmp_path}/{k}.csv")
        assert rows(delimited.read_text_csv(spark, f"{tmp_path}/{k}.csv")) == rows(df)
        assert rows(delimited.read_text_csv(spark, f"{tmp_path}/{k}.csv", True)) == rows(df)


def test_a_large_file_is_read_and_copied_by_many_tasks(spark, tmp_path):
    (tmp_path / "raw" / "d").mkdir(parents=True)
    lines = "".join(f'{i},"title, {i}",{i % 7}.5\n' for i in range(40_000))
    (tmp_path / "raw" / "d" / "large.csv").write_text("id,title,amount\n" + lines)
    (tmp_path / "raw" / "d" / "broken.csv").write_text('id,title,amount\n1,"two\nlines",0.5\n2,x,1.5\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        large = delimited.read_text_csv(spark, f"{tmp_path}/raw/d/large.csv")
        assert large.rdd.getNumPartitions() > 5 and large.count() == 40_000
        assert delimited.read_text_csv(spark, f"{tmp_path}/raw/d/broken.csv").rdd.getNumPartitions() == 1
        both = delimited.read_text_csv(spark, f"{tmp_path}/raw/d")
        assert both.count() == 40_002 and both.filter("title = 'two\nlines'").count() == 1
        listed = spark.createDataFrame([("d", "large.csv"), ("d", "broken.csv")], manifest.MANIFEST_SCHEMA)
        manifest.ingest_manifest(spark, listed, f"{tmp_path}/raw", f"{tmp_path}/bronze")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list((tmp_path / "bronze" / "d" / "large.csv").glob("part-*"))) > 5
    kinds = T.StructType.fromDDL("id bigint, title string, amount double")
    copied = delimited.read_declared_csv(spark, f"{tmp_path}/bronze/d/large.csv", kinds)
    assert copied.count() == 40_000 and copied.agg(F.sum("id")).first()[0] == sum(range(40_000))
    assert rows(delimited.read_declared_csv(spark, f"{tmp_path}/bronze/d/broken.csv", kinds)) == [(1, "two\nlines", 0.5), (2, "x", 1.5)]


def test_names_with_blanks(spark, tmp_path):
    (tmp_path / "a folder").mkdir()
    (tmp_path / "a folder" / "one file.csv").write_text('a\n"x\ny"\n')
    (tmp_path / "a folder" / "other%20file.csv").write_text("a\nz\n")
    assert rows(delimited.read_text_csv(spark, f"{tmp_path}/a folder")) == [("x\ny",), ("z",)]
