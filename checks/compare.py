"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _sorted_rows(names: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(row[i] for i in order)) for row in rows)


def spark_rows(spark: SparkSession, name: str, sf_dir: str) -> tuple[list[str], list[str]]:
    df = QUERIES[name](spark, sf_dir)
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con: duckdb.DuckDBPyConnection, name: str) -> tuple[list[str], list[str]]:
    found = con.execute(ORACLES[name])
    return _sorted_rows([c[0] for c in found.description], found.fetchall())


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name in names or QUERIES:
        began = time.time()
        mine = spark_rows(spark, name, sf_dir)
        took = time.time() - began
        theirs = oracle_rows(con, name)
        same = mine == theirs
        failed += not same
        print(f"{'ok  ' if same else 'DIFF'} {name:32} {len(mine[1]):8} rows {took:6.2f} s", flush=True)
        if not same:
            print("  columns", mine[0], theirs[0])
            print("  only here ", sorted(set(mine[1]) - set(theirs[1]))[:3])
            print("  only there", sorted(set(theirs[1]) - set(mine[1]))[:3], len(theirs[1]))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
