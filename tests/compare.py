"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(cell(row[i]) for i in order)) for row in rows)


def differences(spark: SparkSession, con, name: str, function, sql: str | None, sf_dir: str) -> str | None:
    """None when the results are equal, else a short account of the first difference."""
    df = function(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    if len(set(df.columns)) != len(df.columns):
        return f"duplicate columns {df.columns}"
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}"
    if not want:
        return "both sides are empty"
    left, right = canonical(df.columns, got), canonical(columns, want)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return None if not bad else f"{len(bad)} rows differ, first:\n    spark {bad[0][0]}\n    sql   {bad[0][1]}"


def main(arguments: list[str]) -> int:
    import __spark_entry__ as contract

    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in arguments:
        at = arguments.index("--sf")
        sf_dir = arguments[at + 1]
        arguments = arguments[:at] + arguments[at + 2:]
    spark, con = session(), duck(sf_dir)
    queries, oracles = contract.queries(), contract.oracle_sql()
    failures = 0
    for name in arguments or queries:
        start = time.time()
        try:
            problem = differences(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # a broken query must not hide the rest
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        kind = "S" if name in oracles else "R"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(arguments or queries)} queries, {failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
