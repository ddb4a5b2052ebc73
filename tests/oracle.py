"""Compare registered queries with their SQL on DuckDB: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _key(value):
    if value is None:
        return (0, 0.0, "")
    if isinstance(value, bool):
        return (1, float(value), "")
    if isinstance(value, (int, float)):
        return (1, float(value), "")
    return (2, 0.0, str(value))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(query, sql: str | None, spark, folder: str, connection) -> str | None:
    """None if both agree, otherwise what differs."""
    df = query(spark, folder)
    mine = sorted(df.columns)
    rows = sorted((tuple(row[c] for c in mine) for row in df.collect()), key=lambda t: tuple(map(_key, t)))
    if sql is None:
        return None if rows else "no rows"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = sorted(names)
    if mine != theirs:
        return f"columns {mine} / {theirs}"
    order = [names.index(c) for c in theirs]
    expected = sorted(
        (tuple(row[i] for i in order) for row in result.fetchall()), key=lambda t: tuple(map(_key, t))
    )
    if len(rows) != len(expected):
        return f"rows {len(rows)} / {len(expected)}"
    kinds = [
        (type(a), type(b), c)
        for a, b, c in zip(rows[0] if rows else (), expected[0] if expected else (), mine)
        if a is not None and b is not None and type(a) is not type(b)
    ]
    if kinds:
        return f"types {kinds}"
    bad = [(a, b) for a, b in zip(rows, expected) if not all(map(_same, a, b))]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {mine} {bad[0][0]} / {bad[0][1]}"
    if not rows:
        return "no rows"
    return None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    built = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    built.sparkContext.setLogLevel("ERROR")
    return built


def main() -> int:
    from sensorloom.plans.queries import registered

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, connection = session(), connect(folder)
    failed = 0
    for name, (query, sql) in registered().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(query, sql, spark, folder, connection)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
