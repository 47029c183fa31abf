"""Compare registered queries with their SQL in DuckDB, value by value.

Run as a script to check any folder: ``python -m tests.compare /root/testdata/sf0.01 [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

import __spark_entry__ as entry_points


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def _kind(spark_type: str) -> str:
    return {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "string": "VARCHAR",
        "double": "DOUBLE",
        "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP",
        "timestamp": "TIMESTAMP",
        "date": "DATE",
    }.get(spark_type, spark_type)


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a query's result and its SQL, or None."""
    expected = connection.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(expected.columns):
        return f"columns {columns} != {sorted(expected.columns)}"
    wanted = dict(zip(expected.columns, (str(t) for t in expected.types), strict=True))
    types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    if types != wanted:
        return f"types {types} != {wanted}"
    quoted = ", ".join(f'"{c}"' for c in columns)
    right = Counter(
        tuple(map(_plain, r))
        for r in connection.sql(f"SELECT {quoted} FROM ({sql}) AS whole").fetchall()
    )
    left = Counter(tuple(_plain(r[c]) for c in columns) for r in df.select(*columns).collect())
    if left != right:
        more, fewer = left - right, right - left
        return (
            f"{sum(left.values())} rows against {sum(right.values())}; "
            f"{sum(more.values())} only here, {sum(fewer.values())} only in SQL; "
            f"here {str(list(more)[:2])[:600]}, SQL {str(list(fewer)[:2])[:600]}"
        )
    return None if left else "no rows"


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name in names or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                found = difference(df, connection, oracles[name])
            else:
                found = None if df.count() else "no rows"
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:6000]}"
        failed += found is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if found else 'ok  '} {kind} {time.time() - began:6.2f}s {name} {found or ''}",
              flush=True)
    print(f"{len(names or queries)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
