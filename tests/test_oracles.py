"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry_points
from tests.compare import connect, difference

FOLDER = entry_points.SMALL
QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark: SparkSession, connection, name: str) -> None:
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(df, connection, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries() -> None:
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark: SparkSession) -> None:
    result = entry_points.entry(spark)
    assert result.count() == 150
    assert {"custkey", "score"} <= set(result.columns)
