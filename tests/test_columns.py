from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.types import columns_of, has_type, type_of
from millrace.operators import columns as cols
from millrace.operators.model import placeholder_score


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(1, 10, 1.5, "a", None), (2, -150, float("nan"), "b", True), (3, None, None, None, False)],
        "i int, l bigint, d double, s string, b boolean",
    )


def test_filter_drops_null_predicates(table):
    assert [r.i for r in cols.filter_rows(table, "l > 0").collect()] == [1]


def test_rename_needs_the_column(table):
    assert "key" in cols.rename_columns(table, {"i": "key"}).columns
    with pytest.raises(ValueError, match="nothing"):
        cols.rename_columns(table, {"nothing": "x"})


def test_cast_makes_bad_values_null_unless_strict(table):
    assert [r.s for r in cols.cast_columns(table, {"s": "int"}).collect()] == [None] * 3
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cols.cast_columns(table, {"s": "int"}, strict=True).collect()


def test_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r.x for r in cols.derive(df, {"x": cols.ratio("a", "b")}).collect()] == [None, 0.5]


def test_remainder_sign(table):
    row = table.filter("i = 2").select(
        cols.remainder("l", 100).alias("a"), cols.remainder("l", 100, True).alias("b")
    ).first()
    assert (row.a, row.b) == (-50, 50)


def test_derive_when(table):
    got = cols.derive_when(table, "x", [("l > 0", "up"), (F.col("l") < 0, "down")], "none")
    assert [r.x for r in got.orderBy("i").collect()] == ["up", "down", "none"]
    assert cols.derive_when(table, "x", [], 1).first().x == 1


def test_random_column_repeats_with_its_seed(table):
    first = [r.x for r in cols.random_column(table, "x", 5).collect()]
    assert first == [r.x for r in cols.random_column(table, "x", 5).collect()]
    assert all(0 <= x < 100 for x in first)
    assert first != [r.x for r in cols.random_column(table, "x", 6).collect()]


def test_placeholder_score_falls_back(table):
    assert placeholder_score(table, "l").filter("i = 2").first().score == -50.0
    assert placeholder_score(table, "l", non_negative=True).filter("i = 2").first().score == 50.0
    assert all(0 <= r.score < 100 for r in placeholder_score(table, "absent").collect())


def test_families(table):
    assert columns_of(table, "numeric") == ["i", "l", "d"]
    assert columns_of(table, "float") == ["i", "l", "d"]
    assert columns_of(table, "integer") == ["i", "l"]
    assert columns_of(table, "string") == ["s"]
    assert columns_of(table, "boolean") == ["b"]


@pytest.mark.parametrize(
    ("column", "name", "expected"),
    [
        ("i", "IntegerType", True),
        ("i", "int", True),
        ("i", "integer", True),
        ("l", "IntegerType", False),
        ("l", "bigint", True),
        ("l", "float", True),
        ("s", "float", False),
        ("d", "DoubleType", True),
    ],
)
def test_type_names(table, column, name, expected):
    assert has_type(type_of(table, column), name) is expected


def test_every_numeric_type_is_numeric(spark):
    df = spark.sql(
        "SELECT 1Y AS a, 1S AS b, 1 AS c, 1L AS d, 1.0F AS e, 1.0D AS f, 1.0BD AS g, "
        "DATE '2020-01-01' AS h, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS k"
    )
    assert columns_of(df, "numeric") == list("abcdefg")
    assert columns_of(df, "date") == ["h", "k"]
