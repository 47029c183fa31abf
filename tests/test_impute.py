from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators.impute import impute, warn_skipped
from millrace.operators.stats import column_means, column_modes, top_value, value_counts

NAN = float("nan")


def test_integer_mean_is_truncated(spark):
    df = spark.createDataFrame([(1,), (3,), (4,), (None,)], "i int")
    done = impute(df)
    assert sorted(r.i for r in done.data.collect()) == [1, 2, 3, 4]
    assert done.data.schema["i"].dataType.simpleString() == "int"


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (NAN,), (None,)], "d double")
    assert sorted(r.d for r in impute(df).data.collect()) == [1.0, 2.0, 2.0, 3.0]


def test_mode_ignores_null_and_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "s string")
    assert sorted(r.s for r in impute(df).data.collect()) == ["a", "a", "a", "a", "b"]


@pytest.mark.parametrize("now", [False, True])
def test_all_null_columns_stay_and_are_logged(spark, now):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2)], "d double, s string, i int")
    done = impute(df, now=now)
    assert {(r.d, r.s) for r in done.data.collect()} == {(None, None)}
    outcomes = {r.column: (r.outcome, r.missing) for r in done.log.collect()}
    assert outcomes == {
        "d": ("skipped: no value present", 2),
        "s": ("skipped: no value present", 2),
        "i": ("nothing missing", 0),
    }
    assert sorted(warn_skipped(done.log)) == ["d", "s"]


def test_empty_table(spark):
    done = impute(spark.createDataFrame([], "i int, s string"))
    assert done.data.count() == 0
    assert {r.outcome for r in done.log.collect()} == {"nothing missing"}


def test_constant_exclude_and_columns(spark):
    df = spark.createDataFrame([(None, None, None), (2, "x", 4.0)], "k int, s string, d double")
    filled = impute(df, categorical="constant", exclude=["k"]).data
    assert {tuple(r) for r in filled.collect()} == {(None, "Unknown", 4.0), (2, "x", 4.0)}
    named = impute(df, columns=["d"]).data
    assert {tuple(r) for r in named.collect()} == {(None, None, 4.0), (2, "x", 4.0)}
    with pytest.raises(ValueError, match="absent"):
        impute(df, columns=["absent"])


def test_decimal_and_short_columns_are_filled(spark):
    df = spark.sql("SELECT * FROM VALUES (1.50BD, 1S), (2.50BD, 4S), (NULL, NULL) AS t(a, b)")
    assert {(str(r.a), r.b) for r in impute(df).data.collect()} == {
        ("1.50", 1), ("2.50", 4), ("2.00", 2)
    }


@pytest.mark.parametrize("now", [False, True])
def test_known_counts_spare_whole_columns(spark, now):
    df = spark.createDataFrame([("a", None), ("b", "x")], "s string, t string")
    done = impute(df, missing={"s": 0, "t": 1}, now=now)
    assert {tuple(r) for r in done.data.collect()} == {("a", "x"), ("b", "x")}
    log = {r.column: (r.strategy, r.outcome) for r in done.log.collect()}
    assert log == {"s": ("none", "nothing missing"), "t": ("mode", "filled")}


def test_means_and_modes(spark):
    df = spark.createDataFrame(
        [(1, "x", 2.0), (1, None, NAN), (2, "y", None)], "i int, s string, d double"
    )
    assert column_means(df, ["i", "d"]).first().asDict() == {"i": 4 / 3, "d": 2.0}
    modes = column_modes(df, ["i", "s"])
    assert modes.first().asDict() == {"i": 1, "s": "x"}
    assert modes.schema["i"].dataType.simpleString() == "int"
    assert [tuple(r) for r in value_counts(df, "i").collect()] == [(1, 2), (2, 1)]
    assert top_value(df, "i").first()["i"] == 1


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(-50, 50)),
            st.one_of(st.none(), st.sampled_from(["a", "b", "c"])),
        ),
        min_size=1,
        max_size=20,
    )
)
def test_no_nulls_left_where_a_value_is_present(spark, rows):
    df = spark.createDataFrame(rows, "i int, s string")
    filled = [tuple(r) for r in impute(df).data.collect()]
    for position in (0, 1):
        if any(r[position] is not None for r in rows):
            assert all(r[position] is not None for r in filled)
    assert len(filled) == len(rows)
