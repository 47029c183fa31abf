from __future__ import annotations

from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.types import wider
from millrace.operators import joins
from millrace.operators.joins import JOIN_TYPES, fits_broadcast, join_tables

LEFT = [(1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "d"), (4, "e")]
RIGHT = [(1, 10), (1, 11), (2, 20), (3, 30), (None, 40), (3, 30)]


def expected(how: str) -> Counter:
    pairs = [(l, r) for l, r in product(LEFT, RIGHT) if l[0] is not None and l[0] == r[0]]
    matched_left = {id(l) for l, _ in pairs}
    matched_right = {id(r) for _, r in pairs}
    inner = [(l[0], l[1], r[1]) for l, r in pairs]
    only_left = [(l[0], l[1], None) for l in LEFT if id(l) not in matched_left]
    only_right = [(r[0], None, r[1]) for r in RIGHT if id(r) not in matched_right]
    return Counter(
        {
            "inner": inner,
            "left": inner + only_left,
            "right": inner + only_right,
            "full": inner + only_left + only_right,
            "left_semi": [l for l in LEFT if id(l) in matched_left],
            "left_anti": [l for l in LEFT if id(l) not in matched_left],
        }[how]
    )


@pytest.fixture
def sides(spark):
    return (
        spark.createDataFrame(LEFT, "k int, x string"),
        spark.createDataFrame(RIGHT, "k int, y int"),
    )


@pytest.mark.parametrize("salt", [None, 3])
@pytest.mark.parametrize("how", JOIN_TYPES)
def test_join_types(sides, how, salt):
    joined = join_tables(*sides, on="k", how=how, salt=salt)
    assert joined.columns == ["k", "x"] if "semi" in how or "anti" in how else ["k", "x", "y"]
    assert Counter(map(tuple, joined.collect())) == expected(how)


def test_clashing_columns_get_a_suffix(spark):
    left = spark.createDataFrame([(1, "a", 5)], "k int, v string, w int")
    right = spark.createDataFrame([(1, "b")], "k int, v string")
    joined = join_tables(left, right, "k")
    assert joined.columns == ["k", "v", "w", "v_right"]
    assert tuple(joined.first()) == (1, "a", 5, "b")


def test_unknown_type_and_key_are_refused(sides):
    with pytest.raises(ValueError, match="cross"):
        join_tables(*sides, on="k", how="cross")
    with pytest.raises(ValueError, match="absent"):
        join_tables(*sides, on="absent")


def test_align_keys(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([("1",), ("n/a",)], "k string")
    assert [r.k for r in join_tables(left, right, "k", align_keys=True).collect()] == ["1"]


@pytest.mark.parametrize(
    ("left", "right", "meet"),
    [
        (T.IntegerType(), T.LongType(), T.LongType()),
        (T.LongType(), T.FloatType(), T.DoubleType()),
        (T.FloatType(), T.DoubleType(), T.DoubleType()),
        (T.IntegerType(), T.StringType(), T.StringType()),
        (T.DateType(), T.TimestampType(), T.TimestampType()),
        (T.LongType(), T.DecimalType(20, 2), T.DecimalType(22, 2)),
        (T.DecimalType(10, 4), T.DecimalType(12, 2), T.DecimalType(14, 4)),
    ],
)
def test_wider(left, right, meet):
    assert wider(left, right) == meet
    assert wider(right, left) == meet


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_needs_a_small_side(spark, sides, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan(join_tables(*sides, on="k", broadcast="right"))
        assert not fits_broadcast(sides[1], max_rows=2)
        assert not fits_broadcast(sides[1], max_bytes=10)
        monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
        large = join_tables(*sides, on="k", broadcast="right")
        assert "BroadcastHashJoin" not in plan(large)
        assert Counter(map(tuple, large.collect())) == expected("inner")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_side_must_suit_the_join(sides):
    with pytest.raises(ValueError, match="left"):
        join_tables(*sides, on="k", how="left", broadcast="left")


def test_salting_spreads_equal_rows_of_frequent_keys(spark):
    rows = spark.range(1000).selectExpr("1 AS k", "'same' AS x").unionAll(
        spark.range(1).selectExpr("2 AS k", "'other' AS x")
    )
    frequent = F.col("k") == 1
    dealt = joins.salted(rows, frequent, 8).groupBy("k", "__salt").agg(F.sum("__times").alias("n"))
    found = {(r.k, r["__salt"]): r.n for r in dealt.collect()}
    assert found == {(1, i): 125 for i in range(8)} | {(2, 0): 1}


@pytest.mark.parametrize("how", JOIN_TYPES)
def test_salted_joins_shuffle_and_agree(spark, how):
    left = spark.range(3000).selectExpr("IF(id % 3 = 0, id, 7) AS k", "'same' AS `x.y`")
    right = spark.createDataFrame([(7, "a"), (7, "a"), (9, "b"), (10_000, "c"), (None, "d")], "k int, y string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        salted = join_tables(left, right, "k", how, salt=4)
        assert "BroadcastHashJoin" not in plan(salted)
        plain = Counter(map(tuple, join_tables(left, right, "k", how).collect()))
        assert Counter(map(tuple, salted.collect())) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_frequent_keys_are_split(spark):
    keys = spark.range(5000).selectExpr("IF(id < 100, -1, id) AS k")
    hashed = F.xxhash64("k")
    expected_hash = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long")).alias("h")).first().h
    assert joins.hot_keys(keys, hashed) == [expected_hash]
    assert joins.hot_keys(keys.limit(0), hashed) == []


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_keys_frequent_on_both_sides(spark, how):
    # Key 1 holds a third of both sides, with equal rows among them; nulls are frequent too.
    left = [(1, k % 7) for k in range(60)] + [(None, k) for k in range(30)] + [(k, k) for k in range(2, 92)]
    right = [(1, k % 5) for k in range(40)] + [(None, k) for k in range(20)] + [(k // 2, k) for k in range(100, 160)]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y int")
    plain = Counter(map(tuple, join_tables(a, b, "k", how).collect()))
    assert Counter(map(tuple, join_tables(a, b, "k", how, salt=5).collect())) == plain


def test_a_grid_spreads_a_key_on_both_axes(spark):
    salt, n = 6, 300
    a = spark.createDataFrame([(1, k % 50) for k in range(n)], "k int, x int")
    b = spark.createDataFrame([(1, k % 40) for k in range(n)], "k int, y int")
    left, right = joins._grid(a, b, F.lit(True), salt)
    for df, times, axis in ((left, "__times", "__salt"), (right, "__other_times", "__cell")):
        cells = df.groupBy("__salt", "__cell").agg(F.sum(times).alias("n")).collect()
        assert len(cells) == salt * salt
        # A cell has about its share of one axis, not all rows of the key.
        assert all(r.n < 2.5 * n / salt for r in cells) and sum(r.n for r in cells) == n * salt
        assert axis in df.columns
    pairs = left.join(right, ["k", "__salt", "__cell"]).agg(F.sum(F.col("__times") * F.col("__other_times"))).first()[0]
    assert pairs == n * n


def test_hot_keys_take_one_pass(spark):
    rows = [(1,)] * 500 + [(k,) for k in range(2, 502)]
    df = spark.createDataFrame(rows, "k int")
    one = df.filter("k = 1").select(F.xxhash64("k")).first()[0]
    assert joins.hot_keys(df, F.xxhash64("k"), 10) == [one]
    assert joins.hot_keys(df.limit(0), F.xxhash64("k")) == []


@pytest.mark.parametrize("how", ["inner", "full"])
def test_pairs_of_frequent_keys_spread_over_tasks(spark, how, monkeypatch):
    # Few rows make many pairs: tasks follow the pairs, not the bytes they read.
    monkeypatch.setattr(joins, "TASK_PAIRS", 5_000, raising=False)
    monkeypatch.setattr(joins, "CELL_ROWS", (100, 40), raising=False)
    left = [(k % 2, k % 290) for k in range(600)] + [(None, 1), (5, 1)]
    right = [(k % 2, k % 190) for k in range(400)] + [(None, 1), (6, 1)]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y int")
    joined = join_tables(a, b, "k", how, salt=2)
    tasks = joined.filter("k < 2").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 6 and max(r["count"] for r in tasks) < 120_000 / 4
    plain = Counter(map(tuple, join_tables(a, b, "k", how).collect()))
    assert Counter(map(tuple, joined.collect())) == plain
