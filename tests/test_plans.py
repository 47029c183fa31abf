"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry_points
from millrace.operators import checks as q
from millrace.operators import joins, search
from millrace.operators.chunks import upsert
from millrace.operators.impute import impute
from millrace.operators.search import top_k
from millrace.operators.stats import column_modes

FOLDER = entry_points.SMALL
QUERIES = entry_points.queries()

# Queries that run jobs of their own while they are built.
EAGER = {n for n in QUERIES if n.startswith(("flagship", "job_", "train_", "score_", "global_"))}
EAGER |= {"stage_log"}


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_query_joins_without_keys(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["filter_rows"](spark, FOLDER))
    assert "GreaterThan(o_totalprice,200000.0)" in text
    assert "o_orderdate" not in text.split("ReadSchema")[1]


def test_means_are_one_partial_aggregate(spark):
    text = plan(QUERIES["column_means"](spark, FOLDER))
    assert text.count("FileScan") == 1
    assert text.count("partial_avg") == 5
    assert "l_shipdate" not in text


def test_modes_take_one_scan(spark):
    text = plan(column_modes(spark.read.parquet(f"{FOLDER}/orders.parquet"),
                             ["o_orderstatus", "o_orderpriority"]))
    assert text.count("FileScan") == 1
    assert "partial_count" in text


def test_imputation_adds_no_join(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(impute(orders).data)
    assert "Join" not in text
    assert "Subquery" in text
    at_once = plan(impute(orders, now=True).data)
    assert "Subquery" not in at_once
    assert at_once.count("FileScan") == 1


def test_validation_scans_once_and_reads_only_checked_columns(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    suite = q.Suite(
        "s",
        [q.not_null("o_orderkey"), q.between("o_totalprice", 0, 1), q.match_regex("o_orderstatus", "F")],
    )
    text = plan(q.validate(orders, suite))
    assert text.count("FileScan") == 1
    assert "o_orderdate" not in text
    unique = plan(q.validate(orders, q.Suite("u", [q.unique("o_orderkey")])))
    assert "partial_count" in unique
    assert "o_totalprice" not in unique


def test_top_k_keeps_the_best_of_each_partition(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    text = plan(top_k(vectors, [1.0] * 64, key="vec_id"))
    assert "TakeOrderedAndProject" in text
    assert text.count("ArrowEvalPython") == 1


def test_batch_search_limits_before_the_shuffle(spark):
    text = plan(QUERIES["top_k_join"](spark, FOLDER))
    above, below = text.split("Exchange", 1)
    assert "WindowGroupLimit" in above
    assert "WindowGroupLimit" in below


def test_no_round_of_batch_search_shuffles_vectors(spark, monkeypatch):
    plans = []

    def scored(*args):
        found = score_block(*args)
        plans.append(plan(found))
        return found

    score_block = search._score_block
    monkeypatch.setattr(search, "_score_block", scored)
    assert QUERIES["top_k_join_in_blocks"](spark, FOLDER).count() > 0
    assert len(plans) > 1
    for text in plans:
        assert "MapInArrow" in text and "Scan parquet" in text
        assert "Exchange" not in text


def test_upsert_does_not_shuffle_the_stored_table_for_few_keys(spark, monkeypatch):
    stored = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    new = stored.filter("role = 'assistant'")
    kept = plan(upsert(stored, new, "conv_id", "turn")).split("Union")[1].split("SortAggregate")[0]
    assert "BroadcastHashJoin" in kept
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(upsert(stored, new, "conv_id", "turn"))
        assert "SortMergeJoin" in text
        assert "BroadcastHashJoin" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
