"""Outputs are written once, checked, then put in place; stages keep the columns still needed."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.checks import Check, CriticalCheckFailed
from millrace.plans import job
from millrace.plans.job import Spec, run_job
from millrace.plans.liveness import live_columns
from millrace.queries.of_jobs import _ratio_spec
from millrace.sources.scratch import beside, swap

NOT_NULL = {"expectation_type": "not_null", "column": "twice"}
UNIQUE = {"expectation_type": "unique", "column": "id"}


def spec(path, checks, **more):
    return {
        "source": [{"name": "given"}],
        "transformation": [
            {"type": "column_manipulation", "transformations_details": [{"operation": "derive", "expressions": {"twice": "seen(v)"}}]}
        ],
        "output": [{"type": "format", "path": path, "columns": ["id", "twice"], **more}],
        "global_data_quality_checks": checks,
    }


@pytest.fixture
def given(spark):
    return spark.createDataFrame([(k, k + 1) for k in range(40)], "id int, v int").repartition(3)


@pytest.fixture
def seen(spark):
    times = spark.sparkContext.accumulator(0)

    def doubled(x):
        times.add(1)
        return 2 * x

    spark.udf.register("seen", doubled, "int")
    return times


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_the_final_plan_runs_once(spark, given, seen, tmp_path, fmt):
    path = str(tmp_path / "out")
    done = run_job({"given": given}, spec(path, [NOT_NULL, UNIQUE], fmt=fmt))
    assert seen.value == 40
    assert [(r.check, r.success, r.total) for r in done.results.collect()] == [("not_null", True, 40), ("unique", True, 40)]
    assert done.log.first().rows == 40
    if fmt == "parquet":
        assert done.data.agg(F.sum("twice")).first()[0] == 2 * sum(range(1, 41))
        assert seen.value == 40
    assert os.listdir(tmp_path) == ["out"]


def test_a_failing_check_leaves_the_old_output(spark, given, seen, tmp_path):
    path = str(tmp_path / "out")
    run_job({"given": given}, spec(path, [NOT_NULL]))
    low = {"expectation_type": "between", "column": "twice", "kwargs": {"max_value": 0}}
    for checks in ([low], [UNIQUE, low]):
        with pytest.raises(CriticalCheckFailed):
            run_job({"given": given.unionAll(given)}, spec(path, checks), report_path=str(tmp_path / "report"))
        assert spark.read.parquet(path).count() == 40
    with pytest.raises(Exception, match="seen"):
        run_job({"given": given.withColumn("v", F.lit("x"))}, spec(path, []) | {"business_rules": [{"type": "condition", "predicate": "seen(id, 1) > 0"}]})
    assert sorted(os.listdir(tmp_path)) == ["out", "report"]
    assert spark.read.parquet(path).count() == 40
    run_job({"given": given.limit(5)}, spec(path, [{**low, "severity": "WARNING"}]))
    assert spark.read.parquet(path).count() == 5
    assert sorted(os.listdir(tmp_path)) == ["out", "report"]


def test_no_output_is_put_in_place_before_all_are_checked(spark, given, seen, tmp_path):
    two = spec(str(tmp_path / "b"), [{"expectation_type": "between", "column": "twice", "kwargs": {"max_value": 0}}])
    two["output"].insert(0, {"type": "format", "path": str(tmp_path / "a"), "input_table_name": "given"})
    two["output"][1]["input_table_name"] = "given"
    with pytest.raises(CriticalCheckFailed):
        run_job({"given": given}, two)
    assert os.listdir(tmp_path) == []


def test_swap_puts_the_old_table_back(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="does not exist|cannot move"):
        swap(spark, beside(path), path)
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["t"]


def test_stages_hold_only_needed_columns(spark, monkeypatch, tmp_path):
    written = {}

    def noted(df, path, fmt="parquet"):
        written[path.rpartition("/")[2].split("-")[0]] = df.columns
        write(df, path, fmt)

    write = job.write_table
    monkeypatch.setattr(job, "write_table", noted)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_orderkey", "orderkey")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumnRenamed("l_orderkey", "orderkey")
    run_job({"orders": orders, "lineitem": lines}, _ratio_spec(str(tmp_path / "out")))
    assert written["joined"] == ["orderkey", "o_orderstatus", "o_totalprice", "l_linenumber", "l_extendedprice", "l_discount"]


STEPS = [
    {"type": "join", "inputs": ["a", "b"], "on": "k", "output_table_name": "j", "data_quality_checks": [{"expectation_type": "not_null", "column": "checked"}]},
    {"type": "filter", "predicate": "lower(`odd name`) = 'x'", "output_table_name": "f"},
    {"type": "aggregation", "by": ["k"], "measures": {"m": "sum(v_right)", "n": "count(*)"}, "output_table_name": "g"},
    {"type": "column_manipulation", "transformations_details": [{"operation": "rename_column", "names": {"m": "total"}}]},
]
COLUMNS = ["k", "checked", "odd name", "V", "w", "m", "n", "total"]


def columns(**more):
    source = [{"name": "a"}, {"name": "b"}]
    return [n.columns(COLUMNS) for n in live_columns(Spec.from_dict({"source": source, "transformation": STEPS, **more}))]


def test_columns_that_are_needed():
    kept = columns()
    # The right "v" of the join is there under a longer name; nothing passes the grouping.
    assert [c for c in kept[0] if c not in ("m", "n")] == ["k", "checked", "odd name", "V"]
    assert "checked" not in kept[1] and kept[2] == kept[3] == COLUMNS
    ended = columns(output=[{"type": "format", "columns": ["total"]}], global_data_quality_checks=[])
    assert ended[3] == ["total"] and set(ended[2]) >= {"m", "total"} and "k" not in ended[2] and "w" not in ended[2]
    assert columns(output=[{"type": "format", "columns": ["total"], "path": "p"}])[3] == ["total"]
    rules = [{"type": "calculation", "expressions": {"h": "xxhash64(*)"}}]
    assert columns(business_rules=rules, output=[{"type": "format", "columns": ["h"]}])[3] == COLUMNS
    assert columns(output=[{"type": "scoring_model", "model": "m"}])[3] == COLUMNS


def test_odd_names_are_found():
    from millrace.plans.liveness import mention

    names = ['say "x"', "a`b", "back\\slash", "naïve", "unused"]
    needed = mention({"e": 'upper(`say "x"`) = `a``b`', "more": ["BACK\\SLASH", "`Naïve`_1"]})
    assert needed.columns(names) == names[:4]


def test_checks_name_their_columns():
    check = Check("proportion_between", "k", {"condition": "w > 1"})
    from millrace.plans.liveness import _of_checks

    assert _of_checks([check]).columns(COLUMNS) == ["k", "w"]
