from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.fixed import CRITICAL, WARNING
from millrace.operators import checks as q


def run(df, *checks):
    results = {}
    for check in checks:
        (row,) = q.validate(df, q.Suite("s", [check])).collect()
        results[check.kind] = row
    return results if len(checks) > 1 else row


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, "2024-01-31"), (2, " ", -5.0, "31/01/2024"), (2, None, None, None)],
        "k int, s string, d double, day string",
    )


def test_null_checks(table):
    assert run(table, q.not_null("k")).success
    row = run(table, q.not_null("s"))
    assert (row.success, row.total, row.unexpected) == (False, 3, 1)
    assert row.unexpected_pct == pytest.approx(100 / 3)
    assert run(table, q.not_null_not_empty("s")).unexpected == 2
    assert not run(table.limit(0), q.not_null_not_empty("k")).success
    assert run(table.limit(0), q.not_null("k")).success


def test_uniqueness(table):
    row = run(table, q.unique("k"))
    assert (row.success, row.total, row.unexpected) == (False, 3, 2)
    assert (row.detail.lowest, row.detail.highest) == ("2", "2")
    assert run(table, q.unique("s")).success
    assert run(table, q.pair_unique("k", "s")).success
    assert run(table, q.pair_unique("k", "s")).total == 2
    assert run(table.union(table), q.pair_unique("k", "s")).unexpected == 4
    assert run(table.limit(0), q.unique("k")).total == 0


def test_between_ignores_null(table):
    row = run(table, q.between("d", 0, 10))
    assert (row.total, row.unexpected, row.detail.lowest) == (2, 1, "-5.0")
    assert run(table, q.between("d", max_value=1)).success
    assert not run(table, q.between("d", min_value=0)).success


def test_nan_is_out_of_range(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "d double")
    assert run(df, q.between("d", 0, 10)).unexpected == 1


def test_formats_and_sets(spark, table):
    assert run(table, q.datetime_format("day", "yyyy-MM-dd")).detail.lowest == "31/01/2024"
    assert run(table, q.distinct_in_set("k", [1, 2])).success
    assert run(table, q.distinct_in_set("k", [1])).unexpected == 2
    allowed = spark.createDataFrame([(1,), (1,), (None,)], "v int")
    row = run(table, q.distinct_in_set("k", allowed))
    assert (row.total, row.unexpected, row.detail.lowest) == (3, 2, "2")
    assert run(table, q.match_regex("s", "^[a ]$")).success


def test_proportion_and_counts(table):
    assert run(table, q.proportion_between("k", 0.3, 0.4, value_set=[1])).success
    assert not run(table, q.proportion_between("k", 0.5, value_set=[1])).success
    assert run(table, q.proportion_between("d", 0.5, 0.5, condition="d > 0")).success
    assert not run(table.limit(0), q.proportion_between("k", 0, 1, value_set=[1])).success
    assert run(table, q.row_count_between(1, 3)).success
    assert not run(table, q.row_count_between(4)).success


def test_types_and_vectors(spark, table):
    assert run(table, q.of_type("k", "IntegerType")).success
    assert run(table, q.of_type("s", "float")).unexpected == 3
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<float>")
    assert run(vectors, q.vector_length("v", 2)).unexpected == 1


def test_unknown_names_are_refused(table):
    with pytest.raises(ValueError, match="nonsense"):
        q.Check("nonsense", "k")
    with pytest.raises(ValueError, match="severity"):
        q.Check("not_null", "k", severity="LOW")
    with pytest.raises(ValueError, match="absent"):
        q.validate(table, q.Suite("s", [q.not_null("absent")]))


def test_checks_from_specs():
    check = q.Check.from_dict(
        {
            "expectation_type": "expect_column_values_to_be_between",
            "column": "d",
            "kwargs": {"min_value": 0, "max_value": 100},
            "severity": "WARNING",
            "description": "range",
        }
    )
    wanted = q.between("d", 0, 100).warning().described("range")
    assert check == wanted
    pair = q.Check.from_dict(
        {
            "expectation_type": "expect_column_pair_values_to_be_unique",
            "kwargs": {"column_A": "a", "column_B": "b"},
        }
    )
    assert (pair.columns, pair.severity) == (["a", "b"], CRITICAL)


def test_a_pair_from_a_spec_is_named_in_the_result(table):
    spec = {
        "expectation_type": "expect_column_pair_values_to_be_unique",
        "kwargs": {"column_A": "k", "column_B": "s"},
    }
    assert run(table, q.Check.from_dict(spec)).column == "k, s"
    assert run(table, q.row_count_between(1)).column is None


def suite():
    return q.Suite(
        "all",
        [
            q.not_null("k"),
            q.unique("k").warning(),
            q.between("d", -10, 10),
            q.pair_unique("k", "s"),
            q.of_type("d", "float"),
            q.row_count_between(1),
        ],
    )


def by_check(results):
    return sorted(map(tuple, results.collect()), key=str)


def test_the_three_ways_to_validate_agree(spark, table, tmp_path):
    lazy = by_check(q.validate(table, suite()))
    assert len(lazy) == 6
    assert by_check(q.measure(table, suite()).results(table)) == lazy
    watched = q.watch(table, suite())
    watched.data.write.parquet(str(tmp_path / "t"))
    measured = watched.measured()
    assert measured.rows == 3
    assert measured.missing(table.columns) == {"k": 0, "s": 1, "d": 1, "day": 1}
    assert by_check(measured.results(spark.read.parquet(str(tmp_path / "t")))) == lazy


def test_row_wise_checks_share_one_scan(table):
    checks = [q.not_null("k"), q.between("d", 0, 1), q.match_regex("s", "a"), q.of_type("k", "int")]
    plan = q.validate(table, q.Suite("s", checks))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_gate_and_enforce(table):
    results = q.validate(table, suite())
    assert tuple(q.gate(results).first()) == ("all", 6, 0, 1, "continue with warnings")
    (warning,) = q.enforce(results)
    assert (warning.check, warning.severity) == ("unique", WARNING)
    critical = q.validate(table, suite().with_checks(q.not_null("s")))
    assert q.gate(critical).first().action == "halt"
    with pytest.raises(q.CriticalCheckFailed, match="not_null") as stopped:
        q.enforce(critical)
    assert [r.column for r in stopped.value.failures] == ["s"]
    assert q.gate(q.validate(table, q.Suite("s", [q.not_null("k")]))).first().action == "pass"


def test_an_empty_suite_passes(table):
    assert q.validate(table, q.Suite("none")).collect() == []


def test_stored_suites(spark, tmp_path):
    store = str(tmp_path / "suites")
    with pytest.raises(q.SuiteNotFound, match="all"):
        q.load_suite(spark, "all", store)
    assert q.get_or_create_suite(spark, "empty", store).checks == ()
    assert q.load_suite(spark, "empty", store) == q.Suite("empty")
    q.save_suite(spark, suite(), store)
    assert q.get_or_create_suite(spark, "all", store) == suite()
    replaced = q.Suite("all", [q.not_null("k")])
    q.save_suite(spark, replaced, store)
    assert q.load_suite(spark, "all", store) == replaced


def test_examples_are_bounded_and_do_not_depend_on_the_order(spark):
    rows = [(str(k), "x" * 1000 if k == 7 else f"v{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "id string, v string")
    suite = q.Suite("s", [q.match_regex("v", "^w"), q.unique("v"), q.not_null("v"), q.distinct_in_set("v", df.select("id"))])
    runs = []
    for shuffled in (df, df.orderBy(F.rand(1)).repartition(7), df.coalesce(1).unionByName(df)):
        shown = {r["check"]: r.detail.examples for r in q.validate(shuffled, suite).collect()}
        assert shown["not_null"] == []
        assert shown["match_regex"] == shown["distinct_in_set"]
        runs.append(shown)
    assert runs[0] == runs[1] and runs[0]["unique"] == []
    assert runs[2]["unique"] == runs[2]["match_regex"] == runs[0]["match_regex"]
    assert len(runs[0]["match_regex"]) == q.EXAMPLES and set(runs[0]["match_regex"]) <= {v[:200] for _, v in rows}


def test_examples_ride_on_writes(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(50)], "n int")
    suite = q.Suite("s", [q.between("n", 0, 40)])
    watched = q.watch(df, suite)
    watched.data.write.parquet(str(tmp_path / "t"))
    (seen,) = watched.measured().results(df).collect()
    (again,) = q.validate(df, suite).collect()
    assert seen == again and 1 <= len(seen.detail.examples) <= q.EXAMPLES


def test_uniqueness_checks_share_a_scan_and_a_shuffle(spark):
    rows = [(1, "a", 1.0), (1, "b", 1.0), (2, "a", None), (None, "c", 3.0), (None, None, 3.0), (2, "a", 5.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    checks = [q.unique("a"), q.pair_unique("a", "b"), q.unique("c"), q.pair_unique("b", "a"), q.unique("a").warning()]
    alone = [q.validate(df, q.Suite("s", [c])).first() for c in checks]
    assert q.validate(df, q.Suite("s", checks)).collect() == alone
    assert [r.unexpected for r in alone] == [4, 2, 4, 2, 4]
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    suite = q.Suite("s", [q.unique("l_orderkey"), q.unique("l_partkey"), q.pair_unique("l_orderkey", "l_linenumber")])
    text = q.validate(table, suite)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "l_comment" not in text
