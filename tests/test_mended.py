"""What jobs, checks and searches must not do silently."""

from __future__ import annotations

import datetime
import logging
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import checks as q
from millrace.operators import chunks as ch
from millrace.operators import columns as cols
from millrace.operators.impute import impute
from millrace.operators.joins import JOIN_TYPES, join_tables
from millrace.operators.search import top_k_join
from millrace.operators.stats import aggregate, column_modes, value_counts
from millrace.plans.job import apply_operations, run_files, run_job
from millrace.sources.readers import load_sources
from millrace.sources.scratch import shared_folder
from millrace.sources.writers import write_table


def test_mode_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([(9, "9", b"\xff"), (9, "9", b"\x0a"), (10, "10", b"\xff"), (10, "10", b"\x0a")], "n int, s string, b binary")
    assert tuple(column_modes(df, ["n", "s", "b"]).first()) == (9, "10", bytearray(b"\x0a"))


def test_extremes_of_repeated_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (9, 9, 10, 10, 100, 100, 7)], "n int")
    row = q.validate(df, q.Suite("s", [q.unique("n")])).first()
    assert (row["unexpected"], row["detail"]["lowest"], row["detail"]["highest"]) == (6, "9", "100")


@pytest.mark.parametrize("name", ["a.b", "Mixed Case", "tick`ed"])
def test_odd_names(spark, name):
    quoted = "`" + name.replace("`", "``") + "`"
    df = spark.createDataFrame([(1, 1.0), (2, None), (2, 4.0)], f"id int, {quoted} double")
    assert impute(df).data.filter(F.col(quoted).isNull()).count() == 0
    suite = q.Suite("s", [q.between(name, 0, 3), q.unique(name), q.not_null(name)])
    got = [r["unexpected"] for r in q.validate(df, suite).collect()]
    assert sorted(got) == [0, 1, 1]
    watched = q.watch(df, suite)
    watched.data.write.format("noop").mode("overwrite").save()
    assert watched.measured().missing(df.columns)[name] == 1


@pytest.mark.parametrize("name", ["a.b", "Mixed Case", "tick`ed"])
def test_odd_names_in_every_operator(spark, name):
    quoted = "`" + name.replace("`", "``") + "`"
    df = spark.createDataFrame([(1, 4), (2, 6), (2, 6)], f"{quoted} int, v int")
    for salt in (None, 2):
        for how in JOIN_TYPES:
            joined = join_tables(df, df.withColumnRenamed("v", "w"), name, how, salt=salt)
            assert joined.count() == (3 if "semi" in how else 0 if "anti" in how else 5)
    assert cols.select_columns(df, [name]).columns == [name]
    assert cols.cast_columns(df, {name: "string"}).schema[name].dataType.simpleString() == "string"
    made = cols.derive(df, {"r": cols.ratio("v", name), "m": cols.remainder(name, 2)})
    assert [tuple(r)[2:] for r in made.orderBy(F.col(quoted)).limit(1).collect()] == [(4.0, 1)]
    assert [tuple(r) for r in value_counts(df, name).collect()] == [(2, 2), (1, 1)]
    assert aggregate(df, [name], {"n": "count(1)"}).count() == 2
    assert ch.latest(df, name, "v").count() == 2


def test_named_columns_are_filled_or_refused(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, 2.0, "b")], "k int, v double, s string")
    filled = apply_operations(df, [{"operation": "impute_mean", "columns": ["k"]}], keep=["k"])
    assert filled.filter("k IS NULL").count() == 0
    with pytest.raises(ValueError, match="s: not of the type"):
        apply_operations(df, [{"operation": "impute_mean", "columns": ["s"]}])
    with pytest.raises(ValueError, match="declares w as string"):
        apply_operations(df, [{"operation": "derive", "expressions": {"w": "v + 1"}, "data_type": "string"}])
    apply_operations(df, [{"operation": "derive", "expressions": {"w": "v + 1"}, "data_type": "numeric"}])


def test_skipped_columns_are_warned_about(spark, caplog):
    df = spark.createDataFrame([(1, None)], "k int, empty double")
    spec = {
        "source": [{"name": "t"}],
        "transformation": [
            {"type": "column_manipulation", "transformations_details": [{"operation": "impute"}]}
        ],
    }
    with caplog.at_level(logging.WARNING):
        result = run_job({"t": df}, spec)
    assert "column empty has no value" in caplog.text
    assert {r["column"]: r["outcome"] for r in result.imputed.collect()} == {
        "k": "nothing missing",
        "empty": "skipped: no value present",
    }


_JOINED = {
    "source": [{"name": "a"}, {"name": "b"}],
    "transformation": [
        {
            "type": "join",
            "inputs": ["a", "b"],
            "on": "k",
            "output_table_name": "joined",
            "data_quality_checks": [{"expectation_type": "expect_column_values_to_be_unique", "column": "k"}],
        }
    ],
}


def _staged(spark) -> set[str]:
    folder = Path(shared_folder(spark)) / "millrace"
    return {p.name for p in folder.glob("*")} if folder.exists() else set()


def test_nothing_staged_is_left(spark):
    tables = {"a": spark.range(5).toDF("k"), "b": spark.range(5).toDF("k")}
    before = _staged(spark)
    result = run_job(tables, _JOINED)
    assert result.data.count() == 5 and _staged(spark) > before
    result.release()
    assert _staged(spark) == before
    with pytest.raises(q.CriticalCheckFailed):
        run_job({**tables, "b": tables["b"].union(tables["b"])}, _JOINED)
    assert _staged(spark) == before


def test_uniqueness_of_a_source_writes_nothing(spark):
    before = _staged(spark)
    spec = {
        "source": [{"name": "t"}],
        "transformation": [
            {"type": "filter", "predicate": "k > 1", "data_quality_checks": [{"expectation_type": "unique", "column": "k"}]}
        ],
    }
    assert run_job({"t": spark.range(5).toDF("k")}, spec).results.first()["success"]
    assert _staged(spark) == before


def test_check_arguments(spark):
    for wrong in (
        lambda: q.Check("between", "x", {"mostly": 0.5}),
        lambda: q.Check("match_regex", "x", {}),
        lambda: q.Check("not_null", "x", {"min_value": 1}),
        lambda: q.spark_pattern("%Y %Q"),
    ):
        with pytest.raises(ValueError):
            wrong()
    assert q.spark_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert q.spark_pattern("%d o'clock %%") == "dd' o''clock %'"


def test_suites_keep_types_and_are_not_wiped(spark, tmp_path, monkeypatch):
    suite = q.Suite("dated", [q.between("d", datetime.date(2020, 1, 2), datetime.date(2021, 1, 1))])
    q.save_suite(spark, suite, str(tmp_path))
    assert q.load_suite(spark, "dated", str(tmp_path)).checks[0].kwargs == suite.checks[0].kwargs

    def broken(*_, **__):
        raise q.SourceError("the store cannot be reached")

    monkeypatch.setattr(q, "read_table", broken)
    with pytest.raises(q.SourceError):
        q.get_or_create_suite(spark, "dated", str(tmp_path))
    monkeypatch.undo()
    assert len(q.load_suite(spark, "dated", str(tmp_path)).checks) == 1


def test_upsert_without_versions(spark):
    schema = "id int, version int, text string"
    stored = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], schema)
    new = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (3, None, "z"), (2, 5, "p"), (2, 5, "q")], schema)
    got = sorted(map(tuple, ch.upsert(stored, new, "id", "version").collect()), key=lambda r: r[0])
    assert got == [(1, None, "y"), (2, 5, "q"), (3, None, "z")]


def test_csv_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, 'c "d"')], "id int, text string")
    write_table(df, f"{tmp_path}/notes.csv", "csv")
    read = load_sources(spark, str(tmp_path), ["notes"], "csv", options={"multiLine": "true"})["notes"]
    assert sorted(map(tuple, read.collect())) == [(1, "a\nb"), (2, 'c "d"')]
    spec = {"source": [{"name": "notes"}], "output": [{"type": "format"}]}
    done = run_files(spark, str(tmp_path), spec, schemas={"notes": "id int, text string"}, reader={"multiLine": "true"})
    assert done.data.count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        reader = {"mode": "FAILFAST"}
        run_files(spark, str(tmp_path), spec, schemas={"notes": "id int, text string"}, reader=reader).data.collect()


def test_suffixes_do_not_meet(spark):
    left = spark.createDataFrame([(1, 2, 3)], "k int, x int, x_right int")
    right = spark.createDataFrame([(1, 4, 5)], "k int, X int, y int")
    joined = join_tables(left, right, "k")
    names = [c.lower() for c in joined.columns]
    assert len(set(names)) == len(names) == 5 and joined.count() == 1


@pytest.mark.parametrize("query_bytes", [1 << 20, 1])
def test_vectors_without_direction(spark, query_bytes):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [inf, 1.0]), (4, [nan, 1.0]), (5, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id int, v array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.5]), (8, [inf, 0.0])], "q int, w array<double>")
    got = top_k_join(asked, vectors, 2, query_key="q", query_vector="w", key="id", vector="v", query_bytes=query_bytes)
    assert [tuple(r)[:2] for r in got.orderBy("rank").collect()] == [(7, 1), (7, 2)]
    alone = top_k_join(asked, vectors.filter("id > 2"), 1, query_key="q", query_vector="w", key="id", vector="v", query_bytes=query_bytes)
    assert alone.count() == 0


def test_modes_count_instants_and_zeros(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 05:30Z and 06:30Z are both 01:30 there on the day the clocks go back.
        seconds = [1604208600, 1604212200, 1604280000, 1604280000]
        rows = [(s, x) for s, x in zip(seconds, [0.0, -0.0, 5.0, float("nan")], strict=True)]
        df = spark.createDataFrame(rows, "s long, x double").select(F.timestamp_seconds("s").alias("t"), "x")
        row = column_modes(df, ["t", "x"]).select(F.unix_seconds("t").alias("t"), "x").first()
        assert (row.t, row.x) == (1604280000, 0.0)
    finally:
        spark.conf.unset("spark.sql.session.timeZone")
