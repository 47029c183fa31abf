"""Rows that do not fit, files that change, names with digits, suites with versions, mistyped specs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import catalog as cat
from millrace.operators import checks as q
from millrace.operators.names import automaton_of, match_names, names_in
from millrace.plans.job import run_files, run_job
from millrace.sources.readers import file_state, read_csv_sorted


def jobs_of(spark, label, action):
    """How many Spark jobs an action starts."""
    context = spark.sparkContext
    context.setJobGroup(label, label)
    try:
        result = action()
        return result, len(context.statusTracker().getJobIdsForGroup(label))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


GOOD, BROKEN = ["1,a,0.5", '2,"b, c",1.5', "3,,"], ["4,d", "x,e,2.5", "5,f,3.5,more", "6,g,much"]


@pytest.fixture
def people(tmp_path):
    lines = ["id,name,share", GOOD[0], BROKEN[0], GOOD[1], BROKEN[1], BROKEN[2], GOOD[2], BROKEN[3]]
    (tmp_path / "people.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_rows_that_do_not_fit_are_set_apart(spark, people):
    found = read_csv_sorted(spark, f"{people}/people.csv", "id int, name string, share double")
    assert sorted(map(tuple, found.data.collect())) == [(1, "a", 0.5), (2, "b, c", 1.5), (3, None, None)]
    assert sorted(r.record for r in found.rejects.collect()) == sorted(BROKEN)
    # Which columns are read makes no difference to what fits.
    assert found.data.select("id").count() == 3 and found.data.agg(F.sum("share")).first()[0] == 2.0
    assert found.rejects.count() == len(BROKEN)
    with pytest.raises(ValueError, match="__record"):
        read_csv_sorted(spark, f"{people}/people.csv", "__record string")


def test_jobs_count_rejects(spark, people, tmp_path):
    spec = {"source": [{"name": "people"}], "transformation": [{"type": "filter", "predicate": "id > 1"}]}
    schemas = {"people": "id int, name string, share double"}
    rejects = str(tmp_path / "rejects")
    done = run_files(spark, people, spec, schemas=schemas, reject_path=rejects)
    assert done.data.count() == 2
    assert [(r.stage, r.rows) for r in done.log.collect()] == [("rejected people", len(BROKEN))]
    assert spark.read.parquet(f"{rejects}/people").count() == len(BROKEN)
    assert run_files(spark, people, spec, schemas=schemas).log.count() == 0


def test_profiles_follow_the_state_of_files(spark, people, tmp_path):
    path, store = f"{people}/people.csv", str(tmp_path / "store")
    assert file_state(spark, f"{people}/none.csv") is None
    first = cat.cached_profile_path(spark, path, "people.csv", store)
    assert {r.column for r in first.collect()} == {"id", "name", "share"}
    again, jobs = jobs_of(spark, "again", lambda: cat.cached_profile_path(spark, path, "people.csv", store))
    assert jobs == 0 and again.collect() == first.collect()
    with open(path, "a") as more:
        more.write("7,,1.0\n")
    changed, jobs = jobs_of(spark, "changed", lambda: cat.cached_profile_path(spark, path, "people.csv", store))
    assert jobs > 0
    assert {r.column: r.null_count for r in changed.collect()}["name"] == 2
    assert len(os.listdir(f"{store}/table=people.csv")) == 1
    assert cat.cached_profile_path(spark, f"{people}/none.csv", "none", store).count() == 0


def test_described_files_are_not_opened_again(spark, people, tmp_path):
    dictionary = spark.createDataFrame([("people", "id", "Key"), ("none", "x", "No file")], "Table string, Row string, Description string")
    store = str(tmp_path / "store")
    first = cat.profile_sources(spark, dictionary, people, store).collect()
    os.chmod(f"{people}/people.csv", 0o000)
    assert cat.profile_sources(spark, dictionary, people, store).collect() == first and len(first) == 3


def test_names_with_digits_spaces_and_dots(spark):
    names = ["SK_ID_CURR2", "SK_ID_CURR", "AMT CREDIT", "a.b", "b", "", None, "é1", "b"]
    catalog = spark.createDataFrame([(n,) for n in names], "column string")
    texts = [
        (1, "use SK_ID_CURR2, not XSK_ID_CURR"), (2, "AMT CREDIT/a.b"), (3, "(b)b b2 _b éb"), (4, None), (5, ""),
        (6, "é1 SK_ID_CURR"), (7, "SK_ID_CURR2SK_ID_CURR"), (8, "x" * 100_000 + " b"),
    ]
    df = spark.createDataFrame(texts, "id int, `the.text` string").withColumn("names", F.lit("clash"))
    wanted = {1: ["SK_ID_CURR2"], 2: ["AMT CREDIT", "a.b", "b"], 3: ["b"], 4: [], 5: [], 6: ["SK_ID_CURR", "é1"], 7: [], 8: ["b"]}
    for size in (1 << 20, 8):
        found = match_names(df, "the.text", catalog, into="found", size=size)
        assert {r.id: r.found for r in found.collect()} == wanted and "names" in found.columns
    assert [r.found for r in match_names(df, "the.text", catalog.limit(0), into="found").collect()] == [[]] * len(texts)
    assert names_in("b", automaton_of(["b"])) == ["b"]


def test_suites_have_versions(spark, tmp_path):
    store = str(tmp_path / "suites")
    assert q.suite_versions(spark, store).count() == 0
    with pytest.raises(q.SuiteNotFound):
        q.latest_suite(spark, "s", store)
    one = q.Suite("s", [q.between("a", 0), q.match_regex("b", "x").warning().described("has x")])
    two = one.with_checks(q.unique("a"))
    assert [q.keep_version(spark, s, store) for s in (one, one, two, two, one)] == [1, 1, 2, 2, 3]
    assert q.keep_version(spark, q.Suite("empty"), store) == 1 and q.keep_version(spark, q.Suite("empty"), store) == 1
    assert q.latest_suite(spark, "s", store) == one and q.latest_suite(spark, "empty", store) == q.Suite("empty")
    assert q.suite_versions(spark, store).filter("suite = 's'").count() == 2 + 3 + 2
    with pytest.raises(ValueError, match="table"):
        q.keep_version(spark, q.Suite("t", [q.distinct_in_set("a", spark.range(2))]), store)


def test_jobs_validate_by_the_stored_suite(spark, tmp_path):
    store = str(tmp_path / "suites")
    given = spark.createDataFrame([(1,), (None,)], "a int")
    check = {"expectation_type": "not_null", "column": "a", "severity": "WARNING", "description": "known"}
    spec = {"source": [{"name": "given"}], "global_data_quality_checks": [check]}
    done = run_job({"given": given}, spec, suite_store=store)
    assert [(w.check, w.detail.description) for w in done.warnings] == [("not_null", "known")]
    assert [(r.suite, r.version, r.check) for r in q.suite_versions(spark, store).collect()] == [("global_suite", 1, "not_null")]


def test_mistyped_parts_of_specs_are_found(spark):
    specs = [
        {"source": [{"name": "t"}], "transformation": {"details": "use BAD_COL"}},
        {"source": [{"name": "t"}], "transformation": [{"transformations_details": [{"columns": "BAD_COL"}]}]},
        {"source": "t"},
        {"source": [{"name": "t"}], "output": None, "other": 5, "transformation": []},
        {"source": [None, {"name": ["t"]}]},
    ]
    rows = [(k, json.dumps(s)) for k, s in enumerate(specs)] + [(8, "[1]"), (9, "no"), (10, None)]
    df = spark.createDataFrame(rows, "id int, path string")
    found = [tuple(r) for r in cat.mistyped_parts(df, "id", "path").orderBy("spec_id").collect()]
    assert found == [
        (0, "$.transformation", "list", "object"),
        (1, "$.transformation[0].transformations_details[0].columns", "list", "text"),
        (2, "$.source", "list", "text"),
        (4, "$.source[1].name", "text", "list"),
        (8, "$", "object", "list"),
    ]
    reasons = {r.spec_id: r.reason for r in cat.malformed_specs(df, "id", "path").collect()}
    assert reasons == {k: "mistyped parts" for k in (0, 1, 2, 4)} | {8: "not an object", 9: "not JSON", 10: "no text"}
