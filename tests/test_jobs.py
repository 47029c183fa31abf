from __future__ import annotations

import logging

import pytest

from millrace.operators import checks as q
from millrace.operators.model import score, to_score, train
from millrace.plans.job import Spec, audit, run_files, run_job
from millrace.plans.scoring import score_applicants
from millrace.sources.models import load_model, save_model
from millrace.sources.readers import SourceError


@pytest.fixture
def applicants(spark):
    rows = [(1, 10000, 0), (2, None, 1), (3, 120050, 0)]
    return spark.createDataFrame(rows, "SK_ID_CURR int, AMT_INCOME_TOTAL int, TARGET int")


@pytest.fixture
def records(spark):
    rows = [(1, "Active", 1000), (1, "Closed", 500), (2, "Closed", 5000)]
    return spark.createDataFrame(
        rows, "SK_ID_CURR int, CREDIT_ACTIVE string, AMT_CREDIT_SUM int"
    )


MEASURES = {"credits": "count(1)", "credit_sum": "sum(AMT_CREDIT_SUM)"}


@pytest.mark.parametrize("stage", ["table", "persist", None])
def test_flagship(spark, applicants, records, tmp_path, stage):
    path, report = str(tmp_path / "out"), str(tmp_path / "report")
    done = score_applicants(
        applicants, records, "SK_ID_CURR", "AMT_INCOME_TOTAL", MEASURES, path, stage, report
    )
    rows = {r.SK_ID_CURR: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {1, 2}
    assert rows[2].AMT_INCOME_TOTAL == 10000
    assert rows[1].score == 0.0
    assert spark.read.parquet(report).count() == 8
    assert done.warnings == []
    assert [(r.stage, r.rows) for r in done.log.orderBy("position").collect()] == [
        ("joined", 2), ("cleaned", 2), ("scored", 2)
    ]
    done.release()


def join_spec(checks, **more):
    return {
        "source": [{"name": "applicants"}, {"name": "records"}],
        "transformation": [
            {
                "type": "join",
                "inputs": ["applicants", "records"],
                "on": "SK_ID_CURR",
                "output_table_name": "joined",
                "data_quality_checks": checks,
            }
        ],
        **more,
    }


UNIQUE = {"expectation_type": "expect_column_values_to_be_unique", "column": "SK_ID_CURR"}


def test_fan_out_fails_the_unique_key_and_is_reported(spark, applicants, records, tmp_path):
    report = str(tmp_path / "report")
    tables = {"applicants": applicants, "records": records}
    with pytest.raises(q.CriticalCheckFailed, match="unique"):
        run_job(tables, join_spec([UNIQUE]), report_path=report)
    (row,) = spark.read.parquet(report).collect()
    assert (row.success, row.unexpected) == (False, 2)


def test_warnings_let_the_job_go_on(applicants, records, caplog):
    tables = {"applicants": applicants, "records": records}
    with caplog.at_level(logging.WARNING):
        done = run_job(tables, join_spec([{**UNIQUE, "severity": "WARNING"}]))
    assert done.data.count() == 3
    assert [w.check for w in done.warnings] == ["unique"]
    assert "unique on SK_ID_CURR failed" in caplog.text


def test_left_join_impute_and_train(applicants, records):
    spec = join_spec([])
    spec["transformation"][0]["how"] = "left"
    spec["transformation"].append(
        {
            "type": "column_manipulation",
            "transformations_details": [
                {"operation": "impute"},
                {"operation": "rename_column", "names": {"AMT_CREDIT_SUM": "credit"}},
                {"operation": "cast", "types": {"credit": "double"}},
                {"operation": "filter_rows", "predicate": "credit >= 0"},
                {"operation": "derive", "expressions": {"half": "credit / 2"}},
                {
                    "operation": "select",
                    "columns": ["SK_ID_CURR", "AMT_INCOME_TOTAL", "credit", "half", "TARGET"],
                },
            ],
            "output_table_name": "cleaned",
        }
    )
    done = run_job({"applicants": applicants, "records": records}, spec, keep=["TARGET"])
    rows = done.data.collect()
    assert len(rows) == 4
    assert all(v is not None for r in rows for v in r)
    assert [r.credit for r in rows if r.SK_ID_CURR == 3] == [2166.0]
    model = train(done.data, ["AMT_INCOME_TOTAL", "credit"], "TARGET", "gbt", maxIter=2)
    spec["output"] = [
        {
            "type": "scoring_model",
            "model": "loan",
            "confidence": True,
            "output_table_name": "scored",
            "data_quality_checks": [
                {
                    "expectation_type": "expect_column_values_to_be_between",
                    "column": "score",
                    "kwargs": {"min_value": 0, "max_value": 100},
                }
            ],
        },
        {"type": "metadata", "expressions": {"run": "'first'"}},
    ]
    scored = run_job(
        {"applicants": applicants, "records": records}, spec, models={"loan": model}
    )
    assert {"score", "confidence", "prediction", "run"} <= set(scored.data.columns)
    assert [r.success for r in scored.results.collect()] == [True]


def test_rules(applicants):
    spec = {
        "source": [{"name": "applicants"}],
        "business_rules": [
            {"type": "condition", "predicate": "AMT_INCOME_TOTAL > 0"},
            {"type": "calculation", "expressions": {"r": "try_divide(1, TARGET)"}},
            {
                "type": "domain_logic",
                "name": "band",
                "cases": [{"when": "AMT_INCOME_TOTAL > 50000", "then": "high"}],
                "default": "low",
            },
        ],
    }
    rows = run_job({"applicants": applicants}, spec).data.orderBy("SK_ID_CURR").collect()
    assert [(r.SK_ID_CURR, r.r, r.band) for r in rows] == [(1, None, "low"), (3, None, "high")]


def test_model_round_trip(spark, tmp_path):
    rows = [(float(i), float(i % 7), int(i > 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = train(df, ["a", "b"], "y")
    save_model(model, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"))
    got = to_score(score(df, loaded), confidence=True).collect()
    assert all(0 <= r.score <= 100 and 0.5 <= r.confidence <= 1 for r in got)
    assert [r.prediction for r in got] == [float(r.y) for r in got]
    with pytest.raises(ValueError, match="forest"):
        train(df, ["a"], "y", "forest")


def test_missing_table_then_missing_column_stop_the_job(spark, applicants, tmp_path):
    base = str(tmp_path)
    applicants.toPandas().to_csv(tmp_path / "applicants.csv", index=False)
    spec = {
        "source": [{"name": "applicants"}, {"name": "non_existent_table"}],
        "transformation": [{"type": "filter", "predicate": "x", "details": "by SK_ID_CLIENT"}],
    }
    with pytest.raises(SourceError, match="non_existent_table.csv"):
        run_files(spark, base, spec)
    spec["source"] = [{"name": "applicants"}]
    with pytest.raises(ValueError, match="SK_ID_CLIENT"):
        run_files(spark, base, spec)
    spec["transformation"] = [
        {"type": "filter", "predicate": "TARGET = 0", "details": "where TARGET is 0"}
    ]
    assert run_files(spark, base, spec).data.count() == 2


def test_audit_knows_what_the_spec_creates(applicants, records):
    spec = join_spec([{"expectation_type": "not_null", "column": "made"}])
    spec["transformation"].insert(
        0,
        {
            "type": "aggregation", "inputs": ["records"], "by": ["SK_ID_CURR"],
            "measures": {"made": "count(1)"}, "output_table_name": "records",
        },
    )
    spec["business_rules"] = [{"type": "condition", "predicate": "x", "details": "NO_SUCH"}]
    absent = audit(spec, {"applicants": applicants, "records": records})
    assert [r.column for r in absent.collect()] == ["NO_SUCH"]


def test_specs_are_checked(applicants):
    with pytest.raises(ValueError, match="sort"):
        Spec.from_dict({"source": [{"name": "a"}], "transformation": [{"type": "sort"}]})
    with pytest.raises(ValueError, match="no table"):
        run_job({"applicants": applicants}, {"source": [{"name": "b"}]})
    bad = {
        "source": [{"name": "applicants"}],
        "transformation": [
            {"type": "column_manipulation", "transformations_details": [{"operation": "melt"}]}
        ],
    }
    with pytest.raises(ValueError, match="melt"):
        run_job({"applicants": applicants}, bad)
    assert Spec.from_json('{"source": [{"name": "a"}]}').sources == ("a",)
