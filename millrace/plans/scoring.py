"""The default job: applicants and their credit records, checked, imputed and scored."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from millrace.functions.fixed import CRITICAL, SCORE_MAX, SCORE_MIN, WARNING
from millrace.plans.job import JobResult, run_job


def scoring_spec(key: str, income: str, records: dict[str, str], score: str = "score") -> dict:
    """Spec of the default job.

    The record table has many rows per applicant; it is aggregated to one row per key
    before the join, because the joined table must have a unique key.
    """

    def check(kind: str, column: str, severity: str, text: str, **kwargs: Any) -> dict:
        return {
            "expectation_type": kind,
            "column": column,
            "kwargs": kwargs,
            "severity": severity,
            "description": text,
        }

    return {
        "source": [{"name": "applicants"}, {"name": "records"}],
        "transformation": [
            {
                "type": "aggregation",
                "inputs": ["records"],
                "by": [key],
                "measures": records,
                "output_table_name": "record_totals",
            },
            {
                "type": "join",
                "inputs": ["applicants", "record_totals"],
                "on": key,
                "how": "inner",
                "output_table_name": "joined",
                "data_quality_checks": [
                    check("not_null_not_empty", key, CRITICAL, "the key is never null or blank"),
                    check("unique", key, CRITICAL, "one row per applicant"),
                    check("of_type", key, WARNING, "the key is an integer", type="integer"),
                ],
            },
            {
                "type": "column_manipulation",
                "transformations_details": [{"operation": "impute"}],
                "output_table_name": "cleaned",
                "data_quality_checks": [
                    check("not_null", income, WARNING, "no income is left missing"),
                    check("of_type", income, WARNING, "income is numeric", type="float"),
                ],
            },
        ],
        "output": [
            {
                "type": "scoring_model",
                "column": income,
                "name": score,
                "non_negative": True,
                "output_table_name": "scored",
                "data_quality_checks": [
                    check("not_null", score, CRITICAL, "every row has a score"),
                    check(
                        "between",
                        score,
                        CRITICAL,
                        "scores stay in range",
                        min_value=SCORE_MIN,
                        max_value=SCORE_MAX,
                    ),
                    check("of_type", score, CRITICAL, "the score is numeric", type="float"),
                ],
            }
        ],
    }


def score_applicants(
    applicants: DataFrame,
    records: DataFrame,
    key: str,
    income: str,
    measures: dict[str, str],
    path: str | None = None,
    stage: str | None = "table",
    report_path: str | None = None,
) -> JobResult:
    """Run the default job; writes the scored table to ``path`` when one is given."""
    spec = scoring_spec(key, income, measures)
    if path:
        spec["output"].append({"type": "format", "path": path})
    return run_job(
        {"applicants": applicants, "records": records},
        spec,
        stage=stage,
        report_path=report_path,
    )
