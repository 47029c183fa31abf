"""Composed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.checks import CriticalCheckFailed, suite_versions
from millrace.plans.job import JobResult, run_job
from millrace.plans.scoring import score_applicants
from millrace.queries.of_columns import APPLICANTS, applicants
from millrace.queries.registry import query, table
from millrace.sources.readers import read_table
from millrace.sources.scratch import new_path


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return applicants(spark, folder).withColumnRenamed("c_custkey", "custkey")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumnRenamed("o_custkey", "custkey")


_TOTALS = {
    "orders": "count(1)",
    "total": "cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double)",
}


def run_flagship(spark: SparkSession, folder: str, path: str | None = None) -> JobResult:
    return score_applicants(
        _people(spark, folder),
        _records(spark, folder),
        "custkey",
        "c_acctbal",
        _TOTALS,
        path=path,
        report_path=f"{path}_report" if path else None,
    )


_FLAGSHIP = f"""
WITH totals AS (
    SELECT o_custkey AS custkey, count(*) AS orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM orders GROUP BY 1),
joined AS (
    SELECT a.c_custkey AS custkey, a.c_name, a.c_nationkey, a.c_acctbal, a.c_mktsegment,
           t.orders, t.total
    FROM {APPLICANTS} a JOIN totals t ON a.c_custkey = t.custkey),
cleaned AS (
    SELECT custkey, c_name, c_nationkey, c_mktsegment, orders, total,
           coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM joined)) AS c_acctbal
    FROM joined)
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"c_acctbal": F.round("c_acctbal", 6), "score": F.round("score", 6)}
    )


@query(
    "flagship_scoring",
    _FLAGSHIP
    + """
    SELECT custkey, c_name, c_nationkey, c_mktsegment, orders, total,
           round(c_acctbal, 6) AS c_acctbal, round((c_acctbal % 100), 6) AS score
    FROM cleaned
    """,
)
def flagship_scoring(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "scored")
    run_flagship(spark, folder, path)
    return _rounded(read_table(spark, path))


@query(
    "flagship_results",
    _FLAGSHIP
    + """
    SELECT suite, "check", severity, true AS success, (SELECT count(*) FROM joined) AS total
    FROM (VALUES ('joined_suite', 'not_null_not_empty', 'CRITICAL'),
                 ('joined_suite', 'unique', 'CRITICAL'),
                 ('joined_suite', 'of_type', 'WARNING'),
                 ('cleaned_suite', 'not_null', 'WARNING'),
                 ('cleaned_suite', 'of_type', 'WARNING'),
                 ('scored_suite', 'not_null', 'CRITICAL'),
                 ('scored_suite', 'between', 'CRITICAL'),
                 ('scored_suite', 'of_type', 'CRITICAL')) AS r(suite, "check", severity)
    """,
)
def flagship_results(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "scored")
    run_flagship(spark, folder, path)
    report = read_table(spark, f"{path}_report")
    return report.select("suite", "check", "severity", "success", "total")


@query(
    "stage_log",
    _FLAGSHIP
    + """
    SELECT CAST(position AS INTEGER) AS position, stage, (SELECT count(*) FROM joined) AS rows
    FROM (VALUES (0, 'joined'), (1, 'cleaned'), (2, 'scored')) AS s(position, stage)
    """,
)
def stage_log(spark: SparkSession, folder: str) -> DataFrame:
    return run_flagship(spark, folder).log.select("position", "stage", "rows")


_LEFT_IMPUTE = {
    "source": [{"name": "applicants"}, {"name": "records"}],
    "transformation": [
        {
            "type": "filter",
            "inputs": ["records"],
            "predicate": "o_orderpriority = '1-URGENT' AND o_totalprice > 400000",
            "output_table_name": "urgent",
        },
        {
            "type": "aggregation",
            "inputs": ["urgent"],
            "by": ["custkey"],
            "measures": {"largest": "max(o_totalprice)"},
            "output_table_name": "urgent_totals",
        },
        {
            "type": "join",
            "inputs": ["applicants", "urgent_totals"],
            "on": "custkey",
            "how": "left",
            "output_table_name": "joined",
            "data_quality_checks": [
                {"expectation_type": "expect_column_values_to_be_unique", "column": "custkey"}
            ],
        },
        {
            "type": "column_manipulation",
            "transformations_details": [{"operation": "impute_mean", "columns": ["largest"]}],
            "output_table_name": "cleaned",
            "data_quality_checks": [
                {"expectation_type": "expect_column_values_to_not_be_null", "column": "largest"}
            ],
        },
    ],
    "business_rules": [],
    "output": [
        {"type": "format", "details": "a table", "columns": ["custkey", "c_name", "largest"]}
    ],
}


@query(
    "job_left_impute",
    """
    WITH urgent AS (
        SELECT o_custkey AS custkey, max(o_totalprice) AS largest FROM orders
        WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1)
    SELECT c_custkey AS custkey, c_name,
           round(coalesce(largest, (SELECT avg(largest) FROM urgent)), 6) AS largest
    FROM customer LEFT JOIN urgent ON c_custkey = custkey
    """,
)
def job_left_impute(spark: SparkSession, folder: str) -> DataFrame:
    tables = {"applicants": _people(spark, folder), "records": _records(spark, folder)}
    return run_job(tables, _LEFT_IMPUTE).data.withColumn("largest", F.round("largest", 6))


def _ratio_spec(path: str) -> dict:
    return {
        "source": [{"name": "orders"}, {"name": "lineitem"}],
        "transformation": [
            {
                "type": "join",
                "inputs": ["orders", "lineitem"],
                "on": "orderkey",
                "how": "inner",
                "output_table_name": "joined",
                "data_quality_checks": [
                    {
                        "expectation_type": "expect_column_pair_values_to_be_unique",
                        "kwargs": {"column_A": "orderkey", "column_B": "l_linenumber"},
                        "severity": "WARNING",
                    }
                ],
            },
            {
                "type": "column_manipulation",
                "transformations_details": [
                    {"operation": "impute_mean", "columns": ["l_discount"]}
                ],
            },
        ],
        "business_rules": [
            {"type": "condition", "predicate": "o_orderstatus <> 'P'"},
            {
                "type": "calculation",
                "expressions": {"price_share": "try_divide(l_extendedprice, o_totalprice)"},
            },
            {
                "type": "domain_logic",
                "name": "band",
                "cases": [{"when": "price_share > 1", "then": "above"}],
                "default": "within",
            },
        ],
        "output": [
            {"type": "format", "path": path, "columns": [
                "orderkey", "l_linenumber", "l_discount", "price_share", "band"]},
        ],
        "global_data_quality_checks": [
            {
                "expectation_type": "expect_table_row_count_to_be_between",
                "kwargs": {"min_value": 1},
            },
            {
                "expectation_type": "expect_column_values_to_not_be_null",
                "column": "price_share",
            },
        ],
    }


@query(
    "job_ratio",
    """
    WITH joined AS (
        SELECT o_orderkey AS orderkey, o_orderstatus, o_totalprice, l_linenumber,
               l_extendedprice, NULLIF(l_discount, 0) AS l_discount
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    kept AS (
        SELECT orderkey, l_linenumber, o_orderstatus, l_extendedprice / o_totalprice AS price_share,
               coalesce(l_discount, (SELECT avg(l_discount) FROM joined)) AS l_discount
        FROM joined)
    SELECT orderkey, l_linenumber, round(l_discount, 6) AS l_discount, price_share,
           CASE WHEN price_share > 1 THEN 'above' ELSE 'within' END AS band
    FROM kept WHERE o_orderstatus <> 'P'
    """,
)
def job_ratio(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "orderkey")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "orderkey")
    lines = lines.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    path = new_path(spark, "price_shares")
    run_job({"orders": orders, "lineitem": lines}, _ratio_spec(path))
    return read_table(spark, path).withColumn("l_discount", F.round("l_discount", 6))


@query(
    "global_checks",
    """
    WITH joined AS (SELECT o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT 'row_count_between' AS "check", true AS success,
           count(*) FILTER (o_orderstatus <> 'P') AS total FROM joined
    UNION ALL
    SELECT 'not_null', true, count(*) FILTER (o_orderstatus <> 'P') FROM joined
    """,
)
def global_checks(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "orderkey")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "orderkey")
    spec = _ratio_spec(new_path(spark, "price_shares"))
    results = run_job({"orders": orders, "lineitem": lines}, spec).results
    return results.filter("suite = 'global_suite'").select("check", "success", "total")


@query(
    "job_two_outputs",
    """
    SELECT 'large' AS output, o_orderkey AS orderkey, o_totalprice AS price FROM orders
    WHERE o_totalprice > 1000
    UNION ALL
    SELECT 'people', c_custkey, NULL FROM customer
    """,
)
def job_two_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Two outputs of different tables, each read back from its own path."""
    large, people = new_path(spark, "large"), new_path(spark, "people")
    spec = {
        "source": [{"name": "orders"}, {"name": "customer"}],
        "transformation": [
            {"type": "filter", "inputs": ["orders"], "predicate": "o_totalprice > 1000",
             "output_table_name": "large"}
        ],
        "output": [
            {"type": "format", "input_table_name": "large", "path": large,
             "columns": ["o_orderkey", "o_totalprice"]},
            {"type": "format", "input_table_name": "customer", "path": people, "columns": ["c_custkey"]},
        ],
    }
    names = ("orders", "customer")
    run_job({n: table(spark, folder, n) for n in names}, spec).release()
    first = read_table(spark, large).toDF("orderkey", "price")
    second = read_table(spark, people).toDF("orderkey").withColumn("price", F.lit(None).cast("double"))
    return first.withColumn("output", F.lit("large")).unionByName(
        second.withColumn("output", F.lit("people"))
    )


@query(
    "job_impute_log",
    """
    SELECT 'o_totalprice' AS "column", 'mean' AS strategy,
           count(*) FILTER (o_orderkey % 7 = 0) AS missing, 'filled' AS outcome FROM orders
    UNION ALL SELECT 'nothing', 'mean', count(*), 'skipped: no value present' FROM orders
    UNION ALL SELECT 'o_custkey', 'mean', 0, 'nothing missing'
    """,
)
def job_impute_log(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", price.alias("o_totalprice"))
    orders = orders.withColumn("nothing", F.lit(None).cast("double"))
    columns = ["o_totalprice", "nothing", "o_custkey"]
    spec = {
        "source": [{"name": "orders"}],
        "transformation": [
            {"type": "column_manipulation", "transformations_details": [
                {"operation": "impute_mean", "columns": columns}]}
        ],
    }
    # A key may be filled where it is named; by type it is left alone.
    result = run_job({"orders": orders}, spec, keep=["o_custkey"])
    return result.imputed.select("column", "strategy", "missing", "outcome")


@query(
    "job_published",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000",
)
def job_published(spark: SparkSession, folder: str) -> DataFrame:
    """A second run whose global check fails leaves the output of the first in its place."""
    path = new_path(spark, "published")

    def spec(least: int, highest: float) -> dict:
        return {
            "source": [{"name": "orders"}],
            "transformation": [{"type": "filter", "predicate": f"o_totalprice > {least}"}],
            "output": [{"type": "format", "path": path, "columns": ["o_orderkey", "o_totalprice"]}],
            "global_data_quality_checks": [
                {"expectation_type": "expect_column_values_to_be_unique", "column": "o_orderkey"},
                {
                    "expectation_type": "expect_column_values_to_be_between",
                    "column": "o_totalprice",
                    "kwargs": {"max_value": highest},
                },
            ],
        }

    tables = {"orders": table(spark, folder, "orders")}
    run_job(tables, spec(1000, 1e9)).release()
    try:
        run_job(tables, spec(2000, 0.0))
    except CriticalCheckFailed:
        return read_table(spark, path)
    raise AssertionError("no price is below zero, so the second run must stop")


@query(
    "job_stored_suites",
    """
    SELECT suite, CAST(version AS INTEGER) AS version, "check", "column", (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS total
    FROM (VALUES ('kept_suite', 1, 'not_null', 'o_custkey'), ('kept_suite', 2, 'not_null', 'o_custkey'),
                 ('kept_suite', 2, 'unique', 'o_orderkey'), ('global_suite', 1, 'not_null', 'o_orderkey')) AS v(suite, version, "check", "column")
    """,
)
def job_stored_suites(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs of a job that keeps its suites: the first two with the same, the third with one more check."""
    store = new_path(spark, "suites")
    known = {"expectation_type": "expect_column_values_to_not_be_null", "column": "o_custkey"}
    unique = {"expectation_type": "expect_column_values_to_be_unique", "column": "o_orderkey"}
    tables = {"orders": table(spark, folder, "orders")}

    def run(*checks: dict) -> JobResult:
        spec = {
            "source": [{"name": "orders"}],
            "transformation": [
                {"type": "filter", "predicate": "o_totalprice > 1000", "output_table_name": "kept", "data_quality_checks": list(checks)}
            ],
            "global_data_quality_checks": [{"expectation_type": "not_null", "column": "o_orderkey"}],
        }
        return run_job(tables, spec, suite_store=store)

    run(known)
    run(known)
    results = run(known, unique).results.select("suite", "check", "column", "total")
    versions = suite_versions(spark, store).select("suite", "version", "check", "column")
    return versions.join(results, ["suite", "check", "column"])
