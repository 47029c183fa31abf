"""Projections, filters and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.types import columns_of
from millrace.operators import columns as cols
from millrace.operators.model import placeholder_score
from millrace.queries.registry import query, table


def applicants(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as applicants; a negative balance is not a valid income and counts as missing."""
    income = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, folder, "customer").withColumn("c_acctbal", income)


APPLICANTS = (
    "(SELECT c_custkey, c_name, c_nationkey, c_mktsegment, "
    "CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)"
)


@query(
    "filter_rows",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority
    FROM orders
    WHERE o_totalprice > 200000 AND NULLIF(o_orderpriority, '4-NOT SPECIFIED') <> '5-LOW'
    """,
)
def filter_rows(spark: SparkSession, folder: str) -> DataFrame:
    kept = cols.filter_rows(
        table(spark, folder, "orders"),
        "o_totalprice > 200000 AND NULLIF(o_orderpriority, '4-NOT SPECIFIED') <> '5-LOW'",
    )
    return cols.select_columns(kept, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])


@query("null_rows", f"SELECT c_custkey, c_name FROM {APPLICANTS} a WHERE c_acctbal IS NULL")
def null_rows(spark: SparkSession, folder: str) -> DataFrame:
    missing = cols.filter_rows(applicants(spark, folder), F.col("c_acctbal").isNull())
    return cols.select_columns(missing, ["c_custkey", "c_name"])


@query(
    "rename_columns",
    """
    SELECT c_custkey AS applicant_id, c_name AS applicant_name, c_nationkey, c_acctbal AS income,
           c_mktsegment
    FROM customer
    """,
)
def rename_columns(spark: SparkSession, folder: str) -> DataFrame:
    names = {"c_custkey": "applicant_id", "c_name": "applicant_name", "c_acctbal": "income"}
    return cols.rename_columns(table(spark, folder, "customer"), names)


@query(
    "cast_columns",
    """
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey,
           CAST(o_custkey AS VARCHAR) AS o_custkey,
           CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice,
           TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority
    FROM orders
    """,
)
def cast_columns(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    orders = cols.select_columns(table(spark, folder, "orders"), columns)
    types = {
        "o_orderkey": "int",
        "o_custkey": "string",
        "o_totalprice": "bigint",
        "o_orderpriority": "int",
    }
    return cols.cast_columns(orders, types)


@query(
    "derive_ratio",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice,
           CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price,
           CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS discount_tax_ratio
    FROM lineitem
    """,
)
def derive_ratio(spark: SparkSession, folder: str) -> DataFrame:
    ratios = cols.derive(
        table(spark, folder, "lineitem"),
        {
            "unit_price": cols.ratio("l_extendedprice", "l_quantity"),
            "discount_tax_ratio": cols.ratio("l_discount", "l_tax"),
        },
    )
    wanted = ["l_orderkey", "l_linenumber", "l_extendedprice", "unit_price", "discount_tax_ratio"]
    return cols.select_columns(ratios, wanted)


@query(
    "derive_expression",
    """
    SELECT l_orderkey, l_linenumber,
           l_extendedprice * (1 - l_discount) AS net,
           upper(l_returnflag) || '-' || l_linestatus AS status
    FROM lineitem
    """,
)
def derive_expression(spark: SparkSession, folder: str) -> DataFrame:
    derived = cols.derive(
        table(spark, folder, "lineitem"),
        {
            "net": "l_extendedprice * (1 - l_discount)",
            "status": "upper(l_returnflag) || '-' || l_linestatus",
        },
    )
    return cols.select_columns(derived, ["l_orderkey", "l_linenumber", "net", "status"])


@query(
    "derive_when",
    """
    SELECT o_orderkey,
           CASE WHEN o_totalprice >= 300000 THEN 'large'
                WHEN o_totalprice >= 100000 THEN 'medium'
                ELSE 'small' END AS band
    FROM orders
    """,
)
def derive_when(spark: SparkSession, folder: str) -> DataFrame:
    cases = [("o_totalprice >= 300000", "large"), (F.col("o_totalprice") >= 100000, "medium")]
    banded = cols.derive_when(table(spark, folder, "orders"), "band", cases, "small")
    return cols.select_columns(banded, ["o_orderkey", "band"])


@query(
    "modulo_score",
    """
    SELECT c_custkey,
           round(c_acctbal % 100, 6) AS signed_score,
           round(CASE WHEN (c_acctbal % 100) < 0
                      THEN ((c_acctbal % 100) + 100) % 100
                      ELSE (c_acctbal % 100) END, 6) AS score
    FROM customer
    """,
)
def modulo_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = cols.derive(
        table(spark, folder, "customer"),
        {
            "signed_score": F.round(cols.remainder("c_acctbal", 100), 6),
            "score": F.round(cols.remainder("c_acctbal", 100, non_negative=True), 6),
        },
    )
    return cols.select_columns(scored, ["c_custkey", "signed_score", "score"])


@query(
    "placeholder_score",
    "SELECT c_custkey, round(c_acctbal % 100, 6) AS score FROM customer",
)
def placeholder(spark: SparkSession, folder: str) -> DataFrame:
    scored = placeholder_score(table(spark, folder, "customer"), "c_acctbal")
    return scored.select("c_custkey", F.round("score", 6).alias("score"))


_IN_RANGE = "score >= 0 AND score < 100"


@query("placeholder_score_without_column", "SELECT s_suppkey, true AS in_range FROM supplier")
def placeholder_without_column(spark: SparkSession, folder: str) -> DataFrame:
    scored = placeholder_score(table(spark, folder, "supplier"), "c_acctbal", seed=7)
    return scored.select("s_suppkey", F.expr(_IN_RANGE).alias("in_range"))


@query("random_column", "SELECT o_orderkey, true AS in_range FROM orders")
def random_column(spark: SparkSession, folder: str) -> DataFrame:
    scored = cols.random_column(table(spark, folder, "orders"), "score", seed=11)
    return scored.select("o_orderkey", F.expr(_IN_RANGE).alias("in_range"))


@query("select_output", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def select_output(spark: SparkSession, folder: str) -> DataFrame:
    return cols.select_columns(
        table(spark, folder, "customer"), ["c_custkey", "c_acctbal", "c_mktsegment"]
    )


@query(
    "columns_by_family",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           l_discount, l_tax
    FROM lineitem
    """,
)
def columns_by_family(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    return cols.select_columns(lineitem, columns_of(lineitem, "numeric"))
