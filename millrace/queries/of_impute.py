"""Imputation. Values count as missing where the data marks them so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.impute import impute
from millrace.queries.of_columns import APPLICANTS, applicants
from millrace.queries.registry import query, table


@query(
    "impute_mean",
    f"""
    SELECT c_custkey,
           round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {APPLICANTS} m)), 6) AS c_acctbal
    FROM {APPLICANTS} a
    """,
)
def impute_mean(spark: SparkSession, folder: str) -> DataFrame:
    filled = impute(applicants(spark, folder), categorical=None, exclude=["c_custkey"]).data
    return filled.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(
    "impute_mean_int",
    """
    WITH p AS (SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN p_size END AS p_size FROM part)
    SELECT p_partkey,
           CAST(coalesce(p_size, (SELECT trunc(avg(p_size)) FROM p)) AS INTEGER) AS p_size
    FROM p
    """,
)
def impute_mean_int(spark: SparkSession, folder: str) -> DataFrame:
    sized = F.when(F.col("p_type") != "ECONOMY", F.col("p_size"))
    parts = table(spark, folder, "part").withColumn("p_size", sized)
    return impute(parts, columns=["p_size"]).data.select("p_partkey", "p_size")


@query(
    "impute_mean_nan",
    """
    WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
    SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) AS value FROM e
    """,
)
def impute_mean_nan(spark: SparkSession, folder: str) -> DataFrame:
    measured = F.when(F.col("event_type") != "error", F.col("value")).otherwise(float("nan"))
    events = table(spark, folder, "events").withColumn("value", measured)
    filled = impute(events, columns=["value"]).data
    return filled.select("event_id", F.round("value", 6).alias("value"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with an unspecified priority as missing."""
    priority = F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))
    return table(spark, folder, "orders").withColumn("o_orderpriority", priority)


_ORDERS = """
WITH o AS (
    SELECT o_orderkey, o_orderstatus, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority
    FROM orders)
"""


@query(
    "impute_mode",
    _ORDERS
    + """
    SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, (
        SELECT o_orderpriority FROM o WHERE o_orderpriority IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority
    FROM o
    """,
)
def impute_mode(spark: SparkSession, folder: str) -> DataFrame:
    filled = impute(_orders(spark, folder), numeric=None).data
    return filled.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "impute_constant",
    _ORDERS
    + """
    SELECT o_orderkey, o_orderstatus, coalesce(o_orderpriority, 'Unknown') AS o_orderpriority
    FROM o
    """,
)
def impute_constant(spark: SparkSession, folder: str) -> DataFrame:
    filled = impute(_orders(spark, folder), numeric=None, categorical="constant").data
    return filled.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "impute_named",
    """
    WITH l AS (
        SELECT l_orderkey, l_linenumber, l_quantity,
               NULLIF(l_discount, 0) AS l_discount, NULLIF(l_tax, 0) AS l_tax
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity,
           round(coalesce(l_discount, (SELECT avg(l_discount) FROM l)), 6) AS l_discount, l_tax
    FROM l
    """,
)
def impute_named(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
    )
    filled = impute(lines, columns=["l_discount"]).data
    return filled.withColumn("l_discount", F.round("l_discount", 6))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Events with missing values and props, and a column that holds nothing at all."""
    event = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.when(event != "error", F.col("value")).alias("value"),
        F.when(event != "signup", event).alias("event_type"),
        F.lit(None).cast("double").alias("nothing"),
    )


_MIXED = """
WITH e AS (
    SELECT event_id, user_id,
           CASE WHEN event_type <> 'error' THEN value END AS value,
           CASE WHEN event_type <> 'signup' THEN event_type END AS event_type,
           CAST(NULL AS DOUBLE) AS nothing
    FROM events),
means AS (SELECT avg(value) AS value FROM e),
modes AS (
    SELECT event_type FROM e WHERE event_type IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
"""


@query(
    "impute_all_columns",
    _MIXED
    + """
    SELECT event_id, user_id, round(coalesce(value, (SELECT value FROM means)), 6) AS value,
           coalesce(event_type, (SELECT event_type FROM modes)) AS event_type, nothing
    FROM e
    """,
)
def impute_all_columns(spark: SparkSession, folder: str) -> DataFrame:
    filled = impute(_mixed(spark, folder), exclude=["event_id"]).data
    return filled.withColumn("value", F.round("value", 6))


@query(
    "impute_log",
    _MIXED
    + """
    SELECT 'value' AS "column", 'mean' AS strategy, round((SELECT value FROM means), 6) AS number,
           CAST(NULL AS VARCHAR) AS value, (SELECT count(*) FROM e WHERE value IS NULL) AS missing,
           'filled' AS outcome
    UNION ALL SELECT 'nothing', 'mean', NULL, NULL, (SELECT count(*) FROM e),
           'skipped: no value present'
    UNION ALL SELECT 'event_type', 'mode', NULL, (SELECT event_type FROM modes),
           (SELECT count(*) FROM e WHERE event_type IS NULL), 'filled'
    """,
)
def impute_log(spark: SparkSession, folder: str) -> DataFrame:
    log = impute(_mixed(spark, folder), exclude=["event_id", "user_id"]).log
    text = F.col("strategy") == "mode"
    return log.select(
        "column",
        "strategy",
        F.round(F.when(~text, F.col("value")).cast("double"), 6).alias("number"),
        F.when(text, F.col("value")).alias("value"),
        "missing",
        "outcome",
    )
