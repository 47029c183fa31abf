"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import stats
from millrace.queries.of_columns import APPLICANTS, applicants
from millrace.queries.registry import query, table


@query(
    "column_means",
    """
    SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6)
           AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6)
           AS l_tax, round(avg(l_linenumber), 6) AS l_linenumber
    FROM lineitem
    """,
)
def column_means(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    means = stats.column_means(table(spark, folder, "lineitem"), columns)
    return means.select(*[F.round(c, 6).alias(c) for c in columns])


@query(
    "column_means_with_nulls",
    f"""
    SELECT round(avg(c_acctbal), 6) AS c_acctbal, CAST(NULL AS DOUBLE) AS nothing
    FROM {APPLICANTS} a
    """,
)
def column_means_with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    people = applicants(spark, folder).withColumn("nothing", F.lit(None).cast("double"))
    means = stats.column_means(people, ["c_acctbal", "nothing"])
    return means.select(F.round("c_acctbal", 6).alias("c_acctbal"), "nothing")


def _modes_sql(source: str, columns: list[str]) -> str:
    picks = ", ".join(
        f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"
        for c in columns
    )
    return f"SELECT {picks}"


@query("column_modes", _modes_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def column_modes(spark: SparkSession, folder: str) -> DataFrame:
    return stats.column_modes(
        table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"]
    )


_WIDE = ["props", "event_type", "user_id"]


@query("column_modes_many_values", _modes_sql("events", _WIDE))
def column_modes_many_values(spark: SparkSession, folder: str) -> DataFrame:
    return stats.column_modes(table(spark, folder, "events"), _WIDE)


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return stats.row_count(table(spark, folder, "lineitem"))


@query(
    "value_counts",
    "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1",
)
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.value_counts(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "value_counts_with_null",
    """
    SELECT NULLIF(event_type, 'error') AS kind, count(*) AS count
    FROM events GROUP BY 1 ORDER BY 2 DESC, 1
    """,
)
def value_counts_with_null(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "events").select(
        F.nullif("event_type", F.lit("error")).alias("kind")
    )
    return stats.value_counts(kinds, "kind")


@query(
    "top_value",
    "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
def top_value(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_value(table(spark, folder, "events"), "user_id")


@query(
    "aggregate_step",
    """
    SELECT o_custkey, count(*) AS orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total,
           max(o_totalprice) AS largest, count(DISTINCT o_orderstatus) AS statuses
    FROM orders GROUP BY o_custkey
    """,
)
def aggregate_step(spark: SparkSession, folder: str) -> DataFrame:
    return stats.aggregate(
        table(spark, folder, "orders"),
        ["o_custkey"],
        {
            "orders": "count(1)",
            "total": "cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double)",
            "largest": F.max("o_totalprice"),
            "statuses": "count(DISTINCT o_orderstatus)",
        },
    )


@query(
    "aggregate_two_keys",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS lines,
           CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity,
           round(avg(l_discount), 6) AS mean_discount
    FROM lineitem GROUP BY 1, 2
    """,
)
def aggregate_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    return stats.aggregate(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {
            "lines": "count(1)",
            "quantity": "cast(sum(cast(l_quantity AS decimal(18, 2))) AS double)",
            "mean_discount": "round(avg(l_discount), 6)",
        },
    )


# Keys of orders whose customers have as many orders tie in great numbers, 9 against 10 as well.
_TIED = "(SELECT o_custkey, o_custkey % 11 AS tied FROM (SELECT DISTINCT o_custkey FROM orders) d)"


@query("column_modes_numeric_ties", _modes_sql(f"{_TIED} t", ["o_custkey", "tied"]))
def column_modes_numeric_ties(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "orders").select("o_custkey").distinct()
    return stats.column_modes(keys.withColumn("tied", F.col("o_custkey") % 11), ["o_custkey", "tied"])


@query(
    "column_modes_of_instants",
    """
    SELECT 1604206800000000 + (SELECT user_id % 8 AS part FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) * 1800000000 AS instant,
           (SELECT CASE WHEN abs(value) < 10 THEN 0.0::DOUBLE ELSE round(value / 100) + 1 END AS v
            FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS level
    """,
)
def column_modes_of_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Half hours around the end of daylight saving time, where two instants have one local text."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        events = table(spark, folder, "events")
        at = F.timestamp_seconds(F.lit(1604206800) + F.col("user_id") % 8 * 1800)
        zero = F.when(F.col("user_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0))
        level = F.when(F.abs("value") < 10, zero).otherwise(F.round(F.col("value") / 100) + 1)
        modes = stats.column_modes(events.select(at.alias("instant"), level.alias("level")), ["instant", "level"])
        return modes.select(F.unix_micros("instant").alias("instant"), "level")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
