"""Equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.columns import cast_columns
from millrace.operators.joins import join_tables
from millrace.operators.stats import aggregate
from millrace.queries.registry import query, table


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal", "c_mktsegment"
    )


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice", "o_orderpriority"
    )


def _building(spark: SparkSession, folder: str) -> DataFrame:
    customers = _customers(spark, folder)
    return customers.filter("c_mktsegment = 'BUILDING'").select("custkey", "c_name")


def _urgent(spark: SparkSession, folder: str) -> DataFrame:
    large = "o_orderpriority = '1-URGENT' AND o_totalprice > 400000"
    return _orders(spark, folder).filter(large).select("custkey", "o_orderkey", "o_totalprice")


_SQL = """
WITH customers AS (
    SELECT c_custkey AS custkey, c_name, c_acctbal, c_mktsegment FROM customer),
building AS (SELECT custkey, c_name FROM customers WHERE c_mktsegment = 'BUILDING'),
all_orders AS (
    SELECT o_custkey AS custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders),
urgent AS (
    SELECT custkey, o_orderkey, o_totalprice FROM all_orders
    WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
"""


@query("join_inner", _SQL + "SELECT * FROM customers JOIN all_orders USING (custkey)")
def join_inner(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(_customers(spark, folder), _orders(spark, folder), "custkey")


@query("join_left", _SQL + "SELECT * FROM customers LEFT JOIN urgent USING (custkey)")
def join_left(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(_customers(spark, folder), _urgent(spark, folder), "custkey", "left")


@query(
    "join_right",
    _SQL
    + """
    SELECT o.custkey, c_name, o_orderkey, o_totalprice, o_orderpriority
    FROM building b RIGHT JOIN all_orders o ON b.custkey = o.custkey
    """,
)
def join_right(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(_building(spark, folder), _orders(spark, folder), "custkey", "right")


_FULL = (
    _SQL
    + """
    SELECT coalesce(b.custkey, u.custkey) AS custkey, c_name, o_orderkey, o_totalprice
    FROM building b FULL JOIN urgent u ON b.custkey = u.custkey
    """
)


@query("join_full", _FULL)
def join_full(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(_building(spark, folder), _urgent(spark, folder), "custkey", "full")


_SEMI = _SQL + "SELECT * FROM customers WHERE custkey IN (SELECT custkey FROM urgent)"
_ANTI = _SQL + "SELECT * FROM customers WHERE custkey NOT IN (SELECT custkey FROM urgent)"


@query("join_semi", _SEMI)
def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(_customers(spark, folder), _urgent(spark, folder), "custkey", "left_semi")


@query("join_anti", _ANTI)
def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(_customers(spark, folder), _urgent(spark, folder), "custkey", "left_anti")


@query("join_broadcast", _SQL + "SELECT * FROM all_orders JOIN customers USING (custkey)")
def join_broadcast(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(
        _orders(spark, folder), _customers(spark, folder), "custkey", broadcast="right"
    )


@query(
    "join_aligned_keys",
    _SQL
    + """
    SELECT CAST(custkey AS VARCHAR) AS custkey, c_name, o_orderkey
    FROM customers JOIN all_orders USING (custkey)
    """,
)
def join_aligned_keys(spark: SparkSession, folder: str) -> DataFrame:
    customers = cast_columns(_customers(spark, folder), {"custkey": "int"})
    orders = cast_columns(_orders(spark, folder), {"custkey": "string"})
    joined = join_tables(customers, orders, "custkey", align_keys=True)
    return joined.select("custkey", "c_name", "o_orderkey")


@query(
    "join_widened_keys",
    _SQL + "SELECT custkey, c_name, o_orderkey FROM customers JOIN all_orders USING (custkey)",
)
def join_widened_keys(spark: SparkSession, folder: str) -> DataFrame:
    customers = cast_columns(_customers(spark, folder), {"custkey": "int"})
    joined = join_tables(customers, _orders(spark, folder), "custkey", align_keys=True)
    return joined.select("custkey", "c_name", "o_orderkey")


@query(
    "join_clashing_columns",
    """
    SELECT c_nationkey AS nationkey, c_name AS name, c_acctbal AS acctbal,
           s_name AS name_right, s_acctbal AS acctbal_right
    FROM customer JOIN supplier ON c_nationkey = s_nationkey
    """,
)
def join_clashing_columns(spark: SparkSession, folder: str) -> DataFrame:
    def renamed(name: str, prefix: str) -> DataFrame:
        names = ("nationkey", "name", "acctbal")
        return table(spark, folder, name).select(*[F.col(prefix + n).alias(n) for n in names])

    # Every nation is frequent on both sides.
    return join_tables(renamed("customer", "c_"), renamed("supplier", "s_"), "nationkey", salt=8)


@query(
    "join_two_keys",
    """
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, lines
    FROM lineitem JOIN (
        SELECT l_partkey, l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1, 2
    ) USING (l_partkey, l_suppkey)
    """,
)
def join_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["l_partkey", "l_suppkey"]
    lines = table(spark, folder, "lineitem").select(
        *keys, "l_orderkey", "l_linenumber", "l_quantity"
    )
    return join_tables(lines, aggregate(lines, keys, {"lines": "count(1)"}), keys)


def _status_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by status: three keys, so each holds a large share of all rows."""
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), "o_orderkey", "o_totalprice"
    )


@query(
    "join_salted",
    """
    SELECT o_orderstatus AS status, o_orderkey, o_totalprice, orders, largest
    FROM orders JOIN (
        SELECT o_orderstatus, count(*) AS orders, max(o_totalprice) AS largest
        FROM orders GROUP BY 1
    ) USING (o_orderstatus)
    """,
)
def join_salted(spark: SparkSession, folder: str) -> DataFrame:
    orders = _status_totals(spark, folder)
    totals = aggregate(
        orders, ["status"], {"orders": "count(1)", "largest": "max(o_totalprice)"}
    )
    return join_tables(orders, totals, "status", salt=8)


@query("join_salted_full", _FULL)
def join_salted_full(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(_building(spark, folder), _urgent(spark, folder), "custkey", "full", salt=4)


@query(
    "join_salted_right",
    _SQL
    + """
    SELECT o.custkey, c_name, o_orderkey, o_totalprice, o_orderpriority
    FROM building b RIGHT JOIN all_orders o ON b.custkey = o.custkey
    """,
)
def join_salted_right(spark: SparkSession, folder: str) -> DataFrame:
    return join_tables(
        _building(spark, folder), _orders(spark, folder), "custkey", "right", salt=4
    )


@query("join_salted_semi", _SEMI)
def join_salted_semi(spark: SparkSession, folder: str) -> DataFrame:
    customers, urgent = _customers(spark, folder), _urgent(spark, folder)
    return join_tables(customers, urgent, "custkey", "left_semi", salt=4)


@query("join_salted_anti", _ANTI)
def join_salted_anti(spark: SparkSession, folder: str) -> DataFrame:
    customers, urgent = _customers(spark, folder), _urgent(spark, folder)
    return join_tables(customers, urgent, "custkey", "left_anti", salt=4)


def _near_suppliers(spark: SparkSession, folder: str, how: str) -> DataFrame:
    """Customers and suppliers of a nation: every key is frequent on both sides."""
    own = F.nullif("c_nationkey", F.lit(7)).alias("nation")
    customers = table(spark, folder, "customer").select(own, "c_custkey", "c_mktsegment")
    suppliers = table(spark, folder, "supplier").filter("s_nationkey <> 3")
    suppliers = suppliers.select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return join_tables(customers, suppliers, "nation", how, salt=4)


_NEAR_SUPPLIERS = """
    SELECT coalesce(c.nation, s.s_nationkey) AS nation, c_custkey, c_mktsegment, s_suppkey, s_acctbal
    FROM (SELECT NULLIF(c_nationkey, 7) AS nation, * FROM customer) c
    {how} JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) s ON c.nation = s.s_nationkey
    """


@query("join_salted_both", _NEAR_SUPPLIERS.format(how="INNER"))
def join_salted_both(spark: SparkSession, folder: str) -> DataFrame:
    return _near_suppliers(spark, folder, "inner")


@query("join_salted_both_left", _NEAR_SUPPLIERS.format(how="LEFT"))
def join_salted_both_left(spark: SparkSession, folder: str) -> DataFrame:
    return _near_suppliers(spark, folder, "left")


@query("join_salted_both_full", _NEAR_SUPPLIERS.format(how="FULL"))
def join_salted_both_full(spark: SparkSession, folder: str) -> DataFrame:
    return _near_suppliers(spark, folder, "full")
