"""Sources and sinks: tables written to scratch space and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fixed import DICTIONARY_ENCODING
from millrace.operators import checks as q
from millrace.queries.registry import query, table
from millrace.sources.readers import load_sources, read_csv, read_csv_sorted, read_dictionary, read_table
from millrace.sources.scratch import new_path, stage_table
from millrace.sources.writers import write_counted, write_report, write_table


@query("csv_roundtrip", "SELECT * FROM customer")
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    path = new_path(spark, "customer") + ".csv"
    write_table(customers, path, "csv")
    return read_csv(spark, path, customers.schema)


@query(
    "csv_inferred",
    """
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice, o_orderpriority FROM orders
    """,
)
def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = new_path(spark, "orders") + ".csv"
    write_table(orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "csv")
    return read_csv(spark, path)


@query("csv_text_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def csv_text_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "conversations")
    path = new_path(spark, "conversations") + ".csv"
    write_table(messages, path, "csv")
    return read_csv(spark, path, messages.schema, multi_line=True)


@query("parquet_roundtrip", "SELECT * FROM lineitem")
def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "lineitem")
    write_table(table(spark, folder, "lineitem"), path)
    return read_table(spark, path)


@query("stage_table", "SELECT * FROM orders")
def staged(spark: SparkSession, folder: str) -> DataFrame:
    return stage_table(table(spark, folder, "orders"), "orders")


@query("write_counted", "SELECT count(*) AS written, count(*) AS read FROM events")
def counted(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "events")
    written = write_counted(table(spark, folder, "events"), path)
    return read_table(spark, path).agg(
        F.lit(written).cast("bigint").alias("written"), F.count(F.lit(1)).alias("read")
    )


@query(
    "load_sources",
    """
    SELECT n_nationkey, n_name, r_name, count(*) AS suppliers
    FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
    GROUP BY 1, 2, 3
    """,
)
def sources(spark: SparkSession, folder: str) -> DataFrame:
    found = load_sources(spark, folder, ["nation", "region", "supplier"], "parquet")
    nations = found["nation"].withColumnRenamed("n_regionkey", "r_regionkey")
    suppliers = found["supplier"].withColumnRenamed("s_nationkey", "n_nationkey")
    return (
        nations.join(found["region"], "r_regionkey")
        .join(suppliers, "n_nationkey")
        .groupBy("n_nationkey", "n_name", "r_name")
        .agg(F.count(F.lit(1)).alias("suppliers"))
    )


@query(
    "report_sink",
    """
    SELECT 'first' AS suite, 'not_null' AS "check", true AS success, count(*) AS total FROM orders
    UNION ALL
    SELECT 'second', 'row_count_between', false, count(*) FROM orders
    """,
)
def report_sink(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    path = new_path(spark, "report")
    write_report(q.validate(orders, q.Suite("first", [q.not_null("o_orderkey")])), path)
    empty = q.row_count_between(max_value=0)
    write_report(q.validate(orders, q.Suite("second", [empty])), path)
    return read_table(spark, path).select("suite", "check", "success", "total")


@query(
    "read_dictionary",
    'SELECT source AS "Table", lang AS "Row", text AS "Description" FROM documents',
)
def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        F.col("source").alias("Table"), F.col("lang").alias("Row"),
        F.col("text").alias("Description"),
    )
    path = new_path(spark, "dictionary") + ".csv"
    rows.write.options(
        header=True,
        escape='"',
        encoding=DICTIONARY_ENCODING,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return read_dictionary(spark, path)


@query(
    "csv_rejects",
    """
    SELECT 'fits' AS kind, o_orderkey || ',' || o_custkey || ',' || o_orderstatus AS record FROM orders
    WHERE o_orderkey % 5 NOT IN (0, 2)
    UNION ALL SELECT 'reject', o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',more' FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT 'reject', o_orderkey || ',x' || o_custkey || ',' || o_orderstatus FROM orders WHERE o_orderkey % 5 = 2
    """,
)
def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV of which rows have a value too many, or a word for a number."""
    kind, path = F.col("o_orderkey") % 5, new_path(spark, "orders")
    key = F.when(kind == 2, F.concat(F.lit("x"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    more = F.when(kind == 0, F.lit("more"))
    lines = table(spark, folder, "orders").select(F.concat_ws(",", "o_orderkey", key, "o_orderstatus", more))
    lines.write.text(path)
    found = read_csv_sorted(spark, path, "orderkey long, custkey long, status string", {"header": "false"})
    whole = F.concat_ws(",", "orderkey", "custkey", "status").alias("record")
    return found.data.select(F.lit("fits").alias("kind"), whole).unionByName(
        found.rejects.select(F.lit("reject").alias("kind"), "record")
    )
