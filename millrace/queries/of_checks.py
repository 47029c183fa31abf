"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fixed import CRITICAL, WARNING
from millrace.operators import checks as q
from millrace.operators.search import check_dimension
from millrace.queries.of_columns import APPLICANTS, applicants
from millrace.queries.registry import query, table
from millrace.sources.scratch import new_path


def _flat(results: DataFrame) -> DataFrame:
    extremes = ("detail.description", "detail.lowest", "detail.highest")
    return results.select(*[c for c in results.columns if c != "detail"], *extremes)


def _run(df: DataFrame, *checks: q.Check, suite: str = "suite") -> DataFrame:
    return _flat(q.validate(df, q.Suite(suite, checks)))


def _row(
    check: str,
    column: str | None,
    source: str,
    total: str,
    unexpected: str,
    value: str | None = None,
    bad: str | None = None,
    success: str = "unexpected = 0",
    severity: str = CRITICAL,
    description: str = "",
    suite: str = "suite",
    extremes: tuple[str, str] | None = None,
) -> str:
    """SQL of one result row; ``value`` and ``bad`` give the lowest and highest bad value."""
    lowest = f"CAST(min({value}) FILTER ({bad}) AS VARCHAR)" if value else "CAST(NULL AS VARCHAR)"
    highest = f"CAST(max({value}) FILTER ({bad}) AS VARCHAR)" if value else "CAST(NULL AS VARCHAR)"
    lowest, highest = extremes or (lowest, highest)
    shown = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"""
    SELECT '{suite}' AS suite, '{check}' AS "check", {shown} AS "column",
           '{severity}' AS severity, {success} AS success, total, unexpected,
           CASE WHEN total = 0 THEN 0 ELSE unexpected * 100.0::DOUBLE / total END::DOUBLE
               AS unexpected_pct,
           '{description}' AS description, lowest, highest
    FROM (SELECT CAST({total} AS BIGINT) AS total, CAST({unexpected} AS BIGINT) AS unexpected,
                 {lowest} AS lowest, {highest} AS highest FROM {source})
    """


def _bad(check: str, column: str, source: str, bad: str, **more: str) -> str:
    """SQL of a check that counts the non-null values for which ``bad`` holds."""
    unexpected = f"count(*) FILTER ({bad})"
    return _row(check, column, source, f"count({column})", unexpected, column, bad, **more)


def _repeats(check: str, columns: list[str], source: str, **more: str) -> str:
    """SQL of a uniqueness check."""
    keys = ", ".join(columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    grouped = f"(SELECT {keys}, count(*) AS times FROM {source} WHERE {known} GROUP BY {keys})"
    total, repeated = "coalesce(sum(times), 0)", "coalesce(sum(times) FILTER (times > 1), 0)"

    def extreme(way: str) -> str:
        # The first or last key in the order of the values, then shown as text.
        parts = " || ', ' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
        order = ", ".join(f"{c} {way}" for c in columns)
        return f"(SELECT {parts} FROM {grouped} k WHERE times > 1 ORDER BY {order} LIMIT 1)"

    return _row(
        check, keys, grouped, total, repeated, None, None,
        extremes=(extreme("ASC"), extreme("DESC")), **more,
    )


_MISSING_INCOME = "count(*) FILTER (c_acctbal IS NULL)"


@query(
    "check_not_null",
    _row(
        "not_null",
        "c_acctbal",
        f"{APPLICANTS} a",
        "count(*)",
        _MISSING_INCOME,
        severity=WARNING,
        description="income is known",
    ),
)
def check_not_null(spark: SparkSession, folder: str) -> DataFrame:
    check = q.not_null("c_acctbal").warning().described("income is known")
    return _run(applicants(spark, folder), check)


_BLANK = "NULLIF(o_orderpriority, '4-NOT SPECIFIED')"


@query(
    "check_not_null_not_empty",
    _row(
        "not_null_not_empty",
        "o_custkey",
        "orders",
        "count(*)",
        "count(*) FILTER (o_custkey IS NULL)",
        success="total > 0 AND unexpected = 0",
    )
    + " UNION ALL "
    + _row(
        "not_null_not_empty",
        "priority",
        "orders",
        "count(*)",
        "count(*) FILTER (o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW'))",
        success="total > 0 AND unexpected = 0",
    ),
)
def check_not_null_not_empty(spark: SparkSession, folder: str) -> DataFrame:
    priority = F.expr(f"CASE WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE {_BLANK} END")
    orders = table(spark, folder, "orders").withColumn("priority", priority)
    return _run(orders, q.not_null_not_empty("o_custkey"), q.not_null_not_empty("priority"))


@query("check_unique", _repeats("unique", ["o_orderkey"], "orders"))
def check_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _run(table(spark, folder, "orders"), q.unique("o_orderkey"))




@query(
    "check_unique_repeats",
    _repeats("unique", ["o_custkey"], "orders", severity=WARNING),
)
def check_unique_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return _run(table(spark, folder, "orders"), q.unique("o_custkey").warning())


@query("check_pair_unique", _repeats("pair_unique", ["l_orderkey", "l_linenumber"], "lineitem"))
def check_pair_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _run(table(spark, folder, "lineitem"), q.pair_unique("l_orderkey", "l_linenumber"))


@query(
    "check_of_type",
    _row("of_type", "c_custkey", "customer", "count(*)", "0")
    + " UNION ALL "
    + _row("of_type", "c_acctbal", "customer", "count(*)", "0")
    + " UNION ALL "
    + _row("of_type", "c_name", "customer", "count(*)", "count(*)", severity=WARNING),
)
def check_of_type(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        table(spark, folder, "customer"),
        q.of_type("c_custkey", "integer"),
        q.of_type("c_acctbal", "float"),
        q.of_type("c_name", "IntegerType").warning(),
    )


@query(
    "check_between",
    _bad("between", "c_acctbal", "customer", "c_acctbal < 0 OR c_acctbal > 9000")
    + " UNION ALL "
    + _bad("between", "c_nationkey", "customer", "c_nationkey < 0", severity=WARNING),
)
def check_between(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        table(spark, folder, "customer"),
        q.between("c_acctbal", 0, 9000),
        q.between("c_nationkey", min_value=0).warning(),
    )


_DATES = """(SELECT CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%d/%m/%Y')
                         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)"""


@query(
    "check_datetime_format",
    _bad("datetime_format", "day", _DATES, "try_strptime(day, '%Y-%m-%d') IS NULL"),
)
def check_datetime_format(spark: SparkSession, folder: str) -> DataFrame:
    return _run(_dates(spark, folder), q.datetime_format("day", "yyyy-MM-dd"))


def _dates(spark: SparkSession, folder: str) -> DataFrame:
    iso, local = (F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "dd/MM/yyyy"))
    day = F.when(F.col("o_orderstatus") == "P", local).otherwise(iso)
    return table(spark, folder, "orders").select(day.alias("day"))


@query(
    "check_distinct_in_set",
    _bad("distinct_in_set", "o_orderstatus", "orders", "o_orderstatus NOT IN ('F', 'O', 'P')")
    + " UNION ALL "
    + _bad("distinct_in_set", "o_orderpriority", "orders", "o_orderpriority <> '1-URGENT'"),
)
def check_distinct_in_set(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        table(spark, folder, "orders"),
        q.distinct_in_set("o_orderstatus", ["F", "O", "P"]),
        q.distinct_in_set("o_orderpriority", ["1-URGENT"]),
    )


@query(
    "check_distinct_in_table",
    _bad(
        "distinct_in_set",
        "l_partkey",
        "lineitem",
        "l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)",
    ),
)
def check_distinct_in_table(spark: SparkSession, folder: str) -> DataFrame:
    large = table(spark, folder, "part").filter("p_size > 25").select("p_partkey")
    return _run(table(spark, folder, "lineitem"), q.distinct_in_set("l_partkey", large))


def _share(column: str, source: str, selected: str, low: float, high: float) -> str:
    return _row(
        "proportion_between",
        column,
        source,
        f"count({column})",
        f"count(*) FILTER ({column} IS NOT NULL AND NOT ({selected}))",
        success=f"(total - unexpected)::DOUBLE / total BETWEEN {low} AND {high}",
    )


@query(
    "check_proportion_between",
    _share("quality", "labels", "quality IN (1)", 0.5, 1.0)
    + " UNION ALL "
    + _share("toxic", "labels", "toxic > 0", 0.0, 0.05),
)
def check_proportion_between(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        table(spark, folder, "labels"),
        q.proportion_between("quality", 0.5, 1.0, value_set=[1]),
        q.proportion_between("toxic", 0.0, 0.05, condition="toxic > 0"),
    )


@query(
    "check_row_count_between",
    _row("row_count_between", None, "orders", "count(*)", "0", success="total BETWEEN 1 AND 1000"),
)
def check_row_count_between(spark: SparkSession, folder: str) -> DataFrame:
    return _run(table(spark, folder, "orders"), q.row_count_between(1, 1000))


@query(
    "check_match_regex",
    _bad(
        "match_regex", "c_name", "customer", "NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')"
    )
    + " UNION ALL "
    + _bad("match_regex", "c_mktsegment", "customer", "NOT regexp_matches(c_mktsegment, 'U')"),
)
def check_match_regex(spark: SparkSession, folder: str) -> DataFrame:
    return _run(
        table(spark, folder, "customer"),
        q.match_regex("c_name", "^Customer#[0-9]{9}$"),
        q.match_regex("c_mktsegment", "U"),
    )


_LENGTHS = "(SELECT len(embedding) AS embedding FROM embeddings)"


@query(
    "check_dimension",
    _bad("vector_length", "embedding", _LENGTHS, "embedding <> 64", suite="vectors"),
)
def dimension(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(check_dimension(table(spark, folder, "embeddings"), "embedding", 64))


@query(
    "check_dimension_default",
    _bad("vector_length", "embedding", _LENGTHS, "embedding <> 768", suite="vectors"),
)
def dimension_default(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(check_dimension(table(spark, folder, "embeddings"), "embedding"))


def _lineitem_suite() -> q.Suite:
    return q.Suite(
        "lineitem",
        [
            q.not_null("l_orderkey"),
            q.between("l_quantity", 1, 50),
            q.between("l_discount", 0, 0.05).warning(),
            q.distinct_in_set("l_returnflag", ["A", "N", "R"]),
            q.match_regex("l_linestatus", "^[FO]$"),
            q.of_type("l_extendedprice", "numeric"),
            q.unique("l_orderkey").warning(),
            q.pair_unique("l_orderkey", "l_linenumber").warning(),
            q.row_count_between(min_value=1),
        ],
    )


_LINEITEM = " UNION ALL ".join(
    [
        _row("not_null", "l_orderkey", "lineitem", "count(*)", "0", suite="lineitem"),
        _bad(
            "between",
            "l_quantity",
            "lineitem",
            "NOT l_quantity BETWEEN 1 AND 50",
            suite="lineitem",
        ),
        _bad(
            "between",
            "l_discount",
            "lineitem",
            "NOT l_discount BETWEEN 0 AND 0.05::DOUBLE",
            severity=WARNING,
            suite="lineitem",
        ),
        _bad(
            "distinct_in_set",
            "l_returnflag",
            "lineitem",
            "l_returnflag NOT IN ('A', 'N', 'R')",
            suite="lineitem",
        ),
        _bad(
            "match_regex",
            "l_linestatus",
            "lineitem",
            "NOT regexp_matches(l_linestatus, '^[FO]$')",
            suite="lineitem",
        ),
        _row("of_type", "l_extendedprice", "lineitem", "count(*)", "0", suite="lineitem"),
        _repeats("unique", ["l_orderkey"], "lineitem", severity=WARNING, suite="lineitem"),
        _repeats(
            "pair_unique",
            ["l_orderkey", "l_linenumber"],
            "lineitem",
            severity=WARNING,
            suite="lineitem",
        ),
        _row(
            "row_count_between",
            None,
            "lineitem",
            "count(*)",
            "0",
            success="total >= 1",
            suite="lineitem",
        ),
    ]
)


@query("validate_suite", _LINEITEM)
def validate_suite(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(q.validate(table(spark, folder, "lineitem"), _lineitem_suite()))


@query("validate_stored_suite", _LINEITEM)
def validate_stored_suite(spark: SparkSession, folder: str) -> DataFrame:
    store = new_path(spark, "suites")
    q.save_suite(spark, _lineitem_suite(), store)
    suite = q.load_suite(spark, "lineitem", store)
    return _flat(q.validate(table(spark, folder, "lineitem"), suite))


@query("validate_while_writing", _LINEITEM)
def validate_while_writing(spark: SparkSession, folder: str) -> DataFrame:
    watched = q.watch(table(spark, folder, "lineitem"), _lineitem_suite())
    path = new_path(spark, "lineitem")
    watched.data.write.parquet(path)
    return _flat(watched.measured().results(spark.read.parquet(path)))


@query(
    "severity_gate",
    f"""
    WITH results AS (
        {_LINEITEM} UNION ALL
        {_row("not_null", "c_acctbal", f"{APPLICANTS} a", "count(*)", _MISSING_INCOME)}
        UNION ALL
        {_row("not_null", "c_custkey", f"{APPLICANTS} a", "count(*)", "0", suite="keys")})
    SELECT suite, count(*) AS checks,
           count(*) FILTER (NOT success AND severity = 'CRITICAL') AS critical_failed,
           count(*) FILTER (NOT success AND severity = 'WARNING') AS warning_failed,
           CASE WHEN count(*) FILTER (NOT success AND severity = 'CRITICAL') > 0 THEN 'halt'
                WHEN count(*) FILTER (NOT success AND severity = 'WARNING') > 0
                THEN 'continue with warnings' ELSE 'pass' END AS action
    FROM results GROUP BY suite
    """,
)
def severity_gate(spark: SparkSession, folder: str) -> DataFrame:
    people = applicants(spark, folder)
    results = q.validate(table(spark, folder, "lineitem"), _lineitem_suite())
    results = results.unionByName(q.validate(people, q.Suite("suite", [q.not_null("c_acctbal")])))
    results = results.unionByName(q.validate(people, q.Suite("keys", [q.not_null("c_custkey")])))
    return q.gate(results)


@query(
    "check_datetime_format_spec",
    _bad("datetime_format", "day", _DATES, "try_strptime(day, '%Y-%m-%d') IS NULL"),
)
def check_datetime_format_spec(spark: SparkSession, folder: str) -> DataFrame:
    """As a job spec gives it, with a strftime format."""
    check = q.Check.from_dict(
        {
            "expectation_type": "expect_column_values_to_match_datetime_format",
            "column": "day",
            "kwargs": {"strftime_format": "%Y-%m-%d"},
        }
    )
    return _run(_dates(spark, folder), check)


@query(
    "check_unique_numbers",
    _repeats("unique", ["n"], "(SELECT o_custkey % 1009 + 9 AS n FROM orders) k"),
)
def check_unique_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest and highest of repeated numbers, in a column named like a count."""
    keys = table(spark, folder, "orders").select((F.col("o_custkey") % 1009 + 9).alias("n"))
    return _run(keys, q.unique("n"))


def _shown(check: str, column: str, values: str) -> str:
    """SQL of the examples of a check; ``values`` selects its bad values as text ``v``."""
    return f"""
    SELECT '{check}' AS "check", '{column}' AS "column",
           (SELECT string_agg(left(v, {q.EXAMPLE_CHARS}), '|' ORDER BY h) FROM (
                SELECT v, h, row_number() OVER (PARTITION BY ascii(h) % {q.EXAMPLES} ORDER BY h) AS place
                FROM (SELECT DISTINCT v, md5(v) AS h FROM ({values}))) WHERE place = 1) AS examples"""


_REPEATED_KEYS = "SELECT CAST(o_custkey AS VARCHAR) AS v FROM orders GROUP BY o_custkey HAVING count(*) > 1"
_REPEATED_PAIRS = """SELECT o_orderstatus || ', ' || o_orderpriority AS v FROM orders
    GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 1"""


@query(
    "check_examples",
    " UNION ALL ".join(
        [
            _shown("between", "o_custkey", "SELECT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_custkey > 40"),
            _shown("match_regex", "o_orderpriority", "SELECT o_orderpriority AS v FROM orders WHERE NOT o_orderpriority SIMILAR TO '.*URGENT'"),
            _shown("distinct_in_set", "o_orderstatus", "SELECT o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'F'"),
            _shown("unique", "o_custkey", _REPEATED_KEYS),
            _shown("pair_unique", "o_orderstatus, o_orderpriority", _REPEATED_PAIRS),
        ]
    )
    + """ UNION ALL SELECT 'unique', 'o_orderkey', ''""",
)
def check_examples(spark: SparkSession, folder: str) -> DataFrame:
    """A bounded sample of the bad values of each check, the same on every run."""
    suite = q.Suite(
        "suite",
        [
            q.between("o_custkey", max_value=40),
            q.match_regex("o_orderpriority", "URGENT"),
            q.distinct_in_set("o_orderstatus", ["F"]),
            q.unique("o_custkey"),
            q.pair_unique("o_orderstatus", "o_orderpriority"),
            q.unique("o_orderkey"),
        ],
    )
    results = q.validate(table(spark, folder, "orders"), suite)
    return results.select("check", "column", F.array_join("detail.examples", "|").alias("examples"))


@query(
    "check_unique_together",
    " UNION ALL ".join(
        [
            _repeats("unique", ["l_orderkey"], "lineitem"),
            _repeats("pair_unique", ["l_orderkey", "l_linenumber"], "lineitem"),
            _repeats("unique", ["l_comment_key"], "(SELECT NULLIF(l_partkey, 1) AS l_comment_key FROM lineitem)"),
        ]
    ),
)
def check_unique_together(spark: SparkSession, folder: str) -> DataFrame:
    """Three uniqueness checks, one scan and one shuffle."""
    lines = table(spark, folder, "lineitem").withColumn("l_comment_key", F.nullif("l_partkey", F.lit(1).cast("long")))
    return _run(lines, q.unique("l_orderkey"), q.pair_unique("l_orderkey", "l_linenumber"), q.unique("l_comment_key"))
