"""Data-quality checks, suites, validation and the severity gate.

Validation yields one row per check: ``suite, check, column, severity, success, total,
unexpected, unexpected_pct, detail``. Every row-wise check of a suite is computed in one
aggregate; all uniqueness checks share one grouping, and membership in a table of values adds
one, that read their own columns only. Stage an expensive table before validating it. Only the
not-null checks look at nulls; the others ignore them.

``detail`` shows the lowest and the highest bad value and up to ``EXAMPLES`` more: the hashes of
the values are dealt into so many parts, and of each part the value of least hash is shown. They
are the same on every run and in every order of the rows, and are kept by the same aggregate.
"""

from __future__ import annotations

import datetime
import json
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.fixed import CRITICAL, EMBEDDING_LENGTH, EXPECTATIONS, WARNING
from millrace.functions.types import has_type, quoted, type_of
from millrace.operators.columns import as_column, require_columns
from millrace.operators.stats import present
from millrace.sources.readers import SourceError, is_missing, read_table

_log = logging.getLogger(__name__)

RESULT_SCHEMA = (
    "suite string, check string, column string, severity string, success boolean, "
    "total bigint, unexpected bigint, unexpected_pct double, "
    "detail struct<description: string, lowest: string, highest: string, examples: array<string>>"
)

# Bad values shown for a check, and the code points shown of each.
EXAMPLES = 3
EXAMPLE_CHARS = 200


@dataclass(frozen=True)
class Check:
    """One check: what it tests, on which column, with which arguments, and how severe it is."""

    kind: str
    column: str | None = None
    kwargs: Mapping[str, Any] = field(default_factory=dict)
    severity: str = CRITICAL
    description: str = ""

    def __post_init__(self) -> None:
        if self.kind not in _KINDS:
            raise ValueError(f"unknown check {self.kind!r}")
        if self.severity not in (CRITICAL, WARNING):
            raise ValueError(f"severity must be {CRITICAL} or {WARNING}, not {self.severity!r}")
        needed, allowed = _ARGUMENTS.get(self.kind, ((), ()))
        unknown = sorted(self.kwargs.keys() - {*needed, *allowed})
        absent = sorted(set(needed) - self.kwargs.keys())
        if unknown or absent:
            told = [f"does not know {', '.join(unknown)}"] * bool(unknown)
            told += [f"needs {', '.join(absent)}"] * bool(absent)
            raise ValueError(f"check {self.kind} {' and '.join(told)}")

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> Check:
        """Build a check from a job spec; expectation names and check names both work."""
        kwargs = dict(spec.get("kwargs") or {})
        name = spec["expectation_type"]
        column = spec.get("column") or kwargs.pop("column", None)
        if "strftime_format" in kwargs:
            kwargs["fmt"] = spark_pattern(kwargs.pop("strftime_format"))
        return cls(
            EXPECTATIONS.get(name, name),
            column,
            {_KWARG_NAMES.get(k, k): v for k, v in kwargs.items()},
            spec.get("severity") or CRITICAL,
            spec.get("description") or "",
        )

    def warning(self) -> Check:
        return replace(self, severity=WARNING)

    def described(self, description: str) -> Check:
        return replace(self, description=description)

    @property
    def columns(self) -> list[str]:
        """The columns the check reads."""
        if self.kind == "pair_unique":
            return [self.kwargs["column_a"], self.kwargs["column_b"]]
        return [self.column] if self.column else []


_KWARG_NAMES = {
    "type": "type_name",
    "type_": "type_name",
    "column_A": "column_a",
    "column_B": "column_b",
}


# The arguments that each kind needs, and those that it may have.
_ARGUMENTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "pair_unique": (("column_a", "column_b"), ()),
    "of_type": (("type_name",), ()),
    "between": ((), ("min_value", "max_value")),
    "datetime_format": (("fmt",), ()),
    "distinct_in_set": (("value_set",), ()),
    "proportion_between": ((), ("min_value", "max_value", "value_set", "condition")),
    "row_count_between": ((), ("min_value", "max_value")),
    "match_regex": (("regex",), ()),
    "vector_length": (("length",), ()),
}

# What the directives of strftime are in Spark's patterns.
_DIRECTIVES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "f": "SSSSSS",
    "p": "a",
    "b": "MMM",
    "B": "MMMM",
    "a": "EEE",
    "A": "EEEE",
    "j": "DDD",
    "z": "xx",
    "F": "yyyy-MM-dd",
    "T": "HH:mm:ss",
}


def spark_pattern(strftime: str) -> str:
    """A strftime format as a Spark datetime pattern; unknown directives raise."""
    parts: list[str] = []
    literal, rest = "", iter(strftime + "%")
    for char in rest:
        if char != "%":
            literal += char
            continue
        directive = next(rest, None)
        if directive == "%":
            literal += "%"
            continue
        if any(c.isalpha() or c == "'" for c in literal):
            literal = "'" + literal.replace("'", "''") + "'"
        parts.append(literal)
        literal = ""
        if directive is not None:
            if directive not in _DIRECTIVES:
                raise ValueError(f"the directive %{directive} of {strftime!r} is not known")
            parts.append(_DIRECTIVES[directive])
    return "".join(parts)


def not_null(column: str) -> Check:
    return Check("not_null", column)


def not_null_not_empty(column: str) -> Check:
    """At least one row, no null and no blank string."""
    return Check("not_null_not_empty", column)


def unique(column: str) -> Check:
    """No value occurs twice; every row of a repeated value is unexpected."""
    return Check("unique", column)


def pair_unique(column_a: str, column_b: str) -> Check:
    """No pair of values occurs twice; pairs with a null are ignored."""
    return Check(
        "pair_unique", f"{column_a}, {column_b}", {"column_a": column_a, "column_b": column_b}
    )


def of_type(column: str, type_name: str) -> Check:
    return Check("of_type", column, {"type_name": type_name})


def between(column: str, min_value: Any = None, max_value: Any = None) -> Check:
    return Check("between", column, {"min_value": min_value, "max_value": max_value})


def datetime_format(column: str, fmt: str) -> Check:
    return Check("datetime_format", column, {"fmt": fmt})


def distinct_in_set(column: str, value_set: Sequence[Any] | DataFrame) -> Check:
    """Every value is in the set, given as a short list or as a one-column table."""
    return Check("distinct_in_set", column, {"value_set": value_set})


def proportion_between(
    column: str,
    min_value: float | None = None,
    max_value: float | None = None,
    value_set: Sequence[Any] | None = None,
    condition: str | None = None,
) -> Check:
    """The share of non-null rows that meet a condition lies between two bounds."""
    return Check(
        "proportion_between",
        column,
        {
            "min_value": min_value,
            "max_value": max_value,
            "value_set": value_set,
            "condition": condition,
        },
    )


def row_count_between(min_value: int | None = None, max_value: int | None = None) -> Check:
    return Check("row_count_between", None, {"min_value": min_value, "max_value": max_value})


def match_regex(column: str, regex: str) -> Check:
    """Every value contains a match; anchor the pattern to match whole values."""
    return Check("match_regex", column, {"regex": regex})


def vector_length(column: str, length: int = EMBEDDING_LENGTH) -> Check:
    """Every vector has the declared length."""
    return Check("vector_length", column, {"length": length})


@dataclass(frozen=True)
class Suite:
    """A named list of checks."""

    name: str
    checks: tuple[Check, ...] = ()

    def __init__(self, name: str, checks: Sequence[Check] = ()) -> None:
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "checks", tuple(checks))

    def with_checks(self, *checks: Check) -> Suite:
        return Suite(self.name, (*self.checks, *checks))


class SuiteNotFound(LookupError):
    """No suite of that name is stored."""


class CriticalCheckFailed(RuntimeError):
    """At least one CRITICAL check failed; ``failures`` holds its result rows."""

    def __init__(self, failures: Sequence[Row]) -> None:
        self.failures = list(failures)
        names = ", ".join(f"{r['check']}({r['column'] or 'table'})" for r in self.failures)
        super().__init__(f"critical checks failed in {self.failures[0]['suite']}: {names}")


# --- what each row-wise check counts -------------------------------------------------------


def _within(value: Column, low: Any, high: Any) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value >= F.lit(low))
    if high is not None:
        inside = inside & (value <= F.lit(high))
    return inside


def _blank(df: DataFrame, column: str) -> Column:
    value = F.col(quoted(column))
    if isinstance(type_of(df, column), T.StringType):
        return value.isNull() | (F.trim(value) == "")
    return value.isNull()


def _selected(check: Check) -> Column:
    if check.kwargs.get("condition"):
        return as_column(check.kwargs["condition"])
    return F.col(quoted(check.column)).isin(list(check.kwargs["value_set"]))


# For each kind: the condition that makes a non-null value unexpected.
_UNEXPECTED: dict[str, Callable[[Check], Column]] = {
    "between": lambda c: ~_within(
        F.col(quoted(c.column)), c.kwargs.get("min_value"), c.kwargs.get("max_value")
    ),
    "datetime_format": lambda c: F.try_to_timestamp(
        F.col(quoted(c.column)), F.lit(c.kwargs["fmt"])
    ).isNull(),
    "distinct_in_set": lambda c: ~F.col(quoted(c.column)).isin(list(c.kwargs["value_set"])),
    "match_regex": lambda c: ~F.col(quoted(c.column)).rlike(c.kwargs["regex"]),
    "vector_length": lambda c: F.size(quoted(c.column)) != c.kwargs["length"],
    "proportion_between": lambda c: ~_selected(c),
}
_ROW_WISE = {"not_null", "not_null_not_empty", "of_type", "row_count_between", *_UNEXPECTED}
_UNIQUENESS = {"unique", "pair_unique"}
_KINDS = _ROW_WISE | _UNIQUENESS

# Kinds that group the table by value.
GROUPING = frozenset(_UNIQUENESS)


# Kinds whose results show the lowest and highest bad value.
_SAMPLED = _UNIQUENESS | (_UNEXPECTED.keys() - {"proportion_between"})


def _hashed(text: Column) -> Column:
    """The hash of a value, then what is shown of it; null for null."""
    return F.concat(F.md5(text), F.left(text, F.lit(EXAMPLE_CHARS)))


def _least(hashed: Column) -> dict[str, Column]:
    """Aggregates: the least hashed value of each part of the hashes."""
    part = F.ascii(hashed) % EXAMPLES
    return {f"example{j}": F.min(F.when(part == j, hashed)) for j in range(EXAMPLES)}


def _examples(i: int) -> Column:
    """What is shown of the least values, by their hashes."""
    kept = F.array_compact(F.array(*[F.col(f"example{j}_{i}") for j in range(EXAMPLES)]))
    return F.transform(F.array_sort(kept), lambda x: F.substring(x, 33, EXAMPLE_CHARS))


def _marked(df: DataFrame, checks: Mapping[int, Check]) -> DataFrame:
    """Add ``__bad_i``, the unexpected value of check ``i``, and ``__hashed_i`` of it, else null.

    Columns of their own let the count, the extremes and the examples share one evaluation.
    """
    marks = {}
    hashed = {}
    for i, check in checks.items():
        if check.kind not in _UNEXPECTED:
            continue
        value = F.col(quoted(check.column))
        bad = value.isNotNull() & F.coalesce(_UNEXPECTED[check.kind](check), F.lit(True))
        shown = {"vector_length": F.size(value), "proportion_between": F.lit(True)}
        marks[f"__bad_{i}"] = F.when(bad, shown.get(check.kind, value))
        if check.kind in _SAMPLED:
            hashed[f"__hashed_{i}"] = _hashed(F.col(f"__bad_{i}").cast("string"))
    return df.withColumns(marks).withColumns(hashed) if marks else df


def _measures(df: DataFrame, check: Check, i: int) -> list[Column]:
    """The aggregates of a row-wise check over a marked table: total, unexpected, extremes."""
    rows = F.count(F.lit(1))
    if check.kind in _UNEXPECTED:
        bad = F.col(f"__bad_{i}")
        parts = {"total": F.count(F.col(quoted(check.column))), "unexpected": F.count(bad)}
        if check.kind in _SAMPLED:
            parts |= {"lowest": F.min(bad).cast("string"), "highest": F.max(bad).cast("string")}
            parts |= _least(F.col(f"__hashed_{i}"))
    elif check.kind == "not_null":
        parts = {"total": rows, "unexpected": rows - F.count(F.col(quoted(check.column)))}
    elif check.kind == "not_null_not_empty":
        parts = {"total": rows, "unexpected": F.count_if(_blank(df, check.column))}
    elif check.kind == "of_type":
        fits = has_type(type_of(df, check.column), check.kwargs["type_name"])
        parts = {"total": rows, "unexpected": rows * F.lit(0 if fits else 1)}
    else:
        parts = {"total": rows}
    return [part.alias(f"{name}_{i}") for name, part in parts.items()]


def _result_row(suite: str, check: Check, i: int) -> Column:
    """The result of check ``i`` as a struct over its measures."""
    total = F.coalesce(F.col(f"total_{i}"), F.lit(0)).cast("long")
    counted = F.lit(0) if check.kind == "row_count_between" else F.col(f"unexpected_{i}")
    unexpected = F.coalesce(counted, F.lit(0)).cast("long")
    nothing = F.lit(None).cast("string")
    sampled = check.kind in _SAMPLED
    percent = F.coalesce(F.try_divide(unexpected * F.lit(100.0), total), F.lit(0.0))
    low, high = check.kwargs.get("min_value"), check.kwargs.get("max_value")
    if check.kind == "row_count_between":
        success = _within(total, low, high)
    elif check.kind == "proportion_between":
        success = F.coalesce(
            _within(F.try_divide((total - unexpected).cast("double"), total), low, high),
            F.lit(False),
        )
    elif check.kind == "not_null_not_empty":
        success = (total > 0) & (unexpected == 0)
    else:
        success = unexpected == 0
    return F.struct(
        F.lit(suite).alias("suite"),
        F.lit(check.kind).alias("check"),
        F.lit(check.column or ", ".join(check.columns) or None).cast("string").alias("column"),
        F.lit(check.severity).alias("severity"),
        success.alias("success"),
        total.alias("total"),
        unexpected.alias("unexpected"),
        percent.alias("unexpected_pct"),
        F.struct(
            F.lit(check.description).alias("description"),
            (F.col(f"lowest_{i}") if sampled else nothing).alias("lowest"),
            (F.col(f"highest_{i}") if sampled else nothing).alias("highest"),
            (_examples(i) if sampled else F.array().cast("array<string>")).alias("examples"),
        ).alias("detail"),
    )


def _result_rows(measures: DataFrame, suite: str, checks: Mapping[int, Check]) -> DataFrame:
    """Turn the one wide row of measures into one row per check."""
    rows = F.array(*[_result_row(suite, c, i) for i, c in checks.items()])
    return measures.select(F.explode(rows).alias("r")).select("r.*")


# --- uniqueness and membership -------------------------------------------------------------


def _uniqueness(df: DataFrame, suite: str, checks: Mapping[int, Check]) -> DataFrame:
    """Count the keys of all uniqueness checks at once, then combine the counts.

    Reads the key columns only, once, whatever the number of checks: with several, every row
    stands for one key of each (grouping sets), and one shuffle counts them all. Counting combines
    on the map side, so a frequent key costs one row per task.
    """
    names = {c: f"__key_{k}" for k, c in enumerate(dict.fromkeys(c for x in checks.values() for c in x.columns))}
    keys = df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()])
    sets = list(dict.fromkeys(tuple(sorted({names[c] for c in x.columns})) for x in checks.values()))
    rows = F.count(F.lit(1)).alias("__n")
    if len(sets) == 1:
        counted = keys.groupBy(*sets[0]).agg(rows).withColumn("__set", F.lit(0).cast("long"))
        numbers = {sets[0]: 0}
    else:
        columns = list(names.values())
        counted = keys.groupingSets([list(s) for s in sets], *columns).agg(rows, F.grouping_id().alias("__set"))
        # The number of a set has a bit for each column that is not in it.
        bits = {c: 1 << (len(columns) - 1 - k) for k, c in enumerate(columns)}
        numbers = {s: sum(bits[c] for c in columns if c not in s) for s in sets}
    measures = []
    for i, check in checks.items():
        own = [names[c] for c in check.columns]
        known = F.col("__set") == numbers[tuple(sorted(set(own)))]
        for name in own:
            known = known & F.col(name).isNotNull()
        repeated = known & (F.col("__n") > 1)
        # Extremes are those of the values, not of their text.
        key = F.struct(*[F.col(n).alias(f"k{j}") for j, n in enumerate(own)])

        def shown(extreme: Column, width: int = len(own)) -> Column:
            text = F.concat_ws(", ", *[extreme.getField(f"k{j}").cast("string") for j in range(width)])
            return F.when(extreme.isNotNull(), text)

        hashed = _hashed(F.when(repeated, F.concat_ws(", ", *[F.col(n).cast("string") for n in own])))
        parts = {
            "total": F.sum(F.when(known, F.col("__n"))),
            "unexpected": F.sum(F.when(repeated, F.col("__n"))),
            "lowest": shown(F.min(F.when(repeated, key))),
            "highest": shown(F.max(F.when(repeated, key))),
            **_least(hashed),
        }
        measures += [part.alias(f"{name}_{i}") for name, part in parts.items()]
    return _result_rows(counted.agg(*measures), suite, checks)


def _membership(df: DataFrame, suite: str, i: int, check: Check) -> DataFrame:
    """Membership in a table of values: count each value first, then look it up once."""
    allowed: DataFrame = check.kwargs["value_set"]
    name = allowed.columns[0]
    known = (
        allowed.select(F.col(quoted(name)).alias("value")).distinct().withColumn("known", F.lit(True))
    )
    counted = (
        df.select(F.col(quoted(check.column)).alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bad = F.col("known").isNull()
    hashed = _hashed(F.when(bad, F.col("value").cast("string")))
    measures = counted.join(known, "value", "left").agg(
        F.sum("n").alias(f"total_{i}"),
        F.sum(F.when(bad, F.col("n"))).alias(f"unexpected_{i}"),
        F.min(F.when(bad, F.col("value"))).cast("string").alias(f"lowest_{i}"),
        F.max(F.when(bad, F.col("value"))).cast("string").alias(f"highest_{i}"),
        *(part.alias(f"{part_name}_{i}") for part_name, part in _least(hashed).items()),
    )
    return _result_rows(measures, suite, {i: check})


# --- validation ----------------------------------------------------------------------------


def _split(suite: Suite) -> tuple[dict[int, Check], dict[int, Check]]:
    """The row-wise checks of a suite and those that need a grouping, by position."""
    row_wise, grouped = {}, {}
    for i, check in enumerate(suite.checks):
        in_table = isinstance(check.kwargs.get("value_set"), DataFrame)
        (grouped if in_table or check.kind in _UNIQUENESS else row_wise)[i] = check
    return row_wise, grouped


def _require(df: DataFrame, suite: Suite) -> None:
    for check in suite.checks:
        require_columns(df, check.columns)


def _row_wise_measures(df: DataFrame, suite: Suite) -> list[Column]:
    row_wise, _ = _split(suite)
    return [m for i, check in row_wise.items() for m in _measures(df, check, i)]


def _union(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], RESULT_SCHEMA)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _grouped_results(df: DataFrame, suite: Suite) -> list[DataFrame]:
    _, grouped = _split(suite)
    unique_keys = {i: c for i, c in grouped.items() if c.kind in _UNIQUENESS}
    parts = [_uniqueness(df, suite.name, unique_keys)] if unique_keys else []
    return parts + [
        _membership(df, suite.name, i, c) for i, c in grouped.items() if i not in unique_keys
    ]


def validate(df: DataFrame, suite: Suite) -> DataFrame:
    """One result row per check. Lazy: nothing runs until the results are used."""
    _require(df, suite)
    row_wise, _ = _split(suite)
    parts = _grouped_results(df, suite)
    if row_wise:
        measures = _marked(df, row_wise).agg(*_row_wise_measures(df, suite))
        parts.insert(0, _result_rows(measures, suite.name, row_wise))
    return _union(df.sparkSession, parts)


_MEASURE_NAMES = ("total_", "unexpected_", "lowest_", "highest_", "example")


@dataclass(frozen=True)
class Measured:
    """The row count and the measures of a suite's row-wise checks, already computed."""

    suite: Suite
    seen: Mapping[str, Any]

    @property
    def rows(self) -> int:
        return self.seen["rows"]

    def missing(self, columns: Sequence[str]) -> dict[str, int]:
        """Nulls (and NaN) seen in each column, where the table was watched."""
        counted = {c: self.seen.get(f"missing_{i}") for i, c in enumerate(columns)}
        return {c: n for c, n in counted.items() if n is not None}

    def results(self, df: DataFrame) -> DataFrame:
        """Results of the whole suite; reads ``df`` only for checks that need a grouping."""
        row_wise, _ = _split(self.suite)
        parts = _grouped_results(df, self.suite)
        if row_wise:
            names = [n for n in self.seen if n.startswith(_MEASURE_NAMES)]
            types = ", ".join(
                f"{n} {'bigint' if n.startswith(('total', 'unexpected')) else 'string'}"
                for n in names
            )
            values = [tuple(self.seen[n] for n in names)]
            row = df.sparkSession.createDataFrame(values, types)
            parts.insert(0, _result_rows(row, self.suite.name, row_wise))
        return _union(df.sparkSession, parts)


def measure(df: DataFrame, suite: Suite) -> Measured:
    """Count rows and compute the row-wise checks in one job that reads only their columns."""
    _require(df, suite)
    marked = _marked(df, _split(suite)[0])
    row = marked.agg(F.count(F.lit(1)).alias("rows"), *_row_wise_measures(df, suite)).first()
    return Measured(suite, row.asDict())


@dataclass(frozen=True)
class Watched:
    """A table whose rows, nulls and row-wise checks are counted by the next action on it.

    Write ``data`` once, then take ``measured``.
    """

    data: DataFrame
    suite: Suite
    observation: Observation

    def measured(self) -> Measured:
        return Measured(self.suite, self.observation.get)


def watch(df: DataFrame, suite: Suite) -> Watched:
    """Attach row and null counts and a suite's row-wise checks to the table's next action."""
    _require(df, suite)
    counts = [
        (F.count(F.lit(1)) - F.count(present(df, c))).alias(f"missing_{i}")
        for i, c in enumerate(df.columns)
    ]
    observation = Observation()
    rows = F.count(F.lit(1)).alias("rows")
    observed = _marked(df, _split(suite)[0]).observe(
        observation, rows, *_row_wise_measures(df, suite), *counts
    )
    return Watched(observed.select(*[F.col(quoted(c)) for c in df.columns]), suite, observation)


def gate(results: DataFrame) -> DataFrame:
    """One row per suite: failures by severity and what the job does next."""
    failed = ~F.col("success")
    critical = F.count_if(failed & (F.col("severity") == CRITICAL))
    warnings = F.count_if(failed & (F.col("severity") == WARNING))
    action = (
        F.when(critical > 0, "halt").when(warnings > 0, "continue with warnings").otherwise("pass")
    )
    return results.groupBy("suite").agg(
        F.count(F.lit(1)).alias("checks"),
        critical.alias("critical_failed"),
        warnings.alias("warning_failed"),
        action.alias("action"),
    )


def enforce(results: DataFrame | Sequence[Row]) -> list[Row]:
    """Raise if a CRITICAL check failed; log WARNING failures and return them.

    Collects the failed result rows only: at most one per check.
    """
    if isinstance(results, DataFrame):
        results = results.filter(~F.col("success")).collect()
    failures = [row for row in results if not row["success"]]
    for row in failures:
        _log.warning(
            "%s: %s on %s failed (%s): %s of %s unexpected; %s",
            row["suite"],
            row["check"],
            row["column"],
            row["severity"],
            row["unexpected"],
            row["total"],
            row["detail"],
        )
    critical = [row for row in failures if row["severity"] == CRITICAL]
    if critical:
        raise CriticalCheckFailed(critical)
    return failures


# --- stored suites -------------------------------------------------------------------------

_SUITE_SCHEMA = (
    "position int, check string, column string, kwargs string, severity string, "
    "description string"
)


_STORED_TYPES: dict[str, tuple[type, Callable[[str], Any]]] = {
    "datetime": (datetime.datetime, datetime.datetime.fromisoformat),
    "date": (datetime.date, datetime.date.fromisoformat),
    "decimal": (Decimal, Decimal),
}


def _typed(value: Any) -> dict[str, str]:
    """A value that JSON lacks, with its type."""
    for name, (kind, _) in _STORED_TYPES.items():
        if isinstance(value, kind):
            return {"__type": name, "value": str(value)}
    raise TypeError(f"an argument of type {type(value).__name__} cannot be stored")


def _untyped(value: dict[str, Any]) -> Any:
    return _STORED_TYPES[value["__type"]][1](value["value"]) if "__type" in value else value


def _suite_rows(suite: Suite) -> list[tuple[int, str, str | None, str, str, str]]:
    for check in suite.checks:
        if isinstance(check.kwargs.get("value_set"), DataFrame):
            raise ValueError(f"{check.kind}({check.column}) refers to a table and cannot be stored")
    return [
        (i, c.kind, c.column, json.dumps(dict(c.kwargs), default=_typed), c.severity, c.description)
        for i, c in enumerate(suite.checks)
    ]


def _suite_of(name: str, rows: Sequence[Row]) -> Suite:
    return Suite(
        name,
        [
            Check(
                r["check"], r["column"], json.loads(r["kwargs"], object_hook=_untyped), r["severity"], r["description"]
            )
            for r in rows
        ],
    )


def save_suite(spark: SparkSession, suite: Suite, store: str) -> None:
    """Keep a suite below ``store``; a suite of the same name is replaced.

    Sets given as tables are not stored with the suite.
    """
    table = spark.createDataFrame(_suite_rows(suite), _SUITE_SCHEMA).coalesce(1)
    table.write.mode("overwrite").parquet(f"{store}/suite={suite.name}")


def load_suite(spark: SparkSession, name: str, store: str) -> Suite:
    """A stored suite. Collects one row per check."""
    try:
        table = read_table(spark, f"{store}/suite={name}", schema=_SUITE_SCHEMA)
    except SourceError as error:
        if not is_missing(error):
            raise
        raise SuiteNotFound(f"no suite {name!r} in {store}") from error
    return _suite_of(name, table.orderBy("position").collect())


def get_or_create_suite(spark: SparkSession, name: str, store: str) -> Suite:
    try:
        return load_suite(spark, name, store)
    except SuiteNotFound:
        suite = Suite(name)
        save_suite(spark, suite, store)
        return suite


# --- versions of suites ---------------------------------------------------------------------

_VERSION_SCHEMA = f"suite string, version int, checks int, {_SUITE_SCHEMA}"


def suite_versions(spark: SparkSession, store: str) -> DataFrame:
    """The log of all suites: a row for each check of each version, an empty suite as one row.

    The log only grows. A store that is not there has no rows.
    """
    try:
        return read_table(spark, store, schema=_VERSION_SCHEMA)
    except SourceError as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], _VERSION_SCHEMA)


def _latest_rows(spark: SparkSession, name: str, store: str) -> list[Row]:
    own = suite_versions(spark, store).filter(F.col("suite") == name)
    rows = own.orderBy("version", "position").collect()  # a row for each check
    return [r for r in rows if r["version"] == rows[-1]["version"]]


def keep_version(spark: SparkSession, suite: Suite, store: str) -> int:
    """Append a suite to the log at ``store`` unless its latest version is the same; its version.

    Versions of a name count from 1. Appending is one write of one file, so a job that dies leaves
    a whole version or none. Sets given as tables are not stored.
    """
    rows = _suite_rows(suite)
    latest = _latest_rows(spark, suite.name, store)
    last = latest[0]["version"] if latest else 0
    kept = [tuple(r[c] for c in ("position", "check", "column", "kwargs", "severity", "description")) for r in latest]
    if latest and [r for r in kept if r[0] is not None] == rows:
        return last
    empty = [(None, None, None, None, None, None)]
    log = [(suite.name, last + 1, len(rows), *row) for row in rows or empty]
    spark.createDataFrame(log, _VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(store)
    return last + 1


def latest_suite(spark: SparkSession, name: str, store: str) -> Suite:
    """The latest version of a suite in the log at ``store``. Collects one row per check."""
    rows = _latest_rows(spark, name, store)
    if not rows:
        raise SuiteNotFound(f"no suite {name!r} in {store}")
    # Two writers at once may have given one number twice; the checks of one of them count.
    wanted = rows[0]["checks"]
    once = {r["position"]: r for r in rows if r["position"] is not None and r["checks"] == wanted}
    return _suite_of(name, [once[k] for k in sorted(once)])
