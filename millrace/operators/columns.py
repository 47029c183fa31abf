"""Projections, filters and derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.types import quoted

Expression = str | Column


def as_column(expression: Expression) -> Column:
    """SQL text or a Column, as a Column."""
    return F.expr(expression) if isinstance(expression, str) else expression


def filter_rows(df: DataFrame, predicate: Expression) -> DataFrame:
    """Rows where the predicate is true; false and null both drop the row."""
    return df.filter(predicate)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    require_columns(df, names)
    return df.withColumnsRenamed(dict(names))


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Cast columns; values that do not fit become null, or fail the job when ``strict``."""
    require_columns(df, types)

    def cast(name: str, target: str) -> Column:
        value = F.col(quoted(name))
        return value.cast(target) if strict else value.try_cast(target)

    return df.withColumns({name: cast(name, target) for name, target in types.items()})


def derive(df: DataFrame, columns: Mapping[str, Expression]) -> DataFrame:
    """Add calculated columns, all from the input columns."""
    return df.withColumns({name: as_column(e) for name, e in columns.items()})


def ratio(numerator: str, denominator: str) -> Column:
    """Quotient of two columns; null where the denominator is zero."""
    return F.try_divide(F.col(quoted(numerator)), F.col(quoted(denominator)))


def remainder(column: str, divisor: int, non_negative: bool = False) -> Column:
    """Remainder of a division; the sign follows the dividend unless ``non_negative``."""
    value = F.col(quoted(column))
    return F.pmod(value, F.lit(divisor)) if non_negative else value % divisor


def derive_when(
    df: DataFrame,
    name: str,
    cases: Sequence[tuple[Expression, object]],
    default: object = None,
) -> DataFrame:
    """Add a column that takes the value of the first case whose condition is true."""
    if not cases:
        return df.withColumn(name, F.lit(default))
    (condition, value), *rest = cases
    chosen = F.when(as_column(condition), value)
    for condition, value in rest:
        chosen = chosen.when(as_column(condition), value)
    return df.withColumn(name, chosen.otherwise(default))


def random_column(df: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """Uniform value in [0, 100); the same seed gives the same values on the same partitions."""
    return df.withColumn(name, F.rand(seed) * 100)


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*[quoted(c) if c in df.columns else c for c in columns])


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}; found {df.columns}")
