"""Aggregations: means, modes, counts and grouped measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, TimestampType

from millrace.functions.types import has_nan, quoted, type_of
from millrace.operators.columns import Expression, as_column, require_columns


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into null, so that both count as missing."""
    value = F.col(quoted(column))
    return F.nanvl(value, F.lit(None).cast(type_of(df, column))) if has_nan(
        type_of(df, column)
    ) else value


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean of each column, from one pass; null where nothing is present."""
    require_columns(df, columns)
    return df.agg(*[F.avg(present(df, c)).alias(c) for c in columns])


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of each column; ties go to the smallest value.

    Nulls do not count. Values of all columns are counted in one pass. Counting combines on
    the map side, so a value that fills most of a column costs one row per task in the
    shuffle, and a column with many distinct values spreads over all tasks instead of
    filling one buffer.
    """
    require_columns(df, columns)
    counts = counted_values(df, columns).filter(F.col("value").isNotNull())
    return counts.agg(
        *[mode_of(i, type_of(df, c)).alias(c) for i, c in enumerate(columns)]
    )


def counted_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each column holds each value: ``position`` of the column, ``value``, ``n``.

    Values are counted as text, which is exact for every atomic type: bytes as hexadecimal digits,
    instants as microseconds, because two of them can have one local text, and the two zeros as one.
    """
    entries = [
        F.struct(F.lit(i).alias("position"), _as_text(df, c).alias("value"))
        for i, c in enumerate(columns)
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("entry"))
        .select("entry.*")
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _as_text(df: DataFrame, column: str) -> Column:
    value, kind = F.col(quoted(column)), type_of(df, column)
    if isinstance(kind, BinaryType):
        return F.hex(value)
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("string")
    return (value + F.lit(0.0).cast(kind) if has_nan(kind) else value).cast("string")


def mode_of(position: int, kind: DataType) -> Column:
    """Aggregate over ``counted_values``: the most frequent value of the column there.

    Of equally frequent values the smallest one of the column's type, not of its text.
    """
    own = (F.col("position") == position) & F.col("value").isNotNull()
    text = F.col("value")
    if isinstance(kind, BinaryType):
        value = F.unhex(text)
    elif isinstance(kind, TimestampType):
        value = F.timestamp_micros(text.try_cast("long"))
    else:
        value = text.try_cast(kind)
    entry = F.struct((-F.col("n")).alias("n"), value.alias("value"))
    return F.min(F.when(own, entry)).getField("value")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def aggregate(
    df: DataFrame, by: Sequence[str], measures: Mapping[str, Expression]
) -> DataFrame:
    """Grouped aggregation; ``measures`` maps output names to aggregate expressions."""
    require_columns(df, by)
    return df.groupBy(*map(quoted, by)).agg(*[as_column(e).alias(n) for n, e in measures.items()])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Group sizes, largest first, equal sizes by value; null is a group of its own."""
    return (
        df.groupBy(quoted(column))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(quoted(column)))
    )


def top_value(df: DataFrame, column: str) -> DataFrame:
    """The most frequent group: the first row of ``value_counts``."""
    return value_counts(df, column).limit(1)
