"""Filling missing values, with a log of what was filled and why a column was left alone."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.fixed import MISSING_TEXT
from millrace.functions.types import columns_of, in_family, quoted, type_of
from millrace.operators.columns import require_columns
from millrace.operators.stats import counted_values, mode_of, present

IMPUTED_SCHEMA = (
    "column string, strategy string, value string, missing bigint, outcome string"
)

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Imputed:
    """The filled table and the log: column, strategy, value, missing, outcome."""

    data: DataFrame
    log: DataFrame


def impute(
    df: DataFrame,
    numeric: str | None = "mean",
    categorical: str | None = "mode",
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    value: str = MISSING_TEXT,
    missing: Mapping[str, int] | None = None,
    now: bool = False,
) -> Imputed:
    """Fill nulls (and NaN) in numeric and string columns.

    ``numeric``      "mean" or None. The mean is cast to the column type, so an integer
                     column gets the truncated mean.
    ``categorical``  "mode", "constant" (fills ``value``) or None.
    ``columns``      fill these columns, each of which must fit a strategy. Without it all
                     columns of a family are filled but for those in ``exclude``.
    ``missing``      known null counts, as observed when ``df`` was written. Columns that
                     miss nothing need no statistics, which spares the counting of values.
    ``now``          compute the statistics at once, as one row per strategy, instead of as
                     scalar subqueries of every query on the result.

    A column without any value is left as it is. The statistics take one pass over ``df``
    for each strategy, however many columns there are. Stage an expensive ``df`` first.
    """
    chosen = list(columns) if columns is not None else [c for c in df.columns if c not in exclude]
    require_columns(df, chosen)
    if columns is not None:
        _require_families(df, chosen, numeric, categorical)
    whole = [c for c in chosen if missing is not None and missing.get(c) == 0]
    chosen = [c for c in chosen if c not in whole]
    by_strategy = {
        numeric: [c for c in chosen if in_family(type_of(df, c), "numeric")],
        categorical: [c for c in chosen if in_family(type_of(df, c), "string")],
    }

    fills: dict[str, Column] = {}
    logs: list[DataFrame] = [_nothing_missing(df, whole)] if whole else []
    for strategy, names in by_strategy.items():
        if strategy is None or not names:
            continue
        statistics = _statistics(df, strategy, names, value)
        if now:
            row = statistics.collect()
            statistics = df.sparkSession.createDataFrame(row, statistics.schema)
            found = {n: F.lit(row[0][f"value_{i}"]) for i, n in enumerate(names)}
        elif strategy == "constant":
            found = {n: F.lit(value) for n in names}
        else:
            struct = statistics.select(F.struct(*_values(names))).scalar()
            found = {n: struct.getField(f"value_{i}") for i, n in enumerate(names)}
        fills |= {n: F.coalesce(present(df, n), c.cast(type_of(df, n))) for n, c in found.items()}
        logs.append(_log_rows(df, strategy, names, statistics))
    data = df.withColumns(fills) if fills else df
    return Imputed(data, _union(logs or [_nothing_missing(df, [])]))


def _require_families(
    df: DataFrame, columns: Sequence[str], numeric: str | None, categorical: str | None
) -> None:
    families = [f for f, s in (("numeric", numeric), ("string", categorical)) if s is not None]
    wrong = [c for c in columns if not any(in_family(type_of(df, c), f) for f in families)]
    if wrong:
        raise ValueError(f"{', '.join(wrong)}: not of the type that is filled ({', '.join(families)})")


def _values(names: Sequence[str]) -> list[str]:
    return [f"value_{i}" for i in range(len(names))]


def _statistics(df: DataFrame, strategy: str, names: list[str], value: str) -> DataFrame:
    """One row: the filling value and the number of missing entries of each column."""
    if strategy == "mode":
        own = [F.when((F.col("position") == i) & F.col("value").isNull(), F.col("n"))
               for i in range(len(names))]
        values = [mode_of(i, type_of(df, n)) for i, n in enumerate(names)]
        absent = [F.coalesce(F.sum(o), F.lit(0)) for o in own]
        source = counted_values(df, names)
    elif strategy == "mean":
        values = [F.avg(present(df, n)) for n in names]
        absent = [F.count_if(present(df, n).isNull()) for n in names]
        source = df
    elif strategy == "constant":
        values = [F.max(F.lit(value)) for _ in names]
        absent = [F.count_if(F.col(quoted(n)).isNull()) for n in names]
        source = df
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return source.agg(
        *[v.alias(f"value_{i}") for i, v in enumerate(values)],
        *[a.cast("long").alias(f"missing_{i}") for i, a in enumerate(absent)],
    )


def _log_rows(
    df: DataFrame, strategy: str, names: list[str], statistics: DataFrame
) -> DataFrame:
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(strategy).alias("strategy"),
            F.col(f"value_{i}").cast(type_of(df, n)).cast("string").alias("value"),
            F.col(f"missing_{i}").alias("missing"),
        )
        for i, n in enumerate(names)
    ]
    outcome = (
        F.when(F.col("missing") == 0, "nothing missing")
        .when(F.col("value").isNull(), "skipped: no value present")
        .otherwise("filled")
    )
    return (
        statistics.select(F.explode(F.array(*rows)).alias("row"))
        .select("row.*")
        .withColumn("outcome", outcome)
    )


def _union(logs: list[DataFrame]) -> DataFrame:
    whole = logs[0]
    for log in logs[1:]:
        whole = whole.unionByName(log)
    return whole


def _nothing_missing(df: DataFrame, names: list[str]) -> DataFrame:
    rows = [(n, "none", None, 0, "nothing missing") for n in names]
    return df.sparkSession.createDataFrame(rows, IMPUTED_SCHEMA)


def warn_skipped(log: DataFrame) -> list[str]:
    """Columns that could not be filled, each logged as a warning. One row per column."""
    skipped = [r["column"] for r in log.filter(F.col("outcome").startswith("skipped")).collect()]
    for name in skipped:
        _log.warning("column %s has no value to fill with; left as it is", name)
    return skipped
