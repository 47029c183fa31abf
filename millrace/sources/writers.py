"""Sinks: tables in Parquet or CSV, and the validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite ``path``. Object-store paths work where the cluster has the connector."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    writer.save(path)


def write_counted(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """As ``write_table``; the row count is observed during the write, without another job."""
    observed = Observation()
    write_table(df.observe(observed, F.count(F.lit(1)).alias("rows")), path, fmt)
    return observed.get["rows"]


def write_report(results: DataFrame, path: str) -> None:
    """Append validation results, whether they passed or not."""
    results.write.mode("append").parquet(path)
