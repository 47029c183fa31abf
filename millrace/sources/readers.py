"""Scans: CSV files, named sources and column dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from millrace.functions.fixed import DICTIONARY_COLUMNS, DICTIONARY_ENCODING
from millrace.functions.types import quoted


class SourceError(IOError):
    """A source cannot be read; the message names it."""


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multi_line: bool = False,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV with a header row; a quote inside a quoted value is doubled.

    Give ``schema`` for large files: inference reads the whole input once more. Files whose
    values span lines need ``multi_line``, and then each file is read by a single task.
    ``options`` are those of Spark's reader; ``mode=FAILFAST`` stops at a malformed row.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("multiLine", multi_line).options(**(options or {}))
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    try:
        return reader.csv(path)
    except PySparkException as error:
        raise SourceError(f"cannot read {path}: {error}") from error


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema, options=options)
    reader = spark.read.options(**(options or {}))
    reader = reader.schema(schema) if schema else reader
    try:
        return reader.format(fmt).load(path)
    except PySparkException as error:
        raise SourceError(f"cannot read {path}: {error}") from error


def load_sources(
    spark: SparkSession,
    base: str,
    names: Iterable[str],
    fmt: str = "csv",
    schemas: Mapping[str, StructType | str] | None = None,
    options: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Resolve each name to ``{base}/{name}.{fmt}``; every missing name is reported at once.

    ``schemas`` spare the inference of CSV types; ``options`` go to the reader of every source.
    """
    tables: dict[str, DataFrame] = {}
    missing: list[str] = []
    for name in names:
        path = f"{base}/{name}.{fmt}"
        try:
            tables[name] = read_table(spark, path, fmt, (schemas or {}).get(name), options)
        except SourceError as error:
            if not is_missing(error):
                raise
            missing.append(f"{name}.{fmt}")
    if missing:
        raise SourceError(f"not found: {', '.join(missing)}")
    return tables


def is_missing(error: SourceError) -> bool:
    """True when the error says that the path does not exist."""
    cause = error.__cause__
    return isinstance(cause, AnalysisException) and cause.getCondition() == "PATH_NOT_FOUND"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Column dictionary: a latin-1 CSV with table, column and description, all text.

    Quoted descriptions may span lines, so the file is read with ``multiLine``; it holds
    one row per documented column and stays small.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", DICTIONARY_ENCODING)
        .option("multiLine", True)
        .option("escape", '"')
    )
    try:
        found = reader.csv(path)
    except PySparkException as error:
        raise SourceError(f"cannot read {path}: {error}") from error
    absent = [name for name in DICTIONARY_COLUMNS if name not in found.columns]
    if absent:
        raise SourceError(f"{path} lacks the columns {', '.join(absent)}; found {found.columns}")
    return found.select(*DICTIONARY_COLUMNS)


def file_state(spark: SparkSession, path: str) -> str | None:
    """A digest of the path, length and modification time of every file at ``path``; None if none.

    Asks the file system only: no Spark job runs and no file is opened.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    found, listed = [], files.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        found.append(f"{status.getPath().toString()}\t{status.getLen()}\t{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


@dataclass(frozen=True)
class Sorted:
    """Rows of a CSV that fit the schema, and the text of those that do not, as ``record``."""

    data: DataFrame
    rejects: DataFrame


_RECORD = "__record"


def read_csv_sorted(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    options: Mapping[str, str] | None = None,
) -> Sorted:
    """As ``read_csv``, with malformed rows set apart instead of turned into nulls.

    A row is malformed if it has another number of values than the schema, or a value of another
    type. All columns are read for either table, because whether a row fits shows in all of them.
    Both tables are lazy and read the file on their own.
    """
    if schema is None:
        schema = read_csv(spark, path, options=options).schema
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if _RECORD in schema.names:
        raise ValueError(f"a column may not be named {_RECORD}")
    marked = StructType([*schema.fields]).add(_RECORD, StringType())
    given = {
        **(options or {}), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RECORD, "columnPruning": "false"
    }
    found = read_csv(spark, path, marked, options=given)
    columns = [F.col(quoted(c)) for c in schema.names]
    # Spark converts only the columns that are read, and finds errors only in them; this condition,
    # which every row meets, reads all of them whatever is selected later.
    found = found.filter(F.length(F.concat_ws("", *[c.cast("string") for c in columns])) >= 0)
    # No plain null test: that would be pushed into the parser, which asks before it knows the record.
    fits = F.coalesce(F.length(_RECORD), F.lit(-1)) < 0
    rejects = found.filter(~fits).select(F.col(_RECORD).alias("record"))
    return Sorted(found.filter(fits).select(*columns), rejects)
