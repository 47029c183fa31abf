"""The column catalog: profiles, dictionary rows, lookups and checks of mentioned columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.fixed import (
    CATALOG_SENTENCE,
    SPEC_ITEM,
    TABLE_SUFFIX,
    TABLE_TEMPLATE,
    TABLE_TEMPLATE_VALUES,
    UNKNOWN_TYPE,
)
from millrace.functions.text import identifiers
from millrace.operators.joins import join_tables
from millrace.sources.readers import SourceError, file_state, is_missing, read_table

PROFILE_SCHEMA = "column string, data_type string, nullable boolean, null_count bigint"


def profile(df: DataFrame) -> DataFrame:
    """Type, null presence and null count of every column, from one pass over the table.

    Nulls are the rows less the non-null values: two plain counts, which Spark can answer
    from Parquet footers where ``spark.sql.parquet.aggregatePushdown`` is on.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    counts = df.agg(
        *[(F.count(F.lit(1)) - F.count(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            (F.col(f"n{i}") > 0).alias("nullable"),
            F.col(f"n{i}").alias("null_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def profile_path(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Profile of a file; empty when the file is missing or unreadable."""
    try:
        return profile(read_table(spark, path, fmt))
    except SourceError:
        return spark.createDataFrame([], PROFILE_SCHEMA)


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Profiles of several tables under one another, with the table name in front."""
    whole = None
    for name, df in tables.items():
        part = profile(df).select(F.lit(name).alias("table"), "*")
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        raise ValueError("no tables to profile")
    return whole


def cached_profile(df: DataFrame, table: str, store: str) -> DataFrame:
    """The stored profile of a table; computed and stored on the first request."""
    spark = df.sparkSession
    path = f"{store}/table={table}"
    try:
        return read_table(spark, path, schema=PROFILE_SCHEMA)
    except SourceError as error:
        if not is_missing(error):
            raise
    profile(df).write.mode("overwrite").parquet(path)
    return read_table(spark, path, schema=PROFILE_SCHEMA)


def cached_profile_path(
    spark: SparkSession, path: str, table: str, store: str, fmt: str = "csv"
) -> DataFrame:
    """The profile of a file, read from ``store`` as long as the file has not changed.

    The store is asked for the file's state (paths, lengths and modification times) before anything
    is inferred, so a known file is not opened. A changed file is profiled again, and the profile
    of its earlier state goes. A missing or unreadable file has an empty profile.
    """
    state = file_state(spark, path)
    if state is None:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    folder = f"{store}/table={table}"
    own = f"{folder}/state={state}"
    try:
        return read_table(spark, own, schema=PROFILE_SCHEMA)
    except SourceError as error:
        if not is_missing(error):
            raise
    try:
        found = profile(read_table(spark, path, fmt))
    except SourceError:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    found.write.mode("overwrite").parquet(own)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("state=") and name != f"state={state}":
            files.delete(status.getPath(), True)
    return read_table(spark, own, schema=PROFILE_SCHEMA)


def profile_sources(
    spark: SparkSession, dictionary: DataFrame, base: str, store: str | None = None
) -> DataFrame:
    """Profiles of the CSV files below ``base`` that a dictionary describes.

    The names of the described tables are collected: metadata, one name per file. A file
    that is missing or unreadable contributes nothing. With a ``store`` each file is profiled
    once and its stored profile is read from then on, until the file changes.
    """
    names = [r["table"] for r in expand_tables(dictionary).select("table").distinct().collect()]
    whole = spark.createDataFrame([], f"table string, {PROFILE_SCHEMA}")
    for name in sorted(names):
        path = f"{base}/{name}"
        found = cached_profile_path(spark, path, name, store) if store else profile_path(spark, path)
        whole = whole.unionByName(found.select(F.lit(name).alias("table"), "*"))
    return whole


def expand_tables(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows as ``table, column, original_description``.

    A table name with the train/test template stands for one table of each kind; every
    name gets the file suffix unless it has it.
    """
    table = F.col("Table")
    variants = F.array(
        *[F.replace(table, F.lit(TABLE_TEMPLATE), F.lit(v)) for v in TABLE_TEMPLATE_VALUES]
    )
    names = F.when(F.contains(table, F.lit(TABLE_TEMPLATE)), variants).otherwise(F.array(table))
    expanded = dictionary.select(
        F.explode(names).alias("table"),
        F.col("Row").alias("column"),
        F.col("Description").alias("original_description"),
    )
    named = F.col("table").endswith(TABLE_SUFFIX)
    return expanded.withColumn(
        "table", F.when(named, F.col("table")).otherwise(F.concat("table", F.lit(TABLE_SUFFIX)))
    )


def build_catalog(dictionary: DataFrame, profiles: DataFrame) -> DataFrame:
    """Expanded dictionary rows with the type and null presence found in the data.

    Both sides hold metadata (one row per column of a table); a column that was not
    profiled gets an unknown type and counts as not nullable.
    """
    found = profiles.select("table", "column", "data_type", "nullable")
    return (
        expand_tables(dictionary)
        .join(found, ["table", "column"], "left")
        .select(
            "table",
            "column",
            "original_description",
            F.coalesce("data_type", F.lit(UNKNOWN_TYPE)).alias("data_type"),
            F.coalesce("nullable", F.lit(False)).alias("nullable"),
        )
    )


def catalog_text(catalog: DataFrame) -> DataFrame:
    """Add ``text``: one sentence per catalog row."""
    text = F.format_string(
        CATALOG_SENTENCE,
        F.col("table"),
        F.col("column"),
        F.coalesce("original_description", F.lit("")),
        F.col("data_type"),
        F.when(F.col("nullable"), "True").otherwise("False"),
    )
    return catalog.withColumn("text", text)


def catalog_items(catalog: DataFrame) -> DataFrame:
    """Catalog rows as text items: the sentence, and the row's fields as metadata."""
    fields = ("table", "column", "original_description", "data_type")
    entries = [part for f in fields for part in (F.lit(f), F.coalesce(F.col(f), F.lit("")))]
    nullable = F.when(F.col("nullable"), "True").otherwise("False")
    metadata = F.create_map(*entries, F.lit("nullable"), nullable)
    return catalog_text(catalog).select("text", metadata.alias("metadata"))


def spec_items(specs: DataFrame, request: str, spec: str, source: str) -> DataFrame:
    """Job specs (JSON text) as text items next to the request each one answers."""
    text = F.format_string(SPEC_ITEM, F.col(request), F.col(spec))
    metadata = F.create_map(
        F.lit("source"), F.lit(source), F.lit("request"), F.coalesce(F.col(request), F.lit(""))
    )
    return specs.select("*", text.alias("text"), metadata.alias("metadata"))


def lookup(catalog: DataFrame, table: str, column: str) -> DataFrame:
    """The catalog rows of exactly this table and column."""
    return catalog.filter((F.col("table") == table) & (F.col("column") == column))


def extract_identifiers(
    df: DataFrame, column: str, catalog: DataFrame | None = None
) -> DataFrame:
    """Distinct column-like tokens of a text column, as ``identifier``.

    With a ``catalog``, only tokens that name one of its columns. Tokens are made distinct
    per text before the shuffle, and again by the aggregation's map side.
    """
    tokens = df.select(
        F.explode(F.array_distinct(identifiers(F.col(column)))).alias("identifier")
    ).distinct()
    if catalog is None:
        return tokens
    known = catalog.select(F.col("column").alias("identifier"))
    return tokens.join(known, "identifier", "left_semi")


_CHECK = T.StructType([T.StructField("column", T.StringType())])
_CHECKS = T.StructField("data_quality_checks", T.ArrayType(_CHECK))
_OPERATION = T.StructType(
    [
        T.StructField("operation", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
    ]
)

# The part of a stored job spec that names columns.
SPEC_SCHEMA = T.StructType(
    [
        T.StructField(
            "source", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
        ),
        T.StructField(
            "transformation",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("details", T.StringType()),
                        T.StructField("transformations_details", T.ArrayType(_OPERATION)),
                        _CHECKS,
                    ]
                )
            ),
        ),
        T.StructField(
            "business_rules",
            T.ArrayType(T.StructType([T.StructField("details", T.StringType())])),
        ),
        T.StructField(
            "output",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("details", T.StringType()),
                        _CHECKS,
                    ]
                )
            ),
        ),
        T.StructField("global_data_quality_checks", T.ArrayType(_CHECK)),
    ]
)


# What a part of a spec is called in a finding, and how a variant of it calls itself.
_KINDS = {T.StringType: ("text", "STRING"), T.ArrayType: ("list", "ARRAY"), T.StructType: ("object", "OBJECT")}
_FOUND = {
    "STRING": "text", "ARRAY": "list", "OBJECT": "object", "BOOLEAN": "truth value",
    "BIGINT": "number", "DOUBLE": "number", "DECIMAL": "number",
}
_FINDING = "array<struct<path: string, expected: string, found: string>>"


def _mistyped(value: Column, shape: T.DataType, path: Column) -> Column:
    """Findings of a variant that does not have a shape, down to its parts; null parts may be."""
    expected, name = _KINDS[type(shape)]
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    told = F.coalesce(*[F.when(kind == k, word) for k, word in _FOUND.items()], F.lower(kind))
    here = F.array(
        F.struct(path.alias("path"), F.lit(expected).alias("expected"), told.alias("found"))
    ).cast(_FINDING)
    clean = F.array().cast(_FINDING)
    if isinstance(shape, T.ArrayType):
        parts = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(
            F.transform(
                parts,
                lambda v, i: _mistyped(v, shape.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
            )
        )
    elif isinstance(shape, T.StructType):
        fields = [
            _mistyped(F.try_variant_get(value, f"$.{f.name}", "variant"), f.dataType, F.concat(path, F.lit(f".{f.name}")))
            for f in shape.fields
        ]
        inside = F.concat(*fields)
    else:
        inside = clean
    known = value.isNotNull() & (kind != "VOID")
    return F.when(~known, clean).when(kind != name, here).otherwise(F.coalesce(inside, clean))


def mistyped_parts(df: DataFrame, spec_id: str, text: str) -> DataFrame:
    """Parts of stored specs that have another type than a spec has there.

    ``spec_id, path, expected, found``, for instance a text where a list of columns belongs. All
    parts are walked that name columns or tables; such a part would otherwise be read as nothing
    and its columns pass unseen. A JSON null counts as absent. Works row by row.
    """
    spec = F.try_parse_json(F.col(text))
    found = _mistyped(spec, SPEC_SCHEMA, F.lit("$"))
    return df.select(F.col(spec_id).alias("spec_id"), F.explode(found).alias("f")).select("spec_id", "f.*")


def malformed_specs(df: DataFrame, spec_id: str, text: str) -> DataFrame:
    """Ids of the specs whose text is missing or no spec, as ``spec_id, reason``.

    ``parse_specs`` has nothing or not all to tell of them, so an audit must not take them for
    clean; ``mistyped_parts`` says which parts are wrong.
    """
    parsed = F.try_parse_json(F.col(text))
    reason = (
        F.when(F.col(text).isNull(), "no text")
        .when(parsed.isNull(), "not JSON")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
        .when(F.size(_mistyped(parsed, SPEC_SCHEMA, F.lit("$"))) > 0, "mistyped parts")
        .when(F.from_json(F.col(text), SPEC_SCHEMA)["source"].isNull(), "no sources")
    )
    found = df.select(F.col(spec_id).alias("spec_id"), reason.alias("reason"))
    return found.filter(F.col("reason").isNotNull())


def parse_specs(df: DataFrame, spec_id: str, text: str) -> DataFrame:
    """Specs stored as JSON text, as ``spec_id`` and the fields of ``SPEC_SCHEMA``."""
    spec = F.from_json(F.col(text), SPEC_SCHEMA)
    return df.select(F.col(spec_id).alias("spec_id"), spec.alias("spec")).select(
        "spec_id", "spec.*"
    )


def mentioned_columns(specs: DataFrame) -> DataFrame:
    """Every column a stored job spec mentions, as ``spec_id, column, generated``.

    Columns come from operations, checks and the column-like tokens in descriptions of
    steps, rules and outputs. Columns checked on a scoring output are marked as generated.
    Works row by row on the spec's arrays, without a shuffle.
    """

    def parts(items: str, pick: object) -> Column:
        nested = F.flatten(F.transform(F.col(items), pick))
        return F.coalesce(nested, F.array().cast("array<string>"))

    def names(checks: Column) -> Column:
        return F.coalesce(
            F.transform(checks, lambda c: c["column"]), F.array().cast("array<string>")
        )

    def tokens(text: Column) -> Column:
        return F.coalesce(identifiers(text), F.array().cast("array<string>"))

    def operation_columns(operations: Column) -> Column:
        listed = F.transform(
            operations, lambda o: F.coalesce(o["columns"], F.array().cast("array<string>"))
        )
        return F.coalesce(F.flatten(listed), F.array().cast("array<string>"))

    mentioned = F.concat(
        parts(
            "transformation",
            lambda s: F.concat(
                tokens(s["details"]),
                operation_columns(s["transformations_details"]),
                names(s["data_quality_checks"]),
            ),
        ),
        parts("business_rules", lambda r: tokens(r["details"])),
        parts(
            "output", lambda o: F.concat(tokens(o["details"]), names(o["data_quality_checks"]))
        ),
        names(F.col("global_data_quality_checks")),
    )
    generated = parts(
        "output",
        lambda o: F.when(o["type"] == "scoring_model", names(o["data_quality_checks"])).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return (
        specs.select("spec_id", F.explode(F.array_distinct(mentioned)).alias("column"),
                     generated.alias("generated_columns"))
        .filter(F.col("column").isNotNull())
        .select(
            "spec_id",
            "column",
            F.array_contains("generated_columns", F.col("column")).alias("generated"),
        )
    )


def spec_sources(specs: DataFrame) -> DataFrame:
    """The tables each stored job spec reads, as ``spec_id, table``."""
    named = F.array_distinct(F.transform(F.col("source"), lambda s: s["name"]))
    return specs.select("spec_id", F.explode(named).alias("table")).filter(
        F.col("table").isNotNull()
    )


def missing_columns(mentioned: DataFrame, sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mentioned columns that no source of their spec has, generated ones aside.

    ``mentioned``  spec_id, column, generated
    ``sources``    spec_id, table
    ``catalog``    table, column

    One shuffle, by spec, serves the join with the sources and the final grouping. Some
    columns are mentioned by most specs, so the catalog is broadcast while its measured size
    allows it.
    """
    needed = mentioned.filter(~F.col("generated")).select("spec_id", "column")
    pairs = needed.join(sources.select("spec_id", "table"), "spec_id", "left")
    known = catalog.select("table", "column").distinct().withColumn("known", F.lit(True))
    looked_up = join_tables(pairs, known, ["table", "column"], "left", broadcast="right")
    return (
        looked_up.groupBy("spec_id", "column")
        .agg(F.count("known").alias("found"))
        .filter(F.col("found") == 0)
        .select("spec_id", "column")
    )


def missing_sources(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Source tables that the catalog does not hold, per spec."""
    return sources.join(catalog.select("table").distinct(), "table", "left_anti").select(
        "spec_id", "table"
    )
