"""The column catalog and the audit of mentioned columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fixed import WHITESPACE
from millrace.operators import catalog as cat
from millrace.operators.chunks import to_records
from millrace.operators.names import match_names
from millrace.operators.search import search_text
from millrace.queries.of_columns import APPLICANTS, applicants
from millrace.queries.of_vectors import letter_counts, letters_sql
from millrace.queries.registry import query, table
from millrace.sources.scratch import new_path
from millrace.sources.writers import write_table

_CUSTOMER_TYPES = {
    "c_custkey": "bigint",
    "c_name": "string",
    "c_nationkey": "int",
    "c_acctbal": "double",
    "c_mktsegment": "string",
}
_DOCUMENT_TYPES = {
    "doc_id": "bigint",
    "text": "string",
    "lang": "string",
    "source": "string",
    "n_chars": "bigint",
}


def _profile_sql(source: str, types: dict[str, str], table_name: str | None = None) -> str:
    label = f"'{table_name}' AS \"table\", " if table_name else ""
    return " UNION ALL ".join(
        f"SELECT {label}'{c}' AS \"column\", '{t}' AS data_type, "
        f"count(*) FILTER ({c} IS NULL) > 0 AS nullable, "
        f"count(*) FILTER ({c} IS NULL) AS null_count FROM {source}"
        for c, t in types.items()
    )


@query("profile", _profile_sql(f"{APPLICANTS} a", _CUSTOMER_TYPES))
def profile(spark: SparkSession, folder: str) -> DataFrame:
    return cat.profile(applicants(spark, folder))


@query("profile_file", _profile_sql("documents", _DOCUMENT_TYPES))
def profile_file(spark: SparkSession, folder: str) -> DataFrame:
    return cat.profile_path(spark, f"{folder}/documents.parquet", "parquet")


@query("profile_cached", _profile_sql(f"{APPLICANTS} a", _CUSTOMER_TYPES))
def profile_cached(spark: SparkSession, folder: str) -> DataFrame:
    store = new_path(spark, "profiles")
    cat.cached_profile(applicants(spark, folder), "customer.csv", store)
    return cat.cached_profile(applicants(spark, folder), "customer.csv", store)


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    people = applicants(spark, folder)
    documents = table(spark, folder, "documents")
    return cat.profile_tables(
        {"customer_train.csv": people, "customer_test.csv": people, "documents.csv": documents}
    )


_PROFILES = " UNION ALL ".join(
    [
        _profile_sql(f"{APPLICANTS} a", _CUSTOMER_TYPES, "customer_train.csv"),
        _profile_sql(f"{APPLICANTS} a", _CUSTOMER_TYPES, "customer_test.csv"),
        _profile_sql("documents", _DOCUMENT_TYPES, "documents.csv"),
    ]
)


@query("profile_tables", _PROFILES)
def profile_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark, folder)


def _document_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as dictionary rows: English ones describe a templated table name."""
    name = F.when(F.col("lang") == "en", F.concat("source", F.lit("_{train|test}")))
    name = name.when(F.col("lang") == "fr", F.concat("source", F.lit(".csv")))
    return table(spark, folder, "documents").select(
        name.otherwise(F.col("source")).alias("Table"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("Row"),
        F.col("text").alias("Description"),
    )


@query(
    "expand_tables",
    """
    SELECT unnest(CASE WHEN lang = 'en' THEN [source || '_train.csv', source || '_test.csv']
                       ELSE [source || '.csv'] END) AS "table",
           'doc_' || doc_id AS "column", text AS original_description
    FROM documents
    """,
)
def expand_tables(spark: SparkSession, folder: str) -> DataFrame:
    return cat.expand_tables(_document_dictionary(spark, folder))


_DESCRIPTIONS = [
    ("customer_{train|test}", "c_custkey", "Key of the applicant"),
    ("customer_{train|test}.csv", "c_acctbal", "Income, missing where negative"),
    ("customer_{train|test}", "c_birthday", "Not in the data"),
    ("documents", "lang", "Language of the text"),
    ("documents.csv", "text", "Whole text"),
    ("unknown_table", "lang", "Table without a profile"),
]
_EXPANDED = [
    (full, column, text)
    for name, column, text in _DESCRIPTIONS
    for full in (
        [name.replace("{train|test}", v).removesuffix(".csv") + ".csv" for v in ("train", "test")]
        if "{" in name
        else [name.removesuffix(".csv") + ".csv"]
    )
]


def _catalog_sql(expanded: str) -> str:
    return (
        f"WITH profiles AS ({_PROFILES}), expanded(\"table\", \"column\", original_description) AS "
        f"({expanded}), catalog AS ("
        "SELECT \"table\", \"column\", original_description, coalesce(data_type, 'Unknown') AS "
        "data_type, coalesce(nullable, false) AS nullable "
        "FROM expanded LEFT JOIN profiles USING (\"table\", \"column\")) "
    )


_CATALOG = _catalog_sql(f"VALUES {', '.join(str(row) for row in _EXPANDED)}")


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    dictionary = spark.createDataFrame(
        _DESCRIPTIONS, "Table string, Row string, Description string"
    )
    return cat.build_catalog(dictionary, _profiles(spark, folder))


@query("build_catalog", _CATALOG + "SELECT * FROM catalog")
def build_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _catalog(spark, folder)


_OF_DOCUMENTS = _catalog_sql(
    """
    SELECT unnest(CASE lang WHEN 'en' THEN ['customer_train.csv', 'customer_test.csv']
                  WHEN 'fr' THEN ['documents.csv'] ELSE [source || '.csv'] END),
           CASE lang WHEN 'en' THEN 'c_acctbal' WHEN 'fr' THEN 'lang' ELSE 'doc_' || doc_id END, text
    FROM documents
    """
)


def _catalog_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog with a row for each document: most of them describe the same few columns."""
    lang, own = F.col("lang"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    dictionary = table(spark, folder, "documents").select(
        F.when(lang == "en", "customer_{train|test}").when(lang == "fr", "documents.csv")
        .otherwise(F.col("source")).alias("Table"),
        F.when(lang == "en", "c_acctbal").when(lang == "fr", "lang").otherwise(own).alias("Row"),
        F.col("text").alias("Description"),
    )
    return cat.build_catalog(dictionary, _profiles(spark, folder))


@query("build_catalog_of_documents", _OF_DOCUMENTS + "SELECT * FROM catalog")
def build_catalog_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _catalog_of_documents(spark, folder)


_TEXT_SQL = """
    SELECT "table", "column",
           'Table: ' || "table" || ', Column: ' || "column" || ', Description: ' ||
           original_description || ', Data Type: ' || data_type || ', Nullable: ' ||
           CASE WHEN nullable THEN 'True' ELSE 'False' END AS text
    FROM catalog
    """


@query("catalog_text_of_documents", _OF_DOCUMENTS + _TEXT_SQL)
def catalog_text_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return cat.catalog_text(_catalog_of_documents(spark, folder)).select("table", "column", "text")


@query("catalog_text", _CATALOG + _TEXT_SQL)
def catalog_text(spark: SparkSession, folder: str) -> DataFrame:
    return cat.catalog_text(_catalog(spark, folder)).select("table", "column", "text")


_ITEM_TEXT = (
    "'Table: ' || \"table\" || ', Column: ' || \"column\" || ', Description: ' || "
    "original_description || ', Data Type: ' || data_type || ', Nullable: ' || "
    "CASE WHEN nullable THEN 'True' ELSE 'False' END"
)
_ITEM_ID = "sha256(sha256(text) || " + " || ".join(
    f"'-' || sha256('{key}') || sha256({value})"
    for key, value in [
        ("column", '"column"'),
        ("data_type", "data_type"),
        ("nullable", "CASE WHEN nullable THEN 'True' ELSE 'False' END"),
        ("original_description", "original_description"),
        ("table", '"table"'),
    ]
) + ") || '-0'"


@query(
    "ingest_catalog",
    _CATALOG
    + f"""
    SELECT {_ITEM_ID} AS id, "table", "column", data_type, text,
           CAST(768 AS INTEGER) AS length
    FROM (SELECT *, {_ITEM_TEXT} AS text FROM catalog)
    """,
)
def ingest_catalog(spark: SparkSession, folder: str) -> DataFrame:
    records = to_records(cat.catalog_items(_catalog(spark, folder)))
    names = ("table", "column", "data_type", "text")
    return records.select(
        "id", *[F.col("metadata")[n].alias(n) for n in names], F.size("embedding").alias("length")
    )


_ASKED = "column with the language of the whole text"


def _searched(spark: SparkSession, folder: str, **settings: object) -> DataFrame:
    """The catalog rows nearest to a sentence, then only those of one table."""
    items = cat.catalog_items(_catalog(spark, folder))
    encode = {k: v for k, v in settings.items() if k in ("encode", "length")}
    records = to_records(items, **encode)
    everywhere = search_text(records, _ASKED, 3, **settings)
    somewhere = search_text(records, "income", 2, where={"table": "customer_train.csv"}, **settings)
    both = everywhere.withColumn("asked", F.lit(1)).unionByName(somewhere.withColumn("asked", F.lit(2)))
    return both.select("asked", "id", F.col("metadata")["text"].alias("text"), "score", "metadata")


@query(
    "search_catalog",
    """
    SELECT CAST(asked AS INTEGER) AS asked, true AS in_range, true AS in_table,
           true AS is_stored
    FROM (VALUES (1), (1), (1), (2), (2)) t(asked)
    """,
)
def search_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """By hashed words; the hash has no SQL, so what any search must hold is compared."""
    stored = to_records(cat.catalog_items(_catalog(spark, folder))).select(
        F.col("id"), F.lit(True).alias("is_stored")
    )
    found = _searched(spark, folder).join(stored, "id", "left")
    inside = (F.col("asked") == 1) | (F.col("metadata")["table"] == "customer_train.csv")
    return found.select(
        "asked",
        F.col("score").between(0, 1).alias("in_range"),
        inside.alias("in_table"),
        F.coalesce("is_stored", F.lit(False)).alias("is_stored"),
    )


def _nearest_sql(asked: int, text: str, k: int, where: str = "true") -> str:
    score = f"round(list_cosine_similarity(v, {letters_sql(repr(text))}), 9)"
    return (
        f"(SELECT CAST({asked} AS INTEGER) AS asked, id, text, {score} AS score FROM named "
        f"WHERE {where} ORDER BY score DESC, id LIMIT {k})"
    )


@query(
    "search_catalog_by_letters",
    _CATALOG
    + f""", named AS (
        SELECT {_ITEM_ID} AS id, "table", text, {letters_sql("text")} AS v
        FROM (SELECT *, {_ITEM_TEXT} AS text FROM catalog))
    {_nearest_sql(1, _ASKED, 3)}
    UNION ALL {_nearest_sql(2, "income", 2, "\"table\" = 'customer_train.csv'")}
    """,
)
def search_catalog_by_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The same searches with an embedding that SQL can compute."""
    return _searched(spark, folder, encode=letter_counts, length=26).drop("metadata")


_CHUNKED = (
    _OF_DOCUMENTS
    + f""", items AS (SELECT DISTINCT *, {_ITEM_TEXT} AS text FROM catalog),
    cut AS (SELECT *, {_ITEM_ID.removesuffix(" || '-0'")} AS base,
        list_filter(regexp_split_to_array(text, '{WHITESPACE}'), lambda w: w <> '') AS words FROM items),
    starts AS (SELECT *, unnest(range(0, len(words), 500)) AS start FROM cut),
    chunked AS (SELECT base || '-' || (start // 500) AS id, "table", "column", data_type,
        array_to_string(words[start + 1 : start + 500], ' ') AS text FROM starts)
    """
)


def _records_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return to_records(cat.catalog_items(_catalog_of_documents(spark, folder)), letter_counts, 26)


@query(
    "ingest_catalog_of_documents",
    _CHUNKED + 'SELECT id, "table", "column", data_type, text, CAST(26 AS INTEGER) AS length FROM chunked',
)
def ingest_catalog_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog that grows with the documents, cut, named and embedded."""
    names = ("table", "column", "data_type", "text")
    return _records_of_documents(spark, folder).select(
        "id", *[F.col("metadata")[n].alias(n) for n in names], F.size("embedding").alias("length")
    )


@query(
    "search_catalog_of_documents",
    _CHUNKED
    + f""", named AS (SELECT id, "table", text, {letters_sql("text")} AS v FROM chunked)
    {_nearest_sql(1, _ASKED, 5)}
    UNION ALL {_nearest_sql(2, "income", 4, "\"table\" = 'customer_train.csv'")}
    """,
)
def search_catalog_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Two searches in the catalog of all documents, by letters; the second in one table."""
    records = _records_of_documents(spark, folder)
    settings = {"encode": letter_counts, "length": 26}
    everywhere = search_text(records, _ASKED, 5, **settings)
    somewhere = search_text(records, "income", 4, where={"table": "customer_train.csv"}, **settings)
    both = everywhere.withColumn("asked", F.lit(1)).unionByName(somewhere.withColumn("asked", F.lit(2)))
    return both.select("asked", "id", F.col("metadata")["text"].alias("text"), "score")


_FILE_TYPES = {**_CUSTOMER_TYPES, "c_custkey": "int"}


@query(
    "catalog_from_files",
    f"""
    WITH profiles AS (
        {_profile_sql(f"{APPLICANTS} a", _FILE_TYPES, "customer_train.csv")}),
    expanded("table", "column", original_description) AS (
        VALUES {', '.join(str(row) for row in _EXPANDED)})
    SELECT "table", "column", original_description, coalesce(data_type, 'Unknown') AS data_type,
           coalesce(nullable, false) AS nullable
    FROM expanded LEFT JOIN profiles USING ("table", "column")
    """,
)
def catalog_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of CSV files; one described file exists, the others do not."""
    base = new_path(spark, "files")
    write_table(applicants(spark, folder), f"{base}/customer_train.csv", "csv")
    dictionary = spark.createDataFrame(
        _DESCRIPTIONS, "Table string, Row string, Description string"
    )
    store = new_path(spark, "profiles")
    cat.profile_sources(spark, dictionary, base, store)
    return cat.build_catalog(dictionary, cat.profile_sources(spark, dictionary, base, store))


@query(
    "spec_items",
    """
    SELECT event_id, 'problem_type::' || event_type || ' => ' || props AS text,
           'events' AS source, event_type AS request
    FROM events
    """,
)
def spec_items(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type", "props")
    items = cat.spec_items(events, "event_type", "props", "events")
    metadata = F.col("metadata")
    return items.select(
        "event_id", "text", metadata["source"].alias("source"), metadata["request"].alias("request")
    )


@query(
    "lookup",
    f"SELECT * FROM ({_PROFILES}) WHERE \"table\" = 'customer_test.csv' AND "
    "\"column\" = 'c_acctbal'",
)
def lookup(spark: SparkSession, folder: str) -> DataFrame:
    return cat.lookup(_profiles(spark, folder), "customer_test.csv", "c_acctbal")


# Whole words in DuckDB's regex dialect, which has no look-around: take every run of word
# characters, then keep the runs made of A-Z and underscore alone.
_TOKENS = (
    "list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), "
    "lambda w: regexp_full_match(w, '[A-Z_]+'))"
)


@query(
    "extract_identifiers",
    f"""
    SELECT DISTINCT identifier
    FROM (SELECT unnest({_TOKENS.format("text")}) AS identifier FROM documents)
    """,
)
def extract_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return cat.extract_identifiers(table(spark, folder, "documents"), "text")


@query(
    "extract_known_identifiers",
    f"""
    SELECT DISTINCT identifier
    FROM (SELECT unnest({_TOKENS.format("text")}) AS identifier FROM documents)
    WHERE identifier IN (SELECT upper(lang) FROM documents)
    """,
)
def extract_known_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    known = documents.select(F.upper("lang").alias("column")).distinct()
    return cat.extract_identifiers(documents, "text", known)


def _specs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as stored job specs: text as descriptions, names from the document's fields."""
    named = F.lit("source").alias("name")
    language = F.struct(F.col("lang").alias("column"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("spec_id"),
        F.array(
            F.struct(F.lit("documents").alias("name")), F.struct(F.col("source").alias("name"))
        ).alias("source"),
        F.array(
            F.struct(
                F.col("text").alias("details"),
                F.array(
                    F.struct(
                        F.lit("impute_mean").alias("operation"),
                        F.array(F.lit("n_chars"), F.col("source")).alias("columns"),
                    )
                ).alias("transformations_details"),
                F.array(F.struct(F.lit("doc_id").alias("column"))).alias("data_quality_checks"),
            )
        ).alias("transformation"),
        F.array(F.struct(F.lit("keep rows where AMT_TOTAL is known").alias("details"))).alias(
            "business_rules"
        ),
        F.array(
            F.struct(
                F.when(F.col("lang") == "en", "scoring_model").otherwise("format").alias("type"),
                F.lit("scores go to SCORE").alias("details"),
                F.array(language, F.struct(F.lit("SCORE").alias("column"))).alias(
                    "data_quality_checks"
                ),
            )
        ).alias("output"),
        F.array(F.struct(named.cast("string").alias("column"))).alias(
            "global_data_quality_checks"
        ),
    )


_MENTIONED = f"""
SELECT spec_id, "column", lang = 'en' AND "column" IN (lang, 'SCORE') AS generated
FROM (
    SELECT doc_id AS spec_id, lang, unnest(list_distinct(list_concat({_TOKENS.format("text")},
           ['n_chars', source, 'doc_id', 'AMT_TOTAL', 'SCORE', lang, 'source']))) AS "column"
    FROM documents)
"""


@query("mentioned_columns", _MENTIONED)
def mentioned_columns(spark: SparkSession, folder: str) -> DataFrame:
    return cat.mentioned_columns(_specs(spark, folder))


@query("mentioned_columns_json", _MENTIONED)
def mentioned_columns_json(spark: SparkSession, folder: str) -> DataFrame:
    specs = _specs(spark, folder)
    fields = F.to_json(F.struct(*[c for c in specs.columns if c != "spec_id"]))
    stored = specs.select("spec_id", fields.alias("spec"))
    return cat.mentioned_columns(cat.parse_specs(stored, "spec_id", "spec"))


@query(
    "missing_columns",
    f"""
    SELECT spec_id, "column" FROM ({_MENTIONED})
    WHERE NOT generated AND "column" NOT IN ('doc_id', 'text', 'lang', 'source', 'n_chars')
    """,
)
def missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    specs = _specs(spark, folder)
    catalog = cat.profile_tables({"documents": table(spark, folder, "documents")})
    return cat.missing_columns(cat.mentioned_columns(specs), cat.spec_sources(specs), catalog)


@query("missing_sources", 'SELECT doc_id AS spec_id, source AS "table" FROM documents')
def missing_sources(spark: SparkSession, folder: str) -> DataFrame:
    names = ("documents", "labels", "pages")
    catalog = cat.profile_tables({name: table(spark, folder, name) for name in names})
    return cat.missing_sources(cat.spec_sources(_specs(spark, folder)), catalog)


@query(
    "malformed_specs",
    """
    SELECT doc_id AS spec_id, CASE doc_id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no text'
        WHEN 2 THEN 'not an object' ELSE 'no sources' END AS reason
    FROM documents WHERE doc_id % 5 < 4
    """,
)
def malformed_specs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("doc_id") % 5
    spec = (
        F.when(kind == 0, F.concat(F.lit("{"), F.col("source")))
        .when(kind == 2, F.lit("[1, 2]"))
        .when(kind == 3, F.lit('{"transformation": []}'))
        .when(kind == 4, F.to_json(F.struct(F.array(F.struct(F.col("source").alias("name"))).alias("source"))))
    )
    stored = table(spark, folder, "documents").select("doc_id", spec.alias("spec"))
    return cat.malformed_specs(stored, "doc_id", "spec")


# Specs by the remainder of the document's id: what is wrong in each, as path, expected, found.
_WRONG_SPECS = [
    ('{"source": [{"name": "%s"}], "transformation": [{"details": "X_Y"}], "output": null}', []),
    ('{"source": [{"name": "%s"}], "transformation": {"details": "use BAD_COL"}}', [("$.transformation", "list", "object")]),
    (
        '{"source": [{"name": "%s"}], "transformation": [{"details": 7}, {"transformations_details": '
        '[{"operation": "impute"}, {"operation": "cast", "columns": "BAD_COL"}]}]}',
        [
            ("$.transformation[0].details", "text", "number"),
            ("$.transformation[1].transformations_details[1].columns", "list", "text"),
        ],
    ),
    (
        '{"source": [{"name": "%s"}, "other"], "global_data_quality_checks": [{"column": ["A", "B"]}, {"column": true}]}',
        [
            ("$.source[1]", "object", "text"),
            ("$.global_data_quality_checks[0].column", "text", "list"),
            ("$.global_data_quality_checks[1].column", "text", "truth value"),
        ],
    ),
]


@query(
    "mistyped_specs",
    " UNION ALL ".join(
        f"SELECT doc_id AS spec_id, '{path}' AS path, '{expected}' AS expected, '{found}' AS found "
        f"FROM documents WHERE doc_id % {len(_WRONG_SPECS)} = {k}"
        for k, (_, wrong) in enumerate(_WRONG_SPECS)
        for path, expected, found in wrong
    ),
)
def mistyped_specs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored specs with parts of other types than a spec has there."""
    kind = F.col("doc_id") % len(_WRONG_SPECS)
    texts = [F.when(kind == k, F.format_string(text, "source")) for k, (text, _) in enumerate(_WRONG_SPECS)]
    stored = table(spark, folder, "documents").select("doc_id", F.coalesce(*texts).alias("spec"))
    return cat.mistyped_parts(stored, "doc_id", "spec")


@query(
    "match_names",
    r"""
    WITH tokens AS (
        SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS name FROM documents),
    names AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z_]*[0-9][A-Za-z0-9_]*') AS name FROM documents)
    SELECT doc_id, name FROM tokens JOIN names USING (name)
    """,
)
def match_names_in_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Names with digits, the first such of each document, found in all documents."""
    documents = table(spark, folder, "documents")
    first = F.regexp_extract("text", "[A-Za-z_]*[0-9][A-Za-z0-9_]*", 0)
    matched = match_names(documents.select("doc_id", "text"), "text", documents.select(first.alias("column")))
    return matched.select("doc_id", F.explode("names").alias("name"))


@query(
    "profile_cached_file",
    "SELECT \"column\", data_type, nullable, null_count FROM ("
    + _profile_sql("orders", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string"})
    + ")",
)
def profile_cached_file(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV file profiled once; the second request reads the store."""
    base, store = new_path(spark, "csv"), new_path(spark, "profiles")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    write_table(table(spark, folder, "orders").select(*columns), f"{base}/orders.csv", "csv")
    cat.cached_profile_path(spark, f"{base}/orders.csv", "orders.csv", store)
    return cat.cached_profile_path(spark, f"{base}/orders.csv", "orders.csv", store)
