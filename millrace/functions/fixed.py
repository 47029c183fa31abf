"""Constants, names and formats that results depend on."""

# Text chunks and vector search.
CHUNK_WORDS = 500
EMBEDDING_LENGTH = 768
DEFAULT_TOP_K = 5

# Imputation and catalog defaults.
MISSING_TEXT = "Unknown"
UNKNOWN_TYPE = "Unknown"

# Column dictionary layout and table-name template.
DICTIONARY_COLUMNS = ("Table", "Row", "Description")
DICTIONARY_ENCODING = "ISO-8859-1"
TABLE_TEMPLATE = "{train|test}"
TABLE_TEMPLATE_VALUES = ("train", "test")
TABLE_SUFFIX = ".csv"
CATALOG_SENTENCE = "Table: %s, Column: %s, Description: %s, Data Type: %s, Nullable: %s"

# The text under which a request and its spec are stored.
SPEC_ITEM = "problem_type::%s => %s"

# Severities and the scoring range.
CRITICAL = "CRITICAL"
WARNING = "WARNING"
SCORE_MIN = 0
SCORE_MAX = 100

# Whitespace code points that separate words, as a regex class.
WHITESPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]+"

# A column-like token is a whole word made of A-Z and underscore.
IDENTIFIER = r"(?<![\p{L}\p{N}_])[A-Z_]+(?![\p{L}\p{N}_])"

# Expectation names accepted in job specs, and the check each one means.
EXPECTATIONS = {
    "expect_column_values_to_not_be_null": "not_null",
    "expect_column_values_to_not_be_null_and_column_to_not_be_empty": "not_null_not_empty",
    "expect_column_values_to_be_unique": "unique",
    "expect_column_pair_values_to_be_unique": "pair_unique",
    "expect_column_values_to_be_of_type": "of_type",
    "expect_column_values_to_be_between": "between",
    "expect_column_values_to_match_datetime_format": "datetime_format",
    "expect_column_distinct_values_to_be_in_set": "distinct_in_set",
    "expect_column_proportion_of_values_to_be_between": "proportion_between",
    "expect_table_row_count_to_be_between": "row_count_between",
    "expect_column_values_to_match_regex": "match_regex",
}
