from __future__ import annotations

import json

import pytest

from millrace.operators import catalog as cat
from millrace.operators.chunks import to_records
from millrace.operators.search import check_dimension, search_text


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    rows = {tuple(r) for r in cat.profile(df).collect()}
    assert rows == {("i", "int", False, 0), ("s", "string", True, 1)}
    assert {r.nullable for r in cat.profile(df.limit(0)).collect()} == {False}


def test_profile_of_a_missing_file_is_empty(spark, tmp_path):
    assert cat.profile_path(spark, str(tmp_path / "absent.csv")).collect() == []


def test_cached_profile_is_computed_once(spark, tmp_path):
    store = str(tmp_path / "profiles")
    df = spark.createDataFrame([(1,)], "i int")
    assert cat.cached_profile(df, "t", store).count() == 1
    changed = spark.createDataFrame([(1, 2)], "i int, j int")
    assert cat.cached_profile(changed, "t", store).count() == 1
    assert cat.cached_profile(changed, "u", store).count() == 2


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame(
        [
            ("application_{train|test}.csv", "SK_ID_CURR", "key"),
            ("bureau", "CREDIT_ACTIVE", None),
        ],
        "Table string, Row string, Description string",
    )


def test_expand_tables(dictionary):
    rows = {tuple(r) for r in cat.expand_tables(dictionary).collect()}
    assert rows == {
        ("application_train.csv", "SK_ID_CURR", "key"),
        ("application_test.csv", "SK_ID_CURR", "key"),
        ("bureau.csv", "CREDIT_ACTIVE", None),
    }


def test_catalog_defaults_and_text(spark, dictionary):
    profiles = spark.createDataFrame(
        [("application_train.csv", "SK_ID_CURR", "int", True, 4)],
        "table string, column string, data_type string, nullable boolean, null_count bigint",
    )
    catalog = cat.catalog_text(cat.build_catalog(dictionary, profiles))
    rows = {r.table: r for r in catalog.collect()}
    assert rows["application_train.csv"].text == (
        "Table: application_train.csv, Column: SK_ID_CURR, Description: key, "
        "Data Type: int, Nullable: True"
    )
    assert rows["application_test.csv"].data_type == "Unknown"
    assert rows["bureau.csv"].text.endswith("Description: , Data Type: Unknown, Nullable: False")
    assert cat.lookup(catalog, "bureau.csv", "CREDIT_ACTIVE").count() == 1
    assert cat.lookup(catalog, "bureau.csv", "SK_ID_CURR").count() == 0


SPEC = {
    "source": [{"name": "applicants"}, {"name": "records"}],
    "transformation": [
        {
            "type": "join",
            "details": "join both on SK_ID_CURR",
            "data_quality_checks": [{"expectation_type": "x", "column": "sk_id"}],
        },
        {
            "type": "column_manipulation",
            "details": "fill",
            "transformations_details": [
                {"operation": "impute_mean", "columns": ["AMT_CREDIT", "amt_income"]},
                {"operation": "filter_rows"},
            ],
        },
    ],
    "business_rules": [{"type": "calculation", "details": "AMT_CREDIT / AMT_TOTAL"}],
    "output": [
        {
            "type": "scoring_model",
            "details": "store SCORE",
            "data_quality_checks": [{"expectation_type": "y", "column": "SCORE"}],
        },
        {"type": "format", "details": "as a table",
         "data_quality_checks": [{"expectation_type": "y", "column": "bad"}]},
    ],
    "global_data_quality_checks": [{"expectation_type": "z", "column": "TARGET"},
                                   {"expectation_type": "count"}],
}


def test_mentioned_and_missing_columns(spark):
    stored = spark.createDataFrame(
        [(7, json.dumps(SPEC)), (8, json.dumps({"source": [{"name": "nowhere"}]}))],
        "id int, spec string",
    )
    specs = cat.parse_specs(stored, "id", "spec")
    mentioned = cat.mentioned_columns(specs)
    assert {tuple(r) for r in mentioned.collect()} == {
        (7, c, c == "SCORE")
        for c in ("SK_ID_CURR", "sk_id", "AMT_CREDIT", "amt_income", "AMT_TOTAL", "SCORE", "bad",
                  "TARGET")
    }
    known = [("applicants", c) for c in ("SK_ID_CURR", "sk_id", "AMT_TOTAL")]
    known += [("records", "SK_ID_CURR"), ("records", "AMT_CREDIT"), ("other", "TARGET")]
    catalog = spark.createDataFrame(known, "table string, column string")
    missing = cat.missing_columns(mentioned, cat.spec_sources(specs), catalog)
    assert {tuple(r) for r in missing.collect()} == {
        (7, "amt_income"), (7, "bad"), (7, "TARGET")
    }
    absent = cat.missing_sources(cat.spec_sources(specs), catalog)
    assert [tuple(r) for r in absent.collect()] == [(8, "nowhere")]


def test_extract_identifiers_with_a_catalog(spark):
    df = spark.createDataFrame([("A ETL on SK_ID and SK_ID",), (None,)], "t string")
    assert {r.identifier for r in cat.extract_identifiers(df, "t").collect()} == {
        "A", "ETL", "SK_ID"
    }
    known = spark.createDataFrame([("SK_ID",), ("OTHER",)], "column string")
    assert [r.identifier for r in cat.extract_identifiers(df, "t", known).collect()] == ["SK_ID"]


def test_catalog_of_files_and_search(spark, tmp_path):
    (tmp_path / "application_train.csv").write_text("SK_ID_CURR,AMT_INCOME_TOTAL\n1,10000\n2,\n")
    (tmp_path / "bureau.csv").write_text("SK_ID_CURR,CREDIT_ACTIVE\n1,Active\n")
    rows = [
        ("application_{train|test}.csv", "AMT_INCOME_TOTAL", "income of the applicant"),
        ("bureau", "CREDIT_ACTIVE", "status of the credit"),
    ]
    dictionary = spark.createDataFrame(rows, "Table string, Row string, Description string")
    store = str(tmp_path / "store")
    for _ in range(2):
        profiles = cat.profile_sources(spark, dictionary, str(tmp_path), store)
        catalog = cat.build_catalog(dictionary, profiles)
        assert {tuple(r) for r in catalog.drop("original_description").collect()} == {
            ("application_train.csv", "AMT_INCOME_TOTAL", "int", True),
            ("application_test.csv", "AMT_INCOME_TOTAL", "Unknown", False),
            ("bureau.csv", "CREDIT_ACTIVE", "string", False),
        }
    records = to_records(cat.catalog_items(catalog))
    assert records.count() == 3
    assert check_dimension(records, "embedding").first().success
    found = search_text(records, "credit status", k=1).first()
    assert found.metadata["column"] == "CREDIT_ACTIVE"
    where = {"table": "application_test.csv"}
    assert [r.metadata["table"] for r in search_text(records, "x", where=where).collect()] in (
        [["application_test.csv"], []]
    )
    again = to_records(cat.catalog_items(catalog.union(catalog)))
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in records.collect())


def test_spec_items(spark):
    df = spark.createDataFrame([("do it", "{}")], "request string, spec string")
    (row,) = cat.spec_items(df, "request", "spec", "tests").collect()
    assert row.text == "problem_type::do it => {}"
    assert row.metadata == {"source": "tests", "request": "do it"}
