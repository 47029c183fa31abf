from __future__ import annotations

import pytest

from millrace.operators import checks as q
from millrace.sources import readers, scratch, writers
from millrace.sources.models import load_model


def test_csv_keeps_awkward_values(spark, tmp_path):
    rows = [(1, ' lead "quoted" '), (2, "comma, back\\slash"), (3, None), (4, "two\nlines")]
    df = spark.createDataFrame(rows, "i int, s string")
    path = str(tmp_path / "t.csv")
    writers.write_table(df, path, "csv")
    back = readers.read_csv(spark, path, df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_csv_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,amount,name\n1,2.5,x\n2,,y\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "double", "string"]


def test_missing_paths_are_named(spark, tmp_path):
    with pytest.raises(readers.SourceError, match="absent.csv"):
        readers.read_csv(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "here.csv").write_text("a\n1\n")
    with pytest.raises(IOError, match="one.csv, two.csv"):
        readers.load_sources(spark, str(tmp_path), ["one", "here", "two"])
    assert set(readers.load_sources(spark, str(tmp_path), ["here"])) == {"here"}
    with pytest.raises(readers.SourceError, match="nomodel"):
        load_model(str(tmp_path / "nomodel"))


def test_dictionary(spark, tmp_path):
    text = 'No,Table,Row,Description\n1,t,"c","café, ""au lait""\nline two"\n'
    (tmp_path / "d.csv").write_bytes(text.encode("latin-1"))
    (row,) = readers.read_dictionary(spark, str(tmp_path / "d.csv")).collect()
    assert tuple(row) == ("t", "c", 'café, "au lait"\nline two')
    (tmp_path / "bad.csv").write_text("Table,Description\nt,x\n")
    with pytest.raises(readers.SourceError, match="Row"):
        readers.read_dictionary(spark, str(tmp_path / "bad.csv"))


def test_overwrite_append_and_counts(spark, tmp_path):
    df = spark.range(10)
    path = str(tmp_path / "t")
    writers.write_table(df, path)
    assert writers.write_counted(df.limit(4), path) == 4
    assert spark.read.parquet(path).count() == 4
    results = q.validate(df, q.Suite("s", [q.not_null("id")]))
    report = str(tmp_path / "report")
    writers.write_report(results, report)
    writers.write_report(results, report)
    assert spark.read.parquet(report).count() == 2


def test_scratch_is_below_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch.new_path(spark, "x").startswith(f"{folder}/")
    assert scratch.new_path(spark, "x") != scratch.new_path(spark, "x")
    staged = scratch.stage_table(spark.range(5), "five")
    assert staged.count() == 5
    assert staged.inputFiles()[0].startswith(f"file://{folder}/")
