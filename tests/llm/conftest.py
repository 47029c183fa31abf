from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

#: Names that operators use inside; as further columns they must do no harm.
CLASHING = ["key", "bands", "found", "blob", "size", "n", "row", "copies", "label", "next_text", "edited", "value"]


def words(seed: int, number: int) -> list[str]:
    import random

    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(number)]


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """Ids, texts and sources: nulls, empty, blank, short, very long, copies, near copies."""
    base = words(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    rows: list[tuple[int | None, str | None, str | None]] = [
        (0, " ".join(base), "a"),
        (1, " ".join(base), "a"),
        (2, " ".join(near), "b"),
        (3, None, "b"),
        (4, "", "é"),
        (5, " \t\n", None),
        (6, "one", "a"),
        (7, "one two three", "a"),
        (8, "ß 漢字 🙂 " * 40, "c"),
        (9, " ".join(words(2, 30_000)), "c"),
        (10, "x" * 50_000, "b"),
        (None, " ".join(base), "a"),
        (None, "only here and without any id at all", None),
        (11, 'token = "abcdef123456" and AKIA' + "A1" * 9 + " " + "0a" * 20, "a"),
        (11, 'token = "abcdef123456" and AKIA' + "A1" * 9 + " " + "0a" * 20, "a"),
        (12, "secret=token: abcdefgh password: x", "a"),
    ]
    rows += [(100 + k, " ".join(words(10 + k, 40 + 10 * k)), "abc"[k % 3]) for k in range(24)]
    return rows


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    clash = {name: "clash" for name in CLASHING}
    rows = [
        {"doc_id": i, "text": t, "source": s, "lang": None, "n_chars": len(t or ""), **clash} for i, t, s in texts()
    ]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(
        f"{name} string" for name in CLASHING
    )
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def tables(spark: SparkSession, docs: DataFrame, tmp_path_factory) -> str:
    """A folder with the awkward documents, and labels, conversations and vectors like them."""
    folder = tmp_path_factory.mktemp("awkward")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, k % 2, int(k % 5 == 0), "x") for k in range(200)] + [(0, None, None, "x"), (None, 1, 1, "x"), (7, 3, 9, "x"), (1, 0, 0, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    turns = [
        (1, 0, "user", "hello \\ there <|im_end|>", "x"),
        (1, 1, "assistant", "</s>\\[INST]\\\\ [/INST] \n é🙂", "x"),
        (1, 1, "assistant", "</s>\\[INST]\\\\ [/INST] \n é🙂", "x"),
        (1, None, None, None, "x"),
        (2, 0, "assistant", "", "x"),
        (None, 0, "as<|im_sep|>sistant\n", "<<SYS>> a <</SYS>> <", "x"),
        (3, 5, "assistant", "x" * 100_000, "x"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, all string").write.parquet(
        f"{folder}/conversations.parquet"
    )
    import random

    draw = random.Random(5)
    vectors: list = [(k, [draw.gauss(0, 1) * (1 + k % 3) for _ in range(6)], 0) for k in range(300)]
    vectors += [(300 + k, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0], 0) for k in range(80)]  # copies
    vectors += [(400 + k, [float(k % 2), 1.0, 0.0, 0.0, 0.0, 0.0], 0) for k in range(40)]  # ties
    vectors += [(500, None, 0), (520, [0.0] * 6, 0), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (560, [float("nan")] + [1.0] * 5, 0)]
    vectors += [(580, [float("inf")] + [1.0] * 5, 0), (600, [1.0, 2.0], 0), (None, [1.0] * 6, 0), (0, vectors[0][1], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    pages = [(1, "u", "<article><p>Some text of a page.</p></article>", "x"), (1, "u", None, "x"), (None, None, "", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def nothing(spark: SparkSession, tables: str, tmp_path_factory) -> str:
    """The same tables without rows."""
    folder = tmp_path_factory.mktemp("nothing")
    for path in Path(tables).glob("*.parquet"):
        spark.read.parquet(str(path)).limit(0).write.parquet(f"{folder}/{path.name}")
    return str(folder)
