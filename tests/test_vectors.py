from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.text import identifiers
from millrace.functions.vectors import norm
from millrace.operators import chunks as ch
from millrace.operators import index, search
from millrace.operators.search import check_dimension, top_k, top_k_join

TEXTS = [
    "",
    None,
    "   \n\t ",
    "one",
    " lead and trail ",
    "no break em　wide\x1csep\x85next",
    " ".join(f"w{i}" for i in range(1200)),
    "​zero width stays",
]


def test_chunks_equal_python_splitting(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {(r.id, r.position): r.chunk for r in ch.chunk_text(df, "text").collect()}
    wanted = {
        (i, n): " ".join(words[n * 500 : n * 500 + 500])
        for i, text in enumerate(TEXTS)
        for words in [(text or "").split()]
        for n in range(math.ceil(len(words) / 500))
    }
    assert got == wanted


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20), st.integers(1, 5))
def test_chunks_of_any_text(spark, texts, size):
    clean = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame(list(enumerate(clean)), "id int, text string")
    got = {(r.id, r.position): r.chunk for r in ch.chunk_text(df, "text", size).collect()}
    wanted = {
        (i, n): " ".join(words[n * size : (n + 1) * size])
        for i, text in enumerate(clean)
        for words in [text.split()]
        for n in range(math.ceil(len(words) / size))
    }
    assert got == wanted


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("join A on SK_ID_CURR with an ETL", ["A", "SK_ID_CURR", "ETL"]),
        ("SK_ID_CURR2 lower Mixed", []),
        ("ÉTUDE xÉ", []),
        ("A_B,C_D.(E)", ["A_B", "C_D", "E"]),
        ("", []),
    ],
)
def test_identifiers(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(identifiers(F.col("t")).alias("x")).first().x == tokens


def test_chunk_ids_depend_on_text_and_metadata(spark):
    rows = [
        (1, "same text", {"a": "1", "b": "2"}),
        (2, "same text", {"b": "2", "a": "1"}),
        (3, "same text", {"a": "1"}),
        (4, "other text", {"a": "1"}),
    ]
    df = spark.createDataFrame(rows, "id int, text string, meta map<string,string>")
    ids = {r.id: r.chunk_id for r in ch.with_chunk_ids(df, "text", "meta").collect()}
    assert ids[1] == ids[2]
    assert len({ids[1], ids[3], ids[4]}) == 3
    assert all(i.endswith("-0") for i in ids.values())


def test_metadata_of_the_caller_wins(spark):
    rows = [("chunk", {"text": "own", "x": "1"}), ("chunk", {"x": "1"})]
    df = spark.createDataFrame(rows, "chunk string, meta map<string,string>")
    merged = [r.meta for r in ch.merge_metadata(df, "meta", "chunk").collect()]
    assert merged == [{"text": "own", "x": "1"}, {"text": "chunk", "x": "1"}]


def test_upsert(spark):
    schema = "id int, version int, value string"
    stored = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema)
    new = spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (3, 1, "e")], schema)
    once = ch.upsert(stored, new, "id", "version")
    wanted = {(1, 1, "a"), (2, 3, "d"), (3, 1, "e")}
    assert {tuple(r) for r in once.collect()} == wanted
    twice = ch.upsert(once, new, "id", "version")
    assert Counter(map(tuple, twice.collect())) == Counter(wanted)


def test_embed_checks_the_shape(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    good = ch.embed(df, "t", lambda texts: [[len(t), 1.0] for t in texts], length=2)
    assert sorted(r.embedding for r in good.collect()) == [[0.0, 1.0], [2.0, 1.0]]
    bad = ch.embed(df, "t", lambda texts: [[1.0] for _ in texts], length=2)
    with pytest.raises(Exception, match="expected"):
        bad.collect()


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, "Red red blue"), (2, "blue RED red"), (3, "")], "i int, t string")
    got = ch.embed_hashed(df, "t").withColumn("norm", norm(F.col("embedding")))
    rows = {r.i: r for r in got.collect()}
    assert rows[1].embedding == rows[2].embedding
    assert len(rows[1].embedding) == 768
    assert rows[1].norm == pytest.approx(1.0, abs=1e-6)
    assert rows[3].norm == 0.0


def brute(queries, vectors, k):
    found = set()
    for qid, q in queries:
        scored = []
        for vid, v in vectors:
            size = np.linalg.norm(q) * np.linalg.norm(v)
            if size > 0:
                scored.append((-round(float(np.dot(q, v) / size), 9), vid))
        found |= {(qid, vid, -s + 0.0, n + 1) for n, (s, vid) in enumerate(sorted(scored)[:k])}
    return found


@pytest.fixture
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(60)]
    return [*rows, (500, [0.0] * 4)]


@pytest.mark.parametrize("text_keys", [False, True])
@pytest.mark.parametrize("settings_", [{}, {"query_bytes": 200, "slice_bytes": 2000}])
def test_top_k_join_equals_brute_force(spark, vectors, settings_, text_keys):
    key = (lambda i: f"{i:04d}") if text_keys else (lambda i: i)
    kind = "string" if text_keys else "bigint"
    stored = [(key(i), v) for i, v in vectors]
    asked = [(i, v) for i, v in vectors if i < 25] + [(777, [1.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(stored, f"id {kind}, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    got = top_k_join(queries, df, k=7, **settings_)
    assert {tuple(r) for r in got.collect()} == brute(asked, stored, 7)


def test_top_k_equals_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "id bigint, embedding array<double>").repartition(5)
    query = [1.0, 1.0, 0.0, 0.0]
    wanted = [(v, s) for _, v, s, _ in sorted(brute([(0, query)], vectors, 9), key=lambda r: r[3])]
    assert [(r.id, r.score) for r in top_k(df, query, 9).collect()] == wanted
    assert top_k(df, [0.0] * 4).collect() == []
    assert top_k(df, query, 1000).count() == sum(1 for _, v in vectors if any(v))


def test_top_k_filters_before_ranking(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], {"t": "a"}), (2, [0.0, 1.0], {"t": "b"}), (3, None, {"t": "b"})],
        "id int, embedding array<float>, metadata map<string,string>",
    )
    (row,) = top_k(df, [1.0, 0.1], k=5, where={"t": "b"}).collect()
    assert row.id == 2
    assert top_k(df, [1.0, 0.1], k=5, where={"id": 1}).first().id == 1


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id int, embedding array<float>")
    assert check_dimension(df, "embedding", 2).first().unexpected == 1
    with pytest.raises(Exception, match="length"):
        top_k(df.coalesce(1), [1.0, 0.0]).collect()


def test_no_queries(spark, vectors):
    df = spark.createDataFrame(vectors, "id bigint, embedding array<double>")
    none = spark.createDataFrame([], "query_id bigint, embedding array<double>")
    assert top_k_join(none, df).count() == 0


def test_blocks_of_queries_share_rounds(spark, vectors, monkeypatch):
    """Few jobs score many blocks; the driver's start-up for each would be most of the time."""
    stored = spark.createDataFrame(vectors, "id bigint, embedding array<double>").repartition(3)
    asked = stored.withColumnRenamed("id", "query_id")
    rounds = []
    ranked = search._ranked

    def spied(found, k):
        rounds.append(found)
        return ranked(found, k)

    monkeypatch.setattr(search, "_ranked", spied)
    got = top_k_join(asked, stored, k=7, query_bytes=2_000)
    assert {tuple(r) for r in got.collect()} == brute([v for v in vectors if any(v[1])], vectors, 7)
    blocks = sum((16 + 2 * 7 * 8 + 4 * 8) for _ in vectors) // 2_000
    assert blocks > 10 and len(rounds) <= 2  # and the last one over all hits


def test_blocks_of_a_round_are_scored_in_few_sets(spark, vectors, monkeypatch):
    """Tasks read the vectors once for a set of blocks, not once for each block."""
    stored = spark.createDataFrame(vectors, "id bigint, embedding array<double>").repartition(3)
    sets = []
    score = search._score_block

    def spied(block, *args):
        sets.append(len(block.value[0]))
        return score(block, *args)

    monkeypatch.setattr(search, "_score_block", spied)
    got = top_k_join(stored.withColumnRenamed("id", "query_id"), stored, k=3, query_bytes=1_000)
    assert {tuple(r) for r in got.collect()} == brute([v for v in vectors if any(v[1])], vectors, 3)
    assert 1 < len(sets) <= 8 and sum(sets) == sum(any(v) for _, v in vectors)


def test_scores_that_single_precision_cannot_tell_apart():
    draw = np.random.default_rng(8)
    middle = draw.normal(size=64)
    rows = np.array([middle + 1e-4 * draw.normal(size=64) for _ in range(600)] + list(draw.normal(size=(600, 64))))
    rows, asked = rows[draw.permutation(1200)], rows[::60]
    tables = [pa.table({"id": np.arange(n, n + 50), "vector": pa.array(list(rows[n : n + 50]))}) for n in range(0, 1200, 50)]
    unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    got = search._best_of(iter(tables), np.arange(len(asked)), unit, 5, True)
    wanted = brute(list(enumerate(asked)), list(enumerate(rows)), 5)
    assert {(r.query_id, r.id, round(r.score, 8)) for r in got.itertuples()} == {(q, i, round(s, 8)) for q, i, s, _ in wanted}


@pytest.mark.parametrize("equal", [1, 40])
def test_later_batches_add_only_what_can_be_best(equal):
    draw = np.random.default_rng(5)
    rows = np.repeat(draw.normal(size=(2000 // equal, 8)), equal, axis=0)[draw.permutation(2000)]
    asked, k, seen = draw.normal(size=(30, 8)), 5, []
    each = search._best_in_batch

    def spied(*args):
        found = list(each(*args))
        seen.append(sum(map(len, found)))
        return found

    tables = [
        pa.table({"id": np.arange(at, at + 100), "vector": pa.array(list(rows[at : at + 100]))}) for at in range(0, 2000, 100)
    ]
    search._best_in_batch, unit = spied, asked / np.linalg.norm(asked, axis=1, keepdims=True)
    try:
        got = search._best_of(iter(tables), np.arange(30), unit, k, True)
    finally:
        search._best_in_batch = each
    wanted = brute(list(enumerate(asked)), list(enumerate(rows)), k)
    assert {(r.query_id, r.id, r.score + 0.0) for r in got.itertuples()} == {w[:3] for w in wanted}
    # Each batch passed on the best five of every query before.
    assert max(seen[15:]) < 30 * k


def test_indexed_search_ranks_only_near_scores(monkeypatch):
    """A shard is not sorted for each query, and equal scores and repeated keys keep their places."""
    draw = np.random.default_rng(6)
    keys, rows = np.arange(400) // 2, draw.integers(-2, 3, (400, 4)) + 0.5
    asked = draw.normal(size=(20, 4))
    sizes = []
    sort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: (sizes.append(np.size(a)), sort(a, *x, **y))[1])
    got = index._best(3)(
        pa.table({"key": keys, "vector": pa.array(list(rows))}), pa.table({"query_id": np.arange(20), "query": pa.array(list(asked))})
    ).to_pandas()
    assert max(sizes, default=0) < 20 * 400
    best = got.groupby(["query_id", "key"], as_index=False)["score"].max()
    best = best.sort_values(["query_id", "score", "key"], ascending=[True, False, True]).groupby("query_id").head(3)
    scores = np.round(asked @ rows.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(rows, axis=1), 9)
    for q in range(20):
        each = {}
        for key, score in zip(keys, scores[q], strict=True):
            each[int(key)] = max(each.get(int(key), -2.0), float(score))
        wanted = sorted(each.items(), key=lambda x: (-x[1], x[0]))[:3]
        own = best[best["query_id"] == q]
        assert list(own["key"]) == [key for key, _ in wanted]
        assert np.allclose(own["score"], [s for _, s in wanted], atol=1e-8)


def test_embed_turns_few_texts_into_strings_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ch, "TEXT_BYTES", 1000, raising=False)
    least = ch.TEXT_BYTES

    def encode(texts):
        if sum(map(len, texts)) > least + 100:
            raise ValueError("too many texts at once")
        return [[len(t)] for t in texts]

    df = spark.range(500).selectExpr("id", "IF(id % 9 = 0, NULL, repeat('x', CAST(id % 100 AS INT))) AS t").coalesce(1)
    got = {r.id: r.embedding for r in ch.embed(df, "t", encode, length=1).collect()}
    assert got == {k: [0.0 if k % 9 == 0 else float(k % 100)] for k in range(500)}
