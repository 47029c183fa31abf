"""The bucketed store and the index of vectors."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import index
from millrace.operators.chunks import upsert
from millrace.operators.index import build_index, open_index, recall, search_index
from millrace.operators.search import top_k_join
from millrace.operators.store import read_store, store_buckets, upsert_store
from millrace.sources.readers import SourceError


def files(store):
    return {str(p.relative_to(store)): os.stat(p).st_mtime_ns for p in Path(store).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(k, f"v{k}", 1) for k in range(200)] + [(None, "none", 1)]
    first = spark.createDataFrame(rows, "`the.id` long, value string, version int")
    assert store_buckets(spark, store) is None
    with pytest.raises(SourceError):
        read_store(spark, store)
    assert len(upsert_store(first, store, "the.id", "version", buckets=32)) == 32
    before = files(store)
    # The key is narrower here, and the order of the columns another.
    batch = spark.createDataFrame([(2, 7, "new"), (2, 7, "new"), (2, 1000, "more")], "version int, `the.id` int, value string")
    touched = upsert_store(batch, store, "the.id", "version")
    after = files(store)
    assert 1 <= len(touched) <= 2 and store_buckets(spark, store) == 32
    changed = {n.split("__bucket=")[1].split("/")[0] for n in before.keys() ^ after.keys()}
    assert changed == set(map(str, touched))
    assert all(before[n] == after[n] for n in before.keys() & after.keys())
    found = {r["the.id"]: r["value"] for r in read_store(spark, store).collect()}
    assert found == {k: f"v{k}" for k in range(200)} | {None: "none", 7: "new", 1000: "more"}
    # The same batch again, an older one, and none change nothing.
    old = batch.withColumn("version", F.lit(0)).withColumn("value", F.lit("old"))
    for again in (batch, old):
        upsert_store(again, store, "the.id", "version")
    assert upsert_store(batch.limit(0), store, "the.id", "version") == []
    assert {r["the.id"]: r["value"] for r in read_store(spark, store).collect()} == found
    with pytest.raises(ValueError, match="columns"):
        upsert_store(batch.drop("value"), store, "the.id", "version")


def test_upsert_of_dotted_names(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "`a.key` int, `a value` string, `v.n` int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "`a.key` int, `a value` string, `v.n` int")
    assert sorted(map(tuple, upsert(old, new, "a.key", "v.n").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]


@pytest.fixture
def vectors(spark):
    draw = np.random.default_rng(5)
    middle = draw.normal(size=(12, 8))
    rows = [(k, (middle[k % 12] + 0.3 * draw.normal(size=8)).tolist()) for k in range(900)]
    rows += [(k, rows[0][1]) for k in range(900, 1350)]  # a third of all are equal
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] * 4), (2004, [1.0] * 3), (5, rows[5][1])]
    return spark.createDataFrame(rows, "`vec.id` long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("shard,block", [(16_384, 4096), (50, 30)])
def test_index_finds_nearly_all(spark, vectors, tmp_path, shard, block):
    made = build_index(vectors, str(tmp_path / "i"), "vec.id", centroids=16)
    asked = vectors.filter("`vec.id` % 7 = 0").select(F.col("`vec.id`").alias("query_id"), "embedding")
    found = search_index(open_index(spark, made.path, "vec.id"), asked, 10, probes=8, shard=shard, block=block)
    plain = vectors.withColumnRenamed("vec.id", "id").distinct()
    usable = plain.filter("size(embedding) = 8 AND id NOT IN (2003)")
    exact = top_k_join(asked.filter("query_id < 2000"), usable, 10)
    done = recall(found.withColumnRenamed("vec.id", "id"), exact).first()
    assert done.queries == asked.filter("query_id < 2000").count() and done.hits == 10 * done.queries
    assert done.recall >= 0.95
    rows = found.collect()
    assert not {r["vec.id"] for r in rows} & set(range(2000, 2005))
    # All cells: exactly the exact search, ties included.
    whole = search_index(made, asked, 10, probes=16, shard=shard, block=block).collect()
    wanted = {(r.query_id, r["rank"]): r.id for r in exact.collect()}
    assert {(r.query_id, r["rank"]): r["vec.id"] for r in whole} == wanted


def test_vectors_are_shuffled_once(spark, vectors, tmp_path):
    made = build_index(vectors, str(tmp_path / "i"), "vec.id", centroids=4)
    asked = vectors.select(F.col("`vec.id`").alias("query_id"), "embedding")
    plan = search_index(made, asked, 3, shard=100)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FlatMapCoGroupsInArrow") :]
    own = side[: side.index("Scan parquet")] if "Scan parquet" in side else side
    assert own.count("Exchange hashpartitioning") == 1


def test_a_query_goes_to_a_shard_once(spark, vectors, tmp_path, monkeypatch):
    """Queries are not copied for each of the cells they look into."""

    def groups(k):
        # One hit for each group that a query is in, named by a key that only this group has.
        def each(rows, asked):
            if not len(rows) or not len(asked):
                return pa.table({"query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            return pa.table({"query_id": asked.column("query_id"), "key": [min(rows.column("key").to_pylist())] * len(asked), "score": [1.0] * len(asked)})

        return each

    made = build_index(vectors, str(tmp_path / "i"), "vec.id", centroids=40)
    asked = vectors.filter("`vec.id` < 300").select(F.col("`vec.id`").alias("query_id"), "embedding")
    monkeypatch.setattr(index, "_best", groups)
    copies = [r["count"] for r in search_index(made, asked, 1000, probes=30).groupBy("query_id").count().collect()]
    assert len(copies) == 300 and max(copies) <= 8


@pytest.mark.parametrize("shard,block", [(None, None), (40, 25)])
def test_index_counts_keys_once_over_cells(spark, tmp_path, shard, block):
    draw = np.random.default_rng(9)
    rows = [(k % 150 if k % 50 else None, draw.normal(size=6).tolist()) for k in range(450)]
    rows += [(7, draw.normal(size=6).tolist()) for _ in range(100)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    made = build_index(table, str(tmp_path / "i"), "id", centroids=12)
    asked = [(q, draw.normal(size=6).tolist()) for q in range(60)] + [(0, draw.normal(size=6).tolist())]
    found = search_index(made, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 4, 12, shard=shard, block=block)
    got = {(r.query_id, r["rank"]): (r.id, round(r.score, 8)) for r in found.collect()}
    best = {}
    for q, a in asked:
        for key, v in rows:
            score = round(float(np.dot(a, v) / np.linalg.norm(a) / np.linalg.norm(v)), 9)
            best[q, key] = max(best.get((q, key), -2.0), score)
    for q in range(60):
        of = sorted((-s, -1 if key is None else key) for (asker, key), s in best.items() if asker == q)[:4]
        assert [got[q, n] for n in range(1, 5)] == [(None if key < 0 else key, round(-s, 8)) for s, key in of]


def test_cells_are_put_together_to_shards():
    assert index._dealt_cells({0: 5, 1: 5, 2: 25, 3: 3, 4: 8, 5: 2}, 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 5, 1), (5, 5, 1)]


def test_index_of_nothing(spark, vectors, tmp_path):
    made = build_index(vectors.limit(0), str(tmp_path / "i"), "vec.id")
    asked = vectors.select(F.col("`vec.id`").alias("query_id"), "embedding")
    assert search_index(made, asked, 3).count() == 0
    one = build_index(vectors.filter("`vec.id` = 1"), str(tmp_path / "j"), "vec.id")
    assert search_index(one, asked.filter("query_id = 3"), 3).collect()[0]["vec.id"] == 1
    assert search_index(one, asked.limit(0), 3).count() == 0
