"""Approximate top-k over a table of vectors by an index of coarse cells.

Unlike ``search.top_k_join``, which compares all pairs, an index first puts every vector into the
cell of its nearest centroid, and a search looks only into the cells nearest to each query. What
it misses is told by ``recall`` against the exact search; ``probes`` trades it for time.

The centroids come from spherical k-means on a bounded sample, the vectors of least hash. The index
is a table: ``cells`` holds every vector with its cell, next to its centroids. For a search the cells are
put together to shards of bounded size, a larger cell is dealt into shards by the hash of the key, and
queries go in blocks to the shards that hold a cell of theirs, once whatever the number of these cells:
a task holds one shard and one block and compares each cell with the queries that look into it.

Defined cases: vectors that are null, zero, of another length than the first centroid, or hold null,
NaN or infinite components are in no cell and in no result, and such queries get no hits; equal
scores go to the smaller key; an empty table gives an index without cells; repeated rows of a key
count as one hit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.fixed import DEFAULT_TOP_K
from millrace.functions.types import quoted, type_of
from millrace.functions.vectors import matrix
from millrace.operators.search import Best

#: Vectors that the centroids are fitted on, and centroids, at the most.
SAMPLE = 65_536
CENTROIDS = 4096
#: Queries that are compared with the centroids at once.
BLOCK = 4096
#: Bytes of the vectors of a shard, and of the queries of a block, as doubles. Tables that are not that
#: large are dealt into WAYS shards and blocks, unless these had fewer than LEAST rows.
SIDE_BYTES = 32 * 1024 * 1024
WAYS = 8
LEAST = 1024


@dataclass(frozen=True)
class Index:
    """Cells and their sizes on a path; the name of the key, and the centroids as unit rows."""

    path: str
    key: str
    centroids: np.ndarray

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def _usable(vector: Column, length: int | None = None) -> Column:
    """True for vectors with a direction; they are taken as doubles."""
    values = vector.cast("array<double>")
    norm = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
    # Null parts make the norm null; NaN and infinity make it no finite number.
    good = norm.isNotNull() & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm)
    if length is not None:
        good = good & (F.size(vector) == length)
    return F.coalesce(good, F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _nearest_of(vectors: pd.Series, centroids: np.ndarray, number: int) -> Iterator[np.ndarray]:
    """The cells of the ``number`` nearest centroids, for ``BLOCK`` vectors at a time."""
    for first in range(0, len(vectors), BLOCK):
        near = _unit(_rows(vectors.iloc[first : first + BLOCK])) @ centroids.T
        yield np.argsort(-near, axis=1, kind="stable")[:, :number].astype(np.int32)


def _nearest(vector: Column, centroids: np.ndarray) -> Column:
    """The cell of the nearest centroid; ``centroids`` go along with the function."""

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [near[:, 0] for near in _nearest_of(batch, centroids, 1)]
            yield pd.Series(np.concatenate(found or [np.zeros(0, np.int32)]), index=batch.index)

    return cell(vector)


def _routes(vector: Column, centroids: np.ndarray, number: int, held: np.ndarray) -> Column:
    """The cells of the ``number`` nearest centroids as bits, and the shards that hold one of them.

    ``held`` says of each cell (row) and each shard whether it holds rows of the cell.
    """

    @F.pandas_udf("shards array<int>, cells binary")
    def routes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shards: list[np.ndarray] = []
            cells: list[bytes] = []
            for near in _nearest_of(batch, centroids, number):
                looked = np.zeros((len(near), len(centroids)), bool)
                np.put_along_axis(looked, near, True, axis=1)
                shards += [np.flatnonzero(row).astype(np.int32) for row in looked.astype(np.float32) @ held > 0]
                cells += [row.tobytes() for row in np.packbits(looked, axis=1)]
            yield pd.DataFrame({"shards": pd.Series(shards, dtype=object), "cells": pd.Series(cells, dtype=object)})

    return routes(vector)


def _dealt_cells(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """Cell, its first shard and its number of shards, of about ``most`` rows each.

    Small cells share a shard; those with more rows than ``most`` have shards of their own.
    """
    dealt, shard, room = [], 0, 0
    for cell, rows in sorted(sizes.items()):
        number = -(-rows // most)
        if number > 1:
            dealt.append((cell, shard, number))
            shard, room = shard + number, 0
            continue
        if rows > room:
            shard, room = shard + 1, most
        dealt.append((cell, shard - 1, 1))
        room -= rows
    return dealt


def build_index(
    vectors: DataFrame,
    path: str,
    key: str = "id",
    vector: str = "embedding",
    centroids: int | None = None,
    sample: int = SAMPLE,
    seed: int = 0,
) -> Index:
    """Write the index of a table of vectors below ``path``; no vector is shuffled.

    By default there are as many centroids as the root of the number of sampled vectors.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(quoted(key)).alias("key"), F.col(quoted(vector)).alias("vector"))
    usable = named.filter(_usable(F.col("vector")))
    drawn = usable.orderBy(F.xxhash64("key", "vector"), "key").limit(sample)
    first = drawn.select(F.size("vector").alias("n")).first()
    if first is None:
        rows = np.zeros((0, 0))
        cells = usable.withColumn("cell", F.lit(None).cast("int"))
    else:
        length = first["n"]
        drawn = drawn.filter(F.size("vector") == length)
        drawn = drawn.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")).cache()
        number = min(centroids or math.isqrt(drawn.count()), CENTROIDS)
        if number > 1:
            model = KMeans(k=number, distanceMeasure="cosine", seed=seed, maxIter=10).fit(drawn)
            rows = _unit(np.array(model.clusterCenters()))
        else:
            rows = _unit(np.array([drawn.first()["features"].toArray()]))
        drawn.unpersist()
        usable = usable.filter(F.size("vector") == length)
        cells = usable.withColumn("cell", _nearest(F.col("vector"), rows))
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    saved = [(k, row.tolist()) for k, row in enumerate(rows)]
    spark.createDataFrame(saved, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return Index(path, key, rows)


def open_index(spark: SparkSession, path: str, key: str = "id") -> Index:
    """An index that was built before. Collects its centroids: at most ``CENTROIDS`` rows."""
    saved = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return Index(path, key, np.array([r["centroid"] for r in saved]).reshape(len(saved), -1))


def search_index(
    index: Index,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    probes: int | None = None,
    query_key: str = "query_id",
    vector: str = "embedding",
    shard: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """The ``k`` most similar vectors of every query in its nearest cells: key of the query, key,
    ``score``, ``rank``. ``probes`` cells are searched. By default these are three quarters of all,
    which even vectors without clusters need for a recall of 0.95; give far fewer where there are some.
    ``shard`` and ``block`` are the rows and the queries that a task holds, by default SIDE_BYTES of them.

    Sizes of cells, a row for each, and the number of queries are collected. Vectors are shuffled once
    for each block of queries, queries once for each shard that they look into, and a task passes on its
    best ``k`` for each query: there are WAYS shards and blocks until those are full.
    """
    spark = queries.sparkSession
    known = index.cells(spark)
    key_type, query_type = (type_of(d, c).simpleString() for d, c in ((known, "key"), (queries, query_key)))
    schema = f"query_id {query_type}, key {key_type}, score double"
    asked = queries.select(F.col(quoted(query_key)).alias("query_id"), F.col(quoted(vector)).alias("query"))
    asked = asked.filter(_usable(F.col("query"), index.centroids.shape[1])).dropDuplicates(["query_id", "query"])
    number = min(len(index.centroids), probes or -(-3 * len(index.centroids) // 4))
    if not number:
        found = spark.createDataFrame([], schema)
    else:
        most = max(1, SIDE_BYTES // (8 * index.centroids.shape[1]))

        def held(rows: int, given: int | None) -> int:
            return given or min(most, max(LEAST, -(-rows // WAYS)))

        sizes = {r["cell"]: r["count"] for r in known.groupBy("cell").count().collect()}
        cells = _dealt_cells(sizes, held(sum(sizes.values()), shard))
        rows = asked.count()
        blocks = max(1, -(-rows // held(rows, block)))
        shards = np.zeros((len(index.centroids), max(first + n for _, first, n in cells)), np.float32)
        for cell, first, n in cells:
            shards[cell, first : first + n] = 1
        # A row for each cell, CENTROIDS at the most.
        near = F.broadcast(spark.createDataFrame(cells, "cell int, first int, shards int"))
        place = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("shards"))).cast("int").alias("shard")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        left = known.join(near, "cell").select("key", "vector", "cell", place, every)
        routed = asked.withColumn("route", _routes(F.col("query"), index.centroids, number, shards))
        own = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        right = routed.select("query_id", "query", F.col("route.cells").alias("cells"), own, F.explode("route.shards").alias("shard"))
        group = ("shard", "block")
        scored = left.groupBy(*group).cogroup(right.groupBy(*group))
        found = scored.applyInArrow(_best(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    # A vector is in one cell, so a key comes again only where rows repeat it. One shuffle serves both steps.
    once = found.repartition("query_id").groupBy("query_id", "key").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_key), F.col("key").alias(index.key), "score", "rank")


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``k`` keys of a shard for each query of a block, in the cells that it looks into."""

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        keys, ids = vectors.column("key"), queries.column("query_id")
        if not len(keys) or not len(ids):
            return pa.table({"query_id": ids.slice(0, 0), "key": keys.slice(0, 0), "score": pa.array([], pa.float64())})
        order = pc.sort_indices(keys)
        keys = keys.take(order)
        rows = _unit(matrix(vectors.column("vector").take(order).combine_chunks()))
        asked = _unit(matrix(queries.column("query").combine_chunks()))
        # Rows of a key have the place of the first of them. They may fill places among the best.
        codes = keys.combine_chunks().dictionary_encode("encode").indices.to_numpy()
        first = np.unique(codes, return_index=True)[1]
        places, times = first[codes], np.bincount(codes)
        width = min(k * int(times.max()), k + len(rows) - len(times))
        found = Best(asked, k, once=width > k)
        for at, who in _pieces(vectors, queries, order):
            if who is None or len(who):
                found.add(places[at], rows[at], who, width)
        found = found.found()
        return pa.table(
            {
                "query_id": ids.take(pa.array(found["query"])),
                "key": keys.take(pa.array(found["id"])),
                "score": pa.array(found["score"]),
            }
        )

    return best


def _pieces(
    vectors: pa.Table, queries: pa.Table, order: pa.Array
) -> Iterator[tuple[np.ndarray | slice, np.ndarray | None]]:
    """Places of the rows of each cell, in this order, and of the queries that look into it.

    Tables without cells are one piece with all queries.
    """
    if "cell" not in vectors.column_names:
        yield slice(None), None
        return
    cells = vectors.column("cell").take(order).to_numpy()
    looked = np.frombuffer(b"".join(queries.column("cells").to_pylist()), np.uint8).reshape(len(queries), -1)
    by_cell = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(cells[by_cell]) != 0])
    for at in np.split(by_cell, starts[1:]):
        cell = int(cells[at[0]])
        yield at, np.flatnonzero(looked[:, cell >> 3] >> (7 - (cell & 7)) & 1)


def recall(found: DataFrame, exact: DataFrame, key: str = "id", query_key: str = "query_id") -> DataFrame:
    """One row: ``queries`` and ``hits`` of the exact search, and the share of them found, ``recall``."""
    held = found.select(F.col(query_key), F.col(key), F.lit(1).alias("__held")).distinct()
    return exact.join(held, [query_key, key], "left").agg(
        F.countDistinct(query_key).alias("queries"),
        F.count(F.lit(1)).alias("hits"),
        F.coalesce(F.try_divide(F.count("__held"), F.count(F.lit(1))), F.lit(1.0)).alias("recall"),
    )
