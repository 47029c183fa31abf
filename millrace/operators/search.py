"""Cosine top-k over a table of vectors: one query, filtered, or a whole table of queries."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.fixed import DEFAULT_TOP_K, EMBEDDING_LENGTH
from millrace.functions.types import in_family, type_of
from millrace.functions.vectors import SCORE_PLACES, cosine_to, matrix
from millrace.operators.checks import Suite, validate, vector_length
from millrace.operators.chunks import embed, embed_hashed
from millrace.sources.scratch import new_path, stage_table

# Queries whose vectors and best hits take up to this many bytes are broadcast at once; larger
# sets are dealt into blocks of that size.
QUERY_BYTES = 32 * 1024 * 1024
# Bytes of vectors, as doubles, that a task multiplies at a time.
SLICE_BYTES = 64 * 1024 * 1024
# Cells of a score matrix that a task holds at a time.
_SCORE_CELLS = 4_000_000
# Sets that the blocks of a round are dealt to, each scored by tasks of its own.
ROUND_SETS = 8
# Products of vectors that a task makes at a time when it scores single pairs.
_PAIR_CELLS = 2_000_000


def check_dimension(df: DataFrame, column: str, length: int = EMBEDDING_LENGTH) -> DataFrame:
    """Result row of the check that all vectors have the declared length."""
    return validate(df, Suite("vectors", [vector_length(column, length)]))


def matching(df: DataFrame, where: Mapping[str, object], metadata: str = "metadata") -> DataFrame:
    """Rows equal to every given value, by column or else by metadata key."""
    for name, value in where.items():
        found = F.col(name) if name in df.columns else F.col(metadata)[name]
        df = df.filter(found == value)
    return df


def top_k(
    vectors: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_TOP_K,
    key: str = "id",
    vector: str = "embedding",
    where: Mapping[str, object] | None = None,
) -> DataFrame:
    """The ``k`` rows most similar to one query vector, with all their columns and ``score``.

    Ties go to the smallest key. Only the vectors go through the Arrow function, and each
    task keeps its own best ``k``, so nothing but those rows leaves a partition. ``where``
    filters before ranking.
    """
    candidates = matching(vectors, where) if where else vectors
    return (
        candidates.withColumn("score", cosine_to(query, F.col(vector)))
        .orderBy(F.desc_nulls_last("score"), F.asc(key))
        .limit(k)
        .filter(F.col("score").isNotNull())
    )


def search_text(
    records: DataFrame,
    text: str,
    k: int = DEFAULT_TOP_K,
    encode: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    length: int = EMBEDDING_LENGTH,
    where: Mapping[str, object] | None = None,
) -> DataFrame:
    """The ``k`` records nearest to a text, embedded the way the records were."""
    asked = records.sparkSession.createDataFrame([(text,)], "text string")
    embedded = embed(asked, "text", encode, length) if encode else embed_hashed(asked, "text", length)
    return top_k(records, embedded.first()["embedding"], k, where=where)


def top_k_join(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = DEFAULT_TOP_K,
    query_key: str = "query_id",
    key: str = "id",
    vector: str = "embedding",
    query_vector: str | None = None,
    query_bytes: int = QUERY_BYTES,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The ``k`` most similar vectors of every query: query key, key, ``score``, ``rank``.

    Exact. Pairs are scored as matrix products inside tasks, ``slice_bytes`` of vectors at a
    time, and a task emits its best ``k`` for each query instead of all pairs. The queries are
    broadcast, so the vectors are never shuffled. Queries, keys and best hits are measured
    first: up to ``query_bytes`` they are one block; a larger set is dealt into blocks of about
    that size. A round is a job over as many blocks as stay within QUERY_BYTES together and writes
    their best hits: the blocks go to ROUND_SETS sets at the most, each broadcast and read against
    the staged vectors by tasks of its own. Rounds run when this is called.
    """
    query_vector = query_vector or vector
    asked = queries.select(
        F.col(query_key).alias("query_id"), F.col(query_vector).alias("query_vector")
    ).filter(F.col("query_vector").isNotNull())
    stored = vectors.select(
        F.col(key).alias("id"), F.col(vector).alias("vector")
    ).filter(F.col("vector").isNotNull())
    query_type = type_of(asked, "query_id").simpleString()
    key_type = type_of(stored, "id").simpleString()
    schema = f"query_id {query_type}, id {key_type}, score double"

    spark = queries.sparkSession
    total = _bytes(asked, "query_id", "query_vector", 2 * k)
    numeric = in_family(type_of(stored, "id"), "integer")
    out = _arrow_schema(stored, asked)

    def scored(block: Broadcast, among: DataFrame) -> DataFrame:
        return _score_block(block, among, k, schema, out, numeric, slice_bytes)

    if total <= query_bytes:
        found = scored(_broadcast(spark, asked.toArrow()), stored)
    else:
        at_once = max(1, QUERY_BYTES // max(1, query_bytes))
        found = _score_rounds(asked, stored, k, math.ceil(total / query_bytes), at_once, schema, scored)
    return _ranked(found, k).select(
        F.col("query_id").alias(query_key),
        F.col("id").alias(key if key != query_key else f"{key}_found"),
        "score",
        "rank",
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _broadcast(spark: SparkSession, asked: pa.Table) -> Broadcast:
    return spark.sparkContext.broadcast(_unit_rows(asked, "query_vector"))


def _score_block(
    block: Broadcast,
    stored: DataFrame,
    k: int,
    schema: str,
    out: pa.Schema,
    numeric: bool,
    slice_bytes: int,
) -> DataFrame:
    """Local best ``k`` of every partition against a broadcast block of queries."""

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = block.value
        # Vectors of another length than the queries' are refused, so this is their width too.
        rows = max(1, slice_bytes // (8 * max(1, matrix.shape[1])))
        slices = (
            pa.Table.from_batches([batch.slice(at, rows)])
            for batch in batches
            for at in range(0, len(batch), rows)
        )
        kept = _best_of(slices, ids, matrix, k, numeric)
        yield from pa.Table.from_pandas(kept, schema=out, preserve_index=False).to_batches()

    return stored.mapInArrow(best, schema)


def _score_rounds(
    asked: DataFrame,
    stored: DataFrame,
    k: int,
    blocks: int,
    at_once: int,
    schema: str,
    scored: Callable[[Broadcast, DataFrame], DataFrame],
) -> DataFrame:
    """The best hits of every block of queries, ``at_once`` blocks scored in one round.

    The driver holds the blocks of one round at a time, and a task those of a set. Queries are dealt by their place, not their value, so
    that equal ones spread as well.
    """
    spark = asked.sparkSession
    dealt, found = new_path(spark, "query-blocks"), new_path(spark, "hits")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    asked.withColumn("block", place).repartition("block").write.partitionBy("block").parquet(dealt)
    queries = spark.read.schema(f"{_ddl(asked)}, block int").parquet(dealt)
    vectors = stage_table(stored, "vectors")
    for first in range(0, blocks, at_once):
        # A round's queries are read at once; jobs over single blocks would wait for their starts,
        # and tasks over single blocks would read the vectors once for each.
        held = queries.filter(F.col("block").between(first, first + at_once - 1)).toArrow()
        sets = held["block"].to_numpy() % ROUND_SETS
        given = [held.drop(["block"]).filter(pa.array(sets == n)) for n in range(ROUND_SETS)]
        given = [_broadcast(spark, block) for block in given if len(block)]
        scores = [scored(block, vectors) for block in given if len(block.value[0])]
        if scores:
            best = _ranked(functools.reduce(DataFrame.unionAll, scores), k).drop("rank")
            best.write.mode("append").parquet(found)
        for block in given:
            block.destroy()
    spark.createDataFrame([], schema).write.mode("append").parquet(found)
    return spark.read.schema(schema).parquet(found)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _bytes(df: DataFrame, key: str, vector: str, more: int = 0) -> int:
    """Bytes of the keys and of the vectors as doubles, with ``more`` values a row."""
    row = F.octet_length(F.col(key).cast("string")).cast("long") + (F.size(vector) + more) * 8
    return df.agg(F.sum(F.coalesce(row, F.lit(8 * more)))).first()[0] or 0


def _arrow_schema(stored: DataFrame, asked: DataFrame) -> pa.Schema:
    def arrow(df: DataFrame, column: str) -> pa.DataType:
        names = {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
        name = type_of(df, column).simpleString()
        return pa.int64() if name == "bigint" else names.get(name, pa.string())

    return pa.schema(
        [("query_id", arrow(asked, "query_id")), ("id", arrow(stored, "id")),
         ("score", pa.float64())]
    )


def _unit_rows(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys (first column) and the vectors scaled to length one.

    Vectors without a direction drop out: zero ones, and those with an infinity or a NaN.
    """
    keys = table.column(0).to_numpy(zero_copy_only=False)
    rows = matrix(table.column(column).combine_chunks())
    norms = np.linalg.norm(rows, axis=1) if len(rows) else np.zeros(0)
    usable = (norms > 0) & np.isfinite(norms)
    return keys[usable], rows[usable] / norms[usable, None]


def _best_of(
    tables: Iterable[pa.Table], query_ids: np.ndarray, queries: np.ndarray, k: int, numeric: bool
) -> pd.DataFrame:
    """Best ``k`` per query over a stream of vector batches, carried from batch to batch."""
    best = Best(queries, k, np.int64 if numeric else object)
    for table in tables:
        ids, rows = _unit_rows(table, "vector")
        if not len(ids) or not len(query_ids):
            continue
        if rows.shape[1] != queries.shape[1]:
            raise ValueError(f"queries have {queries.shape[1]} values, vectors {rows.shape[1]}")
        order = np.argsort(ids, kind="stable")
        best.add(ids[order], rows[order])
    kept = best.found()
    return pd.DataFrame(
        {
            "query_id": query_ids[kept["query"].to_numpy(np.int64)],
            "id": kept["id"].to_numpy(),
            "score": kept["score"].to_numpy(np.float64),
        }
    )


class Best:
    """Best ``k`` hits of every query, by its place, over batches of vectors.

    A query that has ``k`` hits takes only what can come before the last of them, so most of the later
    batches add little; what they add is merged when it has become as much as what is kept. With
    ``once`` an id is one hit, with its best score, however many rows it has.
    """

    def __init__(self, queries: np.ndarray, k: int, kind: type = np.int64, once: bool = False) -> None:
        self.queries, self.k, self.once = queries, k, once
        self._narrow = queries.astype(np.float32)
        self._least = np.full(len(queries), -np.inf)
        none = {"query": np.zeros(0, np.int64), "id": np.zeros(0, kind), "score": np.zeros(0)}
        self._kept, self._more = pd.DataFrame(none), []

    def add(
        self, ids: np.ndarray, rows: np.ndarray, at: np.ndarray | None = None, width: int | None = None
    ) -> None:
        """Score unit ``rows``, whose ``ids`` ascend, for the queries at these places or for all.

        ``width`` of the rows are ranked at first, where ``k`` of them may hold fewer ids.
        """
        given = (self.queries, self._least, self._narrow)
        queries, least, narrow = given if at is None else (x[at] for x in given)
        for found in _best_in_batch(ids, rows, queries, width or self.k, least, narrow):
            if at is not None:
                found["query"] = at[found["query"].to_numpy()]
            self._more.append(found)
        if sum(map(len, self._more)) > len(self._kept):
            kept = self.found()
            last = kept[kept.groupby("query").cumcount() == self.k - 1]
            self._least[last["query"].to_numpy(np.int64)] = last["score"].to_numpy()

    def found(self) -> pd.DataFrame:
        ranked = pd.concat([f for f in (self._kept, *self._more) if len(f)] or [self._kept], ignore_index=True)
        ranked = ranked.sort_values(["query", "score", "id"], ascending=[True, False, True])
        if self.once:
            ranked = ranked.drop_duplicates(["query", "id"])
        self._kept, self._more = ranked.groupby("query", sort=False).head(self.k), []
        return self._kept


def _best_in_batch(
    ids: np.ndarray,
    rows: np.ndarray,
    queries: np.ndarray,
    k: int,
    least: np.ndarray | None = None,
    narrow: np.ndarray | None = None,
) -> Iterator[pd.DataFrame]:
    """Best ``k`` of one batch for each query; ``ids`` ascend, so ties go to the left.

    Scores below ``least`` of the query are left out. All pairs are scored in single precision (the
    queries are ``narrow`` there), which costs half; those that can be among the best, by the bound on
    its error for unit vectors, are scored again in double precision, rounded and ranked. Where very
    many are that near, the whole rows of the matrix are.
    """
    step = max(1, _SCORE_CELLS // len(ids))
    k = min(k, len(ids))
    # Each side of a comparison is off by (values + 2) * 2 ** -24 at the most.
    slack = 2 * 10.0**-SCORE_PLACES + (rows.shape[1] + 8) * 2.0**-23
    narrow = queries.astype(np.float32) if narrow is None else narrow
    across = rows.astype(np.float32).T
    for start in range(0, len(queries), step):
        asked = queries[start : start + step]
        scores = narrow[start : start + step] @ across
        limit = np.full(len(scores), -np.inf) if least is None else least[start : start + step].copy()
        if (fresh := np.isneginf(limit)).any():
            limit[fresh] = np.partition(scores[fresh], len(ids) - k, axis=1)[:, len(ids) - k]
        limit = np.nextafter((limit - slack).astype(np.float32), np.float32(-np.inf))
        # Later in a stream few queries have any score that is near.
        own = np.flatnonzero(scores.max(axis=1) >= limit)
        if not len(own):
            continue
        near = scores[own] >= limit[own, None]
        if np.count_nonzero(near) <= 4 * k * len(own) + 1000:
            query, column = np.nonzero(near)
            query = own[query]
            score = np.round(_products(asked, query, rows, column), SCORE_PLACES)
            order = np.lexsort((column, -score, query))
            query, column, score = query[order], column[order], score[order]
            first = np.searchsorted(query, query, side="left")
            taken = np.arange(len(query)) - first < k
            if least is not None:
                taken &= score >= least[start + query]
            query, column, score = query[taken], column[taken], score[taken]
        else:
            scores = np.round(asked[own] @ rows.T, SCORE_PLACES)
            limit = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
            above = scores > limit
            level = scores == limit
            room = k - above.sum(axis=1, keepdims=True)
            taken = above | (level & (np.cumsum(level, axis=1) <= room))
            if least is not None:
                taken &= scores >= least[start + own, None]
            query, column = np.nonzero(taken)
            score = scores[query, column]
            query = own[query]
        if len(query):
            yield pd.DataFrame({"query": query + start, "id": ids[column], "score": score})


def _products(left: np.ndarray, at: np.ndarray, right: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The inner products of the pairs of rows ``left[at]`` and ``right[to]``."""
    run = max(1, _PAIR_CELLS // max(1, left.shape[1]))
    found = np.empty(len(at))
    for n in range(0, len(at), run):
        part = slice(n, n + run)
        found[part] = np.einsum("ij,ij->i", left[at[part]], right[to[part]])
    return found
