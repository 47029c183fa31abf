"""Text chunks, embeddings and vector search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.fixed import WHITESPACE
from millrace.functions.vectors import norm
from millrace.operators import chunks as ch
from millrace.operators import index as vector_index
from millrace.operators import store as store_operators
from millrace.operators.search import top_k, top_k_join
from millrace.queries.registry import query, table
from millrace.sources.scratch import new_path

_CHUNKS = f"""
WITH split AS (
    SELECT *, list_filter(regexp_split_to_array(text, '{WHITESPACE}'), lambda w: w <> '') AS words
    FROM documents),
starts AS (SELECT *, unnest(range(0, len(words), 500)) AS start FROM split),
chunked AS (
    SELECT doc_id, text, lang, source, CAST(start // 500 AS INTEGER) AS position,
           array_to_string(words[start + 1 : start + 500], ' ') AS chunk
    FROM starts)
"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "lang", "source")


@query("chunk_text", _CHUNKS + "SELECT doc_id, position, chunk FROM chunked")
def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    return ch.chunk_text(_documents(spark, folder), "text").select("doc_id", "position", "chunk")


_BASE = (
    "sha256(sha256(text) || '-' || sha256('lang') || sha256(lang) || '-' || sha256('source') || "
    "sha256(source))"
)


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text items with a metadata map."""
    metadata = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return _documents(spark, folder).withColumn("metadata", metadata)


@query(
    "chunk_ids",
    _CHUNKS + f"SELECT doc_id, position, {_BASE} || '-' || position AS chunk_id FROM chunked",
)
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    chunked = ch.with_chunk_ids(_items(spark, folder), "text", "metadata")
    return chunked.select("doc_id", "position", "chunk_id")


@query(
    "merge_metadata",
    _CHUNKS
    + """
    SELECT doc_id, position, CASE WHEN lang = 'en' THEN 'kept' ELSE chunk END AS text,
           source, CAST(CASE WHEN lang = 'en' THEN 2 ELSE 2 END AS INTEGER) AS entries
    FROM chunked
    """,
)
def merge_metadata(spark: SparkSession, folder: str) -> DataFrame:
    own = F.create_map(F.lit("source"), F.col("source"), F.lit("text"), F.lit("kept"))
    metadata = F.when(F.col("lang") == "en", own).otherwise(
        F.create_map(F.lit("source"), F.col("source"))
    )
    items = _documents(spark, folder).withColumn("metadata", metadata)
    merged = ch.merge_metadata(ch.chunk_text(items, "text"), "metadata", "chunk")
    return merged.select(
        "doc_id",
        "position",
        F.col("metadata")["text"].alias("text"),
        F.col("metadata")["source"].alias("source"),
        F.size("metadata").alias("entries"),
    )


@query("chunk_counts", _CHUNKS + "SELECT doc_id, count(*) AS chunks FROM chunked GROUP BY 1")
def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ch.chunk_counts(ch.chunk_text(_documents(spark, folder), "text"), "doc_id")


_LATEST = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"


@query(
    "upsert_latest",
    f"""
    WITH stored AS (
        SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'
        QUALIFY {_LATEST}),
    incoming AS (
        SELECT conv_id, turn, role, text FROM conversations WHERE role = 'assistant'
        QUALIFY {_LATEST})
    SELECT * FROM incoming
    UNION ALL
    SELECT * FROM stored WHERE conv_id NOT IN (SELECT conv_id FROM incoming)
    """,
)
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    stored = ch.latest(messages.filter("role = 'user'"), "conv_id", "turn")
    return ch.upsert(stored, messages.filter("role = 'assistant'"), "conv_id", "turn")


@query(
    "store_items",
    _CHUNKS
    + f"""
    SELECT DISTINCT {_BASE} || '-' || position AS chunk_id, chunk, lang, source FROM chunked
    """,
)
def store_items(spark: SparkSession, folder: str) -> DataFrame:
    """Ingest: equal texts with equal metadata share an id, so they are stored once."""
    items = ch.distinct_items(_items(spark, folder), "text", "metadata")
    chunked = ch.with_chunk_ids(items, "text", "metadata")
    return chunked.select("chunk_id", "chunk", "lang", "source")


_COSINE = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 9)"


def _newest(vectors: DataFrame) -> list[float]:
    """One query vector: that of the highest key."""
    return vectors.agg(F.max_by("embedding", "vec_id").alias("embedding")).first()["embedding"]


@query(
    "top_k",
    f"""
    SELECT vec_id, label, {_COSINE.format("embedding", "(SELECT embedding FROM embeddings q "
    "WHERE q.vec_id = (SELECT max(vec_id) FROM embeddings))")} AS score
    FROM embeddings ORDER BY score DESC, vec_id LIMIT 5
    """,
)
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, _newest(vectors), key="vec_id").select("vec_id", "label", "score")


@query(
    "top_k_filtered",
    f"""
    SELECT vec_id, label, {_COSINE.format("embedding", "(SELECT embedding FROM embeddings q "
    "WHERE q.vec_id = (SELECT max(vec_id) FROM embeddings))")} AS score
    FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10
    """,
)
def nearest_filtered(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = top_k(vectors, _newest(vectors), k=10, key="vec_id", where={"label": 3})
    return found.select("vec_id", "label", "score")


_ALL_NEAREST = f"""
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank
FROM (
    SELECT query_id, id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT q.vec_id AS query_id, v.vec_id AS id,
                 {_COSINE.format("q.embedding", "v.embedding")} AS score
          FROM embeddings q, embeddings v))
WHERE rank <= 5
"""


def _all_nearest(spark: SparkSession, folder: str, **settings: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")
    queries = vectors.withColumnRenamed("id", "query_id")
    return top_k_join(queries, vectors, **settings)


@query("top_k_join", _ALL_NEAREST)
def all_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return _all_nearest(spark, folder)


@query("top_k_join_in_blocks", _ALL_NEAREST)
def all_nearest_in_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _all_nearest(spark, folder, query_bytes=100_000, slice_bytes=100_000)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> np.ndarray:
    """A tiny embedding: how often each letter occurs."""
    return np.array([[text.count(letter) for letter in _LETTERS] for text in texts])


@query(
    "embed_text",
    "SELECT doc_id, "
    + ", ".join(
        f"CAST(len(text) - len(replace(text, '{x}', '')) AS DOUBLE) AS letter_{x}"
        for x in _LETTERS
    )
    + " FROM documents",
)
def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    counted = ch.embed(_documents(spark, folder), "text", letter_counts, length=26)
    return counted.select(
        "doc_id",
        *[
            F.col("embedding")[i].cast("double").alias(f"letter_{x}")
            for i, x in enumerate(_LETTERS)
        ],
    )


@query(
    "embed_hashed",
    _CHUNKS + "SELECT doc_id, position, 768 AS length, 1.0::DOUBLE AS norm FROM chunked",
)
def embed_hashed(spark: SparkSession, folder: str) -> DataFrame:
    chunked = ch.chunk_text(_documents(spark, folder), "text").select(
        "doc_id", "position", "chunk"
    )
    embedded = ch.embed_hashed(chunked, "chunk")
    return embedded.select(
        "doc_id",
        "position",
        F.size("embedding").alias("length"),
        F.round(norm(F.col("embedding")), 4).alias("norm"),
    )


_RANKED = """
SELECT item_id AS query_id, CAST(unnest(range(1, 6)) AS INTEGER) AS rank, true AS in_range,
       true AS in_order
FROM benchmark
"""


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    items = ch.distinct_items(_items(spark, folder), "text", "metadata")
    return ch.with_chunk_ids(items, "text", "metadata").select("chunk_id", "chunk")


@query("search_chunks", _RANKED)
def search_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as queries against all document chunks, by hashed words.

    The hash has no SQL; what any search must hold is compared.
    """
    stored = ch.embed_hashed(_chunks(spark, folder), "chunk")
    stored = stored.select(F.col("chunk_id").alias("id"), "embedding")
    passages = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    found = top_k_join(ch.embed_hashed(passages, "text"), stored)
    place = F.struct((-F.col("score")).alias("score"), "id")
    before = F.lag(place).over(Window.partitionBy("query_id").orderBy("rank"))
    return found.select(
        "query_id",
        "rank",
        F.col("score").between(0, 1).alias("in_range"),
        F.coalesce(before < place, F.lit(True)).alias("in_order"),
    )


def letters_sql(text: str) -> str:
    counts = [f"CAST(len({text}) - len(replace({text}, '{x}', '')) AS DOUBLE)" for x in _LETTERS]
    return f"[{', '.join(counts)}]"


@query(
    "search_chunks_by_letters",
    _CHUNKS
    + f""", stored AS (
        SELECT DISTINCT {_BASE} || '-' || position AS id, {letters_sql("chunk")} AS v FROM chunked)
    SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM (SELECT item_id AS query_id, id, {_COSINE.format("q", "v")} AS score
              FROM (SELECT item_id, {letters_sql("text")} AS q FROM benchmark), stored
              WHERE list_sum(v) > 0 AND list_sum(q) > 0))
    WHERE rank <= 5
    """,
)
def search_chunks_by_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The same search with an embedding that SQL can compute."""
    stored = ch.embed(_chunks(spark, folder), "chunk", letter_counts, length=26)
    passages = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    asked = ch.embed(passages, "text", letter_counts, length=26)
    return top_k_join(asked, stored.select(F.col("chunk_id").alias("id"), "embedding"))


_VERSIONED = "conv_id, CASE WHEN conv_id % 3 > 0 THEN turn END AS turn, role, text"
_NEWEST = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1"


@query(
    "upsert_null_version",
    f"""
    WITH given AS (SELECT {_VERSIONED} FROM conversations),
    stored AS (SELECT * FROM given WHERE role = 'user' QUALIFY {_NEWEST}),
    incoming AS (SELECT * FROM given WHERE role = 'assistant' QUALIFY {_NEWEST})
    SELECT * FROM incoming
    UNION ALL SELECT * FROM stored WHERE conv_id NOT IN (SELECT conv_id FROM incoming)
    """,
)
def upsert_null_version(spark: SparkSession, folder: str) -> DataFrame:
    """Keys without any version keep a row, and equal versions are settled."""
    version = F.when(F.col("conv_id") % 3 > 0, F.col("turn")).alias("turn")
    messages = table(spark, folder, "conversations").select("conv_id", version, "role", "text")
    stored = ch.latest(messages.filter("role = 'user'"), "conv_id", "turn")
    return ch.upsert(stored, messages.filter("role = 'assistant'"), "conv_id", "turn")


@query(
    "upsert_store",
    """
    SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN upper(source) ELSE source END AS source,
           CAST(CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS INTEGER) AS version
    FROM documents
    """,
)
def upsert_store(spark: SparkSession, folder: str) -> DataFrame:
    """A store with batches put in: one of them twice, one late with older versions."""
    documents = table(spark, folder, "documents")

    def batch(version: int, rows: DataFrame, name: Column) -> DataFrame:
        return rows.select("doc_id", name.alias("doc.source"), F.lit(version).alias("version"))

    store = new_path(spark, "store")
    english, german = documents.filter("lang = 'en'"), documents.filter("lang = 'de'")
    first, second = batch(0, documents, F.col("source")), batch(2, english, F.upper("source"))
    for new in (first, second, batch(1, german, F.upper("source")), second, batch(1, english, F.lit("late"))):
        store_operators.upsert_store(new, store, "doc_id", "version", buckets=16)
    return store_operators.read_store(spark, store).withColumnRenamed("doc.source", "source")


@query(
    "search_indexed",
    "SELECT count(*) AS queries, 5 * count(*) AS hits, true AS found_again FROM embeddings",
)
def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The approximate search by an index: it finds at least 0.95 of what the exact one finds."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    made = vector_index.build_index(vectors, new_path(spark, "index"), "vec_id")
    found = vector_index.search_index(made, asked, 5)
    exact = top_k_join(asked, vectors, 5, key="vec_id")
    return vector_index.recall(found, exact, "vec_id").select(
        "queries", "hits", (F.col("recall") >= 0.95).alias("found_again")
    )
