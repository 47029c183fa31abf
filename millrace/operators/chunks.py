"""Text items into chunks with stable ids and metadata, embeddings and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.fixed import CHUNK_WORDS, EMBEDDING_LENGTH
from millrace.functions.text import chunks, words
from millrace.functions.types import quoted
from millrace.operators.joins import join_tables

# Bytes of texts that are Python strings at a time while they are embedded.
TEXT_BYTES = 4 * 1024 * 1024


def chunk_text(df: DataFrame, column: str, size: int = CHUNK_WORDS) -> DataFrame:
    """One row per run of ``size`` words, as ``position`` and ``chunk``; none for empty text."""
    return df.select("*", F.posexplode(chunks(F.col(column), size)).alias("position", "chunk"))


def with_base_id(df: DataFrame, text: str, metadata: str | None = None) -> DataFrame:
    """Add ``base_id``: a hash of the text and its metadata, the same on every run."""
    if metadata is None:
        return df.withColumn("base_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    entries = F.array_sort(F.map_entries(F.col(metadata)))
    hashed = F.transform(
        entries,
        lambda e: F.concat(F.sha2(e["key"], 256), F.sha2(F.coalesce(e["value"], F.lit("")), 256)),
    )
    parts = F.concat_ws("-", F.sha2(F.coalesce(F.col(text), F.lit("")), 256), hashed)
    return df.withColumn("base_id", F.sha2(parts, 256))


def distinct_items(df: DataFrame, text: str, metadata: str | None = None) -> DataFrame:
    """One of the items with equal text and metadata."""
    return with_base_id(df, text, metadata).dropDuplicates(["base_id"]).drop("base_id")


def with_chunk_ids(
    df: DataFrame, text: str, metadata: str | None = None, size: int = CHUNK_WORDS
) -> DataFrame:
    """Chunk a text column and add ``chunk_id``: base id, a dash and the position."""
    chunked = chunk_text(with_base_id(df, text, metadata), text, size)
    chunk_id = F.concat_ws("-", "base_id", F.col("position").cast("string"))
    return chunked.withColumn("chunk_id", chunk_id)


def merge_metadata(df: DataFrame, metadata: str, chunk: str, key: str = "text") -> DataFrame:
    """Add the chunk to the metadata map under ``key``; an existing key wins."""
    given = F.col(metadata)
    merged = F.when(F.map_contains_key(given, key), given).otherwise(
        F.map_concat(F.create_map(F.lit(key), F.col(chunk)), given)
    )
    return df.withColumn(metadata, merged)


def chunk_counts(chunked: DataFrame, key: str) -> DataFrame:
    """Chunks stored per item."""
    return chunked.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))


def to_records(
    items: DataFrame,
    encode: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    length: int = EMBEDDING_LENGTH,
    size: int = CHUNK_WORDS,
) -> DataFrame:
    """Text items (``text``, ``metadata``) as vector records: ``id, embedding, metadata``.

    Each chunk becomes a record whose metadata carries the chunk. Equal items give equal
    ids; they are reduced to one before they are cut. Without ``encode``, words are hashed.
    """
    chunked = with_chunk_ids(
        distinct_items(items.select("text", "metadata"), "text", "metadata"), "text", "metadata", size
    )
    once = merge_metadata(chunked, "metadata", "chunk").select(
        F.col("chunk_id").alias("id"), "chunk", "metadata"
    )
    embedded = (
        embed(once, "chunk", encode, length) if encode else embed_hashed(once, "chunk", length)
    )
    return embedded.select("id", "embedding", "metadata")


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version of each key.

    Rows without a version count as the oldest. Of rows with equal versions the largest wins,
    column by column; columns that have no order (maps) do not take part in that. An aggregate
    rather than a window: rows of a frequent key are reduced in every task before the shuffle.
    """
    ordered = [
        F.col(quoted(f.name)) for f in df.schema.fields if "map<" not in f.dataType.simpleString()
    ]
    # A struct is never null, whatever is in it.
    rank = F.struct(F.col(quoted(version)).isNotNull(), F.col(quoted(version)), *ordered)
    newest = F.max_by(F.struct(*[F.col(quoted(c)) for c in df.columns]), rank).alias("row")
    return df.groupBy(quoted(key)).agg(newest).select("row.*")


def upsert(existing: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """``existing`` with the rows of ``new`` put in by key; the later write replaces the earlier.

    ``existing`` holds each key once. Only ``new`` is aggregated. Its distinct keys are
    measured and broadcast if they fit, and then the stored table is not shuffled. Write the
    result to a new path: Spark cannot overwrite a table it is reading.
    """
    columns = [F.col(quoted(c)) for c in existing.columns]
    incoming = latest(new.select(*columns), key, version)
    keys = new.select(F.col(quoted(key)).alias("__key")).distinct()
    kept = join_tables(existing.withColumn("__key", F.col(quoted(key))), keys, "__key", "left_anti", broadcast="right")
    return kept.select(*columns).unionByName(incoming)


def embed(
    df: DataFrame,
    column: str,
    encode: Callable[[list[str]], Sequence[Sequence[float]]],
    length: int = EMBEDDING_LENGTH,
    name: str = "embedding",
) -> DataFrame:
    """Embed a text column with the caller's function, TEXT_BYTES of an Arrow batch at a time.

    ``encode`` takes a list of texts and returns one vector of ``length`` numbers for each.
    """

    @F.arrow_udf("array<float>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [np.zeros((0, length), np.float32)]
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(ends // TEXT_BYTES)) + 1
            for first, end in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                given = [text or "" for text in texts.slice(first, end - first).to_pylist()]
                vectors = np.asarray(encode(given), dtype=np.float32)
                if given and vectors.shape != (len(given), length):
                    raise ValueError(f"expected {len(given)} x {length} values, got {vectors.shape}")
                parts += [vectors] if given else []
            places = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * length)
            yield pa.ListArray.from_arrays(places, pa.array(np.concatenate(parts).ravel()))

    return df.withColumn(name, encoded(F.col(column)))


def embed_hashed(
    df: DataFrame, column: str, length: int = EMBEDDING_LENGTH, name: str = "embedding"
) -> DataFrame:
    """Embed a text column by hashed word counts of unit length; compares words, not meaning.

    A stand-in where no model is at hand. Runs in the JVM.
    """
    staged = df.withColumn("__words", words(F.lower(F.coalesce(F.col(column), F.lit("")))))
    staged = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=length).transform(
        staged
    )
    staged = Normalizer(inputCol="__counts", outputCol="__unit", p=2.0).transform(staged)
    return staged.withColumn(name, vector_to_array("__unit", "float32")).drop(
        "__words", "__counts", "__unit"
    )
