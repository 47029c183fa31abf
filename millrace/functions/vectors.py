"""Vectors as ``array<float>`` or ``array<double>`` columns, handled in Arrow batches.

Spark's array functions interpret a lambda per element; a matrix product over an Arrow batch
is far cheaper, so similarity runs in Arrow functions with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cosine scores are rounded to this many places so that equal vectors tie exactly,
# whatever order a machine adds the products in.
SCORE_PLACES = 9


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors without nulls as the rows of a matrix of doubles; all must be equally long."""
    if not len(vectors):
        return np.zeros((0, 0))
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) != 1:
        raise ValueError(f"vectors differ in length: {sorted(lengths)}")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(vectors), lengths[0])


def norm(vector: Column) -> Column:
    """Euclidean length of each vector; null for null."""

    @F.arrow_udf("double")
    def lengths(vectors: pa.Array) -> pa.Array:
        known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        out = np.full(len(vectors), np.nan)
        out[known] = np.linalg.norm(matrix(vectors.drop_null()), axis=1) if len(known) else 0
        return pa.array(out, from_pandas=True)

    return lengths(vector)


def cosine_to(query: Sequence[float], vector: Column) -> Column:
    """Cosine similarity of each vector to one query; null where either has no length."""
    target = np.asarray(query, dtype=np.float64)
    length = np.linalg.norm(target)
    unit = target / length if length else target

    @F.arrow_udf("double")
    def similarity(vectors: pa.Array) -> pa.Array:
        known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        out = np.full(len(vectors), np.nan)
        if len(known) and length:
            rows = matrix(vectors.drop_null())
            if rows.shape[1] != len(unit):
                raise ValueError(f"the query has {len(unit)} values, the vectors {rows.shape[1]}")
            norms = np.linalg.norm(rows, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[known] = np.where(norms > 0, rows @ unit / norms, np.nan)
        return pa.array(np.round(out, SCORE_PLACES), from_pandas=True)

    return similarity(vector)
