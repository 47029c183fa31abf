"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction is kept.

Shingles are runs of five words. Because the same hashes are kept in every text, the sketches of
two texts of any lengths can be intersected: the share of kept hashes that both hold estimates
their Jaccard similarity, and the share of the smaller's hashes that the larger holds its
containment. Sketches merge by union.

A text with fewer than ``LEAST`` hashes below the fraction also keeps its next smallest ones, up
to that number, and notes the bound up to which its sketch is complete. Two sketches are compared
below the smaller of their bounds, which both keep in full, so estimates stay consistent.

Defined cases: null and empty texts (and those of white space only) have no shingle and an empty
sketch; a text of one to four words has one shingle; two sketches without any hash below their
common bound are alike (1.0) if they are equal and unlike (0.0) otherwise; equal texts have equal
sketches; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from millrace.llm.texts import (
    SHINGLE_WORDS,
    WHITESPACE,
    hash_spans,
    list_array,
    shingle_hashes,
    slices,
    spans,
)

#: One hash in this many is kept.
SCALE = 8
#: Hashes that a sketch holds at least, where the text has as many.
LEAST = 32

#: Hashes are shifted right once, so that they are non-negative 64-bit integers.
_TOP = (1 << 63) - 1

SKETCH = StructType(
    [StructField("bound", LongType()), StructField("hashes", ArrayType(LongType()))]
)


def sketches(texts: pa.Array, scale: int = SCALE, least: int = LEAST) -> pa.Array:
    """The sketch of each text: its bound and its hashes up to the bound, ascending."""
    fraction = _TOP // scale
    bounds, kept = [], []
    for _, _, data, offsets in slices(texts):
        starts, ends, first = spans(data, offsets, WHITESPACE)
        words = hash_spans(data, starts, ends)
        hashes, begin = shingle_hashes(words, first, SHINGLE_WORDS)
        hashes = (hashes >> np.uint64(1)).astype(np.int64)
        low = hashes <= fraction
        below = hashes[low]
        at = np.concatenate([[0], np.cumsum(low)])[begin]
        for k in range(len(begin) - 1):
            own = np.unique(below[at[k] : at[k + 1]])
            bound = fraction
            if len(own) < least:
                every = np.unique(hashes[begin[k] : begin[k + 1]])
                own = every[:least]
                bound = int(own[-1]) if len(every) > least else _TOP
            bounds.append(max(bound, fraction))
            kept.append(own)
    return pa.StructArray.from_arrays(
        [pa.array(bounds, pa.int64()), list_array(kept, pa.int64())], ["bound", "hashes"]
    )


def fingerprint(text: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of each text as ``struct<bound, hashes>``."""

    @F.arrow_udf(SKETCH)
    def sketched(texts: pa.Array) -> pa.Array:
        return sketches(texts, scale, least)

    return sketched(text)


def as_text(sketch: Column) -> Column:
    """A sketch as a string: its bound and hashes, joined by commas; empty without hashes."""
    joined = F.concat_ws(",", sketch["bound"].cast("string"), sketch["hashes"].cast("array<string>"))
    return F.when(F.size(sketch["hashes"]) > 0, joined).otherwise("")


def _below(sketch: Column, bound: Column) -> Column:
    return F.when(sketch["bound"] <= bound, sketch["hashes"]).otherwise(
        F.filter(sketch["hashes"], lambda h: h <= bound)
    )


def _shared(left: Column, right: Column) -> tuple[Column, Column, Column]:
    bound = F.least(left["bound"], right["bound"])
    a, b = _below(left, bound), _below(right, bound)
    return F.size(F.array_intersect(a, b)), F.size(a), F.size(b)


def _share(part: Column, whole: Column, left: Column, right: Column) -> Column:
    equal = (left["hashes"] == right["hashes"]).cast("double")
    return F.when(whole > 0, part / whole).otherwise(equal)


def likeness(left: Column, right: Column) -> Column:
    """The estimated Jaccard similarity of two texts, 0 to 1."""
    both, a, b = _shared(left, right)
    return _share(both, a + b - both, left, right)


def containment(part: Column, whole: Column) -> Column:
    """The estimated share of the first text's shingles that the second holds, 0 to 1."""
    both, a, _ = _shared(part, whole)
    return _share(both, a, part, whole)


def merge(left: Column, right: Column) -> Column:
    """The sketch of the union of two texts' shingles."""
    bound = F.least(left["bound"], right["bound"])
    hashes = F.array_sort(F.array_union(_below(left, bound), _below(right, bound)))
    return F.struct(bound.alias("bound"), hashes.alias("hashes"))
