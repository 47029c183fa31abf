"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased runs of letters of a text and their stems (the first ``STEM`` bytes of
longer ones), hashed into ``2 ** BITS`` cells; a text has a cell or has it not. The logit is linear in the cells plus an inner product of two factor
vectors for every pair of cells, so that a pair of terms can weigh more (or less) than its parts.
Both sums take one pass over the cells of a text: the pair sum is half of the squared sum of
factors less the sum of their squares.

Training takes at most ``sample`` labelled rows (those with the smallest hash of their id) and the
``terms`` cells whose presence is most associated with the label; all three are parameters. Cells
that were not learned have no weight. Scoring runs over all rows in Arrow batches.

Defined cases: null and empty texts have no cells and get the score of the intercept; rows
without id are scored but never trained on; labels other than 0 and 1, or null, are ignored; if
an id has several labels the largest counts; repeated rows get equal scores; of an id with several
texts one is sure to train, the others if there is room; without any label of class 1 every score
is 0, without any of class 0 (and some of class 1) it is 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from millrace.llm.labelled import bounded_rows, labelled_sample
from millrace.llm.texts import NOT_LETTERS, hash_spans, list_array, slices, spans

#: Most labelled rows that training takes.
SAMPLE = 20_000
#: Hash cells, as a power of two.
BITS = 20
#: Bytes of a stem.
STEM = 4
#: Most cells with a weight.
TERMS = 4096
#: Length of a factor vector.
FACTORS = 8
#: Least chi-square of a cell with the label.
LEAST_ASSOCIATION = 30.0


def cells(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of texts: the cell of every term, and the index of each text's first (and end)."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for _, _, data, offsets in slices(lowered):
        starts, ends, first = spans(data, offsets, NOT_LETTERS)
        words = hash_spans(data, starts, ends)
        long = ends - starts > STEM
        stems = ~hash_spans(data, starts[long], starts[long] + STEM)
        # A stem stands right after its word.
        place = np.arange(len(words)) + np.concatenate([[0], np.cumsum(long)[:-1]])[: len(words)]
        terms = np.empty(len(words) + len(stems), dtype=np.uint64)
        terms[place], terms[place[long] + 1] = words, stems
        begin = first + np.concatenate([[0], np.cumsum(long)])[first]
        yield (terms >> np.uint64(64 - BITS)).astype(np.int32), begin


@F.arrow_udf(ArrayType(IntegerType()))
def distinct_cells(texts: pa.Array) -> pa.Array:
    parts = [
        np.unique(found[first[k] : first[k + 1]])
        for found, first in cells(texts)
        for k in range(len(first) - 1)
    ]
    return list_array(parts, pa.int32())


@dataclass(frozen=True)
class Model:
    """``place`` gives the row of a cell in the weights, or the last row, which is zero."""

    bias: float
    place: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        out, nothing = [np.zeros(0)], len(self.linear) - 1
        for found, first in cells(texts):
            rows = len(first) - 1
            at = self.place[found]
            known = at < nothing
            doc = np.repeat(np.arange(rows), np.diff(first))[known]
            pairs = np.unique(doc * (nothing + 1) + at[known])
            doc, at = pairs // (nothing + 1), pairs % (nothing + 1)
            out.append(_logistic(self.bias + _machine(doc, at, rows, self.linear, self.factors)[0]))
        return np.concatenate(out)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _machine(doc, at, rows, linear, factors):
    """The logit of each row without the bias, and the sums of its factors."""
    logit = np.bincount(doc, linear[at], minlength=rows).astype(float)
    sums = np.empty((rows, factors.shape[1]))
    for f in range(factors.shape[1]):
        own = factors[at, f]
        sums[:, f] = np.bincount(doc, own, minlength=rows)
        logit += 0.5 * (sums[:, f] ** 2 - np.bincount(doc, own**2, minlength=rows))
    return logit, sums


def fit(
    found: np.ndarray,
    first: np.ndarray,
    label: np.ndarray,
    terms: int = TERMS,
    factors: int = FACTORS,
    steps: int = 150,
) -> Model:
    """Fit from the distinct cells of each row, rows in a fixed order.

    Rows with the same cells and label count once, or a group of copies would pass as evidence.
    """
    each = {(label[k], found[first[k] : first[k + 1]].tobytes()): k for k in range(len(label))}
    kept = np.sort(np.array(list(each.values()), dtype=np.int64))
    found = np.concatenate([found[:0], *(found[first[k] : first[k + 1]] for k in kept)])
    first = np.concatenate([[0], np.cumsum(np.diff(first)[kept])])
    label = label[kept]
    rows, size = len(label), 1 << BITS
    doc = np.repeat(np.arange(rows), np.diff(first))
    positive = int(label.sum())
    if not positive or positive == rows:
        bias = 500.0 if positive else -500.0
        return Model(bias, np.zeros(size, dtype=np.int32), np.zeros(1), np.zeros((1, factors)))
    seen = np.bincount(found, minlength=size).astype(float)
    toxic = np.bincount(found, label[doc], minlength=size)
    # Chi-square of the two-by-two table of presence and label, with the continuity correction.
    det = np.abs(toxic * (rows - positive) - (seen - toxic) * positive) - rows / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = rows * np.maximum(det, 0) ** 2 / (seen * (rows - seen) * positive * (rows - positive))
    chi = np.nan_to_num(chi, nan=0.0, posinf=0.0)
    chosen = np.argsort(-chi, kind="stable")[:terms]
    chosen = np.sort(chosen[chi[chosen] >= LEAST_ASSOCIATION])
    place = np.full(size, len(chosen), dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    at = place[found]
    doc, at = doc[at < len(chosen)], at[at < len(chosen)]
    # Start from the log odds of each cell, as if cells were independent; five rows of prior
    # evidence keep rare cells near zero.
    share = positive / rows
    odds = np.log((toxic + 5 * share) / positive) - np.log((seen - toxic + 5 * (1 - share)) / (rows - positive))
    linear = np.append(odds[chosen], 0.0)
    vectors = np.random.default_rng(7).normal(0, 0.02, (len(chosen) + 1, factors))
    vectors[-1] = 0
    bias = float(np.log(positive / (rows - positive)))
    state = [np.zeros(1), np.zeros(1), *(np.zeros_like(x) for x in (linear, linear, vectors, vectors))]
    for step in range(1, steps + 1):  # Adam over all rows of the sample
        logit, sums = _machine(doc, at, rows, linear, vectors)
        wrong = (_logistic(bias + logit) - label) / rows
        slope_linear = 1.0 * np.bincount(at, wrong[doc], minlength=len(linear)) + 1e-4 * linear
        slope_vectors = 1e-3 * vectors
        for f in range(factors):
            slope_vectors[:, f] += np.bincount(
                at, wrong[doc] * (sums[doc, f] - vectors[at, f]), minlength=len(linear)
            )
        moved = []
        for k, slope in enumerate((np.array([wrong.sum()]), slope_linear, slope_vectors)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * slope
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * slope**2
            mean, square = state[2 * k] / (1 - 0.9**step), state[2 * k + 1] / (1 - 0.99**step)
            moved.append(0.05 * mean / (np.sqrt(square) + 1e-10))
        bias -= float(moved[0][0])
        linear -= moved[1]
        vectors -= moved[2]
        linear[-1] = 0
        vectors[-1] = 0
    return Model(bias, place, linear, vectors)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    *,
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Fit on labelled documents; ``learn`` says by ``doc_id`` which labels may be used."""
    known = labelled_sample(docs, labels, label, learn, sample)
    rows = known.select("doc_id", "label", distinct_cells("text").alias("cells"))
    # The sample is bounded; the limit holds the bound where an id has several texts.
    table = bounded_rows(rows, "cells", sample).toArrow()
    lists = table["cells"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return fit(np.asarray(lists.flatten()), first.astype(np.int64), np.asarray(table["label"]).astype(float))


def score(model: Model, text: Column) -> Column:
    """The score of each text, 0 to 1, higher for toxic."""

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return scored(text)
