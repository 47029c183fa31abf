"""Quality scores learned from preference pairs (Bradley-Terry), cut at a score quantile.

Every document becomes a short vector of measures of its text. A preference pair holds a better
and a worse labelled document; with the Bradley-Terry model the chance that the first wins is the
logistic function of the difference of their scores, and scores are linear in the measures, so
training is logistic regression on differences of measures. The threshold is the quantile of the
training scores at the share of worse documents; scores are centred there, so that 0.5 separates.

Training takes every labelled row. Rows are dealt by hash into blocks of about ``BLOCK``, every better
row of a block is paired with every worse one, and rows of a rare class stand in several blocks, so
that each row has opponents. A step of training sums the pairs of all blocks as a Spark job, and the
threshold is found in all training scores by counting in ever narrower ranges. The driver holds sums
of measures. ``sample`` bounds the labelled rows where a caller wants that (those with the smallest
hash of their id); the registered queries do not. Scoring runs over all rows in Arrow batches.

Defined cases: null and empty texts have measures of zero words and are scored like any other;
rows without id are scored but never trained on; labels other than 0 and 1, or null, are ignored;
if an id has several labels the largest counts; repeated rows get equal scores and train once; of
an id with several texts all train (under a ``sample`` one is sure to, the others if there is room);
with no labels of one of the classes every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from millrace.llm.labelled import bounded_rows, known_labels, labelled_sample
from millrace.llm.texts import WHITESPACE, hash_spans, list_array, slices, spans
from millrace.sources.scratch import stage_table

#: Labelled rows in a block, each paired with all of the other class; up to so many are fitted at once.
BLOCK = 1024
#: Opponents from the other class for each labelled row, at least; blocks are dealt four times as many
#: on average where that takes copies, so that hardly one has fewer.
RIVALS = 8
#: Ranges that scores are counted in at a time.
BINS = 1024

#: Byte classes by name; the rest is (classes 0) other punctuation and control bytes.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\v\f\r",
    "line": b"\n",
    "stop": b".,;:'\"-()?",
    "shout": b"!",
    "rule": b"|_=<>{}[]\\/~^`",
    "symbol": b"#$%&*@+",
    "wide": bytes(range(128, 256)),
}
_CLASS_OF = np.zeros(256, dtype=np.int64)
for _code, _bytes in enumerate(_CLASSES.values(), start=1):
    _CLASS_OF[list(_bytes)] = _code
_WIDTH = len(_CLASSES) + 1
#: Measures of a text.
MEASURES = 2 * _WIDTH + 6


def measures(texts: pa.Array) -> np.ndarray:
    """A row of measures for each text: byte class shares, their roots, and word statistics."""
    out = np.zeros((len(texts), MEASURES))
    for first, end, data, offsets in slices(texts):
        rows, sizes = end - first, np.diff(offsets)
        owner = np.repeat(np.arange(rows) * _WIDTH, sizes)
        counts = np.bincount(owner + _CLASS_OF[data], minlength=rows * _WIDTH)
        shares = counts.reshape(rows, _WIDTH) / np.maximum(sizes, 1)[:, None]
        starts, ends, begin = spans(data, offsets, WHITESPACE)
        words = hash_spans(data, starts, ends)
        number = np.diff(begin)
        some = np.maximum(number, 1)
        doc = np.repeat(np.arange(rows), number)
        long = (ends - starts).astype(float)
        mean = np.bincount(doc, long, minlength=rows) / some
        spread = np.sqrt(
            np.maximum(np.bincount(doc, long**2, minlength=rows) / some - mean**2, 0)
        )
        twin = np.zeros(len(words), dtype=bool)
        twin[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        # Words dealt over 64 cells by hash: one full cell tells of much repetition.
        cells = np.bincount(doc * 64 + (words % 64).astype(np.int64), minlength=rows * 64)
        top = cells.reshape(rows, 64).max(axis=1) / some
        part = out[first:end]
        part[:, :_WIDTH] = shares
        part[:, _WIDTH : 2 * _WIDTH] = np.sqrt(shares)
        part[:, 2 * _WIDTH :] = np.column_stack(
            [
                np.log1p(number),
                mean,
                spread,
                np.sqrt(np.bincount(doc, twin, minlength=rows) / some),
                top,
                number / np.maximum(counts.reshape(rows, _WIDTH)[:, 5] + 1, 1) / 100,
            ]
        )
    return out


@dataclass(frozen=True)
class Model:
    """Scores are ``logistic((measures @ weights - threshold) / width)``."""

    weights: np.ndarray
    threshold: float
    width: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows @ self.weights - self.threshold) / self.width, -500, 500)
        return 1 / (1 + np.exp(-z))


def _pair_sums(good: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number, gradient and second derivative of the logistic loss over all pairs of two classes."""
    lost = 1 / (1 + np.exp(np.clip((good @ weights)[:, None] - bad @ weights, -500, 500)))
    bent = lost * (1 - lost)
    gradient = bad.T @ lost.sum(axis=0) - good.T @ lost.sum(axis=1)
    cross = good.T @ (bent @ bad)
    own = good.T @ (bent.sum(axis=1)[:, None] * good) + bad.T @ (bent.sum(axis=0)[:, None] * bad)
    return np.concatenate([[lost.size], gradient, (own - cross - cross.T).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], length: int, ridge: float) -> np.ndarray:
    """Newton's method on the mean logistic loss of the pairs, given their sums at some weights."""
    weights = np.zeros(length)
    for _ in range(30):
        at = sums(weights)
        gradient = at[1 : length + 1] / at[0] + ridge * weights
        bend = at[length + 1 :].reshape(length, length) / at[0] + ridge * np.eye(length)
        step = np.linalg.solve(bend, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _scale(spread: np.ndarray) -> np.ndarray:
    """What measures are divided by; those that are the same everywhere count for nothing."""
    return np.where(spread < 1e-12, np.inf, spread)


def fit(rows: np.ndarray, better: np.ndarray, ridge: float = 1e-3) -> Model:
    """Fit from measures and a mark of the better documents, on all pairs of the rows given."""
    if better.all() or not better.any():
        return Model(np.zeros(rows.shape[1]), 0.0, 1.0)
    center, scale = rows.mean(axis=0), _scale(rows.std(axis=0))
    good, bad = (rows[better] - center) / scale, (rows[~better] - center) / scale

    def sums(weights: np.ndarray) -> np.ndarray:
        return sum(_pair_sums(good[k : k + BLOCK], bad, weights) for k in range(0, len(good), BLOCK))

    weights = _newton(sums, rows.shape[1], ridge) / scale
    return Model(weights, float(_cut(rows @ weights, better)), 1.0)


def _cut(reached: np.ndarray, better: np.ndarray) -> float:
    """The quantile of the scores at the share of worse documents, between two neighbours."""
    ordered = np.sort(reached)
    worse = int((~better).sum())
    return (ordered[worse - 1] + ordered[worse]) / 2


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), dtype=float).reshape(-1, MEASURES)


def _packed(block: pa.Table) -> pa.Table:
    """One row for a block: its number and the measures of its better and its worse rows."""
    rows, better = _matrix(block["x"]), np.asarray(block["label"]) == 1
    order = np.lexsort(rows.T)  # the same order on every run
    good, bad = (rows[order[better[order] == side]] for side in (True, False))
    return pa.table({"block": block["block"].slice(0, 1), "good": [good.tobytes()], "bad": [bad.tobytes()]})


def _blocks(rows: DataFrame, better: int, worse: int, rivals: int) -> DataFrame:
    """Every row of ``label, x`` in a block, those of the rarer class in as many as it takes."""
    number = -(-(better + worse) // BLOCK)
    rarer = min(better, worse)
    copies = min(number, -(-4 * rivals * number // rarer))
    again = F.when(F.col("label") == int(better < worse), F.sequence(F.lit(0), F.lit(copies - 1)))
    place = F.pmod(F.xxhash64("doc_id", "x"), F.lit(number))
    dealt = rows.select("label", "x", place.alias("place"), F.explode(F.coalesce(again, F.array(F.lit(0)))).alias("k"))
    dealt = dealt.select("label", "x", F.pmod(F.col("place") + F.col("k"), F.lit(number)).alias("block"))
    return dealt.groupBy("block").applyInArrow(_packed, "block long, good binary, bad binary")


def _fit_blocks(rows: DataFrame, better: int, worse: int, rivals: int, ridge: float = 1e-3) -> Model:
    """As ``fit``, over a staged table of labelled rows, on the pairs within blocks."""
    each = [F.col("x")[k] for k in range(MEASURES)]
    stats = rows.agg(*map(F.avg, each), *map(F.stddev_pop, each)).first()
    center, scale = np.array(stats[:MEASURES]), _scale(np.array(stats[MEASURES:]))
    blocks = stage_table(_blocks(rows, better, worse, rivals), "blocks")

    def sums(weights: np.ndarray) -> np.ndarray:
        def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros(1 + MEASURES + MEASURES**2)
            for batch in batches:
                for pair in zip(batch["good"], batch["bad"], strict=True):
                    good, bad = (
                        (np.frombuffer(side.as_buffer()).reshape(-1, MEASURES) - center) / scale for side in pair
                    )
                    whole += _pair_sums(good, bad, weights)
            yield pa.record_batch({"sums": list_array([whole], pa.float64())})

        # A row for each task.
        return np.sum([r["sums"] for r in blocks.mapInArrow(summed, "sums array<double>").collect()], axis=0)

    weights = _newton(sums, MEASURES, ridge) / scale

    @F.arrow_udf(DoubleType())
    def reached(x: pa.Array) -> pa.Array:
        return pa.array(_matrix(x) @ weights)

    scores = stage_table(rows.select(reached("x").alias("score")), "scores")
    return Model(weights, (_nth(scores, worse - 1) + _nth(scores, worse)) / 2, 1.0)


def _nth(scores: DataFrame, place: int) -> float:
    """The score at a place (from 0) in the order of all, by counting in ever narrower ranges."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    before = 0
    while low < high:
        inside = scores.filter(F.col("score").between(low, high))
        share = (F.col("score") - F.lit(low)) / F.lit(high - low)
        binned = inside.groupBy(F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        counted = binned.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for row in counted.orderBy("bin").collect():
            low, high = row["low"], row["high"]
            if place < before + row["n"]:
                break
            before += row["n"]
        if place == before:
            return low
        if place == before + row["n"] - 1:
            return high
    return low


@F.arrow_udf(ArrayType(DoubleType()))
def measured(texts: pa.Array) -> pa.Array:
    return list_array(list(measures(texts)), pa.float64())


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    *,
    label: str = "quality",
    sample: int | None = None,
    rivals: int = RIVALS,
) -> Model:
    """Fit on labelled documents; ``learn`` says by ``doc_id`` which labels may be used."""
    if sample is None:
        # Measured before the join, which then moves measures instead of texts.
        measures_of = docs.select("doc_id", measured("text").alias("x")).filter("doc_id IS NOT NULL")
        known = known_labels(labels, label, learn)
        rows = measures_of.join(known, "doc_id").select("doc_id", "label", "x").distinct()
    else:
        drawn = labelled_sample(docs, labels, label, learn, sample)
        rows = bounded_rows(drawn.select("doc_id", "label", measured("text").alias("x")), "x", sample)
    rows = stage_table(rows, "labelled")
    number = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    better, worse = number.get(1, 0), number.get(0, 0)
    if not better or not worse:
        return Model(np.zeros(MEASURES), 0.0, 1.0)
    if better + worse > BLOCK:
        return _fit_blocks(rows, better, worse, rivals)
    table = rows.orderBy("doc_id", "label", "x").toArrow()
    return fit(_matrix(table["x"].combine_chunks()), np.asarray(table["label"]) == 1)


def score(model: Model, text: Column) -> Column:
    """The score of each text, 0 to 1; documents at or above 0.5 lie above the quantile."""

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(measures(texts)))

    return scored(text)
