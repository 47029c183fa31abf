"""How far the words of one source are from those of another, language by language.

Counting sorts pointers, not strings. In each slice of texts every word start becomes a pointer
into the Arrow buffer of the texts, and the pointers are sorted by the words they point at: by
their first eight bytes, then, only inside runs that are still equal, by the next eight, and so on
(a multikey quicksort with eight bytes for a digit). Each run of equal words then yields its
document frequency and its count in every source of the slice. Spark adds the slices up by
(language, word), keeps the words of enough documents and compares the sources.

Two sources are compared over all kept words. A word that neither has adds the same to every
such pair, so tasks sum only over words that a source of the pair has, as differences from that
value. The words of a language are dealt into buckets by their hash, and its sources, in order,
into blocks of ``BLOCK``; a task holds one bucket for two blocks of sources as a matrix. So no
task holds a language, and no row stands for a pair of sources of a single word.

All shares are whole numbers of billionths, floored, of counts with ``ADDED`` added to each; all
arithmetic is exact.

Defined cases: null text, language and source count as the empty string; a text without words
still makes its source occur; a language without kept words has the value 0 for all its pairs;
repeated rows count as documents of their own; equal values are ranked by name; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.texts import NOT_LETTERS, slices, spans
from millrace.sources.scratch import stage_table

#: Kept are the words in at least this many documents of their language.
LEAST_DOCUMENTS = 30
#: Added to every count.
ADDED = 5
#: Shares are whole numbers of this part.
PARTS = 1_000_000_000
#: Words reported for each source.
TOP = 50
#: Sources compared at once in a task.
BLOCK = 512
#: Counts of words in one source that a task holds, at the least.
BUCKET = 8192
#: Texts are sorted in slices of about this many bytes.
SLICE_BYTES = 8 << 20
#: Matrix cells at once.
CELLS = 1 << 20

_COUNTED = "lang string, source string, term string, n long, documents long"


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z, and nothing else, in lower case."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the spans by their bytes, ties by position, and where each run of equals begins."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded, strides=(1,))

    def digits(of: np.ndarray, depth: int) -> np.ndarray:
        # Spans hold no zero byte, so that zeros after the end sort a prefix first.
        left = ends[of] - starts[of] - 8 * depth
        spare = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        found = loads[np.minimum(starts[of] + 8 * depth, len(data))].astype(np.uint64)
        return np.where(left > 0, found >> np.minimum(spare, 63) << np.minimum(spare, 63), 0).astype(np.uint64)

    first = digits(np.arange(len(starts)), 0)
    order = np.argsort(first, kind="stable")
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = first[order[1:]] != first[order[:-1]]
    depth = 1
    # Places in the order whose runs may still differ: those with bytes left and an equal neighbour.
    places = np.arange(len(order))
    while len(places):
        run = np.cumsum(fresh[places])
        sizes = np.bincount(run)
        longest = np.zeros(len(sizes), dtype=np.int64)
        np.maximum.at(longest, run, ends[order[places]] - starts[order[places]])
        open_runs = (sizes > 1) & (longest > 8 * depth)
        on = open_runs[run]
        places, run = places[on], run[on]
        if not len(places):
            break
        own = order[places]
        digit = digits(own, depth)
        moved = np.lexsort((digit, run))
        order[places], digit = own[moved], digit[moved]
        apart = np.ones(len(places), dtype=bool)
        apart[1:] = (digit[1:] != digit[:-1]) | (run[1:] != run[:-1])
        fresh[places] = apart
        depth += 1
    return order, np.flatnonzero(fresh)


def count_slice(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """Words of a slice with their counts and document frequencies in every group of texts.

    Returns the first byte and the end of a word, its group, its count and its documents.
    """
    data = lower(data)
    starts, ends, first = spans(data, offsets, NOT_LETTERS)
    if not len(starts):
        nothing = np.zeros(0, dtype=np.int64)
        return data, nothing, nothing, nothing, nothing, nothing
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order, begins = sort_pointers(data, starts, ends)
    run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    # Inside a run the pointers are in the order of the texts.
    of = text[order]
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (of[1:] != of[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(of)))
    groups = int(group.max()) + 1
    cell, which = np.unique(run[at] * groups + group[of[at]], return_inverse=True)
    n = np.bincount(which, weights=times, minlength=len(cell)).astype(np.int64)
    documents = np.bincount(which, minlength=len(cell))
    lead = order[begins[cell // groups]]
    return data, starts[lead], ends[lead], cell % groups, n, documents


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = batch.column("lang"), batch.column("source")
        for start, end, data, offsets in slices(batch.column("text"), SLICE_BYTES):
            names: dict[tuple[str, str], int] = {}
            here = zip(lang[start:end].to_pylist(), source[start:end].to_pylist(), strict=True)
            group = np.array([names.setdefault(pair, len(names)) for pair in here])
            data, begins, ends, of, n, documents = count_slice(data, offsets, group)
            sizes = ends - begins
            place = np.cumsum(sizes) - sizes
            flat = data[np.repeat(begins - place, sizes) + np.arange(sizes.sum())]
            # Every group once without a word, so that it occurs.
            bounds = np.concatenate([[0], np.cumsum(sizes), np.full(len(names), sizes.sum())]).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(
                len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(flat.tobytes())
            ).cast(pa.string())
            of = np.concatenate([of, np.arange(len(names))])
            given = list(names)
            nothing = np.zeros(len(names), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g in given], pa.string()).take(pa.array(of)),
                    pa.array([g[1] for g in given], pa.string()).take(pa.array(of)),
                    words,
                    pa.array(np.concatenate([n, nothing]), pa.int64()),
                    pa.array(np.concatenate([documents, nothing]), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "documents"],
            )


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, documents`` of each slice; sums over slices are the counts.

    Every source has a row for the empty term, which no word is, with the count 0.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(_counted, _COUNTED)


@dataclass(frozen=True)
class Counts:
    """Counts of the kept words, and the sources, of every language.

    ``terms``    lang, source, term, n (1 or more), everywhere (its count in the language)
    ``groups``   lang, source, place (from 0 by name), sources, n (of all kept words), kept (words)
    """

    terms: DataFrame
    groups: DataFrame


def count_kept(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> Counts:
    """Add the slices up by (language, word); both tables are written and read again.

    One shuffle brings the rows of a word of a language together, at most one for each slice and
    source; the sum for each source and the documents of the word follow without another.
    """
    dealt = count_terms(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    word = Window.partitionBy("lang", "term")
    frequent = summed.withColumns(
        {
            "documents": F.sum("documents").over(word),
            "everywhere": F.sum("n").over(word),
            "leads": (F.min("source").over(word) == F.col("source")) & (F.col("term") != ""),
        }
    )
    kept = frequent.filter((F.col("term") == "") | (F.col("documents") >= least)).drop("documents")
    staged = stage_table(kept, "divergence-terms")
    sizes = staged.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("leads").alias("leads"))
    lang = Window.partitionBy("lang")
    groups = sizes.select(
        "lang",
        "source",
        (F.row_number().over(lang.orderBy("source")) - 1).cast("int").alias("place"),
        F.count(F.lit(1)).over(lang).alias("sources"),
        "n",
        F.sum("leads").over(lang).alias("kept"),
    )
    return Counts(staged.filter("term <> ''").drop("leads"), stage_table(groups, "divergence-sources"))


def share(count: Column, n: Column, kept: Column) -> Column:
    """One and the floored share of a count, in ``PARTS``, as a long."""
    whole = F.lit(PARTS).cast("decimal(11,0)") * (count + ADDED).cast("decimal(20,0)")
    parts = (n + kept * ADDED).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", whole, parts) + 1).otherwise(F.lit(1)).cast("long")


def _differences(left: pa.Table, right: pa.Table, size_of_block: int) -> pa.Table:
    """Summed over the words of a bucket: how the difference of two sources exceeds that for no word.

    ``left`` holds counted words, ``right`` all sources of the two blocks.
    """
    key = right.slice(0, 1).select(["lang", "low", "high"]) if right.num_rows else None
    schema = pa.schema(
        [("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())]
    )
    if key is None or not left.num_rows:
        return schema.empty_table()
    lang, low, high = (key.column(k)[0].as_py() for k in range(3))
    base = {}
    for block in {low, high}:
        own = right.column("place").to_numpy() // size_of_block == block
        places = right.column("place").to_numpy()[own]
        base[block] = np.zeros(places.max() % size_of_block + 1, dtype=np.int64)
        base[block][places % size_of_block] = right.column("none").to_numpy()[own]
    _, word = np.unique(left.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
    place, value = left.column("place").to_numpy(), left.column("p").to_numpy()
    order = np.argsort(word, kind="stable")
    word, place, value = word[order], place[order], value[order]
    total = np.zeros((len(base[low]), len(base[high])), dtype=np.int64)
    wide = max(len(base[low]), len(base[high]))
    step, words = max(1, CELLS // wide), int(word[-1]) + 1
    for first in range(0, words, step):
        begin, end = np.searchsorted(word, [first, first + step])
        size = min(step, words - first)
        matrix = {}
        for block, none in base.items():
            matrix[block] = np.tile(none, (size, 1))
            own = np.flatnonzero(place[begin:end] // size_of_block == block) + begin
            matrix[block][word[own] - first, place[own] % size_of_block] = value[own]
        for k in range(len(base[low])):
            apart = np.abs(matrix[high] - matrix[low][:, k : k + 1]).sum(axis=0)
            total[k] += apart - size * np.abs(base[high] - base[low][k])
    a, b = np.nonzero(total)
    return pa.table(
        [pa.array([lang] * len(a), pa.string()), pa.array(a + low * size_of_block, pa.int32()), pa.array(b + high * size_of_block, pa.int32()), pa.array(total[a, b])],
        schema=schema,
    )


def compare(counts: Counts, size: int = BLOCK) -> DataFrame:
    """``lang, source, item, value`` for each source and every other source of its language."""
    groups = counts.groups.withColumn("none", share(F.lit(0).cast("long"), F.col("n"), F.col("kept")))
    many = groups.agg(F.max("sources").alias("most")).first()["most"] or 1
    wide = min(int(many), size)
    # A bucket has several times the rows that it gives.
    buckets = max(1, counts.terms.count() // max(BUCKET, 4 * wide * wide))
    blocks = -(-int(many) // size)
    block = F.floor(F.col("place") / size).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.least(F.lit(blocks - 1), F.floor((F.col("sources") - 1) / size).cast("int"))))
    sides = groups.select("*", other.alias("other")).withColumns(
        {"low": F.least(block, F.col("other")), "high": F.greatest(block, F.col("other"))}
    )
    own = ["lang", "low", "high", "bucket"]
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    known = sides.select("lang", "source", "place", "low", "high", F.col("n").alias("whole"), "kept")
    terms = counts.terms.join(known, ["lang", "source"]).select(
        "lang", "low", "high", bucket.alias("bucket"), "term", "place", share(F.col("n"), F.col("whole"), F.col("kept")).alias("p")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    # New names, or both sides of the cogroup would share columns.
    ends = sides.select(*(F.col(c).alias(c) for c in ("lang", "low", "high", "place", "none")), every)
    apart = terms.groupBy(*own).cogroup(ends.groupBy(*own)).applyInArrow(
        lambda left, right: _differences(left, right, size), "lang string, a int, b int, value long"
    )
    # Inside one block both orders are there; between blocks only one.
    turned = apart.filter(F.floor(F.col("a") / size) != F.floor(F.col("b") / size)).select(
        "lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"
    )
    summed = apart.unionByName(turned).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    one = groups.select("lang", "source", F.col("place").alias("a"), F.col("none").alias("p"), "kept")
    two = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("none").alias("q"))
    pairs = one.join(two, "lang").filter("a <> b")
    value = F.col("kept") * F.abs(F.col("p") - F.col("q")) + F.coalesce("more", F.lit(0))
    return pairs.join(summed, ["lang", "a", "b"], "left").select("lang", "source", "item", value.alias("value"))


def outstanding(counts: Counts) -> DataFrame:
    """``lang, source, item, value`` for each word whose share in a source exceeds that in its language."""
    groups = counts.groups
    whole = groups.groupBy("lang").agg(F.sum("n").alias("whole"))
    known = groups.select("lang", "source", F.col("n").alias("size"), "kept").join(whole, "lang")
    joined = counts.terms.join(known, ["lang", "source"])
    p = share(F.col("n"), F.col("size"), F.col("kept"))
    q = share(F.col("everywhere"), F.col("whole"), F.col("kept"))
    return joined.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source, and the words that stand out."""
    counts = count_kept(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        part.withColumns({"part": F.lit(name), "rank": F.row_number().over(order)})
        for name, part in (("pair", compare(counts, block)), ("term", outstanding(counts)))
    ]
    ranked[1] = ranked[1].filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(*columns).unionByName(ranked[1].select(*columns))
