"""N-gram Jaccard join with MinHash banding.

Texts are sets of hashed runs of five words. Bands of rows of MinHash values are chosen for a
target recall at the threshold: of all shapes within ``MOST`` hashes, the one with the most rows,
which has the fewest false candidates. Texts that agree in a band meet in a shuffle on the hash of
the band; what meets is verified on the full n-gram sets.

Exact copies are one class from the start, and only classes are compared. A bucket of up to
``PAIRS`` classes gives its pairs. Larger buckets would give pairs by the square of their size, so
their classes are gathered into families (components of buckets), a family is dealt into blocks of
bounded size, and one task compares two blocks: it tells pairs that share a band, verifies them
with bit sets and returns for each class its number of links and one neighbour towards a spanning
tree. No row is made for a pair there, and no link is lost. Groups are components of all links.

Defined cases: null and empty texts (and those of white space only) are links of nothing but
equal texts; texts of one to four words have one n-gram; rows without id belong to the class of
their text and are compared like any other, and a group without any id has a null class; repeated
rows are copies;
with several texts for one id each text is compared on its own; an empty table gives an empty
result. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from millrace.llm.components import components
from millrace.llm.texts import (
    SHINGLE_WORDS,
    WHITESPACE,
    hash_spans,
    list_array,
    mix,
    shingle_hashes,
    shingle_sets,
    slices,
    spans,
)
from millrace.sources.scratch import stage_table

#: Least similarity of a link.
THRESHOLD = 0.8
#: Share of pairs at the threshold that must become candidates.
RECALL = 0.999
#: Most MinHash values of a text.
MOST = 256
#: Largest bucket whose pairs are listed.
PAIRS = 24
#: Classes, and n-grams, in a block of a family.
BLOCK_CLASSES = 1024
BLOCK_GRAMS = 1 << 19


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands reach the recall within ``most`` values."""
    best = None
    for rows in range(1, most + 1):
        missed = 1 - threshold**rows
        bands = ceil(log(1 - recall) / log(missed)) if 0 < missed < 1 else most + 1
        if missed <= 0:
            bands = 1
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError(f"{most} values cannot reach a recall of {recall}")
    return best


def band_hashes(texts: pa.Array, bands: int, rows: int) -> pa.Array:
    """The band hashes of each text; an empty list for a text without words."""
    draw = np.random.default_rng(20_240_601)
    turn = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    times = draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = []
    for _, _, data, offsets in slices(texts):
        starts, ends, first = spans(data, offsets, WHITESPACE)
        hashes, begin = shingle_hashes(hash_spans(data, starts, ends), first, SHINGLE_WORDS)
        some = np.diff(begin) > 0
        at = begin[:-1][some]
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(at), bands), dtype=np.uint64)
        for band in range(bands):
            joined = np.full(len(at), band, dtype=np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                value = np.minimum.reduceat((low ^ turn[k]) * times[k], at) if len(at) else low[:0]
                joined = mix(joined ^ value.astype(np.uint64)) * np.uint64(3)
            least[:, band] = joined
        signed = mix(least).view(np.int64)
        which = np.cumsum(some) - 1
        out += [signed[which[k]] if some[k] else signed[:0].ravel()[:0] for k in range(len(some))]
    return list_array(out, pa.int64())


def bands_of(text: Column, bands: int, rows: int) -> Column:
    @F.arrow_udf(ArrayType(LongType()))
    def banded(texts: pa.Array) -> pa.Array:
        return band_hashes(texts, bands, rows)

    return banded(text)


@F.arrow_udf(ArrayType(LongType()))
def grams(texts: pa.Array) -> pa.Array:
    """The distinct n-gram hashes of each text, ascending."""
    return list_array([s.view(np.int64) for s in shingle_sets(texts)], pa.int64())


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Sets as bit rows over the n-grams that at least two sets hold."""
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
    known, place, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often > 1
    column = np.cumsum(shared) - 1
    wide = (int(shared.sum()) + 63) // 64
    rows = np.zeros((len(sets), max(wide, 1)), dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    held = shared[place]
    column = column[place[held]].astype(np.uint64)
    # Straight into words of 64 bits; a row of bytes for each n-gram would take eight times as much.
    bit = np.uint64(1) << (column & np.uint64(63))
    np.bitwise_or.at(rows, (owner[held], (column >> np.uint64(6)).astype(np.int64)), bit)
    return rows


def links_of(sets: list[np.ndarray], bands: np.ndarray, left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs, as indices, among sets that share a band.

    With ``left`` > 0 only pairs of one of the first ``left`` sets and one of the others.
    """
    number = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = _bits(sets)
    from_rows, to_rows = [], []
    for a in range(left or number):
        others = np.arange(left or a + 1, number)
        met = others[(bands[others] == bands[a]).any(axis=1)]
        met = met[np.minimum(sizes[met], sizes[a]) >= threshold * np.maximum(sizes[met], sizes[a])]
        if len(met):
            both = np.bitwise_count(bits[met] & bits[a]).sum(axis=1, dtype=np.int64)
            near = met[both >= threshold * (sizes[met] + sizes[a] - both) - 1e-9]
            from_rows.append(np.full(len(near), a))
            to_rows.append(near)
    nothing = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(from_rows or nothing), np.concatenate(to_rows or nothing)


def _roots(number: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in the component of each of ``number`` nodes."""
    root = np.arange(number)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare_blocks(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("block", "ascending"), ("key", "ascending")])
        key = table["key"].to_numpy()
        copies = table["copies"].to_numpy()
        block = table["block"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left = 0 if low == high else int((block == low).sum())
        links, root = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
        # Of two blocks one may be empty; the rows of the other are compared where it meets itself.
        if low == high or 0 < left < len(key):
            sets = [np.asarray(x.values) for x in table["grams"].combine_chunks()]
            bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(key), -1)
            a, b = links_of(sets, bands, left, threshold)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = _roots(len(key), a, b)
        return pa.table({"key": key, "links": links, "root": key[root]})

    return compare


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For each row its ``doc_id``, ``class_id``, ``copy_id``, ``n_copies`` and ``n_links``.

    ``class_id`` is the least id among all documents reached by links, ``copy_id`` the least among
    those of equal text; ``n_links`` counts the other documents at or above the threshold, copies
    included, and ``n_copies`` the other documents of equal text.
    """
    bands, rows = banding(threshold, recall)
    text = F.coalesce("text", F.lit(""))
    signed = stage_table(
        docs.select("doc_id", F.xxhash64(text).alias("key"), bands_of(text, bands, rows).alias("bands")),
        "bands",
    )
    classes = stage_table(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")
        ),
        "classes",
    )
    entries = classes.select("key", F.posexplode("bands").alias("band", "hash")).select(
        "key", F.xxhash64("band", "hash").alias("bucket")
    )
    buckets = stage_table(
        entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("leader")).filter("n > 1"),
        "buckets",
    )
    met = stage_table(entries.join(buckets, "bucket"), "met")
    large = met.filter(F.col("n") > PAIRS)
    families = _empty(docs, "key long, family long")
    if not large.isEmpty():
        star = large.select(F.col("key").alias("a"), F.col("leader").alias("b"))
        families = components(star).select(F.col("node").alias("key"), F.col("root").alias("family"))
    small = met.filter(F.col("n") <= PAIRS).select("key", "bucket").join(families, "key", "left")
    other = small.select("bucket", F.col("key").alias("b"), F.col("family").alias("family_b"))
    apart = F.col("family").isNull() | F.col("family_b").isNull() | (F.col("family") != F.col("family_b"))
    pairs = (
        small.join(other, (small["bucket"] == other["bucket"]) & (F.col("key") < F.col("b")) & apart)
        .select(F.col("key").alias("a"), "b")
        .distinct()
    )
    pairs = stage_table(pairs, "pairs")
    # The n-gram sets of those classes alone that have someone to be compared with.
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(families.select("key")).distinct()
    wanted = classes.join(needed, "key").select("doc_id", "key")
    texts = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    named = texts.join(wanted, ["doc_id", "key"]).select("key", "text")
    # Copies without id are one row before they meet.
    unnamed = texts.filter("doc_id IS NULL").select("key", "text").distinct()
    unnamed = unnamed.join(wanted.filter("doc_id IS NULL").select("key"), "key").select("key", "text")
    # Of equal texts one is left before any is shingled; tasks drop theirs before they send them.
    once = named.union(unnamed).dropDuplicates(["key"])
    sets = stage_table(once.select("key", grams("text").alias("grams")), "grams")
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    whole = F.size("grams_a") + F.size("grams_b") - both
    linked = stage_table(
        pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("grams_a")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("grams").alias("grams_b")), "b")
        .filter(both >= threshold * whole - 1e-9)
        .select("a", "b"),
        "linked",
    )
    compared = stage_table(_compare_families(families, sets, classes, threshold), "compared")
    edges = linked.union(compared.filter("root != key").select(F.col("key").alias("a"), F.col("root").alias("b")))
    roots = components(edges).select(F.col("node").alias("key"), "root")
    sizes = classes.select("key", "copies")
    ends = linked.select(F.col("a").alias("key"), F.col("b").alias("far")).union(linked.select("b", "a"))
    counted = (
        ends.join(sizes.select(F.col("key").alias("far"), "copies"), "far")
        .select("key", F.col("copies").alias("links"))
        .union(compared.select("key", "links"))
        .groupBy("key")
        .agg(F.sum("links").alias("links"))
    )
    placed = (
        classes.select("key", F.col("doc_id").alias("copy_id"), "copies")
        .join(roots, "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
        .join(counted, "key", "left")
    )
    least = placed.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    found = placed.join(least, "root").select(
        "key",
        "class_id",
        "copy_id",
        (F.col("copies") - 1).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return signed.select("doc_id", "key").join(found, "key").drop("key")


def _compare_families(families: DataFrame, sets: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    # Which block a class is in is settled on small rows; n-grams move by key and by block pair.
    sized = families.join(sets.select("key", F.size("grams").alias("size")), "key")
    blocks = sized.groupBy("family").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("size") / BLOCK_GRAMS, F.lit(1.0))).alias("blocks")
    )
    dealt = stage_table(
        sized.join(blocks, "family").select(
            "key", "family", "blocks", F.pmod(F.xxhash64("key", F.lit(1)), "blocks").alias("block")
        ),
        "blocks",
    )
    # A block meets itself and every other block of its family.
    meets = (
        dealt.join(sets, "key")
        .join(classes.select("key", "bands", "copies"), "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    # One key, so that the pairs of blocks of a family are dealt out apart.
    return (
        meets.select(F.struct("family", low, high).alias("pair"), low, high, "block", "key", "copies", "bands", "grams")
        .groupBy("pair")
        .applyInArrow(_compare_blocks(threshold), "key long, links long, root long")
    )
