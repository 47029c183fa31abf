"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Nearness is the inner product. An added coordinate turns it into Euclidean distance: vectors get
the length of the longest one, queries are scaled to that length. A Gaussian matrix, which is
2-stable, projects all to ``PROJECTED`` dimensions; the squared projected distance of two points,
divided by their squared distance, follows a chi-square law with that many degrees of freedom.

Every query meets points in the order of projected distance, kd-tree leaf by leaf, and verifies
them by true inner products. It stops when the chi-square test holds: a point as near as its
present k-th neighbour would lie within the projected distance reached with probability
``CONFIDENCE``.

In Spark, the upper levels of the kd-tree come from a bounded sample and deal all vectors into
shards; cells with many rows (copies of one vector, say) are split by hash. Each query goes to
the shards that its test, started from its neighbours in the sample, cannot rule out. A task
holds one shard and one block of queries, builds the lower tree, and returns the best ``k`` of
each query, which are then merged.

Defined cases: vectors that are null, zero, or hold null or non-finite components, those without
id, and those whose length is not the most common one (of equally common ones the smallest) take
no part; a query never finds its own id; equal scores go to the smaller id; rows with one id and
equal vectors are one candidate; a table with fewer candidates gives all; an empty table gives an
empty result.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions of the projection, an even number.
PROJECTED = 8
#: Probability with which a k-th neighbour lies within the projected distance searched.
CONFIDENCE = 0.97
#: Vectors from which the upper tree and the first bounds are made.
SAMPLE = 4096
#: Vectors in a shard, and in a leaf.
SHARD = 8192
LEAF = 256
#: Queries in a block.
QUERIES = 8192
#: Most cells of the upper tree.
CELLS = 1024

_RESULT = "query_id long, vec_id long, score double"


def chi_square_quantile(confidence: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees exceeds so rarely."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        half = (low + high) / 4
        inside = 1 - exp(-half) * sum(half**j / factorial(j) for j in range(degrees // 2))
        low, high = ((low + high) / 2, high) if inside < confidence else (low, (low + high) / 2)
    return high


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components, not all of them zero."""
    value = vector.cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(value, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(chunk), -1) if len(chunk) else np.zeros((0, 0))


class Projection:
    """Points and queries in the projected space."""

    def __init__(self, size: int, longest: float, seed: int = 11):
        self.longest = longest
        self.basis = np.random.default_rng(seed).standard_normal((size + 1, PROJECTED))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return vectors @ self.basis[:-1] + lift[:, None] * self.basis[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.basis[:-1] * self._scale(vectors)[:, None]

    def _scale(self, vectors: np.ndarray) -> np.ndarray:
        return self.longest / np.sqrt((vectors**2).sum(axis=1))

    def squared(self, vectors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The squared distance that goes with the inner product of each query."""
        return np.maximum(2 * self.longest**2 - 2 * self._scale(vectors) * scores, 0)


def split(points: np.ndarray, leaf: int, most: int) -> tuple[list[tuple[int, float]], int]:
    """Planes of a balanced kd-tree in heap order: (dimension, median); depth."""
    depth = 0
    while len(points) > leaf << depth and 1 << (depth + 1) <= most:
        depth += 1
    planes: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for part in level:
            wide = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            at = float(np.median(part[:, wide])) if len(part) else 0.0
            planes.append((wide, at))
            right = part[:, wide] > at
            below += [part[~right], part[right]]
        level = below
    return planes, depth


def cell_of(points: np.ndarray, planes: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    wide = np.array([p[0] for p in planes] or [0])
    cut = np.array([p[1] for p in planes] or [0.0])
    for _ in range(depth):
        right = points[np.arange(len(points)), wide[node]] > cut[node]
        node = 2 * node + 1 + right
    return node - ((1 << depth) - 1)


def cell_boxes(planes: list[tuple[int, float]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    low = [np.full(PROJECTED, -np.inf)]
    high = [np.full(PROJECTED, np.inf)]
    for node, (wide, cut) in enumerate(planes):
        for right in (False, True):
            low.append(low[node].copy())
            high.append(high[node].copy())
            (low if right else high)[-1][wide] = cut
    return np.array(low[(1 << depth) - 1 :]), np.array(high[(1 << depth) - 1 :])


def to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of every point to every box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        own = points[:, d, None]
        out += np.maximum(np.maximum(low[:, d] - own, own - high[:, d]), 0) ** 2
    return out


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    out, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        wide = int(np.argmax(np.ptp(points[rows], axis=0)))
        order = rows[np.argpartition(points[rows, wide], len(rows) // 2)]
        open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def _distinct(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of equal vectors those with the smallest ids, each id once."""
    raw = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, group = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, group))
    ids, group = ids[order], group[order]
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
    order, group = order[fresh], group[fresh]
    first = np.searchsorted(group, group)
    return np.sort(order[np.arange(len(group)) - first < most])


def search_shard(projection: Projection, ids, vectors, query_ids, queries, bounds, k: int, chi: float):
    """Best ``k`` of one shard for each query: (query row, id, score), by the stopping test."""
    keep = _distinct(ids, vectors, k + 1)
    ids, vectors = ids[keep], vectors[keep]
    points, targets = projection.points(vectors), projection.queries(queries)
    leaves = _leaves(points)
    low = np.array([points[rows].min(axis=0) for rows in leaves])
    high = np.array([points[rows].max(axis=0) for rows in leaves])
    number, slack = len(queries), k + 8
    best = np.full((number, slack), -np.inf)
    held = np.full((number, slack), -1, dtype=np.int64)
    reach = bounds.copy()
    away = to_boxes(targets, low, high)
    order = np.argsort(away, axis=1, kind="stable")
    active = np.arange(number)
    for turn in range(len(leaves)):
        leaf = order[active, turn]
        go = away[active, leaf] <= reach[active] * chi
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        sort = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[sort], prepend=-1, append=len(leaves)))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            who = active[sort[begin:end]]
            rows = leaves[leaf[sort[begin]]]
            scores = queries[who] @ vectors[rows].T
            scores[query_ids[who][:, None] == ids[rows][None, :]] = -np.inf
            better = (scores >= best[who, -1:]).any(axis=1) & (scores.max(axis=1) > -np.inf)
            who, scores = who[better], scores[better]
            if not len(who):
                continue
            every = np.concatenate([best[who], scores], axis=1)
            place = np.concatenate([held[who], np.broadcast_to(rows, scores.shape)], axis=1)
            named = np.where(place >= 0, ids[place], np.iinfo(np.int64).max)
            top = np.lexsort((named, -every), axis=1)[:, :slack]
            best[who] = np.take_along_axis(every, top, axis=1)
            held[who] = np.take_along_axis(place, top, axis=1)
            full = best[who, k - 1] > -np.inf
            now = projection.squared(queries[who[full]], best[who[full], k - 1])
            reach[who[full]] = np.minimum(reach[who[full]], now)
    row, at = np.nonzero(best > -np.inf)
    held = held[row, at]
    # One way of adding up, whatever the matrix product did.
    return row, ids[held], np.einsum("ij,ij->i", queries[row], vectors[held])


def nearest(
    vectors: DataFrame,
    query: Column,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    confidence: float = CONFIDENCE,
    sample: int = SAMPLE,
    shard: int = SHARD,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows to each row that ``query`` marks."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(query, F.lit(False)).alias("asks")
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    lengths = (
        rows.groupBy(F.size("v").alias("size"))
        .agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asked"), F.max(square).alias("square"))
        .orderBy(F.desc("n"), "size")
        .limit(1)
        .collect()
    )
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, number, asked, longest = lengths[0]
    rows = rows.filter(F.size("v") == size)
    projection = Projection(size, float(longest) ** 0.5)
    # A bounded sample, the same on every run.
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()
    known, known_ids = _matrix(drawn["v"]), drawn["id"].to_numpy()
    # A repeated row is one candidate: counted twice, it would make the first bounds too tight.
    once = _distinct(known_ids, known, len(known))
    known, known_ids = known[once], known_ids[once]
    cells = 1
    while cells * shard < number and cells < CELLS and cells * 16 <= len(known):
        cells *= 2
    planes, depth = split(projection.points(known), max(1, len(known) // cells), cells)
    chi = chi_square_quantile(confidence, PROJECTED)

    def placed(batches):
        for batch in batches:
            found = cell_of(projection.points(_matrix(batch["v"])), planes, depth) if len(batch) else []
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], pa.array(found, pa.int64())], ["id", "v", "cell"]
            )

    dealt = rows.select("id", "v").mapInArrow(placed, f"id long, v {rows.schema['v'].dataType.simpleString()}, cell long")
    # One count for each cell, of which there are at most CELLS.
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    parts = {cell: -(-n // shard) for cell, n in counts.items()}
    first = dict(zip(sorted(parts), np.cumsum([0, *(parts[c] for c in sorted(parts))]).tolist(), strict=False))
    low, high = cell_boxes(planes, depth)
    blocks = max(1, -(-int(asked or 0) // QUERIES))

    def routed(batches):
        places = [list(range(first[c], first[c] + parts[c])) if c in parts else [] for c in range(1 << depth)]
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, len(whole), 1024)):
            own, asks = _matrix(batch["v"]), batch["id"].to_numpy()
            bound = np.full(len(own), np.inf)
            scores = own @ known.T
            scores[asks[:, None] == known_ids[None, :]] = -np.inf
            if scores.shape[1] >= k:
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                enough = kth > -np.inf
                bound[enough] = projection.squared(own[enough], kth[enough])
            near = to_boxes(projection.queries(own), low, high) <= np.nextafter(bound, np.inf)[:, None] * chi
            out_row, out_shard = [], []
            for row, cell in zip(*np.nonzero(near), strict=True):
                out_row += [row] * len(places[cell])
                out_shard += places[cell]
            take = pa.array(out_row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(take), batch["v"].take(take), pa.array(bound[out_row], pa.float64()), pa.array(out_shard, pa.int64())],
                ["query_id", "q", "bound", "shard"],
            )

    kind = rows.schema["v"].dataType.simpleString()
    asking = (
        rows.filter("asks")
        .select("id", "v")
        .mapInArrow(routed, f"query_id long, q {kind}, bound double, shard long")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    )
    part = F.create_map(*(F.lit(int(x)) for c in sorted(parts) for x in (c, parts[c])))
    start = F.create_map(*(F.lit(int(x)) for c in sorted(parts) for x in (c, first[c])))
    shards = dealt.withColumn(
        "shard", start[F.col("cell")] + F.pmod(F.xxhash64("id"), part[F.col("cell")])
    ).select("id", "v", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def compare(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            row, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            asks = np.zeros(0, np.int64)
        else:
            asks = right["query_id"].to_numpy()
            row, found, scores = search_shard(
                projection, left["id"].to_numpy(), _matrix(left["v"]), asks, _matrix(right["q"]),
                right["bound"].to_numpy().copy(), k, chi,
            )
        return pa.table({"query_id": asks[row], "vec_id": found, "score": scores})

    found = shards.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(compare, _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
