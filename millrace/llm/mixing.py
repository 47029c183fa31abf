"""Mixing sources to target word counts by entropy balancing.

Each document gets a rate, the number of times the mix takes it on average. Among all rates that
meet the word target of every source, entropy balancing takes those nearest to one in relative
entropy: a document of ``size`` words in a source with multiplier ``m`` has the rate
``min(cap, exp(m * size))``. The multipliers solve a convex dual, source by source, with Newton's
method inside a bracket; every iteration is one distributed sum over (source, size) cells, and
the state of all sources is a written table, so nothing grows on the driver.

Rates are rounded to whole copies by error diffusion: documents of a source are dealt by hash
into blocks of about ``BLOCK``, and within a block, from the longest to the shortest, each takes
the number of copies that brings the words taken nearest to the sum of rates so far. The error
left in a block is about half of its shortest document. Large sources are many blocks. Equal rows
are rounded together, to one total of copies, which is dealt so that their numbers differ by one at
most.

Defined cases: null and empty texts have size 0, rate 1 and take 0 words; a null source is a
source of its own, last in order; of rows with equal id, source and size (repeated rows) some may get
one copy more than the others; rows without id are dealt as one id; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import stage_table

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: All targets together, as a share of all words.
TOTAL = 1.5
#: Most copies of a document, and so the largest target as a multiple of the source's size.
CAP = 2
#: Documents in a block of the rounding.
BLOCK = 500
#: Newton iterations end when every source is this near its target, relative to its size.
TOLERANCE = 1e-9
#: Iterations at most; the bracket alone halves the error each time.
ITERATIONS = 60


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    cells: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, cap: float = CAP
) -> DataFrame:
    """``source``, ``source_size``, ``documents`` and ``target`` of each source.

    ``cells`` holds ``source, size, n``. Targets share ``total`` times all words by weight; none
    is above ``cap`` times its source, and what it cannot take is shared by the others. There is
    one row for each source, so these windows see sources and not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = (cap * F.col("source_size") / F.col("weight")).alias("ratio")
    sized = cells.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")
    )
    weighted = sized.withColumn(
        "weight",
        F.element_at(
            F.array(*(F.lit(float(w)) for w in weights)),
            (F.row_number().over(by_name) - 1) % len(weights) + 1,
        ),
    ).withColumn("ratio", ratio)
    order = [F.col("ratio"), F.col("source").asc_nulls_last()]
    filled = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    # The level if all sources before this one, by ratio, are full: the first that it does not
    # fill is where filling ends.
    level = (
        total * F.sum("source_size").over(every)
        - cap * F.coalesce(F.sum("source_size").over(filled), F.lit(0))
    ) / F.sum("weight").over(rest)
    levels = weighted.withColumn("level", level)
    end = F.min_by(
        F.when(F.col("level") < F.col("ratio"), F.col("level")),
        F.when(F.col("level") < F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source")),
    ).over(every)
    most = cap * F.col("source_size").cast("double")
    return levels.withColumn("end", end).select(
        "source",
        "source_size",
        "documents",
        F.least(most, F.coalesce(F.col("weight") * F.col("end"), most)).alias("target"),
    )


def multipliers(cells: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """``wanted`` with the multiplier ``tilt`` of each source: distributed Newton iterations."""
    top = float(np.log(cap))
    scaled = cells.groupBy("source").agg(
        F.try_divide(
            F.sum(F.col("n") * F.col("size").cast("double") ** 2), F.sum(F.col("n") * F.col("size"))
        ).alias("unit")
    ).withColumnRenamed("source", "__source")
    state = (
        wanted.join(scaled, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("unit", F.coalesce("unit", F.lit(1.0)))
        # Multipliers are searched between rates of practically none and of the cap for a
        # document of one word.
        .withColumn("low", -60 * F.col("unit"))
        .withColumn("high", top * F.col("unit"))
        .withColumn("at", F.log(F.greatest(F.col("target"), F.lit(1e-300)) / F.greatest("source_size", F.lit(1))))
        .withColumn("at", F.least(F.greatest("at", "low"), "high"))
        .withColumn("open", (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - TOLERANCE)))
        .withColumn("at", F.when(F.col("open"), F.col("at")).otherwise(F.col("high")))
    )
    state = stage_table(state, "mixing")
    step = cells.withColumnRenamed("source", "__source")
    for _ in range(ITERATIONS):
        if state.filter("open").isEmpty():
            break
        power = F.col("at") * F.col("size") / F.col("unit")
        rate = F.when(power >= top, F.lit(float(cap))).otherwise(F.exp(power))
        words = F.col("n") * F.col("size")
        bend = F.when(power < top, words * F.col("size") / F.col("unit") * F.exp(power)).otherwise(0.0)
        sums = (
            step.join(state.filter("open"), F.col("__source").eqNullSafe(F.col("source")))
            .groupBy("__source")
            .agg(F.sum(words * rate).alias("got"), F.sum(bend).alias("bend"))
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("at")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("at")).otherwise(F.col("high"))
        newton = F.col("at") - F.try_divide(miss, F.col("bend"))
        inside = (F.col("bend") > 0) & (newton > low) & (newton < high)
        near = F.abs(miss) <= TOLERANCE * F.col("source_size")
        moved = joined.select(
            "source", "source_size", "documents", "target", "unit",
            F.when(F.col("open"), low).otherwise(F.col("low")).alias("low"),
            F.when(F.col("open"), high).otherwise(F.col("high")).alias("high"),
            F.when(~F.col("open") | near, F.col("at"))
            .when(inside, newton)
            .otherwise((low + high) / 2)
            .alias("at"),
            (F.col("open") & ~near).alias("open"),
        )
        state = stage_table(moved, "mixing")
    return state.select(
        "source", "source_size", "documents", "target", (F.col("at") / F.col("unit")).alias("tilt")
    )


def _rounded(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values(["size", "deal", "doc_id"], ascending=[False, True, True])
    mass = (block["size"] * block["n"]).to_numpy(dtype=float)
    ahead = np.cumsum(mass * block["rate"].to_numpy())
    size, n = block["size"].to_numpy(), block["n"].to_numpy()
    # Copies of all equal rows together.
    total, taken = n.astype(np.int64), 0.0
    for k in range(len(block)):
        if mass[k]:
            total[k] = min(max(int(np.floor((ahead[k] - taken) / size[k] + 0.5)), 0), CAP * n[k])
            taken += float(total[k]) * size[k]
    copies, more = total // n, total % n
    dealt = pd.concat([block.assign(copies=copies, n=n - more), block.assign(copies=copies + 1, n=more)])
    return dealt[dealt["n"] > 0]


def mix(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL
) -> DataFrame:
    """Copies of each document: ``doc_id, source, size, n, source_size, target, rate, copies``.

    ``sized`` holds ``doc_id``, ``source`` and ``size``; it is read several times, so give a
    written table. Equal rows come as one row with their number ``n``, or as two, of which one has
    a copy more.
    """
    cells = stage_table(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-cells")
    solved = multipliers(cells, targets(cells, weights, total)).withColumnRenamed("source", "__source")
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rate = F.least(F.lit(float(CAP)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(50.0))))
    deal = F.xxhash64(F.col("doc_id"))
    dealt = (
        units.join(solved, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("rate", rate)
        .withColumn("deal", deal)
        .withColumn("block", F.pmod(deal, F.ceil(F.col("documents") / BLOCK)))
        .drop("tilt", "documents")
    )
    schema = "doc_id long, source string, size long, n long, source_size long, target double, rate double, deal long, block long, copies long"
    return dealt.select(
        F.col("doc_id").cast("long"), "source", "size", "n", "source_size", "target", "rate", "deal", "block"
    ).groupBy("source", "block").applyInPandas(_rounded, schema).drop("deal", "block")


def dealt(sized: DataFrame) -> DataFrame:
    """``unit, row, m, total``: the copies of all ``m`` rows of one content together.

    ``sized`` is as for ``mix``, with a hash ``row`` of all that a row holds; ``unit`` is the struct
    of id, source and size. Contents of a unit take their copies in the order of the hash: its top
    bits are summed first, so that no task numbers a whole unit.
    """
    unit = F.struct("doc_id", "source", "size").alias("unit")
    taken = mix(sized).groupBy(unit).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("copies")).alias("all"))
    rows = (
        sized.groupBy(unit, "row")
        .agg(F.count("*").alias("m"))
        .join(taken, "unit")
        .select("unit", "row", "m", F.shiftright("row", 52).alias("part"), F.expr("all div n").alias("each"), F.expr("all % n").alias("more"))
    )
    rows = stage_table(rows, "mixing-rows")
    cells = rows.filter("more > 0").groupBy("unit", "part").agg(F.sum("m").alias("held"))
    before = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("unit", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("unit", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("start") + F.coalesce(F.sum("m").over(inside), F.lit(0))
    extra = F.least(F.greatest(F.col("more") - place, F.lit(0)), F.col("m"))
    some = rows.filter("more > 0").join(starts, ["unit", "part"])
    return (
        some.select("unit", "row", "m", (F.col("m") * F.col("each") + extra).alias("total"))
        .union(rows.filter("more = 0").select("unit", "row", "m", (F.col("m") * F.col("each")).alias("total")))
    )
