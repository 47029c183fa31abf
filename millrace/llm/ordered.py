"""Each row next to the row that follows it, without sorting the table in one task.

Keys are cut into ranges at approximate quantiles. A range is a group that a window can sort, and
the first rows of each range are copied to the end of the range before it. The driver holds the
cuts and the first key of each range, whose number is set by the number of shuffle partitions. A
single key that fills much of the table stays one range; give keys that are nearly unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Ranges for each shuffle partition, so that ranges spread evenly over the partitions; at least
#: two, once there are many partitions.
RANGES = 16
MANY = 4096


def with_next(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: the ``value`` of the next row by the integer ``key``; the
    last row's is the first row's.

    Rows with equal keys are in the order of their values; null keys come first. A single row
    follows itself.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = max(2 * partitions, min(RANGES * partitions, MANY))
    whole = F.col(key).cast("long")
    cuts = df.agg(F.percentile_approx(whole, [k / number for k in range(1, number)], 10 * number)).first()[0]
    edges = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.arrow_udf(LongType())
    def place(keys: pa.Array) -> pa.Array:
        found = np.searchsorted(edges, pc.fill_null(keys, np.iinfo(np.int64).min).to_numpy(), side="left")
        return pa.array(np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, found))

    ranged = df.withColumn("__at", place(whole))
    # A row for each range: its first key, null if it holds a null key.
    first = F.min(F.struct(whole.isNotNull().alias("known"), whole.alias("key"))).alias("first")
    heads = ranged.groupBy("__at").agg(first).orderBy("__at").collect()
    if not heads:
        return df.withColumn(name, F.col(value))
    at = np.array([row["__at"] for row in heads])
    before = np.roll(at, 1)  # the first range goes to the last
    known = np.array([row["first"]["known"] for row in heads])
    head = np.array([row["first"]["key"] if row["first"]["known"] else 0 for row in heads], dtype=np.int64)

    @F.arrow_udf(LongType())
    def copied_to(keys: pa.Array, ranges: pa.Array) -> pa.Array:
        which = np.searchsorted(at, ranges.to_numpy())
        is_null = keys.is_null().to_numpy(zero_copy_only=False)
        equal = pc.fill_null(keys, 0).to_numpy() == head[which]
        leads = np.where(known[which], ~is_null & equal, is_null)
        return pa.array(before[which], mask=~leads)

    places = F.filter(
        F.array(
            F.struct(F.col("__at").alias("at"), F.lit(False).alias("copy")),
            F.struct(copied_to(whole, F.col("__at")).alias("at"), F.lit(True).alias("copy")),
        ),
        lambda p: p["at"].isNotNull(),
    )
    spread = ranged.select(*df.columns, F.inline(places).alias("__range", "__copy"))
    order = Window.partitionBy("__range").orderBy(
        "__copy", F.col(key).asc_nulls_first(), F.col(value).asc_nulls_first()
    )
    return (
        spread.withColumn(name, F.lead(value).over(order))
        .filter(~F.col("__copy"))
        .drop("__range", "__copy")
    )
