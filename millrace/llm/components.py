"""Connected components by least labels, with every round in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import remove, stage_path


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for edges ``a, b`` of longs.

    In a round every node takes the least label among its own and its neighbours', then the label
    of that label, so that long chains shorten by jumps. It ends when no label changes, which
    the sum of labels shows, because labels only fall. Repeated edges and loops do no harm.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    spark = edges.sparkSession
    both, held = stage_path(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    (labels, path), last = stage_path(labels, "labels"), None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == last:
            remove(spark, held)
            return labels
        last = total
        spread = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root")
        near = labels.unionByName(spread).groupBy("node").agg(F.min("root").alias("root"))
        near, nearby = stage_path(near, "labels")
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels, new = stage_path(near.join(jump, "root").select("node", F.col("further").alias("root")), "labels")
        # Nothing reads the tables of the round before.
        for done in (path, nearby):
            remove(spark, done)
        path = new
