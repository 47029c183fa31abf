"""A store of records that takes upserts by rewriting only what they touch.

Records lie in Parquet, in buckets by the hash of their key; the number of buckets is part of the
layout, so it is the same for every writer. An upsert reads the buckets of its keys, puts the
newest record of each key in, and replaces just those buckets by dynamic partition overwrite.
A batch that comes twice, or late, changes nothing: of each key the highest version stays.

Defined cases: rows without a version count as the oldest; a null key is a key; an empty batch
writes nothing; columns may have any names but the two of the layout; a batch must have the
columns of the store. One writer at a time: two at once could each miss the other's records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.types import quoted
from millrace.operators.chunks import latest
from millrace.operators.columns import require_columns
from millrace.sources.readers import SourceError
from millrace.sources.scratch import new_path, remove

#: Buckets of a new store. At 100 TB give many more, so that a bucket is some gigabytes.
BUCKETS = 64
_OF, _BUCKET = "__of", "__bucket"


def store_buckets(spark: SparkSession, store: str) -> int | None:
    """The number of buckets of a store, or None if there is none. Lists one folder, runs no job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [str(f.getPath().getName()) for f in files.listStatus(path)]
    found = {int(n.partition("=")[2]) for n in names if n.startswith(f"{_OF}=")}
    if len(found) > 1:
        raise SourceError(f"{store} mixes buckets by {', '.join(map(str, sorted(found)))}")
    return found.pop() if found else None


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All records of a store."""
    if store_buckets(spark, store) is None:
        raise SourceError(f"not found: a store at {store}")
    return spark.read.parquet(store).drop(_OF, _BUCKET)


def upsert_store(new: DataFrame, store: str, key: str, version: str, buckets: int = BUCKETS) -> list[int]:
    """Put ``new`` into the store at ``store``; returns the buckets that were rewritten.

    ``buckets`` counts for a new store only. The numbers of the touched buckets are collected, at
    most one for each bucket, so that the read is pruned to their folders. The merged buckets are
    written aside first, because Spark cannot overwrite what it reads.
    """
    spark = new.sparkSession
    require_columns(new, [key, version])
    given = store_buckets(spark, store)
    buckets = given or buckets
    bucket = F.pmod(F.xxhash64(F.col(quoted(key))), F.lit(buckets)).cast("int")
    columns = new.columns
    if given is None:
        incoming = latest(new, key, version)
    else:
        known = spark.read.parquet(store)
        columns = [c for c in known.columns if c not in (_OF, _BUCKET)]
        if sorted(columns) != sorted(new.columns):
            raise ValueError(f"the store has the columns {columns}, the batch {new.columns}")
        # Equal keys of another type would have another hash.
        new = new.select(*[F.col(quoted(c)).cast(known.schema[c].dataType).alias(c) for c in columns])
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())
        if not touched:
            return []
        held = known.filter(F.col(_BUCKET).isin(touched)).drop(_OF, _BUCKET)
        incoming = latest(held.unionByName(latest(new, key, version)), key, version)
    own = [F.col(quoted(c)) for c in columns]
    merged = incoming.select(*own, F.lit(buckets).alias(_OF), bucket.alias(_BUCKET))
    aside = new_path(spark, "upsert")
    try:
        merged.write.parquet(aside)
        written = spark.read.schema(merged.schema).parquet(aside)
        touched = sorted(r[0] for r in written.select(_BUCKET).distinct().collect())
        if touched:
            writer = written.repartition(_BUCKET).write.mode("overwrite").partitionBy(_OF, _BUCKET)
            writer.option("partitionOverwriteMode", "dynamic").parquet(store)
    finally:
        remove(spark, aside)
    return touched
