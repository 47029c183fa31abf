"""Scratch space for staged tables, on the shared folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder, because there
    driver and tasks share one disk. A cluster session must name shared storage.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set(_SETTING, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: cuts lineage, survives lost executors."""
    return stage_path(df, label)[0]


def stage_path(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``stage_table``, with the path, for those who remove the table when they are done."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that ``new_path`` has given out, through the file system it is on."""
    if not path.startswith(f"{shared_folder(spark)}/millrace/"):
        raise ValueError(f"{path} is not a scratch path")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def beside(path: str) -> str:
    """A path next to ``path``, on the same file system, that no earlier run has used."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{name}-{uuid.uuid4().hex}"


def swap(spark: SparkSession, written: str, path: str) -> None:
    """Put the table at ``written`` in the place of whatever is at ``path``.

    Two renames: the old table steps aside and comes back if the second fails. On a file system
    a rename is one step; an object store copies instead, so there readers should wait.
    """
    new, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (written, path))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        if not files.rename(new, target):
            raise OSError(f"cannot move {written} to {path}")
        return
    old = spark._jvm.org.apache.hadoop.fs.Path(beside(path))
    if not files.rename(target, old):
        raise OSError(f"cannot move the table at {path} aside")
    try:
        moved = files.rename(new, target)
    except Exception:
        files.rename(old, target)
        raise
    if not moved:
        files.rename(old, target)
        raise OSError(f"cannot move {written} to {path}")
    files.delete(old, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that ``beside`` has given out, if something is there."""
    name = path.rpartition("/")[2]
    if not name.startswith("_"):
        raise ValueError(f"{path} is not beside a table")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
