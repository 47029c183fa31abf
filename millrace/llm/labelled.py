"""Labels of documents, whole or in bounded samples, and the folds that hold labels out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import stage_table


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the id as text; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def known_labels(labels: DataFrame, label: str, learn: Column | None) -> DataFrame:
    """``doc_id`` and ``label`` of every labelled id.

    Only 0 and 1 count as labels; of several for one id the largest.
    """
    known = labels.filter(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if learn is None else learn)
    )
    return known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column | None, sample: int
) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of at most ``sample`` labelled ids.

    The ids with the smallest hash are taken, so the sample is the same on every run. Only 0 and
    1 count as labels; of several for one id the largest. The broadcast side has ``sample`` rows.
    """
    labelled = known_labels(labels, label, learn)
    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    # Only hashes that can be among the smallest are sorted, so that every task of a large table
    # passes on few rows; a fifth more than the sample is kept for chance.
    share = 1.2 * sample / max(1, labelled.count()) + 0.001
    if share < 1:
        labelled = labelled.filter(hashed < int((2 * share - 1) * (1 << 63)))
    chosen = labelled.orderBy(hashed, "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def bounded_rows(rows: DataFrame, value: str, sample: int) -> DataFrame:
    """At most ``sample`` of the rows ``doc_id, label, value``, sorted; no id is lost to repeats of another.

    Rows that repeat id and value count once. Of each id the value with the least hash comes
    first, and further values of an id only fill the room that is left. ``rows`` holds at most
    ``sample`` ids, so the broadcast side is bounded.
    """
    each = stage_table(rows.select("doc_id", "label", value).distinct(), "labelled")
    hashed = F.xxhash64(value)
    first = each.groupBy("doc_id").agg(F.min(hashed).alias("first"))
    taken = (
        each.join(F.broadcast(first), "doc_id")
        .orderBy(hashed != F.col("first"), F.xxhash64("doc_id", hashed), "doc_id", value)
        .limit(sample)
    )
    return taken.select("doc_id", "label", value).orderBy("doc_id", "label", value)
