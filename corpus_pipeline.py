"""From raw documents to tokens: rank, deduplicate, redact, mix, encode.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes the result of each as Parquet below the folder in
``spark.checkpoint.dir`` and reads it back for the next.

Defined cases follow those of the operators: null texts count as empty; rows without id take part
in every stage; if texts that differ share an id, the stage of near copies keeps or drops them
together; documents without words are kept once by the mix; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, quality, secrets
from millrace.llm.queries import tokenized
from millrace.queries.registry import table
from millrace.sources.scratch import new_path, stage_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at or above the quantile of the preference model go on."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(quality.score(model, F.col("text")) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays.

    Documents without id rank behind all others, by the hash of their text.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.coalesce("doc_id", F.shiftrightunsigned(text, 2).bitwiseOR(F.lit(1 << 62)))
    named = docs.withColumns({"__id": own, "__text": text})
    groups = jaccard.jaccard_groups(named.select(F.col("__id").alias("doc_id"), "text"))
    leaders = groups.filter("doc_id = class_id").select(F.col("doc_id").alias("__id")).distinct()
    # Rows that repeat the leader's id and text are copies of it: the first in the order of the
    # columns, nulls last. Tasks keep one of theirs before they send any.
    order = F.struct(*(x for k, c in enumerate(docs.columns) for x in (F.col(c).isNull().alias(f"n{k}"), F.col(c).alias(f"c{k}"))))
    held = named.join(leaders, "__id", "left_semi").groupBy("__id", "__text").agg(F.min(order).alias("row"))
    return held.select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings of the ledger are replaced by a mark; ``n_chars`` follows."""
    ledger = new_path(spark, "secret-ledger")
    secrets.scan(docs, ledger)
    named = secrets.findings(docs, ledger, into="__found")
    found = F.col("__found")
    text = F.when(F.size(found) > 0, secrets.redacted(F.col("text"), found)).otherwise(F.col("text"))
    changed = named.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.when(F.size(found) > 0, F.length("text")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is repeated as often as the mix takes it."""
    size = mixing.size_of(F.col("text")).alias("size")
    # Nulls are no part of a hash, so that where they are is hashed with it.
    row = F.xxhash64(*(x for c in docs.columns for x in (F.col(c), F.col(c).isNull())))
    sized = stage_table(docs.select(F.col("doc_id").cast("long"), "source", size, row.alias("row")), "sized")
    dealt = stage_table(mixing.dealt(sized).filter("total > 0"), "dealt").select(
        F.col("unit").alias("__unit"), F.col("row").alias("__row"), F.col("m").alias("__m"), F.col("total").alias("__total")
    )
    named = docs.withColumns({"__unit": F.struct(F.col("doc_id").cast("long").alias("doc_id"), "source", size), "__row": row})
    held = named.join(dealt.filter("__m = 1"), ["__unit", "__row"]).select(*docs.columns, "__total")
    repeated = dealt.filter("__m > 1")
    if not repeated.isEmpty():
        # Equal rows become one, which is then repeated as often as all of them are taken.
        once = named.join(repeated, ["__unit", "__row"]).select(*docs.columns, "__total").distinct()
        held = held.union(once)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__total")))
    return held.withColumn("__copy", copy).select(*docs.columns)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, as digests, with the digest of what they decode to."""
    return tokenized(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality ranking", keep_quality),
    ("near copies", drop_near_copies),
    ("secret ledger", redact_secrets),
    ("entropy mixing", mix_sources),
    ("byte BPE", encode_documents),
]

# Model fitting, MinHash and byte pair merges have no SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
