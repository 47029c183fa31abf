"""Scoring: a placeholder score, model training and applying a fitted pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace.functions.fixed import SCORE_MAX
from millrace.operators.columns import random_column, remainder
from millrace.sources.models import load_model, save_model
from millrace.sources.scratch import new_path, remove

FEATURES = "features"


def placeholder_score(
    df: DataFrame, column: str, name: str = "score", non_negative: bool = False, seed: int = 0
) -> DataFrame:
    """Remainder of a column by 100, as double; a random score when there is no such column.

    The remainder keeps the sign of the column unless ``non_negative``.
    """
    if column not in df.columns:
        return random_column(df, name, seed)
    return df.withColumn(name, remainder(column, SCORE_MAX, non_negative).cast("double"))


def features(columns: Sequence[str]) -> VectorAssembler:
    """Feature assembly for imputed numeric columns; a remaining null fails the job."""
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="error")


def train(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    kind: str = "logistic",
    **settings: object,
) -> PipelineModel:
    """Fit a classifier on numeric columns: "logistic" or "gbt" (boosted trees).

    Training passes over the data many times, so the few columns it needs are kept in memory
    and on disk meanwhile.
    """
    if kind == "logistic":
        classifier = LogisticRegression(labelCol=label, featuresCol=FEATURES, **settings)
    elif kind == "gbt":
        classifier = GBTClassifier(labelCol=label, featuresCol=FEATURES, **settings)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    needed = df.select(*columns, F.col(label).cast("double").alias(label))
    needed = needed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = Pipeline(stages=[features(columns), classifier]).fit(needed)
    finally:
        needed.unpersist()
    return _reloaded(fitted, df.sparkSession)


def _reloaded(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model as read back from a store, without its training summary.

    The summary of a freshly fitted model refers to the session, and Spark cannot send that
    to tasks once a table of the session has been observed.
    """
    path = new_path(spark, "model")
    save_model(model, path)
    try:
        return load_model(path)
    finally:
        remove(spark, path)


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Apply a fitted pipeline; adds ``prediction`` and ``probability``."""
    return model.transform(df).drop(FEATURES, "rawPrediction")


def to_score(scored: DataFrame, name: str = "score", confidence: bool = False) -> DataFrame:
    """0-100 score from the probability of class 1; optionally the winning probability."""
    probability = vector_to_array(F.col("probability"))
    columns = {name: probability.getItem(1) * SCORE_MAX}
    if confidence:
        columns["confidence"] = F.array_max(probability)
    return scored.withColumns(columns)
