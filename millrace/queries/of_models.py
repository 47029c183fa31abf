"""Model training and scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import words
from millrace.operators import model as m
from millrace.operators.columns import derive, ratio
from millrace.operators.joins import join_tables
from millrace.queries.registry import query, table
from millrace.sources.models import load_model, save_model
from millrace.sources.scratch import new_path

_FEATURES = ["n_chars", "n_words", "n_lines", "word_length"]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    counted = table(spark, folder, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words(text)).cast("double").alias("n_words"),
        F.size(F.split(text, "\n")).cast("double").alias("n_lines"),
    )
    word_length = F.coalesce(ratio("n_chars", "n_words"), F.lit(0.0))
    return derive(counted, {"word_length": word_length})


def _fitted(spark: SparkSession, folder: str, kind: str, **settings: int) -> PipelineModel:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    labelled = join_tables(_documents(spark, folder), labels, "doc_id")
    return m.train(labelled, _FEATURES, "quality", kind, **settings)


def _held() -> dict[str, Column]:
    """What a scored table must hold: score in range, agreeing with prediction and confidence."""
    half = F.col("score") / 100
    return {
        "in_range": F.col("score").between(0, 100),
        "prediction_agrees": (F.col("score") > 50) == (F.col("prediction") == 1),
        "confidence_agrees": F.abs(F.greatest(half, 1 - half) - F.col("confidence")) < 1e-9,
    }


@query(
    "train_score",
    """
    SELECT doc_id, true AS in_range, true AS prediction_agrees, true AS confidence_agrees,
           true AS score_is_formula
    FROM documents
    """,
)
def train_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every score is the logistic function of the fitted coefficients, worked out in columns."""
    model = _fitted(spark, folder, "logistic", maxIter=20)
    scored = m.to_score(m.score(_documents(spark, folder), model), confidence=True)
    fitted = model.stages[-1]
    terms = [F.col(c) * float(w) for c, w in zip(_FEATURES, fitted.coefficients, strict=True)]
    margin = sum(terms, F.lit(float(fitted.intercept)))
    formula = F.lit(100.0) / (1 + F.exp(-margin))
    same = F.abs(formula - F.col("score")) < 1e-6
    return scored.select(
        "doc_id",
        *[held.alias(n) for n, held in _held().items()],
        same.alias("score_is_formula"),
    )


@query(
    "train_boosted_trees",
    """
    SELECT doc_id, true AS in_range, true AS prediction_agrees, true AS confidence_agrees
    FROM documents
    """,
)
def train_boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    model = _fitted(spark, folder, "gbt", maxIter=5, maxDepth=3, seed=1)
    scored = m.to_score(m.score(_documents(spark, folder), model), confidence=True)
    return scored.select("doc_id", *[held.alias(n) for n, held in _held().items()])


@query(
    "score_saved_model",
    """
    SELECT doc_id, true AS in_range, true AS prediction_agrees, true AS confidence_agrees,
           true AS same_as_before_saving
    FROM documents
    """,
)
def score_saved_model(spark: SparkSession, folder: str) -> DataFrame:
    model = _fitted(spark, folder, "logistic", maxIter=20)
    path = new_path(spark, "model")
    save_model(model, path)
    documents = _documents(spark, folder)
    loaded = m.to_score(m.score(documents, load_model(path)), "score", confidence=True)
    before = m.to_score(m.score(documents, model), "before").select("doc_id", "before")
    return loaded.join(before, "doc_id").select(
        "doc_id",
        *[held.alias(n) for n, held in _held().items()],
        (F.abs(F.col("score") - F.col("before")) < 1e-9).alias("same_as_before_saving"),
    )
