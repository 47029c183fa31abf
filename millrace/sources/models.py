"""Model store: fitted Spark ML pipelines on a path."""

from __future__ import annotations

from pyspark.ml import PipelineModel

from millrace.sources.readers import SourceError


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as error:  # the JVM reports a missing path in several ways
        raise SourceError(f"cannot load the model at {path}: {error}") from error
