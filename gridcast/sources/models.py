"""Fitted models."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def model_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(f"{path.rstrip('/')}/metadata").limit(1)
    except PySparkException:
        return False
    return True


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not model_exists(spark, path):
        raise FileNotFoundError(f"No fitted model at {path}: fit and save one first")
    return PipelineModel.load(path)
