"""Scoring of feature files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridcast.plans.scoring import Scorer, score_rows


def score_arrivals(
    spark: SparkSession, source: str, schema: T.StructType | str, features: Sequence[str], scorer: Scorer, output: str, checkpoint: str,
    threshold: float = 0.5, fmt: str = "parquet", files_at_once: int | None = None,
) -> None:
    """Score all files at ``source`` that earlier calls with the same ``checkpoint`` have not, then return.

    ``schema`` states the columns, the features as text; rows are scored as ``score_rows`` does, malformed ones with an
    error text. Every micro-batch replaces the folder ``output``/batch=<number>: one that is repeated after a failure
    writes the same rows again, so no row is lost or counted twice. ``files_at_once`` bounds a micro-batch.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_at_once is not None:
        reader = reader.option("maxFilesPerTrigger", files_at_once)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    scored = score_rows(reader.load(source), features, scorer, threshold)
    query = scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def scored_arrivals(spark: SparkSession, output: str) -> DataFrame:
    """All rows scored so far, with the number of their micro-batch."""
    return spark.read.parquet(output)
