"""Assembled datasets and the feature cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.coerce import to_day, to_number
from gridcast.functions.grid import cell_index
from gridcast.operators.checks import require_columns
from gridcast.operators.dedupe import dedupe_last
from gridcast.schemas import CELL_HOUR
from gridcast.sources.detections import read_text_csv


def parse_dataset(raw: DataFrame, numbers: Sequence[str], integers: Sequence[str] = ("hour", "year", "month", "fire")) -> DataFrame:
    """Typed dataset: ``acq_date`` as date, the named columns as doubles or ints; unreadable values are NULL."""
    require_columns(raw, ["acq_date"])
    typed = {"acq_date": to_day(F.col("acq_date"))}
    typed |= {c: to_number(F.col(c)) for c in numbers if c in raw.columns}
    typed |= {c: to_number(F.col(c)).cast("int") for c in integers if c in raw.columns}
    return raw.select(*[typed.get(c, F.col(c)).alias(c) for c in raw.columns])


def scan_dataset(spark: SparkSession, path: str, numbers: Sequence[str]) -> DataFrame:
    """Dataset from parquet (typed already) or from CSV text."""
    if path.rstrip("/").endswith(".csv"):
        return parse_dataset(read_text_csv(spark, path), numbers)
    return require_columns(spark.read.parquet(path), ["acq_date"])


def normalise_cache(rows: DataFrame, version: Sequence[str]) -> DataFrame:
    """Cache rows keyed by text or float coordinates to integer keys; the latest row of a key wins."""
    keyed = rows.select(
        *[c for c in rows.columns if c not in ("grid_lat", "grid_lon", "acq_date", "hour")],
        cell_index(F.col("grid_lat").cast("double")).alias("cell_y"),
        cell_index(F.col("grid_lon").cast("double")).alias("cell_x"),
        to_day(F.col("acq_date")).alias("acq_date"),
        F.col("hour").cast("int").alias("hour"),
    )
    return dedupe_last(keyed, CELL_HOUR, version)


def read_feature_cache(spark: SparkSession, path: str, version: Sequence[str]) -> DataFrame:
    return normalise_cache(spark.read.parquet(path), version)
