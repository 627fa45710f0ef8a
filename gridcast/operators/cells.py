"""Detections to cell-hours, and the filters in front of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.coerce import confidence_score
from gridcast.functions.grid import cell_degrees, cell_index, hour_of
from gridcast.schemas import CELL_HOUR

# fixed values: study area, inclusive
SOUTH, NORTH, WEST, EAST = 6.0, 37.0, 68.0, 98.0


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows in which none of ``columns`` is NULL or NaN."""
    return df.dropna(subset=list(columns))


def bbox_filter(
    df: DataFrame, south: float = SOUTH, north: float = NORTH, west: float = WEST, east: float = EAST
) -> DataFrame:
    """Plain range predicates on the coordinates, so a parquet scan can skip row groups."""
    return df.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def locate(df: DataFrame) -> DataFrame:
    """Add cell indices, hour and confidence score to typed detections."""
    return df.select(
        "*",
        cell_index(F.col("latitude")).alias("cell_y"),
        cell_index(F.col("longitude")).alias("cell_x"),
        hour_of(F.col("acq_time")).alias("hour"),
        confidence_score(F.col("confidence")).alias("confidence_score"),
    )


def fire_cells(located: DataFrame) -> DataFrame:
    """One row per cell, day and hour. Count, mean and max combine before the shuffle, so a hot cell is cheap."""
    return (
        located.groupBy(*CELL_HOUR)
        .agg(
            F.count(F.lit(1)).alias("fire_detections"),
            F.avg("confidence_score").alias("mean_confidence"),
            F.max("frp").alias("max_frp"),
        )
        .select(
            "*",
            F.lit(1).alias("fire"),
            F.year("acq_date").alias("year"),
            F.month("acq_date").alias("month"),
        )
    )


def with_degrees(cells: DataFrame) -> DataFrame:
    """Display coordinates next to the integer keys."""
    return cells.select(
        cell_degrees(F.col("cell_y")).alias("grid_lat"), cell_degrees(F.col("cell_x")).alias("grid_lon"), "*"
    )


def with_indices(df: DataFrame) -> DataFrame:
    """Integer keys for a table that only has display coordinates."""
    if {"cell_y", "cell_x"} <= set(df.columns):
        return df
    return df.withColumns({"cell_y": cell_index(F.col("grid_lat")), "cell_x": cell_index(F.col("grid_lon"))})
