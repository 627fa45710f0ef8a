"""Temporal, spatial-block and membership splits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridcast.functions.grid import block_key
from gridcast.functions.hashing import key_hash


@dataclass(frozen=True)
class Years:
    """Train up to ``train_last``, validate on the years after it up to ``validation_last``, test later ones."""

    train_last: int
    validation_last: int
    test_last: int | None = None


# fixed values: the two published protocols
EXPERIMENT = Years(train_last=2023, validation_last=2024, test_last=2025)
FINAL = Years(train_last=2022, validation_last=2023)


def temporal_split(df: DataFrame, years: Years = EXPERIMENT, year: str = "year", name: str = "split") -> DataFrame:
    """Label each row by year; rows after the last test year, or without a year, belong to no split and get NULL."""
    y = F.col(year)
    label = F.when(y <= years.train_last, "train").when(y <= years.validation_last, "validation")
    # Not ``otherwise``: a row without a year must not become a test row.
    label = label.when(y <= years.test_last if years.test_last is not None else y > years.validation_last, "test")
    return df.withColumn(name, label)


def with_block(df: DataFrame, name: str = "block") -> DataFrame:
    return df.withColumn(name, block_key(F.col("cell_y"), F.col("cell_x")))


def split_blocks(blocks: DataFrame, test_share: float = 0.2, seed: int = 42, block: str = "block") -> DataFrame:
    """Seeded choice of whole blocks: the first max(1, round(share * n)) in hash order are test.

    The globe has 90 x 180 two-degree blocks; the ranked table is no longer unless coordinates are off it.
    """
    ranked = blocks.select(block).distinct().withColumn("_hash", key_hash([block], seed))
    ranked = ranked.select(
        block,
        F.row_number().over(W.orderBy("_hash", block)).alias("_rank"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("_all"),
    )
    cut = F.greatest(F.lit(1), F.rint(F.col("_all") * F.lit(test_share)).cast("int"))
    return ranked.select(block, F.when(F.col("_rank") <= cut, "test").otherwise("train").alias("split"))


def spatial_holdout(df: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Split by block. How the block list is joined is left to the sizes measured at run time."""
    blocked = with_block(df)
    return blocked.join(split_blocks(blocked, test_share, seed), "block")


def in_blocks(df: DataFrame, blocks: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose block is (or is not) listed."""
    return df.join(blocks.select("block").distinct(), "block", "left_semi" if inside else "left_anti")


def split_parts(df: DataFrame, name: str = "split") -> Mapping[str, DataFrame]:
    return {part: df.filter(F.col(name) == part).drop(name) for part in ("train", "validation", "test")}
