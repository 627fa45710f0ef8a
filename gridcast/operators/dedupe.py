"""First-wins and last-wins by key, as aggregates: duplicates shrink before the shuffle, so a hot key is cheap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row lowest in ``order`` (which should be unique within a key)."""
    return _extreme(df, keys, order, F.min_by)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row highest in ``order``."""
    return _extreme(df, keys, order, F.max_by)
