"""Reproducible pseudo-random order: md5 of the row key and a seed gives the same ranks in every engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(keys: Sequence[str | Column], seed: int | str) -> Column:
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_slice(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits from position ``start`` (1-based) as a non-negative long."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def hash_bucket_of(digest: Column, digits: int) -> Column:
    """The first ``digits`` hex digits: equal-sized buckets that keep the order of the digests."""
    return F.substring(digest, 1, digits) if digits else F.lit("")
