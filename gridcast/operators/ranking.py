"""Exact ranks, first-n and running totals without a one-task window.

Each function takes (or makes) a *bucket* column that is monotone in the order: all rows of a lower bucket come
before all rows of a higher one. One partially aggregated count per bucket gives every bucket its offset, and
only rows inside one bucket are sorted against each other. A hash prefix makes equal-sized buckets whatever the
data holds; for measured values the bucket limits are quantiles of the values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridcast.functions.hashing import hash_bucket_of

#: Hex digits of a digest used as bucket where one bucket is sorted: 16^4, so 10^12 rows leave 15 million in it.
HASH_DIGITS = 4
#: Rows a bucket should hold where every bucket is sorted.
BUCKET_ROWS = 65_536


def digits_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits of a hash prefix that keep buckets near ``bucket_rows``; 0 puts a small table in one bucket."""
    return max(0, math.ceil(math.log(rows / bucket_rows, 16))) if rows > bucket_rows else 0


def hash_bucket(digest: Column, digits: int = HASH_DIGITS) -> Column:
    return hash_bucket_of(digest, digits)


def position(
    df: DataFrame, order: Sequence[str], bucket: Column, by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add the 1-based row number of each row in its group (or in the whole table). NULL is a group like any other."""
    by = list(by)
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket: the window behind the offsets never sees more than the number of buckets.
    offsets = running_count(counts, by).drop("_n")
    offsets = offsets.select(*[F.col(b).alias(f"_g_{b}") for b in by], F.col("_bucket").alias("_at"), "_before")
    same = F.col("_bucket") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    local = W.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        keyed.join(offsets, same)
        .withColumn(name, F.row_number().over(local) + F.col("_before"))
        .drop("_bucket", "_before", "_at", *[f"_g_{b}" for b in by])
    )


def running_count(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_before``, the rows of the group in lower buckets, to counts per (group, bucket)."""
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def cut_of(quota: Column) -> list[Column]:
    """Aggregates over running counts: the bucket in which ``quota`` rows are reached, and how many of it fit.

    ``_cut`` is NULL if all rows fit; rows of lower buckets fit whole.
    """
    reached = F.col("_before") + F.col("_n") > quota
    crossing = reached & (F.col("_before") < quota)
    return [
        F.min(F.when(reached & (F.col("_n") > 0), F.col("_bucket"))).alias("_cut"),
        F.coalesce(F.max(F.when(crossing, quota - F.col("_before"))), F.lit(0)).alias("_need"),
    ]


def take_first(
    df: DataFrame, n: int | Column, order: Sequence[str], bucket: Column, short_message: str | None = None
) -> DataFrame:
    """Exactly the first ``n`` rows of the order. With fewer rows: all of them, or a failure if a message is given.

    ``df`` is read three times (counts, whole buckets, the one bucket that is cut), so pass a scan or a stored
    table. Only the cut bucket is sorted.
    """
    keyed = df.withColumn("_bucket", bucket)
    quota = F.lit(n) if isinstance(n, int) else n
    counts = running_count(keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_quota", quota))
    cut = counts.agg(*cut_of(F.col("_quota")), F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    if short_message is not None:
        failure = F.raise_error(F.lit(short_message)).cast(cut.schema["_cut"].dataType)
        cut = cut.withColumn("_cut", F.when(F.col("_total") >= quota, F.col("_cut")).otherwise(failure))
    # One subquery for both numbers: Spark runs it once and shares it between the branches.
    found = cut.select(F.struct("_cut", "_need")).scalar()
    last, need = found.getField("_cut"), found.getField("_need")
    whole = keyed.filter(last.isNull() | (F.col("_bucket") < last))
    edge = (
        keyed.filter(F.col("_bucket") == last)
        .withColumn("_rank", F.row_number().over(W.orderBy(*order)))
        .filter(F.col("_rank") <= need)
        .drop("_rank")
    )
    return whole.unionByName(edge).drop("_bucket")


def quantile_limits(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], error: float
) -> dict[str, list[float]]:
    """Approximate quantiles of each column, found in one pass over ``df`` (runs a job).

    As bucket limits they only keep buckets even; no result depends on where exactly they fall.
    """
    found = df.approxQuantile(list(columns), list(probabilities), error)
    return {c: sorted(set(inner)) for c, inner in zip(columns, found)}


def value_parts(df: DataFrame) -> int:
    """Ranges of a value that are ranked independently: as many as the session shuffles into, 16 at least."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def value_bucket(value: Column, limits: Column) -> Column:
    """Number of limits (an array) at or below the value: a bucket that rises with the value."""
    return F.size(F.filter(limits, lambda limit: limit <= value))


def running_totals(
    table: DataFrame, by: Sequence[str], bucket: str, order: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Add ``cum_<s>`` (running total in order) and ``all_<s>`` (group total) for each summed column.

    ``table`` holds one row per (group, value); ``bucket`` is monotone in ``order``.
    """
    by = list(by)

    def along(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    totals = table.groupBy(*by, bucket).agg(*[F.sum(s).alias(f"_b_{s}") for s in sums])
    before = W.partitionBy(*by).orderBy(along(bucket)).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        bucket,
        *[F.coalesce(F.sum(f"_b_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(W.partitionBy(*by)).alias(f"all_{s}") for s in sums],
    )
    local = W.partitionBy(*by, bucket).orderBy(along(order)).rowsBetween(W.unboundedPreceding, 0)
    return (
        table.join(offsets, [*by, bucket])
        .select(
            "*",
            *[(F.sum(s).over(local) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        )
        .drop(*[f"_o_{s}" for s in sums])
    )
