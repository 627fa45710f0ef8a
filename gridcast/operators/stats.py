"""Feature statistics, class weights and summaries over repeats."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridcast.functions.coerce import missing, no_nan

#: Bits of a value that one pass of the medians looks at; a task counts in 2^16 numbers per column
DIGIT_BITS = 16


def _digits(df: DataFrame, columns: Sequence[str], digits: int, wanted: Mapping[str, Sequence[int]]) -> DataFrame:
    """column, prefix, digit, n, low, high: values counted by the digit after the first ``digits`` ones, which are a wanted prefix.

    After the first digit also the lowest and highest value counted, as bits.
    """
    names, wanted = list(columns), {c: [int(p) for p in of] for c, of in wanted.items()}
    shift = 64 - DIGIT_BITS * (digits + 1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, ends = 1 << DIGIT_BITS, np.iinfo("int64")
        found = {(c, p): [np.full(size, start, "int64") for start in (0, ends.max, ends.min)[: 3 if digits else 1]] for c in names for p in wanted[c]}
        for batch in batches:
            for i, c in enumerate(names):
                value = batch.column(i).to_numpy(zero_copy_only=False)  # NULL becomes NaN
                bits = (value[~np.isnan(value)] + 0.0).view("int64")  # one zero
                order = bits ^ ((bits >> 63) & ends.max)
                for p in wanted[c]:
                    inside = order[order >> (shift + DIGIT_BITS) == p] if digits else order
                    digit = (inside >> shift) & (size - 1) if digits else (inside >> shift) + size // 2
                    n, *least_most = found[c, p]
                    n += np.bincount(digit, minlength=size)
                    for edge, nearer in zip(least_most, (np.minimum, np.maximum)):
                        nearer.at(edge, digit, inside)
        for (c, p), (n, *least_most) in found.items():
            at = np.flatnonzero(n)
            low, high = [pa.array(edge[at]) for edge in least_most] or [pa.nulls(len(at), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([names.index(c)] * len(at), pa.int32()), pa.array([p] * len(at), pa.int64()), pa.array(at), pa.array(n[at]), low, high], names=["column", "prefix", "digit", "n", "low", "high"])

    each = df.mapInArrow(count, "column int, prefix bigint, digit bigint, n bigint, low bigint, high bigint")
    return each.groupBy("column", "prefix", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median of each column (feature, n, median); missing values, NaN among them, are skipped.

    The bits of a number, taken as digits, sort like the number. Each of four passes (jobs) at most counts the values that
    share the digits found so far by their next one, and running counts tell where the middle ranks are: no value is sorted,
    and a task hands on counts, however many rows it reads. A rank is settled once all values left at it are equal.
    """
    columns = list(columns)
    numeric = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    names = numeric.columns
    numeric = numeric.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    # For the middle ranks of a column: the digits known and the rank among values that share them; the bits once settled.
    counts: dict[int, int] = {}
    middle: dict[tuple[int, int], tuple[int, int]] = {}
    settled: dict[tuple[int, int], int] = {}
    for digits in range(64 // DIGIT_BITS):
        if digits and not middle:
            break
        wanted = {c: sorted({p for (column, _), (p, _) in middle.items() if column == i}) if digits else [0] for i, c in enumerate(names)}
        along, whole = W.partitionBy("column", "prefix").orderBy("digit"), W.partitionBy("column", "prefix")
        table = _digits(numeric, names, digits, wanted).select("*", F.sum("n").over(along).alias("upto"), F.sum("n").over(whole).alias("all"))
        if digits:
            ranks = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), F.lit(p).cast("long").alias("p"), F.lit(r).cast("long").alias("r")) for (i, k), (p, r) in middle.items()])
            own = F.filter(ranks, lambda x: (x["c"] == F.col("column")) & (x["p"] == F.col("prefix")))
            hit = table.select("*", F.inline(F.transform(own, lambda x: F.struct(x["k"].alias("k"), x["r"].alias("r")))))
        else:
            low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
            hit = table.select("*", F.posexplode(F.array(low, high)).alias("k", "r"))
        for row in hit.filter("upto - n < r and r <= upto").collect():
            at = row["column"], row["k"]
            if not digits:
                counts[row["column"]] = row["all"]
            known = (row["prefix"] << DIGIT_BITS) + row["digit"] if digits else row["digit"] - (1 << DIGIT_BITS - 1)
            middle[at] = known, row["r"] - (row["upto"] - row["n"])
            if digits and row["low"] == row["high"]:
                settled[at] = row["low"]
                del middle[at]
    value = lambda bits: struct.unpack("<d", struct.pack("<q", bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)))[0]
    rows = [(columns[i], n, (value(settled[i, 0]) + value(settled[i, 1])) / 2.0) for i, n in counts.items()]
    kinds = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("median", pa.float64())])
    found = pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in rows], kinds)
    return df.sparkSession.createDataFrame(found, "feature string, n bigint, median double")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each column, one pass."""
    columns = list(columns)
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(no_nan(F.col(c).cast("double"))).alias("mean"),
                F.stddev_pop(no_nan(F.col(c).cast("double"))).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.inline(F.array(*columns)))


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, median, mean and population std per column: one row per feature on both sides of the join."""
    return exact_medians(df, columns).join(moments(df, columns), "feature")


def fetch_stats(table: DataFrame) -> dict[str, dict[str, float]]:
    """Statistics (one row per feature) as a dict, to be built into a projection."""
    return {r["feature"]: {k: r[k] for k in r.asDict() if k != "feature"} for r in table.collect()}


def impute_median(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.select(*[F.when(missing(df, c), F.lit(medians[c])).otherwise(F.col(c)).alias(c) if c in medians else F.col(c) for c in df.columns])


def standardize(df: DataFrame, stats: dict[str, dict[str, float]]) -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""

    def scaled(c: str):
        std = stats[c]["std"]
        return ((F.col(c) - F.lit(stats[c]["mean"])) / F.lit(std if std else 1.0)).alias(c)

    return df.select(*[scaled(c) if c in stats else F.col(c) for c in df.columns])


def class_weights(df: DataFrame, label: str = "fire") -> DataFrame:
    """n / (classes * n_class) per class: one row per class."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counted.agg(F.sum("rows")).scalar()
    classes = counted.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("weight", total / (classes * F.col("rows")))


def repeat_summary(repeats: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and population standard deviation over repeats."""
    return repeats.groupBy(*by).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std"), F.count(value).alias("repeats")
    )
