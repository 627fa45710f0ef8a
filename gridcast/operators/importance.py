"""Permutation importance: a repeat after the other, each one scoring pass over all features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridcast.functions.hashing import hash_slice, key_hash
from gridcast.operators.metrics import curve_of, per_score, ranking_metrics, ranking_of
from gridcast.operators.ranking import digits_for
from gridcast.operators.stats import repeat_summary
from gridcast.session import snapshot

Scorer = Callable[[DataFrame], DataFrame]
#: Rows of a ring's bucket at most on average: what a window holds in memory without a spillable sorter
RING_ROWS = 4096
#: Hex digits of a hash that are one positive number
HIGH_DIGITS = 15


def permute_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], repeats: int | Sequence[int], seed: int, rows: int, keep: Sequence[str] | None = None
) -> DataFrame:
    """A copy of the table per repeat (so many, or those given); ``_with`` holds the columns of another row.

    ``keep`` names the columns to carry along (all if not given). Once the hash is known the keys need not be among them.

    In each repeat all rows form one random ring, in the order of a hash, and each takes the values of its successor: a
    true permutation (every value is used once) without joining the table to itself. Hash buckets only spread the
    sort: the last row of a bucket is followed by the first of the next, one row per bucket, which is the one with the
    least ``HIGH_DIGITS`` digits of the hash. ``rows`` sizes the buckets and does not affect the result.
    """
    digits = digits_for(rows, RING_ROWS)
    numbers = range(repeats) if isinstance(repeats, int) else repeats
    copies = df.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in numbers])))
    hashed = copies.withColumn("_hash", key_hash([*keys, "repeat"], seed)).withColumn("_high", hash_slice(F.col("_hash"), 1, HIGH_DIGITS))
    # The other digits travel as bytes, which are ordered alike and half as long.
    hashed = hashed.withColumn("_rest", F.unhex(F.substring("_hash", HIGH_DIGITS + 1, 32 - HIGH_DIGITS))).drop("_hash")
    # One number for repeat and bucket: sorts then compare rows of other buckets by it alone.
    bucket = F.shiftright("_high", 4 * (HIGH_DIGITS - digits))
    hashed = hashed.withColumn("_bucket", F.col("repeat").cast("long") * F.lit(16**digits) + bucket)
    if keep is not None:
        hashed = hashed.select(*keep, *[c for c in columns if c not in keep], "repeat", "_high", "_rest", "_bucket")
    ties = [k for k in keys if k in hashed.columns]
    values = F.struct(*columns)
    # Numbers by a number: aggregated where they are, where the least of structures would sort all rows.
    firsts = hashed.groupBy("repeat", "_bucket").agg(F.struct(*[F.min_by(c, "_high").alias(c) for c in columns]).alias("_first"))
    around = W.partitionBy("repeat").orderBy("_bucket")
    whole = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = F.coalesce(F.lead("_first").over(around), F.first("_first").over(whole))
    firsts = firsts.select("_bucket", following.alias("_next"))
    ring = W.partitionBy("_bucket").orderBy("_high", "_rest", *ties)
    successor = F.coalesce(F.lead(values).over(ring), F.col("_next"))
    return hashed.join(firsts, "_bucket").withColumn("_with", successor).drop("_rest", "_high", "_bucket", "_next")


def permuted_scores(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], scorer: Scorer, label: str, repeats: int | Sequence[int], seed: int, rows: int
) -> DataFrame:
    """feature, repeat, label, score for every feature shuffled alone; all of a repeat share one permutation.

    The ring carries the features and the label. ``df`` is read twice: pass a stored table (see ``stored``).
    """
    features = list(features)
    paired = permute_rows(df, keys, features, repeats, seed, rows, keep=[label, *[f for f in features if f != label]])
    spread = paired.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features])))

    def value(f: str) -> Column:
        return F.when(F.col("_feature") == f, F.col(f"_with.{f}")).otherwise(F.col(f)).alias(f)

    swapped = spread.select(F.col("_feature"), "repeat", label, *[value(f) for f in features])
    return scorer(swapped).select(F.col("_feature").alias("feature"), "repeat", label, "score")


def shuffled_metrics(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], scorer: Scorer, label: str, repeats: int, seed: int, rows: int
) -> DataFrame:
    """feature, repeat and the ranking metrics of the scores with that feature shuffled.

    Each repeat is counted per distinct score and stored before the next one starts: what its ring shuffles is deleted by
    then, so the disk holds one ring at a time, however many repeats there are.
    """
    by = ["feature", "repeat"]
    counted = [snapshot(per_score(permuted_scores(df, keys, features, scorer, label, [i], seed, rows), by, "score", label)) for i in range(repeats)]
    return ranking_of(curve_of(snapshot(reduce(DataFrame.unionByName, counted)), by), by)


def stored(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "fire") -> DataFrame:
    """What the shuffles read, written once and dealt out evenly: hashing and scoring then use every task there is."""
    return snapshot(df.select(*dict.fromkeys([*keys, label, *features])), balanced=True)


def permutation_importance(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    scorer: Scorer,
    label: str = "fire",
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Drop in ROC-AUC per feature: mean and population std over repeats.

    ``scorer`` adds a ``score`` column to a table with the feature columns. One row count is fetched to size the
    buckets; scores are counted per distinct value before they are exchanged.
    """
    df = stored(df, keys, features, label)
    rows = df.count()
    base = ranking_metrics(scorer(df), label=label).select("roc_auc").scalar()
    shuffled = shuffled_metrics(df, keys, features, scorer, label, repeats, seed, rows)
    drops = shuffled.select("feature", "repeat", (base - F.col("roc_auc")).alias("importance"))
    return repeat_summary(drops, ["feature"], "importance")


def importance_topk(importances: DataFrame, k: int = 10, value: str = "importance_mean") -> DataFrame:
    return importances.orderBy(F.desc(value), "feature").limit(k)
