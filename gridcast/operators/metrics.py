"""Threshold, ranking and calibration metrics of a scored table, all groups (model, split, repeat) in one plan.

Rows are first counted per distinct score. Everything else runs on that table, so neither a score shared by a
third of the rows nor a single huge group reaches one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.rates import decide, f_score, ratio
from gridcast.operators.ranking import quantile_limits, running_totals, value_bucket, value_parts
from gridcast.session import snapshot


def per_score(scored: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per group and distinct score: ``n`` rows, ``tp`` of them positive."""
    return scored.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("tp")
    )


def rank_curve(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fire") -> DataFrame:
    """Per distinct score, from the highest down: ``n``, ``tp``, running totals and group totals.

    The per-score table is stored, so ``scored`` is read exactly once. A job over it finds bucket limits; they
    spread the work and do not affect the values.
    """
    return curve_of(snapshot(per_score(scored, by, score, label)), by)


def curve_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The curve (see ``rank_curve``) of a stored table of counts per group and distinct score."""
    parts = value_parts(table)
    limits = quantile_limits(table, ["score"], [i / parts for i in range(1, parts)], 1.0 / (4 * parts))["score"]
    bucketed = table.withColumn("_bucket", value_bucket(F.col("score"), F.lit(limits).cast("array<double>")))
    return running_totals(bucketed, by, "_bucket", "score", ["n", "tp"], descending=True).drop("_bucket")


def pr_curve(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fire") -> DataFrame:
    curve = rank_curve(scored, by, score, label)
    return curve.select(
        *by,
        F.col("score").alias("threshold"),
        ratio(F.col("cum_tp").cast("double"), F.col("cum_n").cast("double")).alias("precision"),
        ratio(F.col("cum_tp").cast("double"), F.col("all_tp").cast("double")).alias("recall"),
    )


def roc_curve(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fire") -> DataFrame:
    curve = rank_curve(scored, by, score, label)
    negatives = F.col("all_n") - F.col("all_tp")
    return curve.select(
        *by,
        F.col("score").alias("threshold"),
        ratio((F.col("cum_n") - F.col("cum_tp")).cast("double"), negatives.cast("double")).alias("fpr"),
        ratio(F.col("cum_tp").cast("double"), F.col("all_tp").cast("double")).alias("tpr"),
    )


def _average_precision() -> Column:
    """Step sum over distinct scores; NULL without positives."""
    step = F.sum(F.col("tp").cast("double") * F.col("cum_tp") / F.col("cum_n"))
    return F.try_divide(step, F.max("all_tp").cast("double"))


def _area_under_roc() -> Column:
    """Share of (positive, negative) pairs in the right order, ties half; NULL with one class only."""
    negatives = F.col("n") - F.col("tp")
    beaten = (F.col("cum_tp") - F.col("tp")).cast("double") + F.col("tp") / F.lit(2.0)
    pairs = F.max("all_tp").cast("double") * F.max(F.col("all_n") - F.col("all_tp"))
    return F.try_divide(F.sum(negatives * beaten), pairs)


def ranking_metrics(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fire") -> DataFrame:
    return ranking_of(rank_curve(scored, by, score, label), by)


def ranking_of(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*by).agg(
        _area_under_roc().alias("roc_auc"),
        _average_precision().alias("pr_auc"),
        F.max("all_tp").alias("positives"),
        F.max("all_n").alias("rows"),
    )


def _confusion(score: Column, n: Column, tp: Column, threshold: float) -> dict[str, Column]:
    flagged = score >= F.lit(threshold)
    zero = F.lit(0)
    return {
        "tn": F.sum(F.when(~flagged, n - tp).otherwise(zero)),
        "fp": F.sum(F.when(flagged, n - tp).otherwise(zero)),
        "fn": F.sum(F.when(~flagged, tp).otherwise(zero)),
        "tp": F.sum(F.when(flagged, tp).otherwise(zero)),
    }


def confusion_matrix(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fire", threshold: float = 0.5
) -> DataFrame:
    """Four counts with both labels always present."""
    y = F.col(label)
    p = decide(F.col(score), threshold)
    return scored.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def rates_of(counts: DataFrame, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 from the four counts; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)
    return counts.select(
        *by,
        "tn",
        "fp",
        "fn",
        "tp",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f_score(precision, recall).alias("f1"),
        *keep,
    )


def binary_metrics(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fire", threshold: float = 0.5
) -> DataFrame:
    return rates_of(confusion_matrix(scored, by, score, label, threshold), by)


def brier_score(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "fire") -> DataFrame:
    gap = F.col(score) - F.col(label)
    return scored.groupBy(*by).agg(
        F.avg(gap * gap).alias("brier"), F.avg(F.col(label).cast("double")).alias("positive_rate")
    )


def evaluate(
    scored: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    label: str = "fire",
    threshold: float = 0.5,
    digits: int | None = 5,
) -> DataFrame:
    """Every metric of every group from the per-score table: no second pass over the rows, no join."""
    curve = rank_curve(scored, by, score, label)
    p, n, tp = F.col("score"), F.col("n"), F.col("tp")
    squared = tp * (p - 1.0) * (p - 1.0) + (n - tp) * p * p
    counts = curve.groupBy(*by).agg(
        *[c.cast("long").alias(name) for name, c in _confusion(p, n, tp, threshold).items()],
        _area_under_roc().alias("roc_auc"),
        _average_precision().alias("pr_auc"),
        (F.sum(squared) / F.sum("n")).alias("brier"),
        (F.max("all_tp") / F.max("all_n")).alias("positive_rate"),
    )
    table = rates_of(counts, by, keep=["roc_auc", "pr_auc", "brier", "positive_rate"])
    if digits is None:
        return table
    rounded = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier", "positive_rate")
    return table.select(*[F.round(c, digits).alias(c) if c in rounded else F.col(c) for c in table.columns])


def classification_report(scored: DataFrame, score: str = "score", label: str = "fire", digits: int = 4) -> DataFrame:
    """Rows for class 0, class 1, accuracy, macro and weighted averages."""
    base = rates_of(confusion_matrix(scored, (), score, label))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    s0, s1 = tn + fp, fn + tp
    p0, r0 = ratio(tn, tn + fn), ratio(tn, s0)
    p1, r1 = ratio(tp, tp + fp), ratio(tp, s1)
    f0, f1 = f_score(p0, r0), f_score(p1, r1)
    both = s0 + s1

    def mean(a: Column, b: Column) -> Column:
        return (a + b) / F.lit(2.0)

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * s0 + b * s1, both)

    accuracy = F.col("accuracy")
    lines = [
        ("0", p0, r0, f0, s0),
        ("1", p1, r1, f1, s1),
        ("accuracy", accuracy, accuracy, accuracy, both),
        ("macro avg", mean(p0, p1), mean(r0, r1), mean(f0, f1), both),
        ("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), both),
    ]
    entries = [
        F.struct(
            F.lit(name).alias("class"),
            F.round(p, digits).alias("precision"),
            F.round(r, digits).alias("recall"),
            F.round(f, digits).alias("f1"),
            s.cast("long").alias("support"),
        )
        for name, p, r, f, s in lines
    ]
    return base.select(F.inline(F.array(*entries)))


def calibration_bins(
    scored: DataFrame, bins: int = 10, by: Sequence[str] = (), score: str = "score", label: str = "fire"
) -> DataFrame:
    """Observed rate against mean score in equal-width bins; a score of 1 belongs to the last bin."""
    slot = F.least(F.floor(F.col(score) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    return scored.groupBy(*by, slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )
