"""Batch scoring of raw feature rows and the prediction table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.calendar import day_label
from gridcast.functions.coerce import to_number
from gridcast.functions.grid import cell_degrees
from gridcast.functions.rates import decide, risk_label

Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: Mapping[str, float], intercept: float = 0.0, digits: int | None = None) -> Scorer:
    """Logistic score of a fixed linear form, as a projection."""

    def scorer(df: DataFrame) -> DataFrame:
        total = F.lit(intercept)
        for feature, weight in weights.items():
            total = total + F.lit(weight) * F.col(feature).cast("double")
        probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
        return df.withColumn("score", probability if digits is None else F.round(probability, digits))

    return scorer


def score_rows(raw: DataFrame, features: Sequence[str], scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """Text feature rows to probability, class, percent and label; a malformed row gets an error text instead.

    The first feature (in list order) that is absent or unreadable is the one reported.
    """
    carried = [c for c in raw.columns if c not in features]
    parsed = raw.select("*", *[to_number(F.col(f)).alias(f"_n_{f}") for f in features])
    problems = [
        F.when(F.col(f).isNull(), F.lit(f"Invalid input: '{f}' is missing")).when(
            F.col(f"_n_{f}").isNull(), F.concat(F.lit(f"Invalid input: '{f}' is not a number: "), F.col(f))
        )
        for f in features
    ]
    # Unreadable values are scored as 0 and the result is masked, so one projection serves all rows.
    typed = parsed.select(
        *carried,
        F.coalesce(*problems).alias("error"),
        *[F.coalesce(F.col(f"_n_{f}"), F.lit(0.0)).alias(f) for f in features],
    )
    valid = F.col("error").isNull()
    probability = F.when(valid, F.col("score"))
    decision = F.when(valid, decide(F.col("score"), threshold))
    return scorer(typed).select(
        *carried,
        probability.alias("probability"),
        decision.alias("prediction"),
        (probability * 100.0).alias("percent"),
        F.when(valid, risk_label(decision)).alias("label"),
        "error",
    )


def prediction_table(scored: DataFrame, label: str = "fire", threshold: float = 0.5) -> DataFrame:
    """Key, actual class, probability and predicted class."""
    return scored.select(
        cell_degrees(F.col("cell_y")).alias("grid_lat"),
        cell_degrees(F.col("cell_x")).alias("grid_lon"),
        day_label(F.col("acq_date")).alias("acq_date"),
        "hour",
        F.col(label).cast("int").alias("actual_fire"),
        F.col("score").alias("fire_probability"),
        decide(F.col("score"), threshold).alias("predicted_fire"),
    )
