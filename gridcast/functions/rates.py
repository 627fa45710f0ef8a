"""Ratios, thresholds and physical conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels shown to users, Magnus coefficients over water
LABEL_POSITIVE = "Fire Risk Detected"
LABEL_NEGATIVE = "Low Fire Risk"
MAGNUS_A = 17.625
MAGNUS_B = 243.04


def ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2.0 * precision * recall, precision + recall)


def decide(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= F.lit(threshold)).cast("int")


def risk_label(decision: Column) -> Column:
    return F.when(decision == 1, F.lit(LABEL_POSITIVE)).otherwise(F.lit(LABEL_NEGATIVE))


def vector_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def relative_humidity(temperature: Column, dew_point: Column) -> Column:
    """Percent, from degrees Celsius."""

    def magnus(t: Column) -> Column:
        return (F.lit(MAGNUS_A) * t) / (F.lit(MAGNUS_B) + t)

    return F.lit(100.0) * F.exp(magnus(dew_point) - magnus(temperature))
