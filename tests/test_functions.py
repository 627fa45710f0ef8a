"""Column functions on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridcast.functions import calendar, coerce, grid, rates


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "degrees, index",
    [(20.25, 202), (20.35, 204), (20.45, 204), (20.05, 200), (8.15, 82), (-0.25, -2), (6.05, 60), (68.75, 688), (0.35, 3)],
)
def test_cell_index_rounds_half_to_even(spark, degrees, index):
    assert one(spark, degrees, grid.cell_index, "double") == index


@pytest.mark.parametrize("hhmm, hour", [(0, 0), (59, 0), (130, 1), (2359, 23), (2400, 23), (-5, 0)])
def test_hour_is_clipped(spark, hhmm, hour):
    assert one(spark, hhmm, grid.hour_of, "int") == hour


@pytest.mark.parametrize(
    "text, number",
    [
        ("abc", None), ("", None), ("1d", None), ("1f", None), ("nan", None), ("inf", None), ("0x1p3", None), ("1e", None),
        (".", None), ("+-1", None), (None, None), (" 12 ", 12.0), ("\t-1.5e2\n", -150.0), (".5", 0.5), ("7.", 7.0), ("+3", 3.0),
    ],
)
def test_number_coercion(spark, text, number):
    assert one(spark, text, coerce.to_number) == number


@pytest.mark.parametrize(
    "text, day", [("2024-02-30", None), ("2024-02-29", dt.date(2024, 2, 29)), ("x", None), (" 2024-01-05 ", dt.date(2024, 1, 5))]
)
def test_day_coercion(spark, text, day):
    assert one(spark, text, coerce.to_day) == day


@pytest.mark.parametrize("text, score", [(" L", 0.25), ("n\t", 0.5), ("H", 1.0), ("x", None), ("", None), (None, None), ("85", None)])
def test_confidence(spark, text, score):
    assert one(spark, text, coerce.confidence_score) == score


def test_utc(spark):
    assert one(spark, "2024-01-05T03:15:00+05:30", coerce.to_utc) == dt.datetime(2024, 1, 4, 21, 45)
    assert one(spark, "2024-01-05T03:15", coerce.to_utc) == dt.datetime(2024, 1, 5, 3, 15)
    assert one(spark, "soon", coerce.to_utc) is None


def test_calendar(spark):
    sunday = dt.date(2024, 3, 3)
    assert one(spark, sunday, calendar.week_start, "date") == dt.date(2024, 2, 26)
    assert one(spark, sunday, calendar.days_in_month, "date") == 31
    assert one(spark, dt.date(2024, 2, 1), calendar.days_in_month, "date") == 29
    at = one(spark, sunday, lambda d: calendar.event_instant(d, F.lit(23)), "date")
    assert at == dt.datetime(2024, 3, 3, 23)


def test_ratio_and_decision(spark):
    assert one(spark, 0.0, lambda c: rates.ratio(F.lit(1.0), c), "double") == 0.0
    assert one(spark, 0.5, rates.decide, "double") == 1
    assert one(spark, 0.4999999, rates.decide, "double") == 0


def test_block_key_of_negative_cells(spark):
    assert one(spark, -1, lambda c: grid.block_key(c, F.lit(19)), "int") == "-1_0"


def test_humidity_at_dew_point_is_full(spark):
    assert one(spark, 12.0, lambda c: rates.relative_humidity(c, c), "double") == pytest.approx(100.0)


def test_point_label(spark):
    label = one(spark, 8.1, lambda c: grid.point_label(c, F.lit(77.3), F.lit("2024-01-05 06:00:00").cast("timestamp_ntz")), "double")
    assert label == "+008.10_+0077.30_2024010506"
