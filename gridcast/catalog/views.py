"""Domain views over the given tables.

The view text is common to Spark SQL and DuckDB; Spark and oracle queries therefore start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.session import configure

DETECTIONS = """
select event_id as det_id,
       cast(4 + user_id % 37 as double) + cast(event_id % 20 as double) * cast(0.05 as double) as latitude,
       cast(66 + (user_id * 7) % 34 as double) + cast(event_id % 40 as double) * cast(0.05 as double) as longitude,
       cast(ts as date) as acq_date,
       cast(hour(ts) * 100 + minute(ts) as int) as acq_time,
       case event_type when 'click' then 'l' when 'view' then ' N ' when 'purchase' then 'H'
                       when 'signup' then 'x' end as confidence,
       case when event_id % 17 = 0 then null else value end as frp
from {events}
"""

DETECTIONS_RAW = """
select det_id,
       case when det_id % 53 = 0 then 'bad' else cast(latitude as string) end as latitude,
       cast(longitude as string) as longitude,
       case when det_id % 59 = 0 then '2024-02-30' else cast(acq_date as string) end as acq_date,
       case when det_id % 61 = 0 then '' else cast(acq_time as string) end as acq_time,
       confidence, cast(frp as string) as frp
from {detections}
"""

HOURLY = """
select cast(user_id % 50 as int) as cell,
       date_trunc('hour', ts) as hour_ts,
       round(10 + max(value) % 30, 4) as temperature_2m,
       round(20 + max(value) % 80, 4) as relative_humidity_2m,
       round(2 + min(value) % 15, 4) as dew_point_2m,
       case when min(event_id) % 5 = 0 then null else round(min(value) % 20, 4) end as precipitation,
       round(max(value) % 15, 4) as wind_speed_10m,
       cast(min(event_id) % 360 as double) as wind_direction_10m,
       cast(950 + min(event_id) % 60 as double) as surface_pressure,
       cast(max(event_id) % 101 as double) as cloud_cover,
       cast(max(event_id) % 50 as double) / cast(100 as double) as soil_moisture_0_to_7cm
from {events}
group by cast(user_id % 50 as int), date_trunc('hour', ts)
"""

OBSERVATIONS = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       cast(60 + (l_suppkey * 13) % 311 as int) as cell_y,
       cast(680 + (l_partkey * 7) % 301 as int) as cell_x,
       cast(l_shipdate + interval '24' year as date) as acq_date,
       cast(year(l_shipdate) + 24 as int) as year,
       cast(month(l_shipdate) as int) as month,
       cast((l_linenumber * 5) % 24 as int) as hour,
       10 + l_quantity / 2 as temp_1d,
       case when l_orderkey % 29 = 0 then null
            else 100 - cast(round(l_discount * 100) as double) * 6 end as rh_1d,
       l_tax * 100 as wind_1d,
       least(1.0, cast(cast(l_quantity as int) + 4 * cast(round(l_discount * 100) as int) as double) / 90) as score,
       case when cast(l_quantity as int) + 4 * cast(round(l_discount * 100) as int)
                 + (l_partkey * 7919) % 40 > 65 then 1 else 0 end as fire
from {lineitem}
"""

#: Unique over the observation rows.
OBSERVATION_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "acq_date")


class Views:
    """The views as DataFrames over the parquet tables in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def detections(self) -> DataFrame:
        return self.spark.sql(DETECTIONS, events=self.table("events"))

    def detections_raw(self) -> DataFrame:
        return self.spark.sql(DETECTIONS_RAW, detections=self.detections())

    def hourly(self) -> DataFrame:
        hourly = self.spark.sql(HOURLY, events=self.table("events"))
        return hourly.withColumn("hour_ts", F.col("hour_ts").cast("timestamp_ntz"))

    def observations(self) -> DataFrame:
        return self.spark.sql(OBSERVATIONS, lineitem=self.table("lineitem"))


# --- oracle side -------------------------------------------------------------------------------------------

BOXED = """
select *, cast(round_even(latitude / 0.1::double, 0) as int) as cell_y,
       cast(round_even(longitude / 0.1::double, 0) as int) as cell_x,
       cast(least(greatest(acq_time // 100, 0), 23) as int) as hour,
       case lower(trim(confidence)) when 'l' then 0.25::double when 'n' then 0.5::double when 'h' then 1.0::double end
         as confidence_score
from detections where latitude between 6 and 37 and longitude between 68 and 98
"""

CELLS = """
select cell_y, cell_x, acq_date, hour, count(*) as fire_detections, avg(confidence_score) as mean_confidence,
       max(frp) as max_frp, 1::int as fire, year(acq_date)::int as year, month(acq_date)::int as month
from boxed group by all
"""

DENSE = """
select g.cell, g.hour_ts, h.* exclude (cell, hour_ts)
from (select cell, unnest(generate_series(min(hour_ts), max(hour_ts), interval 1 hour)) as hour_ts
      from hourly group by cell) g
left join hourly h on h.cell = g.cell and h.hour_ts = g.hour_ts
"""

FEATURES = """
select *, sum(precipitation) over (w rows between 23 preceding and current row) as rain_24h,
       sum(precipitation) over (w rows between 71 preceding and current row) as rain_72h,
       sum(precipitation) over (w rows between 167 preceding and current row) as rain_168h,
       avg(temperature_2m) over (w rows between 23 preceding and current row) as avg_temp_24h,
       avg(relative_humidity_2m) over (w rows between 23 preceding and current row) as avg_humidity_24h,
       max(wind_speed_10m) over (w rows between 23 preceding and current row) as max_wind_24h
from dense window w as (partition by cell order by hour_ts)
"""

DAILY = """
select cell, cast(hour_ts as date) as day, avg(temperature_2m) as temp, avg(relative_humidity_2m) as rh,
       avg(wind_speed_10m) as wind, avg(surface_pressure) as pressure, avg(soil_moisture_0_to_7cm) as soil,
       sum(precipitation) as rain
from hourly group by all
"""

BLOCKED = """
select *, concat(floor(cell_y / 20)::int::varchar, '_', floor(cell_x / 20)::int::varchar) as block from observations
"""

#: Name -> (text, names it reads).
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "detections": (DETECTIONS.format(events="events"), ()),
    "detections_raw": (DETECTIONS_RAW.format(detections="detections"), ("detections",)),
    "hourly": (HOURLY.format(events="events"), ()),
    "observations": (OBSERVATIONS.format(lineitem="lineitem"), ()),
    "boxed": (BOXED, ("detections",)),
    "cells": (CELLS, ("boxed",)),
    "dense": (DENSE, ("hourly",)),
    "features": (FEATURES, ("dense",)),
    "daily": (DAILY, ("hourly",)),
    "blocked": (BLOCKED, ("observations",)),
}


def oracle(body: str, *needs: str, **extra: str) -> str:
    """``body`` behind the named views (and what they read); ``extra`` adds query-local ones, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in _CTES[name][1]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} as materialized ({_CTES[name][0]})" for name in ordered]
    parts += [f"{name} as materialized ({text})" for name, text in extra.items()]
    return f"with {', '.join(parts)} {body}"


@dataclass(frozen=True)
class Query:
    build: Callable[[Views], DataFrame]
    oracle: str | None = None


#: Added before rounding on both sides: means of two-decimal values can sit exactly between two roundings, where
#: the last bit of a sum would decide. The shift moves such values off the boundary; it is far below the digits kept.
NUDGE = 1.1e-10


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round measured columns, as the oracle does, so that summation order cannot show."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE), digits) for c in columns})


def rounds(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c} + {NUDGE}::double, {digits}) as {c}" for c in columns)
