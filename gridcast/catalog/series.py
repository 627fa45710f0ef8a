"""Hourly and daily weather queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.catalog.views import Query, Views, oracle, rounded, rounds
from gridcast.functions.calendar import hour_start
from gridcast.functions.rates import MAGNUS_A, MAGNUS_B
from gridcast.operators import weather
from gridcast.schemas import DAILY_FEATURES, INSTANT, n_day_features

DAILY_VALUES = ("temp", "rh", "wind", "pressure", "soil", "rain")


def dense(v: Views):
    return weather.densify_hours(v.hourly())


def _targets(v: Views):
    """Seven hours after each event, at the event's cell."""
    events = v.table("events")
    hour = hour_start(F.col("ts")) + F.expr("interval 7 hours")
    return events.select("event_id", (F.col("user_id") % 50).cast("int").alias("cell"), hour.alias("hour_ts"))


def _daily(v: Views):
    return weather.daily_rollup(v.hourly())


def _components(v: Views):
    angle = F.radians("wind_direction_10m")
    return v.hourly().groupBy("cell", F.to_date("hour_ts").alias("day")).agg(
        F.avg("temperature_2m").alias("temperature"),
        F.avg("dew_point_2m").alias("dew_point"),
        F.avg(F.col("wind_speed_10m") * F.sin(angle)).alias("u"),
        F.avg(F.col("wind_speed_10m") * F.cos(angle)).alias("v"),
        F.avg("surface_pressure").alias("pressure"),
        F.avg("soil_moisture_0_to_7cm").alias("soil"),
        F.max(F.when(F.hour("hour_ts") == 0, F.col("precipitation"))).alias("rain_at_00"),
    )


#: The series with a fill value (the one usual in climate files) at one hour of every ten days
SPIKED = """
select cell, hour_ts, case when (cell * 7 + datediff('day', date '2024-01-01', cast(hour_ts as date)) * 24 + hour(hour_ts)) % 240 = 5
                           then cast(9.96921e36 as double) else precipitation end as precipitation
from {source}
"""
#: Sums that hold a fill value are missing, all others must be as if it had never been.
RECOVERED = "case when {0} < 1e30 then round({0} + 1.1e-10, 6) end"
RAIN = ("rain_24h", "rain_72h", "rain_168h")


def _after_spikes(v: Views):
    spiked = v.spark.sql(SPIKED.format(source="{dense}").replace("datediff('day', date '2024-01-01', cast(hour_ts as date))", "datediff(cast(hour_ts as date), date '2024-01-01')"), dense=dense(v))
    found = weather.trailing_rain(spiked)
    return found.select("cell", "hour_ts", *[F.expr(RECOVERED.format(c)).alias(c) for c in RAIN])


FEATURE_NAMES = ("rain_24h", "rain_72h", "rain_168h", "avg_temp_24h", "avg_humidity_24h", "max_wind_24h")

DENSE_DAYS = """
select g.cell, g.day, d.* exclude (cell, day)
from (select cell, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day
      from daily group by cell) g
left join daily d on d.cell = g.cell and d.day = g.day
"""


def _n_day(n: int) -> str:
    functions = {"mean": "avg", "max": "max", "min": "min", "total": "sum"}
    out = []
    for name in n_day_features(n):
        variable, _, stat = name.split("_")
        value = f"{functions[stat]}({variable}) over (w rows between {n - 1} preceding and current row)"
        out.append(f"{value} as {name}")
    return ", ".join(out)


WINDOWED = f"""
select cell, day, {", ".join(f"{v} as {v}_1d" for v in DAILY_VALUES)}, {_n_day(3)}, {_n_day(7)}
from dense_days window w as (partition by cell order by day)
"""

COMPONENTS = """
select cell, hour_ts::date as day, avg(temperature_2m) as temperature, avg(dew_point_2m) as dew_point,
       avg(wind_speed_10m * sin(radians(wind_direction_10m))) as u, avg(wind_speed_10m * cos(radians(wind_direction_10m))) as v,
       avg(surface_pressure) as pressure, avg(soil_moisture_0_to_7cm) as soil,
       max(precipitation) filter (hour(hour_ts) = 0) as rain_at_00
from hourly group by all
"""

INPUTS = f"""
select cell, day, temperature as temp,
       100.0::double * exp(({MAGNUS_A}::double * dew_point) / ({MAGNUS_B}::double + dew_point)
                           - ({MAGNUS_A}::double * temperature) / ({MAGNUS_B}::double + temperature)) as rh,
       sqrt(u * u + v * v) as wind, pressure, soil,
       case when lead(day) over w = day + 1 then lead(rain_at_00) over w end as rain
from components window w as (partition by cell order by day)
"""

QUERIES = {
    "densify_hours": Query(dense, oracle("select * from dense", "dense")),
    "rain_24_72_168h": Query(
        lambda v: rounded(weather.trailing_rain(dense(v)), "rain_24h", "rain_72h", "rain_168h"),
        oracle(f"select cell, hour_ts, {rounds('rain_24h', 'rain_72h', 'rain_168h')} from features", "features"),
    ),
    "avg_24h": Query(
        lambda v: rounded(weather.trailing_means(dense(v)), "avg_temp_24h", "avg_humidity_24h"),
        oracle(f"select cell, hour_ts, {rounds('avg_temp_24h', 'avg_humidity_24h')} from features", "features"),
    ),
    "max_wind_24h": Query(
        lambda v: weather.trailing_max_wind(dense(v)),
        oracle("select cell, hour_ts, max_wind_24h from features", "features"),
    ),
    "weather_features": Query(
        lambda v: rounded(weather.weather_features(dense(v)), *FEATURE_NAMES),
        oracle(f"select * replace ({rounds(*FEATURE_NAMES)}) from features", "features"),
    ),
    "weather_features_chunked": Query(
        lambda v: rounded(weather.weather_features(weather.densify_hours(v.hourly(), chunk=96), chunk=96), *FEATURE_NAMES),
        oracle(f"select * replace ({rounds(*FEATURE_NAMES)}) from features", "features"),
    ),
    "rain_after_spikes": Query(
        _after_spikes,
        oracle(
            f"select cell, hour_ts, {', '.join(f'{RECOVERED.format(c)} as {c}' for c in RAIN)} from summed",
            "dense",
            spiked=SPIKED.format(source="dense"),
            summed=f"""select *, {', '.join(f"sum(precipitation) over (w rows between {h - 1} preceding and current row) as rain_{h}h" for h in (24, 72, 168))}
                       from spiked window w as (partition by cell order by hour_ts)""",
        ),
    ),
    "weather_at": Query(
        lambda v: weather.weather_at(v.hourly(), _targets(v)),
        oracle(
            f"""select t.event_id, h.* from
                (select event_id, (user_id % 50)::int as cell, date_trunc('hour', ts) + interval 7 hours as hour_ts from events) t
                join hourly h using (cell, hour_ts)""",
            "hourly",
        ),
    ),
    "daily_rollup": Query(
        lambda v: rounded(_daily(v), *DAILY_VALUES),
        oracle(f"select cell, day, {rounds(*DAILY_VALUES)} from daily", "daily"),
    ),
    "daily_features": Query(
        lambda v: rounded(weather.daily_features(weather.densify_days(_daily(v))), *DAILY_FEATURES),
        oracle(f"select cell, day, {rounds(*DAILY_FEATURES)} from windowed", "daily", dense_days=DENSE_DAYS, windowed=WINDOWED),
    ),
    "daily_inputs": Query(
        lambda v: rounded(weather.daily_inputs(_components(v)), *DAILY_VALUES),
        oracle(
            f"select cell, day, {rounds(*DAILY_VALUES)} from inputs",
            "hourly",
            components=COMPONENTS,
            inputs=INPUTS,
        ),
    ),
}
