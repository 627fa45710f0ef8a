"""Column contracts: source columns, feature lists and the leakage list."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names of the detection export -------------------------------------------------
DETECTION_REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "confidence", "frp")
DETECTION_OPTIONAL = ("satellite", "instrument", "daynight", "type")

# --- fixed values: nine instantaneous weather variables and six trailing-window ones --------------------
INSTANT = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "precipitation",
    "wind_speed_10m",
    "wind_direction_10m",
    "surface_pressure",
    "cloud_cover",
    "soil_moisture_0_to_7cm",
)
HISTORY = ("rain_24h", "rain_72h", "rain_168h", "avg_temp_24h", "avg_humidity_24h", "max_wind_24h")
WEATHER_FEATURES = INSTANT + HISTORY

# --- fixed values: feature sets compared in the ablation ------------------------------------------------
ABLATION_SETS = {
    "instantaneous_only": INSTANT,
    "plus_24h": INSTANT + ("rain_24h", "avg_temp_24h", "avg_humidity_24h", "max_wind_24h"),
    "plus_24_72_168h_rain": INSTANT + ("rain_24h", "rain_72h", "rain_168h"),
    "full_multiscale": WEATHER_FEATURES,
}

CALENDAR_FEATURES = ("grid_lat", "grid_lon", "hour", "year", "month")
ONE_DAY = tuple(f"{v}_1d" for v in ("temp", "rh", "wind", "pressure", "soil", "rain"))


def n_day_features(days: int) -> tuple[str, ...]:
    """The ten N-day columns, in their published order."""
    stats = (
        ("temp", ("mean", "max", "min")),
        ("rh", ("mean", "min")),
        ("wind", ("mean", "max")),
        ("pressure", ("mean",)),
        ("soil", ("mean",)),
        ("rain", ("total",)),
    )
    return tuple(f"{var}_{days}d_{stat}" for var, names in stats for stat in names)


DAILY_FEATURES = ONE_DAY + n_day_features(3) + n_day_features(7)
FINAL_FEATURES = CALENDAR_FEATURES + DAILY_FEATURES

#: Recorded by the sensor at the event itself; never a predictor of that event.
LEAKAGE = ("fire_detections", "mean_confidence", "max_frp")

CELL_HOUR = ("cell_y", "cell_x", "acq_date", "hour")

#: One payload of an hourly series: parallel arrays under ``hourly``, or an error marker. Values are read as text, so
#: that one that is no number spoils no other.
HOURLY_PAYLOAD = T.StructType(
    [
        T.StructField("error", T.BooleanType()),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(name, T.ArrayType(T.StringType())) for name in INSTANT]
            ),
        ),
    ]
)
