"""Hourly and daily weather series: payload parsing, regular grids, trailing features and lookups.

An hourly series has one row per (cell, hour), so one cell never holds more rows than the period has hours
(8,784 a year). Windows per cell are therefore bounded whatever the share of one cell among the observations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridcast.functions.coerce import finite, no_nan, to_number, to_utc
from gridcast.functions.rates import relative_humidity, vector_speed
from gridcast.operators.dedupe import dedupe_first
from gridcast.schemas import HOURLY_PAYLOAD, INSTANT


def explode_hourly(payloads: DataFrame, keys: Sequence[str], body: str = "payload") -> DataFrame:
    """JSON payloads (one object or a list of objects) to long rows; error objects and unreadable text give none.

    ``place`` is the position in the list, which is that of the coordinate in the request (0 for a single object); an
    error object keeps its place. The i-th value of every variable belongs to the i-th time. A value that is no number
    is NULL by itself, and so is a variable that is absent or too short.
    """
    text = F.ltrim(F.col(body))
    listed = F.when(text.startswith("["), F.col(body)).otherwise(F.concat(F.lit("["), F.col(body), F.lit("]")))
    parsed = payloads.select(
        *keys, F.posexplode(F.from_json(listed, F.lit(f"array<{HOURLY_PAYLOAD.simpleString()}>"))).alias("place", "_p")
    ).filter(~F.coalesce(F.col("_p.error"), F.lit(False)))
    zipped = F.arrays_zip(
        F.col("_p.hourly.time").alias("time"),
        *[F.coalesce(F.col(f"_p.hourly.{v}"), F.array().cast("array<string>")).alias(v) for v in INSTANT],
    )
    rows = parsed.select(*keys, "place", F.explode(zipped).alias("_r"))
    return rows.select(
        *keys, "place", to_utc(F.col("_r.time")).alias("hour_ts"), *[to_number(F.col(f"_r.{v}")).alias(v) for v in INSTANT]
    ).filter(F.col("hour_ts").isNotNull())


#: Rows of a partial sum; longer frames are put together from partial sums side by side.
BLOCK = 24
#: A length of chunks for very long series: four weeks of hours
CHUNK = 672


def _chunk(at: str, chunk: int) -> Column:
    """Number of the chunk of ``chunk`` hours that an instant lies in."""
    return F.floor(_hour(at) / chunk).cast("long")


def _hour(at: str) -> Column:
    """Full hours since 1970."""
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at).cast("timestamp_ntz"))


def _densify(series: DataFrame, cell: str, at: str, step: Column, back: Column, chunk: int | None = None) -> DataFrame:
    """Fill gaps up to the next reading with NULL rows: one exchange by cell, no grid join.

    Of readings that repeat a time the first stays, in the order of their values; that costs no exchange or sort of its own.
    With ``chunk`` a task holds one chunk of a cell, and the gap behind a chunk's last reading ends at the first one of the
    cell's next chunk with readings, which comes from a table of one row per chunk.
    """
    values = [c for c in series.columns if c not in (cell, at)]
    keys = [cell]
    if chunk is not None:
        keys = [cell, "_k"]
        # Dealt out by chunk explicitly: rows dealt by cell alone would do for a window, and stay one task per cell.
        series = series.withColumn("_k", _chunk(at, chunk)).repartition(*keys)
    before = F.lag(at).over(W.partitionBy(*keys).orderBy(at, *values))
    series = series.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(at))).drop("_before")
    ahead = F.lead(at).over(W.partitionBy(*keys).orderBy(at))
    if chunk is not None:
        firsts = series.groupBy(*keys).agg(F.min(at).alias("_first"))
        following = firsts.select(*keys, F.lead("_first").over(W.partitionBy(cell).orderBy("_k")).alias("_next")).repartition(*keys)
        series = series.withColumn("_ahead", ahead).join(following, keys)
        ahead = F.coalesce("_ahead", "_next")
    gaps = series.withColumn("_until", F.coalesce(ahead - back, F.col(at)))
    grid = gaps.select(cell, *values, F.posexplode(F.sequence(F.col(at), F.col("_until"), step)).alias("_i", at))
    return grid.select(cell, at, *[F.when(F.col("_i") == 0, F.col(v)).alias(v) for v in values])


def densify_hours(hourly: DataFrame, cell: str = "cell", at: str = "hour_ts", chunk: int | None = None) -> DataFrame:
    """Every hour from a cell's first to its last reading, so that rows and hours mean the same in a frame.

    A task holds a cell's whole series, or with ``chunk`` (hours) one chunk of it; the rows are the same.
    """
    hour = F.expr("interval 1 hour")
    return _densify(hourly, cell, at, hour, hour, chunk)


def densify_days(daily: DataFrame, cell: str = "cell", at: str = "day") -> DataFrame:
    return _densify(daily, cell, at, F.expr("interval 1 day"), F.lit(1))


class _Trailing:
    """Sums, means and extremes over the last n rows of a regular series.

    Sums merge partial sums: the one over the last ``BLOCK`` rows, the same one ``BLOCK`` rows earlier and so on, and the
    ragged rest of the frame. Nothing is subtracted, so a value leaves no trace once it is outside the frame, and a row
    costs the same for any length. All frames and lags share one window specification: one exchange and sort.

    With ``chunk`` a task holds one chunk of a cell's hours and a halo, the hours before it that its frames (of ``reach``
    rows at most) look back on; ``select`` leaves the halo out again.
    """

    def __init__(self, df: DataFrame, cell: str, at: str, summed: Sequence[str], reach: int, chunk: int | None = None):
        self.cell, self.at, self.reach, self.chunk = cell, at, reach, chunk
        keys = [cell]
        if chunk is not None:
            keys = [cell, "_k"]
            own = _chunk(at, chunk)
            # Chunks whose first hours look back on this one; as many as the frame's length covers.
            last = F.floor((_hour(at) + (reach - 1)) / chunk).cast("long")
            df = df.select("*", own.alias("_own"), F.explode(F.sequence(own, last)).alias("_k")).repartition(*keys)
        self.order = W.partitionBy(*keys).orderBy(at)
        block = self._frame(0, BLOCK)
        self.table = df.withColumns({v: finite(F.col(v)) for v in summed}).select(
            "*",
            *[F.coalesce(F.sum(v).over(block), F.lit(0.0)).alias(f"_t_{v}") for v in summed],
            *[F.count(v).over(block).alias(f"_c_{v}") for v in summed],
        )

    def _frame(self, first: int, rows: int):
        """The rows from ``rows`` - 1 before the current one to ``first`` before it."""
        return self.order.rowsBetween(-(rows - 1), -first)

    def _merged(self, v: str, rows: int) -> tuple[Column, Column]:
        """Sum and count of the values over the last ``rows`` rows."""
        if rows > self.reach:
            raise ValueError(f"frames look back on {self.reach} rows at most")
        whole = rows // BLOCK
        total = [F.lag(f"_t_{v}", BLOCK * j, 0.0).over(self.order) if j else F.col(f"_t_{v}") for j in range(whole)]
        count = [F.lag(f"_c_{v}", BLOCK * j, 0).over(self.order) if j else F.col(f"_c_{v}") for j in range(whole)]
        if rows % BLOCK:
            rest = self._frame(BLOCK * whole, rows)
            total.append(F.coalesce(F.sum(v).over(rest), F.lit(0.0)))
            count.append(F.coalesce(F.count(v).over(rest), F.lit(0)))
        return reduce(Column.__add__, total), reduce(Column.__add__, count)

    def total(self, v: str, rows: int) -> Column:
        """NULL only if all values in the frame are missing."""
        total, present = self._merged(v, rows)
        return F.when(present > 0, total)

    def mean(self, v: str, rows: int) -> Column:
        total, present = self._merged(v, rows)
        return F.when(present > 0, total / present)

    def highest(self, v: str, rows: int) -> Column:
        return F.max(no_nan(F.col(v))).over(self._frame(0, rows))

    def select(self, *columns: str | Column) -> DataFrame:
        if self.chunk is None:
            return self.table.select(self.cell, self.at, *columns)
        return self.table.select(self.cell, self.at, *columns, "_own", "_k").filter("_own = _k").drop("_own", "_k")


def trailing_rain(hourly: DataFrame, hours: Sequence[int] = (24, 72, 168), chunk: int | None = None) -> DataFrame:
    t = _Trailing(hourly, "cell", "hour_ts", ["precipitation"], max(hours), chunk)
    return t.select(*[t.total("precipitation", h).alias(f"rain_{h}h") for h in hours])


def trailing_means(hourly: DataFrame, hours: int = 24, chunk: int | None = None) -> DataFrame:
    t = _Trailing(hourly, "cell", "hour_ts", ["temperature_2m", "relative_humidity_2m"], hours, chunk)
    return t.select(
        t.mean("temperature_2m", hours).alias(f"avg_temp_{hours}h"),
        t.mean("relative_humidity_2m", hours).alias(f"avg_humidity_{hours}h"),
    )


def trailing_max_wind(hourly: DataFrame, hours: int = 24, chunk: int | None = None) -> DataFrame:
    t = _Trailing(hourly, "cell", "hour_ts", [], hours, chunk)
    return t.select(t.highest("wind_speed_10m", hours).alias(f"max_wind_{hours}h"))


def weather_features(hourly: DataFrame, chunk: int | None = None) -> DataFrame:
    """Nine instantaneous and six trailing features for every hour of every cell.

    ``hourly`` is regular (see ``densify_hours``). Densifying and all frames run on one exchange by cell. A cell's series
    is one task, which the calendar bounds; with ``chunk`` (hours) the series of a cell is dealt out in chunks with a halo,
    for periods of many years, or for few cells on many machines. The rows are the same.
    """
    t = _Trailing(hourly, "cell", "hour_ts", ["precipitation", "temperature_2m", "relative_humidity_2m"], 168, chunk)
    return t.select(
        *INSTANT,
        *[t.total("precipitation", h).alias(f"rain_{h}h") for h in (24, 72, 168)],
        t.mean("temperature_2m", 24).alias("avg_temp_24h"),
        t.mean("relative_humidity_2m", 24).alias("avg_humidity_24h"),
        t.highest("wind_speed_10m", 24).alias("max_wind_24h"),
    )


def restrict_hourly(hourly: DataFrame, wanted: DataFrame, days_back: int = 7) -> DataFrame:
    """Only the cells and days that ``wanted`` (cell, acq_date) can look back on, before any window runs.

    Wanted days are merged into one span per cell first, so the join never multiplies a row.
    """
    spans = wanted.groupBy("cell").agg(F.min("acq_date").alias("_lo"), F.max("acq_date").alias("_hi"))
    day = F.to_date("hour_ts")
    inside = (day >= F.date_sub(F.col("_lo"), days_back)) & (day <= F.col("_hi"))
    return hourly.join(spans, "cell").filter(inside).drop("_lo", "_hi")


def weather_at(hourly: DataFrame, targets: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Reading at exactly the target hour; targets without one are dropped.

    ``order`` names the columns whose lowest value marks the reading to use where the series repeats an hour; without
    it the lowest values do. Many targets may share one hour: the series side has one row per key, so adaptive
    skew-join handling splits a hot key.
    """
    rest = [c for c in hourly.columns if c not in ("cell", "hour_ts")]
    single = dedupe_first(hourly, ["cell", "hour_ts"], order or rest)
    return targets.join(single, ["cell", "hour_ts"])


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """Hourly to daily per cell: means, and the day's rain total."""
    return hourly.groupBy("cell", F.to_date("hour_ts").alias("day")).agg(
        F.avg("temperature_2m").alias("temp"),
        F.avg("relative_humidity_2m").alias("rh"),
        F.avg("wind_speed_10m").alias("wind"),
        F.avg("surface_pressure").alias("pressure"),
        F.avg("soil_moisture_0_to_7cm").alias("soil"),
        F.sum("precipitation").alias("rain"),
    )


def daily_inputs(components: DataFrame) -> DataFrame:
    """Daily component product to the six daily variables.

    ``components``: cell, day, temperature, dew_point (Celsius), u, v, pressure, soil, rain_at_00. The value
    stamped 00:00 holds the day before, so a day takes the stamp of the following day.
    """
    following = W.partitionBy("cell").orderBy("day")
    next_day = F.lead("day").over(following)
    return components.select(
        "cell",
        "day",
        F.col("temperature").alias("temp"),
        relative_humidity(F.col("temperature"), F.col("dew_point")).alias("rh"),
        vector_speed(F.col("u"), F.col("v")).alias("wind"),
        "pressure",
        "soil",
        F.when(next_day == F.date_add("day", 1), F.lead("rain_at_00").over(following)).alias("rain"),
    )


def daily_features(daily: DataFrame, spans: Sequence[int] = (3, 7)) -> DataFrame:
    """One-day values and N-day statistics ending on the day itself, missing values skipped.

    ``daily`` is regular (see ``densify_days``).
    """
    frames = {n: W.partitionBy("cell").orderBy("day").rowsBetween(-(n - 1), 0) for n in spans}
    recipe = (
        ("temp", "mean", F.avg),
        ("temp", "max", F.max),
        ("temp", "min", F.min),
        ("rh", "mean", F.avg),
        ("rh", "min", F.min),
        ("wind", "mean", F.avg),
        ("wind", "max", F.max),
        ("pressure", "mean", F.avg),
        ("soil", "mean", F.avg),
        ("rain", "total", F.sum),
    )
    return daily.select(
        "cell",
        "day",
        *[F.col(v).alias(f"{v}_1d") for v in ("temp", "rh", "wind", "pressure", "soil", "rain")],
        *[fn(v).over(frames[n]).alias(f"{v}_{n}d_{stat}") for n in spans for v, stat, fn in recipe],
    )
